"""Ingest: file guards, chunkers, incremental upsert and prune, markup and log sources."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import has_secret, minified

#: Extensions of texts that are read.
EXTENSIONS = "c cc cpp cs css go h hpp html java js json jsx kt lua md php pl proto py rb rs scala sh sql swift toml ts tsx txt vue xml yaml yml zig".split()
MAX_BYTES = 1 << 20


def files(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """path, length, modified and content of the texts below a folder that pass the guards."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return guarded(raw.select("path", "length", F.col("modificationTime").alias("modified"), F.col("content").cast("string").alias("content")), max_bytes)


def guarded(raw: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Drops large, binary, secret (but in tests), minified and unknown files."""
    test = F.col("path").rlike(r"(^|[/_.])tests?[/_.]")
    keep = (F.col("length") <= max_bytes) & indexable(F.col("path")) & ~binary(F.col("content")) & (test | ~has_secret(F.col("content"))) & ~minified(F.col("content"))
    return raw.where(keep)


def indexable(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)).isin(EXTENSIONS) | F.regexp_extract(path, r"([^/]+)$", 1).isin("Makefile", "Dockerfile", "README", "LICENSE")


def binary(text: Column) -> Column:
    return F.substring(text, 1, 8192).contains("\x00")


def line_windows(docs: DataFrame, size: int = 40, overlap: int = 10) -> DataFrame:
    """id, start_line, end_line and content of overlapping windows of lines; blank windows are left out and the last one
    ends with the text."""
    step = size - overlap
    d = docs.select("id", F.split("content", "\n").alias("lines"))
    n = F.size("lines")
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int"))
    d = d.select("id", "lines", F.explode(starts).alias("k"))
    begin = F.col("k") * step
    w = d.select("id", (begin + 1).alias("start_line"), F.least(begin + size, F.size("lines")).alias("end_line"), F.array_join(F.slice("lines", begin + 1, F.lit(size)), "\n").alias("content"))
    return w.where(F.trim(F.regexp_replace("content", r"\s+", " ")) != "")


def split_long(windows: DataFrame, most: int = 4096) -> DataFrame:
    """Windows of more than `most` bytes halved by lines until they fit; a longer line is cut at letters."""

    def halves(text: str, start: int) -> Iterator[tuple[int, int, str]]:
        if len(text.encode()) <= most:
            yield start, start + text.count("\n"), text
            return
        rows = text.split("\n")
        if len(rows) > 1:
            half = len(rows) // 2
            yield from halves("\n".join(rows[:half]), start)
            yield from halves("\n".join(rows[half:]), start + half)
            return
        data = text.encode()
        at = 0
        while at < len(data):
            end = min(len(data), at + most)
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1
            yield start, start, data[at:end].decode()
            at = end

    def split(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in parts:
            rows = [(r.id, a, b, c) for r in d.itertuples(index=False) for a, b, c in halves(r.content, r.start_line)]
            yield pd.DataFrame(rows, columns=["id", "start_line", "end_line", "content"])

    return windows.mapInPandas(split, "id long, start_line int, end_line int, content string")


def salted(chunks: DataFrame) -> DataFrame:
    """sha of each chunk of a path; of equal contents the second and later are salted with their place."""
    w = Window.partitionBy("path", F.sha1("content")).orderBy("start_line")
    nth = F.row_number().over(w) - 1
    c = chunks.withColumn("nth", nth)
    return c.withColumn("sha", F.when(F.col("nth") == 0, F.sha1("content")).otherwise(F.sha1(F.concat_ws("|", F.sha1("content"), F.col("nth").cast("string"))))).drop("nth")


def upsert(old: DataFrame, new: DataFrame, stamp: int) -> DataFrame:
    """The next table: rows of new replace those of old with the same path and sha; others stay. action tells inserted,
    touched (same content, seen again) and kept."""
    n = new.withColumn("seen", F.lit(stamp).cast("long"))
    o = old.select(F.col("path").alias("_path"), F.col("sha").alias("_sha")).distinct()
    on = (F.col("path") == F.col("_path")) & (F.col("sha") == F.col("_sha"))
    n = n.join(o, on, "left").withColumn("action", F.when(F.col("_sha").isNull(), "inserted").otherwise("touched")).drop("_path", "_sha")
    keys = new.select(F.col("path").alias("_path"), F.col("sha").alias("_sha")).distinct()
    kept = old.join(keys, on, "left_anti").withColumn("action", F.lit("kept"))
    return n.unionByName(kept, allowMissingColumns=True)


def pruned(table: DataFrame, cutoff: int) -> DataFrame:
    return table.where(F.col("seen") >= cutoff)


def next_stamp(table: DataFrame, now: int) -> int:
    """Later than every stamp of the table."""
    last = table.agg(F.max("seen")).first()[0]
    return max(now, (last or 0) + 1)


def hrefs(pages: DataFrame) -> DataFrame:
    """page_id and target of each link."""
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).alias("target"))


def markdown_links(docs: DataFrame) -> DataFrame:
    """id, line, kind (link, wikilink, transclusion, tag or heading) and target, lines inside fences left out."""
    d = docs.select("id", F.posexplode(F.split("content", "\n")).alias("line", "text"))
    fence = F.col("text").rlike(r"^\s*(```|~~~)").cast("int")
    d = d.withColumn("fences", F.sum(fence).over(Window.partitionBy("id").orderBy("line"))).where((F.col("fences") % 2 == 0) & (fence == 0))
    kinds = [("transclusion", r"!\[\[([^\]|#]+)"), ("wikilink", r"(?:^|[^!])\[\[([^\]|#]+)"), ("link", r"(?:^|[^!])\[[^\]]*\]\(<?([^)\s>#]+)"), ("tag", r"(?:^|\s)#([A-Za-z][\w/-]*)"), ("heading", r"^#{1,6}\s+(.+?)\s*#*\s*$")]
    out = None
    for kind, pattern in kinds:
        part = d.select("id", (F.col("line") + 1).alias("line"), F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("target"))
        out = part if out is None else out.unionByName(part)
    return out.where(~F.col("target").rlike(r"^[a-z]+://")).withColumn("target", F.trim("target"))


EVENT = T.StructType([T.StructField("ts", T.LongType()), T.StructField("event", T.StringType()), T.StructField("tool_name", T.StringType()), T.StructField("tokens", T.IntegerType()), T.StructField("paths", T.ArrayType(T.StringType())), T.StructField("intent", T.StringType()), T.StructField("query", T.StringType())])


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of tool events; malformed lines are dropped."""
    return spark.read.schema(EVENT).option("mode", "DROPMALFORMED").json(path)


def unified_diff(diffs: DataFrame) -> DataFrame:
    """id, file, start and n of each hunk of unified diffs (id, content); broken headers are passed over."""
    d = diffs.select("id", F.posexplode(F.split("content", "\n")).alias("line", "text"))
    w = Window.partitionBy("id").orderBy("line")
    d = d.withColumn("file", F.last(F.when(F.col("text").startswith("+++ "), F.regexp_extract("text", r"^\+\+\+ (?:b/)?(\S+)", 1)), ignorenulls=True).over(w))
    at = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    h = d.where(F.col("text").rlike(at) & F.col("file").isNotNull())
    n = F.regexp_extract("text", at, 2)
    return h.select("id", "file", F.regexp_extract("text", at, 1).cast("int").alias("start"), F.when(n == "", 1).otherwise(F.expr("try_cast(regexp_extract(text, '^@@ -\\\\d+(?:,\\\\d+)? \\\\+(\\\\d+)(?:,(\\\\d+))? @@', 2) AS int)")).alias("n"))


def directory_hashes(hashes: DataFrame) -> DataFrame:
    """dir and hash: of each directory the digest of its sorted child hashes (dir, sha), whatever their order."""
    return hashes.groupBy("dir").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("sha")), "\n"), 256).alias("hash"))


def _stem(path: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", ""))


def wikilink_targets(notes: DataFrame, files: DataFrame) -> DataFrame:
    """note, path and ambiguous: the only file of the note's base name, in any case; several are ambiguous."""
    f = files.select("path").distinct().groupBy(_stem(F.col("path")).alias("stem")).agg(F.min("path").alias("only"), F.count("*").alias("n"))
    j = notes.select("note").distinct().join(f, F.lower("note") == F.col("stem"), "left")
    return j.select("note", F.when(F.col("n") == 1, F.col("only")).alias("path"), (F.coalesce("n", F.lit(0)) > 1).alias("ambiguous"))


#: How the names of tests are told from those of code.
TEST_MARK = r"(_test|_spec)\.|\.(test|spec)\.|^test_"


def sibling_tests(files: DataFrame) -> DataFrame:
    """(path, test): files and the tests of the same name beside them."""
    f = files.select("path").distinct().select("path", F.regexp_replace("path", r"/[^/]*$", "").alias("dir"), F.regexp_extract("path", r"([^/]*)$", 1).alias("base"))
    stem = F.regexp_extract("base", r"^([^.]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(stem, "^test_", ""), "(_test|_spec)$", "")
    code = f.where(~F.col("base").rlike(TEST_MARK)).select("path", "dir", stem.alias("stem"))
    tests = f.where(F.col("base").rlike(TEST_MARK)).select(F.col("path").alias("test"), "dir", bare.alias("stem"))
    return code.join(tests, ["dir", "stem"]).select("path", "test")


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of JSON lines; blank and malformed ones are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def tree_hashes(files: DataFrame) -> DataFrame:
    """dir and hash of every directory, bottom up: the digest of the sorted hashes of its files (dir, sha) and of the
    directories in it. The deepest level goes first; there are as many rounds as levels."""
    level = F.size(F.split("dir", "/"))
    rows, done = files.select("dir", "sha"), None
    deepest = rows.agg(F.max(level)).first()[0] or 0
    for depth in range(deepest, 0, -1):
        here = directory_hashes(rows.where(level == depth))
        done = here if done is None else done.unionByName(here)
        up = here.where(F.lit(depth > 1)).select(F.regexp_replace("dir", "/[^/]*$", "").alias("dir"), F.col("hash").alias("sha"))
        rows = rows.where(level < depth).unionByName(up)
    return done if done is not None else rows.select("dir", F.col("sha").alias("hash"))
