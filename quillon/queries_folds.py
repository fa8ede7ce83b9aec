"""Queries of functions beyond SQL, with SQL by construction where the answer is known, and of a few more reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import model
from . import queries as base
from .functions import folds, paths, prose
from .operators import evaluation, lines, search
from .operators import symbols as sy
from .registry import query, rounded

_S = ("edges", "symbols")


@query("SELECT vec_id AS id, len(embedding) * 4 AS bytes, embedding[1] AS first FROM embeddings")
def fn16_vector_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = model.vectors(spark, sf_dir).select("id", folds.encoded_vector(F.col("embedding")).alias("data"))
    return v.select("id", F.octet_length("data").cast("long").alias("bytes"), folds.decoded_vector(F.col("data"))[0].alias("first"))


@query("""SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || ',"s":"a b"}' AS text FROM events""")
def fn32_json_minify(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.concat(F.lit('{ "k" : '), F.get_json_object("props", "$.k"), F.lit(' ,\n "s": "a b" }'))
    return model.read(spark, sf_dir, "events").select("event_id", folds.json_minified(doc).alias("text"))


@query("""SELECT event_id, '{"a":1}' || chr(10) || 'no json ' || event_id || chr(10) || '[1,2]' AS text FROM events""")
def fn33_jsonl_minify(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.concat(F.lit('{"a": 1}\nno json '), F.col("event_id").cast("string"), F.lit("\n[1, 2]"))
    return model.read(spark, sf_dir, "events").select("event_id", folds.jsonl_minified(doc).alias("text"))


@query("SELECT id, CASE WHEN id % 3 = 2 THEN NULL ELSE regexp_replace(regexp_replace(path, '/[^/]*$', ''), '/[^/]*$', '') || '/x.md' END AS target FROM paths", "paths")
def fn38_relative_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = F.when(F.col("id") % 3 == 0, "../x.md").when(F.col("id") % 3 == 1, "./a/../../x.md").otherwise("../../../../../../x.md")
    return model.paths(spark, sf_dir).select("id", folds.resolved(paths.directory(F.col("path")), target).alias("target"))


@query("SELECT id, path FROM paths WHERE (regexp_matches(path, '(^|/)vendor/') OR regexp_matches(path, '(^|/)[^/]*\\.md(/|$)') OR regexp_matches(path, '^src0/docs(/|$)')) AND NOT regexp_matches(path, '(^|/)README\\.md(/|$)')", "paths")
def sc03_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = ["# comment", "vendor/", "*.md", "src0/docs", "!README.md"]
    return model.paths(spark, sf_dir).where(folds.ignored(F.col("path"), rules)).select("id", "path")


@query("SELECT id, ceil(octet_length(encode(content)) / 100000)::INTEGER AS at_least, true AS whole FROM chunks WHERE content <> ''", "chunks")
def sc12_byte_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = model.chunks(spark, sf_dir).where("content <> ''")
    w = folds.byte_windows(c, 100_000).groupBy("id").agg(F.count("*").cast("int").alias("at_least"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "content"))), lambda x: x["content"]), "").alias("t"))
    return w.join(c.select("id", "content"), "id").select("id", "at_least", (F.col("t") == F.col("content")).alias("whole"))


@query()
def fn43_fnv64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.symbols(spark, sf_dir).select("id", folds.fnv64(F.col("name")).alias("hash"))


@query()
def fn58_unified_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = model.chunks(spark, sf_dir).select("id", "content")
    return c.select("id", folds.unified_diff(F.col("content"), F.concat(F.col("content"), F.lit("\nadded"))).alias("diff"))


@query()
def wn11_sliding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.chunks(spark, sf_dir).select("id", F.sha1(folds.without_stale_lines(F.col("content"))).alias("hash"))


@query()
def wn16_debounced_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = model.tool_events(spark, sf_dir).select(F.col("path").alias("key"), "us", "event_id")
    return folds.fired(e, 86400 * 1_000_000)


@query()
def tk08_max_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy cover of the words of the 40 longest chunks of each of ten queries."""
    c = model.chunks(spark, sf_dir).select((F.col("id") % 10).alias("qid"), "id", F.size(F.split("content", "\n")).alias("cost"), search.keywords(F.col("content")).alias("words"))
    c = c.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("cost").desc(), "id"))).where("n <= 40")

    def cover(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("n")
        order = search.max_coverage([(set(w), int(k)) for w, k in zip(d.words, d.cost, strict=True)], 500)
        return pd.DataFrame({"qid": d.qid.iloc[order], "id": d.id.iloc[order], "place": range(1, len(order) + 1)})

    return c.groupBy("qid").applyInPandas(cover, "qid long, id long, place long")


@query(f"+q AS (SELECT id AS qid, replace(name, '_', ' ') AS text FROM symbols WHERE id % 20 = 0), terms AS (SELECT DISTINCT qid, term FROM (SELECT qid, {base._TOKENS_OF} AS term FROM q)), {base._LEXICAL} SELECT qid, id, round(score, 6) AS score, rank FROM lex WHERE rank <= 3", "chunks", "tokens", "postings", "edges", "symbols")
def rt28_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = model.symbols(spark, sf_dir).where("id % 20 = 0").select(F.col("id").alias("qid"), F.replace("name", F.lit("_"), F.lit(" ")).alias("text"))
    return rounded(base._lexical(spark, sf_dir, s, 3).select("qid", "id", "score", F.col("rank").cast("long").alias("rank")), "score")


@query("""+q AS (SELECT id AS qid, file, start_line + 1 AS line FROM symbols WHERE id % 20 = 0 AND regexp_matches(replace(file, '#', ''), '^[A-Za-z0-9_./-]+$')), h AS (SELECT qid, s.id, row_number() OVER (PARTITION BY qid ORDER BY end_line - start_line, s.id) AS r FROM q JOIN symbols s ON s.file = q.file AND line BETWEEN start_line AND end_line) SELECT qid, id FROM h WHERE r = 1""", *_S)
def rt33_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References as text (path:line), looked up in spans whose files have no marks that a reference can't have."""
    s = model.symbols(spark, sf_dir, False).withColumn("file", F.replace("file", F.lit("#"), F.lit("")))
    asked = s.where("id % 20 = 0").select(F.col("id").alias("qid"), prose.reference(F.concat("file", F.lit(":"), (F.col("start_line") + 1).cast("string"))).alias("r")).select("qid", F.col("r.path").alias("file"), F.col("r.line").alias("line"))
    found = sy.at_line(s.select("id", "file", "start_line", "end_line"), asked.select("file", "line").distinct()).select("file", "line", "id")
    return asked.join(found, ["file", "line"]).select("qid", "id")


@query("""+g AS (SELECT community, sum(rank) AS mass, count(*) AS members FROM symbols GROUP BY 1), d AS (SELECT community, package FROM (SELECT community, package, round(sum(rank), 9) AS w, count(*) AS n FROM symbols GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY community ORDER BY w DESC, n DESC, package) = 1)
    SELECT community, members, package, row_number() OVER (ORDER BY round(mass, 9) DESC, community) AS place FROM g JOIN d USING (community)""", *_S)  # fmt: skip
def gr27_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = model.symbols(spark, sf_dir)
    g = s.groupBy("community").agg(F.round(F.sum("rank"), 9).alias("mass"), F.count("*").alias("members")).join(sy.dominant_packages(s).select("community", "package"), "community")
    return sy.placed(g.withColumn("all", F.lit(1)), ["all"], [F.col("mass").desc(), F.col("community")]).select("community", "members", "package", "place")


@query("""+r AS (SELECT package AS qid, id, row_number() OVER (PARTITION BY package ORDER BY rank DESC, id) AS rank, ceil(length(qualified) / 3.5) + 20 AS cost FROM symbols), u AS (SELECT *, sum(cost) OVER (PARTITION BY qid ORDER BY rank) AS used FROM r) SELECT qid, id, used::BIGINT AS used FROM u WHERE used <= 150""", *_S)
def ql10_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = model.symbols(spark, sf_dir)
    ranked = s.withColumn("place", F.row_number().over(Window.partitionBy("package").orderBy(F.col("rank").desc(), "id")))
    items = ranked.select(F.col("package").alias("qid"), "id", F.col("place").alias("rank"), (prose.token_estimate(F.col("qualified")) + 20).alias("cost"))
    return lines.within_budget(items, 150).select("qid", "id", "used")


@query("""+t AS (SELECT id, file FROM symbols WHERE id % 20 = 0), c AS (SELECT dst AS id, count(DISTINCT src) AS callers FROM edges GROUP BY 1), n AS (SELECT file, count(*) AS siblings FROM symbols GROUP BY 1) SELECT id, coalesce(callers, 0) AS callers, siblings FROM t LEFT JOIN c USING (id) JOIN n USING (file)""", *_S)
def ql17_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = model.symbols(spark, sf_dir)
    c = model.edges(spark, sf_dir).groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("callers"))
    n = s.groupBy("file").agg(F.count("*").alias("siblings"))
    return s.where("id % 20 = 0").select("id", "file").join(c, "id", "left").join(n, "file").select("id", F.coalesce("callers", F.lit(0)).alias("callers"), "siblings")


@query("+c AS (SELECT commit_id, file, s_nationkey AS dir FROM commits JOIN supplier ON s_suppkey = file) SELECT commit_id AS commit, count(DISTINCT dir) AS dirs, count(*) AS files FROM c GROUP BY 1 HAVING count(DISTINCT dir) >= 2 AND count(*) <= 5", "commits")
def ev05_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = model.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file"), F.col("s_nationkey").alias("dir"))
    return evaluation.structural(model.commits(spark, sf_dir).join(s, "file"), 2, 5)


@query("SELECT o_orderpriority AS class, count(*) AS n, round(avg(o_totalprice / 1000), 4) AS mean, round(median(o_totalprice / 1000), 4) AS median, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 6) AS coverage FROM orders GROUP BY 1")
def ev21_pack_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = model.read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("class"))
    price = F.col("o_totalprice") / 1000
    r = o.agg(F.count("*").alias("n"), F.avg(price).alias("mean"), evaluation.median(price).alias("median"), F.avg(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("coverage"))
    return rounded(rounded(r, "coverage"), "mean", "median", digits=4)


_SMALL = "['a','an','the','is','are','was','were','be','been','being','have','has','had','do','does','did','will','would','could','should','may','might','shall','can','to','of','in','on','at','by','for','with','from','as','or','and','but','not','it','its','this','that','these','those','which','who','whom','what','so','if']"


@query(rf"""+l AS (SELECT id, content, generate_subscripts(l, 1) AS line, unnest(l) AS text FROM (SELECT id, content, string_split(content, chr(10)) AS l FROM chunks WHERE octet_length(encode(content)) <= 65536)), w AS (SELECT *, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM l),
    s AS (SELECT id, any_value(content) AS content, string_agg(CASE WHEN len(w) > 20 THEN array_to_string(list_filter(w, lambda x: NOT list_contains({_SMALL}, lower(x))), ' ') ELSE text END, chr(10) ORDER BY line) AS cut FROM w GROUP BY id) SELECT id, ceil(length(content) / 3.5) - ceil(length(cut) / 3.5) >= 0.03 * ceil(length(content) / 3.5) AND content <> '' AS applied FROM s""", "chunks")  # fmt: skip
def tx16_terse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = model.chunks(spark, sf_dir).where(F.octet_length("content") <= 65536)
    return c.select("id", (prose.terse(F.col("content"), 1) != F.col("content")).alias("applied"))
