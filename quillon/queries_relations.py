"""Queries of lookups, joins, aggregates, sets and orders over symbols, files and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import model
from .functions import paths
from .operators import retrieval
from .operators import symbols as sy
from .registry import query, rounded

_S, _SE = ("edges", "symbols"), ("edges", "symbols", "typed_edges")


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.symbols(spark, sf_dir)


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _symbols(spark, sf_dir).where("id % 20 = 0")


# -- predicates and lookups ---------------------------------------------------------------------------------------------


@query("""+p AS (SELECT s.name, s.id, row_number() OVER (PARTITION BY s.name ORDER BY rank DESC, in_degree DESC, file, start_line, s.id) AS place FROM symbols s WHERE name IN (SELECT name FROM symbols WHERE id % 20 = 0))
    SELECT * FROM p WHERE place <= 8""", *_S)  # fmt: skip
def pf01_exact_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sy.named(_symbols(spark, sf_dir), _wanted(spark, sf_dir)).select("name", "id", "place")


@query("""+w AS (SELECT DISTINCT name FROM symbols WHERE id % 20 = 0), a AS (SELECT name, id FROM symbols WHERE kind = 'type' AND name IN (SELECT name FROM w)),
    b AS (SELECT name, id FROM symbols WHERE kind <> 'type' AND name IN (SELECT name FROM w)) SELECT *, 'first' AS source FROM a UNION ALL SELECT *, 'second' FROM b WHERE name NOT IN (SELECT name FROM a)""", *_S)  # fmt: skip
def pf02_graph_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _symbols(spark, sf_dir)
    return sy.named_or(s.where("kind = 'type'"), s.where("kind <> 'type'"), _wanted(spark, sf_dir))


@query("SELECT DISTINCT s.id, s.file, w.name AS sym FROM symbols s JOIN symbols w ON w.id % 20 = 0 AND w.file = s.file WHERE s.name = w.name OR s.qualified ILIKE '%.' || w.name ESCAPE '$'", *_S)
def pf03_name_in_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _wanted(spark, sf_dir).select("file", F.col("name").alias("sym")).distinct()
    # LIKE's underscore stands for any character; names are compared as they are, which the SQL does as well by equal lengths.
    return sy.named_in_file(_symbols(spark, sf_dir), w).select("id", "file", "sym").distinct()


@query("SELECT id, name FROM symbols WHERE name ILIKE '%wid_et%' AND file ILIKE '%/%O%.go' AND package ILIKE 'brand#1_'", *_S)
def pf06_glob_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions.text import glob_to_like

    s = _symbols(spark, sf_dir)
    return s.where(F.col("name").ilike(glob_to_like("wid?et", substring=True)) & F.col("file").ilike(glob_to_like("*/*O*.go")) & F.col("package").ilike(glob_to_like("brand#1?"))).select("id", "name")


@query(r"SELECT id, path FROM paths WHERE regexp_matches(path, '^(?:.*/)?testdata/[^/]*/[^/]*\.(?:go|py)$') OR regexp_matches(path, '^[^/]+/src/.*$')", "paths")
def pf07_path_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    found = paths.globbed(p, "**/testdata/*/*.go") | paths.globbed(p, "**/testdata/*/*.py") | paths.globbed(p, "*/src/**")
    return model.paths(spark, sf_dir).where(found).select("id", "path")


@query("SELECT id, path FROM paths WHERE lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '\\.([^.]*)$', 1)) IN ('ts', 'tsx', 'py', 'rb')", "paths")
def pf08_language_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.paths(spark, sf_dir).where(paths.extension(F.col("path")).isin(*paths.extensions_of([" TypeScript", "python", ".rb"]))).select("id", "path")


@query("SELECT id, path FROM paths WHERE (path LIKE '%.go' OR path LIKE '%.py') AND NOT contains(path, '/docs/') ORDER BY id LIMIT 25", "paths")
def pf09_hit_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = model.paths(spark, sf_dir)
    hits = p.where(paths.extension(F.col("path")).isin(*paths.extensions_of(["go", "python"])) & ~paths.globbed(F.col("path"), "**/docs/**"))
    return hits.orderBy("id").limit(25).select("id", "path")


@query("SELECT id, path FROM paths WHERE NOT (starts_with(path, 'src0/') OR regexp_matches(path, '(^|/)[^/]*\\.md$') OR starts_with(path, (SELECT min(path) FROM paths WHERE id = 3)))", "paths")
def pf10_exclude_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = model.paths(spark, sf_dir)
    third = p.where("id = 3").agg(F.min("path").alias("path")).collect()  # one row
    return p.where(~paths.excluded(F.col("path"), ["src0/", "*.md", third[0].path or ""])).select("id", "path")


_POINTS = "points AS (SELECT DISTINCT file, start_line + 3 AS line FROM symbols WHERE id % 20 = 0)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.symbols(spark, sf_dir, False).where("id % 20 = 0").select("file", (F.col("start_line") + 3).alias("line")).distinct()


@query(f"+{_POINTS}, h AS (SELECT p.file, line, s.id, row_number() OVER (PARTITION BY p.file, line ORDER BY end_line - start_line, s.id) AS r FROM points p JOIN symbols s ON s.file = p.file AND line BETWEEN start_line AND end_line) SELECT file, line, id FROM h WHERE r = 1", *_S)
def pf11_span_at_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sy.at_line(model.symbols(spark, sf_dir, False).select("id", "file", "start_line", "end_line"), _points(spark, sf_dir)).select("file", "line", "id")


@query("""+r AS (SELECT DISTINCT file, start_line AS low, start_line + 10 AS high FROM symbols WHERE id % 20 = 0)
    SELECT r.file, low, high, s.id, row_number() OVER (PARTITION BY r.file, low, high ORDER BY end_line - start_line, start_line, s.id) AS place FROM r JOIN symbols s ON s.file = r.file AND start_line <= high AND end_line >= low AND name <> ''""", *_S)  # fmt: skip
def pf12_span_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _wanted(spark, sf_dir).select("file", F.col("start_line").alias("low"), (F.col("start_line") + 10).alias("high")).distinct()
    return sy.overlapping(_symbols(spark, sf_dir), r).select("file", "low", "high", "id", "place")


@query(f"+{_POINTS}, h AS (SELECT p.file, line, s.qualified, row_number() OVER (PARTITION BY p.file, line ORDER BY end_line - start_line, s.id) AS r FROM points p JOIN symbols s ON s.file = p.file AND s.kind <> 'file' AND line BETWEEN start_line AND end_line) SELECT file, line, qualified FROM h WHERE r = 1", *_S)
def pf13_qualified_at_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = model.symbols(spark, sf_dir, False).where("kind <> 'file'").select("id", "qualified", "file", "start_line", "end_line")
    return sy.at_line(s, _points(spark, sf_dir)).select("file", "line", "qualified")


@query("SELECT id, file FROM symbols WHERE file LIKE 'Brand#12/%' AND file NOT LIKE 'Brand#12/%/%'", *_S)
def pf14_dir_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sy.children(_symbols(spark, sf_dir), "Brand#12").select("id", "file")


@query("SELECT EXISTS (SELECT 1 FROM chunks) AS any_chunk, EXISTS (SELECT 1 FROM chunks WHERE id < 0) AS negative, (SELECT count(*) FROM chunks WHERE kind = 'window') AS windows, EXISTS (SELECT 1 FROM chunks WHERE ends_with(path, '/d7')) AS indexed", "chunks")
def pf15_existence(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return model.chunks(spark, sf_dir).agg((F.count("*") > 0).alias("any_chunk"), some(F.col("id") < 0).alias("negative"), F.count_if(F.col("kind") == "window").alias("windows"), some(F.endswith("path", F.lit("/d7"))).alias("indexed"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL AND '7' || json_extract_string(props, '$.k') LIKE '71%'")
def pf16_json_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return model.read(spark, sf_dir, "events").where(k.isNotNull() & F.concat(F.lit("7"), k).like("71%")).select("event_id", k.cast("long").alias("k"))


@query("SELECT id, path FROM paths WHERE NOT (path LIKE 'testdata/%' OR path LIKE '%/testdata/%' OR path LIKE 'vendor/%' OR path LIKE '%/vendor/%')", "paths")
def pf17_fixture_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.paths(spark, sf_dir).where(~paths.vendored(F.col("path"))).select("id", "path")


_SEGMENTS = "string_split(path, '/')"
_TEST_SQL = "(regexp_matches(path, '(_test\\.go|\\.test\\.ts|\\.test\\.tsx|\\.test\\.js|\\.test\\.jsx|\\.spec\\.ts|\\.spec\\.tsx|\\.spec\\.js|\\.spec\\.jsx|_test\\.py|_spec\\.rb|_test\\.rs)$') OR regexp_matches(path, '(^|/)test_[^/]*\\.py$'))"
_FIXTURE_SQL = f"list_has_any({_SEGMENTS}, ['testdata', '__fixtures__', 'testutil', 'mock', 'mocks', 'stub', 'stubs', 'fake', 'fakes'])"


@query(f"""+t AS (SELECT id, path, CASE WHEN regexp_matches(path, '\\.(md|rst|txt|adoc|mdx)$') THEN 'doc ' ELSE '' END || CASE WHEN regexp_matches(path, '\\.(yml|yaml|toml|sh|bash|zsh|fish)$|(^|/)(Dockerfile|Makefile|Taskfile.yml|Taskfile.yaml)$') THEN 'build ' ELSE '' END
    || CASE WHEN {_TEST_SQL} OR {_FIXTURE_SQL} THEN 'test ' ELSE '' END || CASE WHEN {_FIXTURE_SQL} THEN 'fixture ' ELSE '' END AS tags FROM paths) SELECT id, trim(tags) AS tags FROM t""", "paths")  # fmt: skip
def pf18_path_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.paths(spark, sf_dir).select("id", F.array_join(paths.tags(F.col("path")), " ").alias("tags"))


@query(f"""SELECT id, round(CASE WHEN {_TEST_SQL} OR {_FIXTURE_SQL} THEN 0.3 ELSE 1 END * CASE WHEN list_has_any({_SEGMENTS}, ['compat', 'legacy', 'deprecated']) THEN 0.3 ELSE 1 END
    * CASE WHEN list_has_any({_SEGMENTS}, ['examples', 'example', 'demo', 'docs_src', 'samples', 'tutorials', 'cookbook']) THEN 0.3 ELSE 1 END
    * CASE WHEN regexp_matches(path, '(^|/)(index\\.ts|index\\.tsx|__init__\\.py|package-info\\.java|mod\\.rs)$') THEN 0.5 ELSE 1 END * CASE WHEN path LIKE '%.d.ts' OR path LIKE '%.pyi' THEN 0.7 ELSE 1 END, 6)::DOUBLE AS penalty FROM paths""", "paths")  # fmt: skip
def pf19_path_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(model.paths(spark, sf_dir).select("id", paths.penalty(F.col("path")).alias("penalty")), "penalty")


@query("""+k AS (SELECT id, CASE WHEN id % 3 = 0 THEN kind || '_declaration' WHEN id % 3 = 1 THEN kind || ':window' ELSE 'orphan' END AS kind FROM symbols)
    SELECT id, kind, (contains(kind, 'function') OR contains(kind, 'method') OR contains(kind, 'class') OR contains(kind, 'struct') OR contains(kind, 'interface') OR contains(kind, 'type_decl') OR contains(kind, 'impl_item')) AND NOT ends_with(kind, ':window') AS definition, kind = 'orphan' OR ((contains(kind, 'function') OR contains(kind, 'method') OR contains(kind, 'class') OR contains(kind, 'struct') OR contains(kind, 'interface') OR contains(kind, 'type_decl') OR contains(kind, 'impl_item')) AND NOT ends_with(kind, ':window')) AS boosted FROM k""", *_S)  # fmt: skip
def pf20_definition_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("id") % 3 == 0, F.concat("kind", F.lit("_declaration"))).when(F.col("id") % 3 == 1, F.concat("kind", F.lit(":window"))).otherwise("orphan")
    k = _symbols(spark, sf_dir).select("id", kind.alias("kind"))
    return k.select("id", "kind", paths.definition_kind(F.col("kind")).alias("definition"), paths.boostable_kind(F.col("kind")).alias("boosted"))


@query("SELECT id, name FROM symbols WHERE substr(name, 1, 1) BETWEEN 'A' AND 'Z'", *_S)
def pf21_exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _symbols(spark, sf_dir).where(paths.exported(F.col("name"))).select("id", "name")


_L = "lines AS (SELECT id, generate_subscripts(l, 1) AS line, unnest(l) AS text FROM (SELECT id, string_split(content, chr(10)) AS l FROM chunks))"


@query(f"+{_L}, c AS (SELECT id, line, text, lag(text) OVER w AS before, lead(text) OVER w AS after FROM lines WINDOW w AS (PARTITION BY id ORDER BY line)) SELECT id, line::INTEGER AS line, text, coalesce(before, '') AS before, coalesce(after, '') AS after FROM c WHERE regexp_matches(text, '[0-9]{{4}}')", "chunks")
def pf23_grep_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import lines

    return lines.grep_context(lines.lines(model.chunks(spark, sf_dir)), r"[0-9]{4}", 1).select("id", "line", "text", F.array_join("before", "\n").alias("before"), F.array_join("after", "\n").alias("after"))


@query("""+l AS (SELECT id, string_split(content, chr(10)) AS l FROM chunks) SELECT id, array_to_string(l[1:3], chr(10)) AS head, array_to_string(l[greatest(len(l) - 1, 1):], chr(10)) AS tail, array_to_string(l[2:4], chr(10)) AS middle FROM l""", "chunks")
def pf28_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import lines

    c = F.col("content")
    return model.chunks(spark, sf_dir).select("id", lines.head(c, 3).alias("head"), lines.tail(c, 2).alias("tail"), lines.line_range(c, 2, 4).alias("middle"))


@query("""+l AS (SELECT id, string_split(content, chr(10)) AS l FROM chunks) SELECT id, least(2, len(l))::INTEGER AS first, least(5, len(l))::INTEGER AS last, array_to_string(l[least(2, len(l)):least(5, len(l))], chr(10)) AS text FROM l""", "chunks")
def pf29_lines_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import lines

    n = F.size(F.split("content", "\n"))
    first, last = F.least(F.lit(2), n), F.least(F.lit(5), n)
    return model.chunks(spark, sf_dir).select("id", first.alias("first"), last.alias("last"), lines.line_range(F.col("content"), first, last).alias("text"))


_CLAIMS = """claims AS (SELECT id AS ref, CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN 'missing/' || file ELSE file END AS file, CASE id % 3 WHEN 0 THEN 0 WHEN 1 THEN start_line + 1 ELSE 1000 END AS line, CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'nowhere' ELSE qualified END AS sym FROM symbols),
    here AS (SELECT ref, s.name, row_number() OVER (PARTITION BY ref ORDER BY end_line - start_line, s.id) AS r FROM claims c JOIN symbols s ON s.file = c.file AND c.line > 0 AND c.line BETWEEN start_line AND end_line),
    same AS (SELECT ref, min(start_line) AS found FROM claims c JOIN symbols s ON s.file = c.file AND (s.name = sym OR s.name = regexp_extract(sym, '([^.]*)$', 1) OR regexp_extract(s.name, '([^.]*)$', 1) = sym) GROUP BY ref),
    st AS (SELECT c.ref, found, CASE WHEN c.file = '' THEN 'parse_error' WHEN c.file NOT IN (SELECT file FROM symbols) THEN 'no_file' WHEN line <= 0 THEN CASE WHEN sym IS NULL OR found IS NOT NULL THEN 'ok' ELSE 'gone' END
        WHEN h.name IS NOT NULL AND (sym IS NULL OR h.name = sym OR h.name = regexp_extract(sym, '([^.]*)$', 1)) THEN 'ok' WHEN found IS NOT NULL THEN 'moved' ELSE 'gone' END AS status FROM claims c LEFT JOIN here h ON h.ref = c.ref AND h.r = 1 LEFT JOIN same ON same.ref = c.ref)"""


@query(f"+{_CLAIMS} SELECT ref, status, CASE WHEN status = 'moved' THEN found END AS found_at FROM st", *_S)
def pf30_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, i = model.symbols(spark, sf_dir, False), F.col("id")
    file = F.when(i % 5 == 0, "").when(i % 5 == 1, F.concat(F.lit("missing/"), "file")).otherwise(F.col("file"))
    line = F.when(i % 3 == 0, 0).when(i % 3 == 1, F.col("start_line") + 1).otherwise(1000)
    sym = F.when(i % 4 == 1, "nowhere").when(i % 4 > 1, F.col("qualified"))
    return sy.checked_claims(s.select(i.alias("ref"), file.alias("file"), line.alias("line"), sym.alias("sym")), s)


@query("""+p AS (SELECT a.id AS a, b.id AS b, a.qualified AS x, CASE WHEN b.id % 2 = 0 THEN b.name ELSE b.qualified END AS y FROM symbols a JOIN symbols b ON a.file = b.file AND a.id < b.id)
    SELECT a, b FROM p WHERE x = y OR x = regexp_extract(y, '([^.]*)$', 1) OR regexp_extract(x, '([^.]*)$', 1) = y""", *_S)  # fmt: skip
def pf31_symbol_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = model.symbols(spark, sf_dir, False)
    a = s.select("file", F.col("id").alias("a"), F.col("qualified").alias("x"))
    b = s.select("file", F.col("id").alias("b"), F.when(F.col("id") % 2 == 0, F.col("name")).otherwise(F.col("qualified")).alias("y"))
    return sy.matched(a, b, "file").where(F.col("a") < F.col("b")).select("a", "b")


# -- joins ----------------------------------------------------------------------------------------------------------------


@query("SELECT c.id, coalesce(max(rank), 0) AS rank, coalesce(arg_max(in_degree, (rank, in_degree)), 0) AS in_degree FROM chunks c LEFT JOIN symbols s ON s.chunk_id = c.id GROUP BY c.id", "edges", "symbols", "chunks")
def jn01_chunk_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sy.with_centrality(model.chunks(spark, sf_dir).select("id"), _symbols(spark, sf_dir))


@query("""+c AS (SELECT c.id, c.dir, coalesce(max(rank), 0) AS rank FROM chunks c LEFT JOIN symbols s ON s.chunk_id = c.id WHERE c.dir IN (SELECT dir FROM chunks WHERE id % 20 = 0) GROUP BY 1, 2)
    SELECT id, dir, round(rank, 9) AS rank FROM c ORDER BY rank DESC, id LIMIT 40""", "edges", "symbols", "chunks")  # fmt: skip
def jn02_hits_for_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = model.chunks(spark, sf_dir).select("id", "dir")
    own = c.join(c.where("id % 20 = 0").select("dir").distinct(), "dir", "left_semi")
    r = sy.with_centrality(own, _symbols(spark, sf_dir)).select("id", "dir", F.round("rank", 9).alias("rank"))
    return r.orderBy(F.col("rank").desc(), "id").limit(40)


@query("SELECT p.term, c.path, tf::DOUBLE AS tf FROM postings p JOIN chunks c USING (id) WHERE p.term IN ('the', 'and')", "chunks", "tokens", "postings")
def jn03_postings_to_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = model.chunks(spark, sf_dir)
    return model.postings(c).where("term IN ('the', 'and')").join(c.select("id", "path"), "id").select("term", "path", "tf")


@query("""+f AS (SELECT DISTINCT file FROM symbols WHERE id % 20 = 0), e AS (SELECT a.file AS a, b.file AS b FROM edges JOIN symbols a ON a.id = src JOIN symbols b ON b.id = dst WHERE a.file <> b.file),
    u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), v AS (SELECT * FROM u WHERE a IN (SELECT file FROM f)) SELECT a AS src_file, b AS dst_file, count(*) OVER (PARTITION BY a) AS out_degree FROM v""", *_S)  # fmt: skip
def jn05_file_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sy.file_edges(model.edges(spark, sf_dir), _symbols(spark, sf_dir), _wanted(spark, sf_dir).select("file"))


@query("SELECT DISTINCT b.file AS dst_file, a.file AS src_file FROM typed_edges JOIN symbols a ON a.id = src JOIN symbols b ON b.id = dst WHERE typed_edges.kind = 'calls' AND a.file <> b.file AND b.file IN (SELECT file FROM symbols WHERE id % 20 = 0)", *_SE)
def jn06_caller_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sy.caller_files(model.typed_edges(spark, sf_dir), _symbols(spark, sf_dir), _wanted(spark, sf_dir).select("file").distinct())


_COSINE = "list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))) / sqrt(list_sum(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) * x)) * list_sum(list_transform(v.embedding, lambda x: CAST(x AS DOUBLE) * x)))"


@query(f"+k AS (SELECT q.vec_id AS qid, v.vec_id AS node_id, {_COSINE} AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, node_id) AS rank FROM k QUALIFY rank <= 5) SELECT qid, node_id, file, round(score, 6) AS score FROM r JOIN symbols ON symbols.id = node_id", *_S)
def jn07_node_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = model.vectors(spark, sf_dir)
    k = retrieval.knn(v, v.where("id % 20 = 0").select(F.col("id").alias("qid"), "embedding"), 5)
    return rounded(k.join(_symbols(spark, sf_dir).select("id", "file"), "id").select("qid", F.col("id").alias("node_id"), "file", "score"), "score")


_IMPORTS = "i AS (SELECT DISTINCT a.package, b.package AS imports FROM typed_edges JOIN symbols a ON a.id = src JOIN symbols b ON b.id = dst WHERE typed_edges.kind = 'imports' AND a.package <> b.package), k AS (SELECT DISTINCT package FROM symbols WHERE package LIKE 'Brand#1%')"


def _imports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = _symbols(spark, sf_dir)
    return sy.package_imports(model.typed_edges(spark, sf_dir), s, s.where("package LIKE 'Brand#1%'"))


@query(f"+{_IMPORTS} SELECT * FROM i WHERE imports IN (SELECT package FROM k)", *_SE)
def jn08_internal_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _imports(spark, sf_dir)[0]


@query(f"+{_IMPORTS} SELECT DISTINCT imports FROM i WHERE imports NOT IN (SELECT package FROM k)", *_SE)
def jn09_external_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _imports(spark, sf_dir)[1]


@query(f"+{_IMPORTS} SELECT DISTINCT package FROM i WHERE imports IN (SELECT package FROM k) AND package NOT IN (SELECT package FROM k)", *_SE)
def jn10_used_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _symbols(spark, sf_dir)
    own = s.where("package LIKE 'Brand#1%'").select("package").distinct()
    inside, _ = sy.package_imports(model.typed_edges(spark, sf_dir), s, own)
    return inside.select("package").distinct().join(own, "package", "left_anti")


@query(f"+{_IMPORTS} SELECT DISTINCT imports FROM i WHERE package IN (SELECT package FROM symbols WHERE file LIKE 'Brand#12/%')", *_SE)
def jn11_imports_of_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _symbols(spark, sf_dir)
    every, _ = sy.package_imports(model.typed_edges(spark, sf_dir), s, s)
    return every.join(sy.children(s, "Brand#12").select("package").distinct(), "package", "left_semi").select("imports").distinct()


@query("""+n AS (SELECT path, sha1(content) AS sha FROM chunks), o AS (SELECT path, sha FROM n WHERE substr(sha, 1, 1) < '8') SELECT DISTINCT path, sha FROM n WHERE (path, sha) NOT IN (SELECT (path, sha) FROM o)""", "chunks")
def jn12_new_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = model.chunks(spark, sf_dir).select("path", F.sha1("content").alias("sha")).distinct()
    return n.join(n.where("substring(sha, 1, 1) < '8'"), ["path", "sha"], "left_anti")


_DISPATCH = "h AS (SELECT DISTINCT src AS owner, dst AS method, name FROM typed_edges JOIN symbols ON id = dst WHERE typed_edges.kind = 'has_method'), d AS (SELECT DISTINCT i.method AS interface_method, c.method AS concrete_method FROM typed_edges e JOIN h i ON i.owner = e.dst JOIN h c ON c.owner = e.src AND c.name = i.name WHERE e.kind = 'implements' AND i.method <> c.method)"


@query(f"+{_DISPATCH} SELECT * FROM d", *_SE)
def jn14_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sy.dispatch(model.typed_edges(spark, sf_dir), _symbols(spark, sf_dir))


@query(f"+{_DISPATCH} SELECT concrete_method, count(*) AS interfaces FROM d GROUP BY 1", *_SE)
def jn15_dispatch_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sy.dispatch(model.typed_edges(spark, sf_dir), _symbols(spark, sf_dir))
    return d.groupBy("concrete_method").agg(F.count("*").alias("interfaces"))


@query(f"+{_DISPATCH} SELECT interface_method, concrete_method, file FROM d JOIN symbols ON id = concrete_method", *_SE)
def jn16_concrete_implementations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _symbols(spark, sf_dir)
    d = sy.dispatch(model.typed_edges(spark, sf_dir), s)
    return d.join(s.select(F.col("id").alias("concrete_method"), "file"), "concrete_method").select("interface_method", "concrete_method", "file")


@query("SELECT x.file AS a, y.file AS b, count(*) AS commits FROM commits x JOIN commits y ON x.commit_id = y.commit_id AND x.file < y.file GROUP BY 1, 2", "commits")
def jn19_set_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = model.commits(spark, sf_dir)
    p = c.select("commit", F.col("file").alias("a")).join(c.select("commit", F.col("file").alias("b")), "commit").where("a < b")
    return p.groupBy("a", "b").agg(F.count("*").alias("commits"))


@query("""+w AS (SELECT DISTINCT CASE id % 3 WHEN 0 THEN qualified WHEN 1 THEN name ELSE 'Brand#12.' || name END AS asked FROM symbols WHERE id % 20 = 0), f AS (SELECT * FROM symbols WHERE kind IN ('function', 'method')),
    x AS (SELECT asked, id FROM w JOIN f ON asked = qualified OR asked = name), t AS (SELECT asked, id FROM w JOIN f ON package = 'Brand#12' AND asked = 'Brand#12.' || name WHERE asked NOT IN (SELECT asked FROM x)) SELECT DISTINCT * FROM x UNION SELECT * FROM t""", *_S)  # fmt: skip
def jn20_call_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    asked = F.when(i % 3 == 0, F.col("qualified")).when(i % 3 == 1, F.col("name")).otherwise(F.concat(F.lit("Brand#12."), "name"))
    return sy.call_targets(_symbols(spark, sf_dir), _wanted(spark, sf_dir).select(asked.alias("name")))


@query("""+d AS (SELECT DISTINCT path FROM paths WHERE path LIKE '%.md' OR path LIKE '%.txt'), w AS (SELECT DISTINCT CASE id % 2 WHEN 0 THEN './' || regexp_replace(path, '\\.md$', '') ELSE 'x/' || regexp_extract(path, '([^/]*)$', 1) END AS asked FROM paths WHERE id % 10 < 2),
    c AS (SELECT asked, CASE WHEN starts_with(asked, './') THEN asked[3:] ELSE asked END AS doc FROM w), x AS (SELECT asked, coalesce(a.path, b.path, m.path) AS path FROM c LEFT JOIN d a ON a.path = doc LEFT JOIN d b ON b.path = doc || '.md' LEFT JOIN d m ON m.path = doc || '.markdown'),
    s AS (SELECT lower(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '')) AS stem, min(path) AS path FROM d GROUP BY 1 HAVING count(*) = 1)
    SELECT * FROM x WHERE path IS NOT NULL UNION ALL SELECT x.asked, s.path FROM x JOIN c USING (asked) JOIN s ON s.stem = lower(regexp_replace(regexp_extract(doc, '([^/]*)$', 1), '\\.[^.]*$', '')) WHERE x.path IS NULL""", "paths")  # fmt: skip
def jn21_doc_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = model.paths(spark, sf_dir)
    docs = p.where("path LIKE '%.md' OR path LIKE '%.txt'").select("path").distinct()
    asked = F.when(F.col("id") % 2 == 0, F.concat(F.lit("./"), F.regexp_replace("path", r"\.md$", ""))).otherwise(F.concat(F.lit("x/"), paths.base(F.col("path"))))
    return sy.document_targets(docs, p.where("id % 10 < 2").select(asked.alias("doc")))


@query("""+f AS (SELECT DISTINCT path, lower(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '')) AS stem FROM paths), u AS (SELECT stem, min(path) AS path, count(*) AS n FROM f GROUP BY 1),
    w AS (SELECT DISTINCT note FROM (SELECT unnest(['main', 'README', 'types.d', 'src/none', 'app', 'notes', 'x_spec']) AS note)) SELECT note, CASE WHEN n = 1 THEN path END AS path, coalesce(n, 0) > 1 AS ambiguous FROM w LEFT JOIN u ON u.stem = lower(note)""", "paths")  # fmt: skip
def jn22_wikilinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources import ingest

    notes = spark.createDataFrame([(x,) for x in ("main", "README", "types.d", "src/none", "app", "notes", "x_spec")], "note string")
    return ingest.wikilink_targets(notes, model.paths(spark, sf_dir))


@query("""WITH a AS (SELECT o_custkey AS q, avg(o_totalprice) AS s FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey AS q, avg(o_totalprice) AS s FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
    SELECT count(*) FILTER (a.q IS NOT NULL AND b.q IS NOT NULL) AS paired, count(*) FILTER (b.q IS NULL) AS only_now, count(*) FILTER (a.q IS NULL) AS only_ref, round(avg(a.s - b.s), 4) AS mean_change FROM a FULL JOIN b ON a.q = b.q""")
def jn23_paired_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import evaluation

    o = model.read(spark, sf_dir, "orders")
    means = lambda r: o.where(F.col("o_orderkey") % 2 == r).groupBy(F.col("o_custkey").alias("query")).agg(F.avg("o_totalprice").alias("score"))
    return rounded(evaluation.paired(means(0), means(1)), "mean_change", digits=4)


@query("SELECT 0 AS turn, 'en' AS root, count(*) AS n FROM documents WHERE lang = 'en' UNION ALL SELECT 1, 'fr', count(*) FROM documents WHERE lang = 'fr' UNION ALL SELECT 2, 'xx', count(*) FROM documents WHERE lang = 'xx'")
def jn24_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans import surface

    d = model.read(spark, sf_dir, "documents")
    return surface.fan_out({r: d.where(F.col("lang") == r) for r in ("en", "fr", "xx")}, lambda x: x.agg(F.count("*").alias("n")))


# -- aggregates -----------------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS chunks, count(DISTINCT dir) AS files, count(DISTINCT sha1(content)) AS contents FROM chunks", "chunks")
def ag01_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.chunks(spark, sf_dir).agg(F.count("*").alias("chunks"), F.count_distinct("dir").alias("files"), F.count_distinct(F.sha1("content")).alias("contents"))


@query("SELECT dir, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, dir) AS place FROM chunks GROUP BY dir", "chunks")
def ag02_file_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = model.chunks(spark, sf_dir).groupBy("dir").agg(F.count("*").alias("n"))
    return sy.placed(g.withColumn("all", F.lit(1)), ["all"], [F.col("n").desc(), F.col("dir")]).drop("all")


@query("SELECT file, max(end_line) AS lines FROM symbols WHERE kind <> 'file' GROUP BY file", *_S)
def ag03_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _symbols(spark, sf_dir).where("kind <> 'file'").groupBy("file").agg(F.max("end_line").alias("lines"))


@query("SELECT file, round(sum(rank), 6) AS total FROM symbols GROUP BY file", *_S)
def ag04_file_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_symbols(spark, sf_dir).groupBy("file").agg(F.sum("rank").alias("total")), "total")


@query("SELECT CASE WHEN contains(file, '/') THEN regexp_replace(file, '/[^/]*$', '') ELSE '.' END AS dir, round(sum(rank), 6) AS total FROM (SELECT CASE WHEN id % 10 = 0 THEN name ELSE file END AS file, rank FROM symbols) GROUP BY 1", *_S)
def ag05_package_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _symbols(spark, sf_dir).withColumn("file", F.when(F.col("id") % 10 == 0, F.col("name")).otherwise(F.col("file")))
    return rounded(s.groupBy(paths.directory(F.col("file")).alias("dir")).agg(F.sum("rank").alias("total")), "total")


@query("SELECT file, count(*) AS n FROM symbols WHERE kind IN ('function', 'method', 'struct', 'type', 'interface') AND file <> '' GROUP BY file HAVING count(*) >= 3 ORDER BY n DESC, file LIMIT 20", *_S)
def ag06_god_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _symbols(spark, sf_dir).where("kind IN ('function', 'method', 'struct', 'type', 'interface') AND file <> ''")
    return s.groupBy("file").agg(F.count("*").alias("n")).where("n >= 3").orderBy(F.col("n").desc(), "file").limit(20)


_PAIRS = "pairs AS (SELECT x.file AS a, y.file AS b, count(*) / 10 AS weight FROM commits x JOIN commits y ON x.commit_id = y.commit_id AND x.file < y.file GROUP BY 1, 2)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jn19_set_overlap(spark, sf_dir).select("a", "b", (F.col("commits") / 10).alias("weight"))


@query(f"+{_PAIRS}, n AS (SELECT path, max(weight) AS weight FROM (SELECT b AS path, weight FROM pairs WHERE a % 20 = 0 AND weight >= 0.05 UNION ALL SELECT a, weight FROM pairs WHERE b % 20 = 0 AND weight >= 0.05) GROUP BY path ORDER BY round(max(weight), 9) DESC, path LIMIT 15) SELECT path, round(weight, 6) AS weight FROM n WHERE path % 20 <> 0", "commits")
def ag08_coaccess_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = model.commits(spark, sf_dir).where("file % 20 = 0").select(F.col("file").alias("path"))
    return rounded(sy.coaccess_neighbors(_pairs(spark, sf_dir), seeds, 15), "weight")


@query("SELECT path AS spec, count(*) AS n FROM tool_events WHERE path IS NOT NULL AND event = 'ask' GROUP BY path ORDER BY n DESC, spec LIMIT 30", "tool_events")
def ag09_unresolved_inbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = model.tool_events(spark, sf_dir).where("path IS NOT NULL AND event = 'ask'")
    return e.groupBy(F.col("path").alias("spec")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "spec").limit(30)


@query("""+f AS (SELECT *, lower(regexp_extract(file, '\\.([^.]*)$', 1)) AS lang FROM symbols WHERE kind IN ('function', 'method')), g AS (SELECT lang, count(*) AS n, sum(rank) AS mass, count(DISTINCT CASE WHEN community > 0 THEN community END) AS communities FROM f GROUP BY 1)
    SELECT lang, n, communities, round(n / sum(n) OVER (), 6) AS node_share, round(mass / sum(mass) OVER (), 6) AS rank_share, round((mass / sum(mass) OVER ()) / (n / sum(n) OVER ()), 6) AS skew FROM g""", *_S)  # fmt: skip
def ag15_language_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sy.language_skew(_symbols(spark, sf_dir)), "node_share", "rank_share", "skew")


@query("SELECT substr(a.package, 1, 7) AS src_project, substr(b.package, 1, 7) AS dst_project, count(DISTINCT (src, dst)) AS edges FROM typed_edges JOIN symbols a ON a.id = src JOIN symbols b ON b.id = dst WHERE substr(a.package, 1, 7) <> substr(b.package, 1, 7) GROUP BY 1, 2", *_SE)
def ag17_project_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sy.project_graph(model.typed_edges(spark, sf_dir), _symbols(spark, sf_dir), F.substring("package", 1, 7))


@query("SELECT community, count(*) AS members FROM symbols WHERE community > 0 AND kind IN ('function', 'method', 'type', 'struct') GROUP BY 1 HAVING count(*) >= 3 ORDER BY members DESC, community LIMIT 10", *_S)
def ag19_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sy.communities_report(_symbols(spark, sf_dir), 3, 10)


@query("+g AS (SELECT community, package, round(sum(rank), 9) AS weight, count(*) AS n FROM symbols GROUP BY 1, 2) SELECT community, package, round(weight, 6) AS weight, n FROM g QUALIFY row_number() OVER (PARTITION BY community ORDER BY weight DESC, n DESC, package) = 1", *_S)
def ag20_dominant_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sy.dominant_packages(_symbols(spark, sf_dir)), "weight")


@query("""WITH s AS (SELECT o_orderpriority AS intent, count(*) AS slots, count(*) FILTER (o_totalprice > 200000) AS a_only, count(*) FILTER (o_totalprice < 50000) AS b_only FROM orders GROUP BY 1)
    SELECT intent, slots, a_only, b_only, CASE WHEN a_only > b_only THEN 'a' WHEN b_only > a_only THEN 'b' ELSE 'tie' END AS verdict FROM s""")
def ag22_shadow_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import telemetry

    o = model.read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("intent"), (F.col("o_totalprice") > 200000).alias("a_only"), (F.col("o_totalprice") < 50000).alias("b_only"))
    return telemetry.shadow_report(o)


@query("SELECT event_type AS category, count(*) AS n, round(avg(value), 6) AS mean, round(avg(CASE WHEN value > 50 THEN 1 ELSE 0 END), 6) AS hit_rate FROM events GROUP BY 1")
def ag24_category_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = model.read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("category"))
    return rounded(e.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.avg(F.when(F.col("value") > 50, 1).otherwise(0)).alias("hit_rate")), "mean", "hit_rate")


@query("SELECT o_orderstatus AS grp, coalesce(round(avg(CASE WHEN o_totalprice > 30000 THEN CASE WHEN o_custkey % 3 = 0 THEN 1.0 ELSE 0.5 END END), 6), 1.0)::DOUBLE AS faithfulness, count(*) FILTER (o_totalprice > 30000) AS scored FROM orders GROUP BY 1")
def ag27_faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import evaluation

    o = model.read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("grp"), F.when(F.col("o_totalprice") > 30000, F.when(F.col("o_custkey") % 3 == 0, 1.0).otherwise(0.5)).alias("score"))
    return rounded(evaluation.mean_of_scored(o, "grp"), "faithfulness")


@query("SELECT l_returnflag AS pass, round(avg(l_discount), 6) AS mean_ratio, round(avg(CASE WHEN l_tax > 0.02 THEN 1 ELSE 0 END), 6) AS anchors_kept, bool_and(l_quantity > 0) AS round_trips, count(*) AS samples FROM lineitem GROUP BY 1")
def ag28_compression_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import evaluation

    li = model.read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("pass"), F.col("l_discount").alias("ratio"), (F.col("l_tax") > 0.02).alias("anchors"), (F.col("l_quantity") > 0).alias("round_trip"))
    return rounded(evaluation.compression_report(li), "mean_ratio", "anchors_kept")


# -- orders and sets ------------------------------------------------------------------------------------------------------


@query("SELECT id, rank FROM (SELECT id, row_number() OVER (ORDER BY length(content) DESC, id) AS rank FROM chunks) WHERE rank <= least(greatest(5 * 8, 30), 500) QUALIFY row_number() OVER (PARTITION BY id % 10 ORDER BY rank) = 1 ORDER BY rank LIMIT 8", "chunks")
def tk01_over_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = model.chunks(spark, sf_dir).select("id", F.length("content").alias("n"))
    return retrieval.over_fetched(c, [F.col("n").desc(), F.col("id")], F.col("id") % 10, 8).select("id", F.col("rank").cast("long").alias("rank"))


@query("WITH k AS (SELECT unnest(generate_series(-2, 80)) AS asked) SELECT asked, CASE WHEN asked <= 0 THEN 8 WHEN asked > 30 THEN 30 ELSE asked END AS k, CASE WHEN asked <= 0 THEN 80 WHEN asked > 30 THEN 300 ELSE greatest(50, asked * 10) END AS pool FROM k")
def tk02_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, pool = retrieval.clamped(F.col("id"), filtered=True)
    return spark.range(-2, 81).select(F.col("id").alias("asked"), k.alias("k"), pool.alias("pool"))


@query("SELECT id, row_number() OVER (ORDER BY rank DESC, in_degree DESC, file, start_line, id) AS place FROM symbols QUALIFY place <= 50", *_S)
def tk03_central_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _symbols(spark, sf_dir).orderBy(*sy.central()).limit(50)
    return sy.placed(top.withColumn("all", F.lit(1)), ["all"], sy.central()).select("id", "place")


@query("SELECT package, id, place FROM (SELECT package, id, row_number() OVER (PARTITION BY package ORDER BY rank DESC, in_degree DESC, name, id) AS place FROM symbols WHERE substr(name, 1, 1) BETWEEN 'A' AND 'Z') WHERE place <= 4", *_S)
def tk04_top_by_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _symbols(spark, sf_dir).where(paths.exported(F.col("name")))
    return sy.placed(s, ["package"], sy.central("name", "id"), 4).select("package", "id", "place")


@query("""+e AS (SELECT DISTINCT dst, src, site FROM edges WHERE dst % 20 = 0), r AS (SELECT dst, src, site, row_number() OVER (PARTITION BY dst ORDER BY rank DESC, in_degree DESC, file, start_line, id, site) AS place FROM e JOIN symbols ON id = src) SELECT * FROM r WHERE place <= 12""", *_S)
def tk05_callers_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = model.edges(spark, sf_dir).where("dst % 20 = 0").select("dst", "src", "site").distinct()
    j = e.join(_symbols(spark, sf_dir).withColumnRenamed("id", "src"), "src")
    return sy.placed(j, ["dst"], sy.central("file", "start_line", "src", "site"), 12).select("dst", "src", "site", "place")


@query("""+h AS (SELECT id, path, (length(content) % 100) / 100.0 AS score, end_line, id % 3 = 0 AS crossed, regexp_matches(path, '/d[0-9]*[05]$') AS test FROM chunks),
    p AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, id) AS nth FROM h), o AS (SELECT id, row_number() OVER (ORDER BY CASE WHEN crossed THEN 0 ELSE 1 END, CASE WHEN test THEN 1 ELSE 0 END, CAST(floor(score * 20) AS INTEGER) DESC, end_line DESC, score DESC, id) AS place FROM p WHERE nth = 1) SELECT * FROM o WHERE place <= 20""", "chunks")  # fmt: skip
def tk06_suggested_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = model.chunks(spark, sf_dir)
    h = c.select("id", "path", ((F.length("content") % 100) / 100).alias("score"), F.col("end_line").alias("rank"), (F.col("id") % 3 == 0).alias("crossed"), F.col("path").rlike("/d[0-9]*[05]$").alias("test"))
    return retrieval.suggested_reads(h, 20).select("id", F.col("place").cast("long").alias("place"))


@query("""+r AS (SELECT community, name, id, row_number() OVER (PARTITION BY community ORDER BY length(name) <= 2 OR lower(name) IN ('init', 'main', 'new', 'run'), rank DESC, id) AS place FROM symbols) SELECT community, name, place FROM r WHERE place <= 3""", *_S)
def tk07_top_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sy.top_names(_symbols(spark, sf_dir), 3).select("community", "name", "place")


@query("SELECT file, row_number() OVER (ORDER BY max(rank) DESC, sum(in_degree) DESC, file) AS place FROM symbols GROUP BY file", *_S)
def tk09_doc_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _symbols(spark, sf_dir).groupBy("file").agg(F.max("rank").alias("rank"), F.sum("in_degree").alias("in_degree"))
    return sy.placed(g.withColumn("all", F.lit(1)), ["all"], sy.central("file")).select("file", "place")


@query("SELECT community, members, row_number() OVER (ORDER BY members DESC, first) AS place FROM (SELECT community, count(*) AS members, min(id) AS first FROM symbols GROUP BY 1)", *_S)
def tk11_size_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _symbols(spark, sf_dir).groupBy("community").agg(F.count("*").alias("members"), F.min("id").alias("first"))
    return sy.placed(g.withColumn("all", F.lit(1)), ["all"], [F.col("members").desc(), F.col("first")]).select("community", "members", "place")


@query("""+n AS (SELECT b.file, max(b.rank) AS rank FROM (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges) e JOIN symbols a ON a.id = e.src JOIN symbols b ON b.id = e.dst WHERE a.id % 20 = 0 GROUP BY 1 ORDER BY rank DESC, file LIMIT 30)
    SELECT file, round(rank, 9) AS rank FROM n WHERE file NOT IN (SELECT file FROM symbols WHERE id % 20 = 0)""", *_S)  # fmt: skip
def st01_neighbor_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, e = _symbols(spark, sf_dir), model.edges(spark, sf_dir)
    both = e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seeds = s.where("id % 20 = 0")
    n = both.join(seeds.select(F.col("id").alias("src")), "src", "left_semi").join(s.select(F.col("id").alias("dst"), "file", "rank"), "dst")
    top = n.groupBy("file").agg(F.max("rank").alias("rank")).orderBy(F.col("rank").desc(), "file").limit(30)
    return rounded(top.join(seeds.select("file").distinct(), "file", "left_anti"), "rank", digits=9)


@query("SELECT max(e) AS epoch FROM (SELECT max(epoch_us(ts)) AS e FROM events UNION ALL SELECT max(epoch_us(o_orderdate)) FROM orders UNION ALL SELECT max(epoch_us(l_shipdate)) FROM lineitem)")
def st02_max_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from functools import reduce

    parts = [model.read(spark, sf_dir, t).select(F.unix_micros(F.col(c).cast("timestamp")).alias("e")) for t, c in (("events", "ts"), ("orders", "o_orderdate"), ("lineitem", "l_shipdate"))]
    return reduce(DataFrame.unionByName, parts).agg(F.max("e").alias("epoch"))


@query(f"+{_PAIRS}, g AS (SELECT b AS path, 'coaccess' AS lane FROM pairs WHERE a % 20 = 0 UNION SELECT a, 'coaccess' FROM pairs WHERE b % 20 = 0 UNION SELECT l_partkey % 100, 'graph' FROM lineitem WHERE l_suppkey % 20 = 0) SELECT path, min(lane) AS first, count(DISTINCT lane) AS lanes FROM g WHERE path % 20 <> 0 GROUP BY path", "commits")
def st03_related_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir)
    g = p.where("a % 20 = 0").select(F.col("b").alias("path"), F.lit("coaccess").alias("lane")).unionByName(p.where("b % 20 = 0").select(F.col("a").alias("path"), F.lit("coaccess").alias("lane")))
    g = g.unionByName(model.read(spark, sf_dir, "lineitem").where("l_suppkey % 20 = 0").select((F.col("l_partkey") % 100).alias("path"), F.lit("graph").alias("lane"))).distinct()
    return g.where("path % 20 <> 0").groupBy("path").agg(F.min("lane").alias("first"), F.count("*").alias("lanes"))


@query("SELECT id FROM postings WHERE term IN ('the', 'and', 'to') GROUP BY id HAVING count(*) = 3", "chunks", "tokens", "postings")
def st04_postings_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = model.postings(model.chunks(spark, sf_dir)).where(F.col("term").isin("the", "and", "to"))
    return p.groupBy("id").agg(F.count("*").alias("n")).where("n = 3").select("id")


@query("SELECT DISTINCT l_orderkey AS slot, l_partkey AS item FROM lineitem WHERE l_returnflag = 'A' AND (l_orderkey, l_partkey) NOT IN (SELECT (l_orderkey, l_partkey) FROM lineitem WHERE l_returnflag <> 'A')")
def st05_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = model.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("slot"), F.col("l_partkey").alias("item"), "l_returnflag")
    return li.where("l_returnflag = 'A'").select("slot", "item").distinct().join(li.where("l_returnflag <> 'A'").select("slot", "item").distinct(), ["slot", "item"], "left_anti")


@query("""+h AS (SELECT id, path, dir, row_number() OVER (ORDER BY length(content) DESC, id) AS rank, CASE WHEN id % 3 = 0 THEN 0.0 ELSE 1.0 / (id + 1) END AS bm25 FROM chunks), p AS (SELECT * FROM h WHERE rank <= 60), f AS (SELECT DISTINCT dir FROM chunks WHERE id % 20 = 0),
    k AS (SELECT id, rank, 0 AS part FROM p WHERE dir IN (SELECT dir FROM f)), a AS (SELECT id, rank, 1 AS part FROM p WHERE dir NOT IN (SELECT dir FROM f) AND bm25 > 0 QUALIFY row_number() OVER (PARTITION BY dir ORDER BY rank) = 1)
    SELECT id, row_number() OVER (ORDER BY part, rank) AS place FROM (SELECT * FROM k UNION ALL SELECT * FROM a)""", "chunks")  # fmt: skip
def st06_path_set_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = model.chunks(spark, sf_dir)
    top = c.select("id", "dir", F.length("content").alias("n"), F.when(F.col("id") % 3 == 0, 0.0).otherwise(1 / (F.col("id") + 1)).alias("bm25")).orderBy(F.col("n").desc(), "id").limit(60)
    hits = sy.placed(top.withColumn("all", F.lit(1)), ["all"], [F.col("n").desc(), F.col("id")]).withColumnRenamed("place", "rank")
    return retrieval.within_files(hits, c.where("id % 20 = 0").select("dir").distinct(), "dir").select("id", F.col("place").cast("long").alias("place"))


@query("SELECT id, sum(DISTINCT lane)::BIGINT AS lanes FROM (SELECT id, 1 AS lane FROM chunks WHERE id % 2 = 0 UNION ALL SELECT id, 2 FROM chunks WHERE id % 3 = 0 UNION ALL SELECT id, 4 FROM chunks WHERE kind = 'window') GROUP BY id", "chunks")
def st07_lane_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = model.chunks(spark, sf_dir)
    legs = c.where("id % 2 = 0").select("id", F.lit(1).cast("long").alias("lane")).unionByName(c.where("id % 3 = 0").select("id", F.lit(2).cast("long").alias("lane"))).unionByName(c.where("kind = 'window'").select("id", F.lit(4).cast("long").alias("lane")))
    return legs.groupBy("id").agg(F.bit_or("lane").alias("lanes"))


@query("SELECT seed, id, max(way) AS way FROM (SELECT dst AS seed, src AS id, 'caller' AS way FROM edges WHERE dst % 20 = 0 UNION SELECT src, dst, 'callee' FROM edges WHERE src % 20 = 0) WHERE seed <> id GROUP BY 1, 2", "edges")
def st08_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = model.edges(spark, sf_dir)
    a = e.where("dst % 20 = 0").select(F.col("dst").alias("seed"), F.col("src").alias("id"), F.lit("caller").alias("way"))
    b = e.where("src % 20 = 0").select(F.col("src").alias("seed"), F.col("dst").alias("id"), F.lit("callee").alias("way"))
    return a.unionByName(b).where("seed <> id").groupBy("seed", "id").agg(F.max("way").alias("way"))


_CHANGED = "changed AS (SELECT DISTINCT file FROM symbols WHERE id % 20 = 0), seeds AS (SELECT id FROM symbols WHERE kind IN ('function', 'method') AND file IN (SELECT file FROM changed))"


@query(f"+{_CHANGED} SELECT id FROM seeds", *_S)
def st09_changed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _symbols(spark, sf_dir).where("kind IN ('function', 'method')").join(_wanted(spark, sf_dir).select("file").distinct(), "file", "left_semi").select("id")


# -- graph ----------------------------------------------------------------------------------------------------------------


@query("SELECT community, count(*) AS n, dense_rank() OVER (ORDER BY min(id)) AS label FROM symbols GROUP BY community", *_S)
def gr06_stable_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    g = _symbols(spark, sf_dir).groupBy("community").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    return g.select("community", "n", F.dense_rank().over(Window.partitionBy(F.lit(1)).orderBy("first")).cast("long").alias("label"))


@query("""+f AS (SELECT DISTINCT file FROM symbols WHERE id % 20 = 0), n AS (SELECT a.file AS seed, b.file, max(b.rank) AS rank FROM (SELECT src, dst FROM typed_edges UNION SELECT dst, src FROM typed_edges) e JOIN symbols a ON a.id = e.src JOIN symbols b ON b.id = e.dst WHERE a.file IN (SELECT file FROM f) AND a.file <> b.file GROUP BY 1, 2)
    SELECT seed, file, row_number() OVER (PARTITION BY seed ORDER BY rank DESC, file) AS place FROM n QUALIFY place <= 10""", *_SE)  # fmt: skip
def gr10_file_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, e = _symbols(spark, sf_dir), model.typed_edges(spark, sf_dir)
    fe = sy.file_edges(e, s, _wanted(spark, sf_dir).select("file")).select(F.col("src_file").alias("seed"), F.col("dst_file").alias("file"))
    ends = e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    best = ends.join(s.select(F.col("id").alias("src"), F.col("file").alias("seed")), "src").join(s.select(F.col("id").alias("dst"), "file", "rank"), "dst").groupBy("seed", "file").agg(F.max("rank").alias("rank"))
    return sy.placed(fe.join(best, ["seed", "file"]), ["seed"], [F.col("rank").desc(), F.col("file")], 10).select("seed", "file", "place")


@query(f"""+{_CHANGED}, c AS (SELECT DISTINCT src, dst FROM typed_edges WHERE kind = 'calls'), a AS (SELECT DISTINCT src AS id FROM c WHERE dst IN (SELECT id FROM seeds) AND src NOT IN (SELECT id FROM seeds)),
    b AS (SELECT DISTINCT src AS id FROM c WHERE dst IN (SELECT id FROM a) AND src NOT IN (SELECT id FROM seeds) AND src NOT IN (SELECT id FROM a)) SELECT id, CAST(1 AS BIGINT) AS depth FROM a UNION ALL SELECT id, 2 FROM b""", *_SE)  # fmt: skip
def gr15_diff_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sy.diff_impact(model.typed_edges(spark, sf_dir), _symbols(spark, sf_dir), _wanted(spark, sf_dir).select("file").distinct())


@query("""+t AS (SELECT DISTINCT path FROM paths), n AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS dir, regexp_extract(path, '([^/]*)$', 1) AS base FROM t), c AS (SELECT path, dir, regexp_extract(base, '^([^.]*)', 1) AS stem FROM n WHERE NOT regexp_matches(base, '(_test|_spec)\\.|\\.(test|spec)\\.|^test_')),
    s AS (SELECT path AS test, dir, regexp_replace(regexp_replace(regexp_extract(base, '^([^.]*)', 1), '^test_', ''), '(_test|_spec)$', '') AS stem FROM n WHERE regexp_matches(base, '(_test|_spec)\\.|\\.(test|spec)\\.|^test_')) SELECT c.path, s.test FROM c JOIN s USING (dir, stem)""", "paths")  # fmt: skip
def gr16_sibling_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources import ingest

    return ingest.sibling_tests(model.paths(spark, sf_dir))


@query("SELECT b.file AS doc, a.file AS linked_by, count(DISTINCT (src, dst)) AS links FROM typed_edges JOIN symbols a ON a.id = src JOIN symbols b ON b.id = dst WHERE typed_edges.kind IN ('links', 'embeds') AND a.file <> b.file GROUP BY 1, 2", *_SE)
def gr17_doc_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sy.doc_links(model.typed_edges(spark, sf_dir), _symbols(spark, sf_dir))


@query("SELECT DISTINCT b.id AS tag_id, b.name AS tag, a.qualified AS doc FROM typed_edges JOIN symbols a ON a.id = src JOIN symbols b ON b.id = dst WHERE typed_edges.kind = 'tagged'", *_SE)
def gr18_docs_for_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sy.docs_for_tag(model.typed_edges(spark, sf_dir), _symbols(spark, sf_dir))


@query("""+i AS (SELECT DISTINCT a.package, b.package AS imports FROM typed_edges JOIN symbols a ON a.id = src JOIN symbols b ON b.id = dst WHERE typed_edges.kind = 'imports' AND a.package <> b.package)
    SELECT DISTINCT package, (SELECT count(*) FROM i WHERE i.package = s.package) AS imports, (SELECT count(*) FROM i WHERE i.imports = s.package) AS importers FROM symbols s""", *_SE)  # fmt: skip
def gr19_package_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sy.package_neighbors(model.typed_edges(spark, sf_dir), _symbols(spark, sf_dir))


@query("""+h AS (SELECT DISTINCT src AS owner, dst AS member FROM typed_edges WHERE kind = 'has_method'), s AS (SELECT a.member AS id, a.owner, b.member FROM h a JOIN h b ON a.owner = b.owner AND a.member <> b.member WHERE a.member % 20 = 0)
    SELECT s.id, owner, member, row_number() OVER (PARTITION BY s.id ORDER BY rank DESC, in_degree DESC, owner, member) AS place FROM s JOIN symbols ON symbols.id = member QUALIFY place <= 30""", *_SE)  # fmt: skip
def gr21_neighborhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sy.neighbourhood(model.typed_edges(spark, sf_dir), _symbols(spark, sf_dir), _wanted(spark, sf_dir))


@query("""+r AS (SELECT id FROM symbols WHERE name ILIKE 'cold%' AND kind IN ('function', 'method')) SELECT id, 'handler' AS why FROM r UNION SELECT DISTINCT src, 'registrar' FROM typed_edges WHERE kind = 'calls' AND dst IN (SELECT id FROM r)""", *_SE)
def gr24_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _symbols(spark, sf_dir).where("name ILIKE 'cold%' AND kind IN ('function', 'method')").select("id")
    calls = model.typed_edges(spark, sf_dir).where("kind = 'calls'").join(s.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return s.withColumn("why", F.lit("handler")).unionByName(calls.select(F.col("src").alias("id"), F.lit("registrar").alias("why")).distinct())


@query("""+h AS (SELECT DISTINCT src AS owner, name FROM typed_edges JOIN symbols ON id = dst WHERE typed_edges.kind = 'has_method'), k AS (SELECT h.owner, h.name, s.kind FROM h JOIN symbols s ON s.id = h.owner), n AS (SELECT owner, count(*) AS required FROM k WHERE kind = 'interface' GROUP BY 1),
    g AS (SELECT a.owner AS interface, b.owner AS type, count(*) AS have FROM k a JOIN k b ON a.kind = 'interface' AND b.kind IN ('type', 'struct') AND a.name = b.name GROUP BY 1, 2) SELECT interface, type, have, required, CASE WHEN have = required THEN 'complete' ELSE 'partial' END AS state FROM g JOIN n ON n.owner = interface WHERE 2 * have >= required""", *_SE)  # fmt: skip
def gr29_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sy.cohort(model.typed_edges(spark, sf_dir), _symbols(spark, sf_dir))


@query("SELECT DISTINCT e.dst AS id, e.src AS peer, e.kind FROM typed_edges e WHERE e.kind IN ('implements', 'embeds') AND e.dst % 20 = 0 UNION SELECT DISTINCT e.src, e.dst, 'super' FROM typed_edges e WHERE e.kind IN ('implements', 'embeds') AND e.src % 20 = 0", "typed_edges")
def gr30_type_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = model.typed_edges(spark, sf_dir).where("kind IN ('implements', 'embeds')")
    down = e.where("dst % 20 = 0").select(F.col("dst").alias("id"), F.col("src").alias("peer"), "kind")
    return down.unionByName(e.where("src % 20 = 0").select(F.col("src").alias("id"), F.col("dst").alias("peer"), F.lit("super").alias("kind"))).distinct()


@query("""+h AS (SELECT file, start_line + 2 AS low, start_line + 6 AS high, id % 40 AS changed FROM symbols WHERE id % 20 = 0), o AS (SELECT h.file, low, high, changed, s.id, substr(s.name, 1, 1) BETWEEN 'A' AND 'Z' AS exported, in_degree FROM h JOIN symbols s ON s.file = h.file AND start_line <= high AND end_line >= low)
    SELECT DISTINCT file, low, high, id, in_degree, CASE WHEN changed >= 30 THEN CASE WHEN exported THEN 'high' ELSE 'high' END WHEN changed >= 10 THEN CASE WHEN exported THEN 'high' ELSE 'medium' END ELSE CASE WHEN exported THEN 'medium' ELSE 'low' END END AS risk FROM o""", *_S)  # fmt: skip
def gr33_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions import text as tx

    s = _symbols(spark, sf_dir)
    hunks = _wanted(spark, sf_dir).select("file", (F.col("start_line") + 2).alias("low"), (F.col("start_line") + 6).alias("high"), (F.col("id") % 40).alias("changed"))
    o = sy.overlapping(s, hunks).withColumn("risk", tx.hunk_risk(F.col("changed"), paths.exported(F.col("name"))))
    return o.select("file", "low", "high", "id", "in_degree", "risk").distinct()


@query("""+e AS (SELECT DISTINCT a.file AS a, b.file AS b FROM edges JOIN symbols a ON a.id = src JOIN symbols b ON b.id = dst WHERE a.file <> b.file), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), s AS (SELECT DISTINCT file FROM symbols WHERE id % 20 = 0),
    one AS (SELECT a AS seed, b AS file FROM u WHERE a IN (SELECT file FROM s)), two AS (SELECT DISTINCT o.seed, u.b AS file FROM one o JOIN u ON u.a = o.file WHERE u.b <> o.seed AND (o.seed, u.b) NOT IN (SELECT (seed, file) FROM one)) SELECT seed, count(*) FILTER (hop = 1) AS one_hop, count(*) FILTER (hop = 2) AS two_hops FROM (SELECT *, 1 AS hop FROM one UNION ALL SELECT *, 2 FROM two) GROUP BY seed""", *_S)  # fmt: skip
def gr34_file_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, e = _symbols(spark, sf_dir), model.edges(spark, sf_dir)
    every = sy.file_edges(e, s, s.select("file")).select(F.col("src_file").alias("a"), F.col("dst_file").alias("b"))
    one = every.join(_wanted(spark, sf_dir).select(F.col("file").alias("a")).distinct(), "a", "left_semi").toDF("seed", "file")
    two = one.join(every, F.col("file") == F.col("a")).where("b <> seed").select("seed", F.col("b").alias("file")).distinct().join(one, ["seed", "file"], "left_anti")
    both = one.withColumn("hop", F.lit(1)).unionByName(two.withColumn("hop", F.lit(2)))
    return both.groupBy("seed").agg(F.count_if(F.col("hop") == 1).alias("one_hop"), F.count_if(F.col("hop") == 2).alias("two_hops"))
