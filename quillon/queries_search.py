"""Queries of whole searches, clusters, reports, sinks and the query surface."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import model
from . import queries as base
from .functions import paths, prose
from .functions import text as tx
from .operators import evaluation, graph, lines, retrieval, search, spans
from .operators import symbols as sy
from .operators.loops import shared_dir
from .plans import surface
from .registry import ORACLE, query, rounded
from .sources import ingest, tables

_S, _SE = ("edges", "symbols"), ("edges", "symbols", "typed_edges")
_L = "lines AS (SELECT id, generate_subscripts(l, 1) AS line, unnest(l) AS text FROM (SELECT id, string_split(content, chr(10)) AS l FROM chunks))"


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with what reranking looks at."""
    c = model.chunks(spark, sf_dir).select("id", "dir", F.when(F.col("id") % 3 == 0, "function_declaration").otherwise(F.col("kind")).alias("kind"))
    return c.join(model.paths(spark, sf_dir), "id").withColumn("symbol_query", F.lit(False)).withColumn("rerank_score", F.lit(0.0))


_RERANKED = """g AS (SELECT qid, f.id, p.path, c.dir, score FROM {hits} f JOIN chunks c ON c.id = f.id JOIN paths p ON p.id = f.id),
    h AS (SELECT *, score * CASE WHEN regexp_matches(path, '(_test\\.go|\\.test\\.js|_spec\\.rb)$|(^|/)test_[^/]*\\.py$') OR list_has_any(string_split(path, '/'), ['testdata', 'mock']) THEN 0.3 ELSE 1 END * CASE WHEN list_has_any(string_split(path, '/'), ['legacy', 'compat']) THEN 0.3 ELSE 1 END
        * CASE WHEN list_has_any(string_split(path, '/'), ['examples', 'demo']) THEN 0.3 ELSE 1 END * CASE WHEN regexp_matches(path, '(^|/)(index\\.ts|mod\\.rs)$') THEN 0.5 ELSE 1 END * CASE WHEN path LIKE '%.d.ts' OR path LIKE '%.pyi' THEN 0.7 ELSE 1 END
        * CASE WHEN count(*) OVER (PARTITION BY qid, dir) >= 2 THEN 1.15 ELSE 1 END AS b FROM g),
    p AS (SELECT *, row_number() OVER (PARTITION BY qid, dir ORDER BY round(b, 9) DESC, id) AS place FROM h), r AS (SELECT qid, id, dir, b * pow(0.7, greatest(place - 2, 0)) AS final FROM p),
    n AS (SELECT *, row_number() OVER (PARTITION BY qid, dir ORDER BY round(final, 9) DESC, id) AS nth FROM r), o AS (SELECT qid, id, final, row_number() OVER (PARTITION BY qid ORDER BY round(final, 9) DESC, id) AS rank FROM n WHERE nth <= 2)
    SELECT qid, id, round(final, 6) AS final, rank FROM o WHERE rank <= 8"""


def _found(df: DataFrame) -> DataFrame:
    return rounded(df.withColumn("rank", F.col("rank").cast("long")), "final")


@query(base._DENSE + f", {base._HYBRID}, {base._LEXICAL}{base._LINEAR}, " + _RERANKED.format(hits="fused"), "chunks", "tokens", "postings", "paths")
def rt17_full_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(search.search(*base._both_legs(spark, sf_dir), _pool(spark, sf_dir)))


@query(base._DENSE + ", " + _RERANKED.format(hits="dense"), "chunks", "paths")
def rt07_semantic_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(search.search(base._dense(spark, sf_dir), None, _pool(spark, sf_dir)))


@query(f"+{base._HYBRID}, {base._LEXICAL}, " + _RERANKED.format(hits="lex"), "chunks", "tokens", "postings", "paths")
def rt08_lexical_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(search.search(None, base._lexical(spark, sf_dir, base._hybrid(spark, sf_dir)), _pool(spark, sf_dir)))


@query("""+n AS (SELECT (id % 10) AS qid, name FROM symbols WHERE id % 20 = 0 GROUP BY ALL), j AS (SELECT qid, s.*, row_number() OVER (PARTITION BY qid, file, s.name ORDER BY rank DESC, in_degree DESC, start_line, id) AS nth FROM n JOIN symbols s ON s.name = n.name)
    SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY rank DESC, in_degree DESC, start_line, id) AS place FROM j WHERE nth = 1 QUALIFY place <= 12""", *_S)  # fmt: skip
def rt23_symbol_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = model.symbols(spark, sf_dir)
    wanted = s.where("id % 20 = 0").select((F.col("id") % 10).alias("qid"), "name")
    return search.symbol_lane(s, wanted, 12).select("qid", "id", F.col("rank").cast("long").alias("place"))


_PAIRS = """WITH RECURSIVE e AS (SELECT x.vec_id AS a, y.vec_id AS b, list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda p: CAST(p[1] AS DOUBLE) * p[2])) / sqrt(list_sum(list_transform(x.embedding, lambda p: CAST(p AS DOUBLE) * p)) * list_sum(list_transform(y.embedding, lambda p: CAST(p AS DOUBLE) * p))) AS s FROM embeddings x, embeddings y WHERE x.vec_id <> y.vec_id AND x.vec_id % 20 = 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(s, 9) DESC, b) AS r FROM e), p AS (SELECT least(a, b) AS a, greatest(a, b) AS b, max(s) AS s FROM k WHERE r <= 11 AND s >= 0.36 GROUP BY 1, 2)"""


@query(_PAIRS + """, u AS (SELECT a, b FROM p UNION SELECT b, a FROM p), c AS (SELECT a AS seed, a AS id FROM u UNION SELECT c.seed, u.b FROM c JOIN u ON u.a = c.id), g AS (SELECT id, min(seed) AS cluster FROM c GROUP BY id)
    SELECT cluster, count(DISTINCT id) AS members, round(min(s), 6) AS similarity FROM g JOIN p ON p.a = g.id OR p.b = g.id GROUP BY cluster ORDER BY members DESC, similarity DESC, cluster LIMIT 20""")  # fmt: skip
def rt31_clone_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import lanes

    v = model.vectors(spark, sf_dir)
    return rounded(search.clone_clusters(lanes.similar_pairs(v, v.where("id % 20 = 0"), 10, 0.36)), "similarity")


@query("""+e AS (SELECT DISTINCT a.file AS a, b.file AS b FROM edges JOIN symbols a ON a.id = src JOIN symbols b ON b.id = dst WHERE a.file <> b.file), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), s0 AS (SELECT DISTINCT file FROM symbols WHERE id % 20 = 0 AND kind = 'function'),
    s1 AS (SELECT DISTINCT b AS file FROM u WHERE a IN (SELECT file FROM s0) AND b NOT IN (SELECT file FROM s0)), s2 AS (SELECT DISTINCT b AS file FROM u WHERE a IN (SELECT file FROM s1) AND b NOT IN (SELECT file FROM s0 UNION SELECT file FROM s1)),
    s3 AS (SELECT DISTINCT b AS file FROM u WHERE a IN (SELECT file FROM s2) AND b NOT IN (SELECT file FROM s0 UNION SELECT file FROM s1 UNION SELECT file FROM s2)), r AS (SELECT file, 0.6 AS score FROM s1 UNION ALL SELECT file, 0.36 FROM s2 UNION ALL SELECT file, 0.216 FROM s3)
    SELECT file, score::DOUBLE AS score FROM r ORDER BY r.score DESC, file LIMIT 20""", *_S)  # fmt: skip
def rt32_related_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, e = model.symbols(spark, sf_dir), model.edges(spark, sf_dir)
    links = sy.file_edges(e, s, s.select("file")).select(F.col("src_file").alias("a"), F.col("dst_file").alias("b"))
    return rounded(search.related_files(links, s.where("id % 20 = 0 AND kind = 'function'").select("file")), "score")


@query(r"""+o AS (SELECT DISTINCT path, CASE WHEN regexp_matches(path, '(^|/)[^/]*\.md$') THEN 'writers' WHEN contains('/' || path, '/testdata/') THEN 'testers' WHEN regexp_matches(path, '^[^/]*/src/[^/]*/[^/]*\.go$') THEN 'gophers' WHEN regexp_matches(path, '(^|/)[^/]*$') THEN 'all' END AS owner FROM paths) SELECT * FROM o""", "paths")
def rt34_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("*", "all"), ("*/src/*/*.go", "gophers"), ("testdata/", "testers"), ("*.md", "writers")]
    return search.owners(model.paths(spark, sf_dir).select("path").distinct(), rules)


def _package_rank(rounds: int) -> str:
    out = """+e AS (SELECT DISTINCT a.package AS src, b.package AS dst FROM typed_edges JOIN symbols a ON a.id = src JOIN symbols b ON b.id = dst WHERE typed_edges.kind = 'imports' AND a.package <> b.package AND a.package < b.package), n AS (SELECT DISTINCT package AS id FROM symbols),
        o AS (SELECT src AS id, count(*) AS n FROM e GROUP BY 1), r0 AS (SELECT id, 1.0 / (SELECT count(*) FROM n) AS rank FROM n)"""
    for i in range(rounds):
        out += f""", r{i + 1} AS MATERIALIZED (SELECT n.id, 0.15 / (SELECT count(*) FROM n) + 0.85 * (SELECT coalesce(sum(rank), 0) FROM r{i} LEFT JOIN o USING (id) WHERE o.id IS NULL) / (SELECT count(*) FROM n) + 0.85 * coalesce(g.got, 0) AS rank
            FROM n LEFT JOIN (SELECT e.dst AS id, sum(r.rank / o.n) AS got FROM e JOIN r{i} r ON r.id = e.src JOIN o ON o.id = e.src GROUP BY 1) g ON g.id = n.id)"""
    return out


@query(_package_rank(20) + " SELECT id, round(rank, 9) AS rank FROM r20", *_SE)
def gr03_package_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = model.symbols(spark, sf_dir)
    every, _ = sy.package_imports(model.typed_edges(spark, sf_dir), s, s)
    e = every.where("package < imports").select(F.col("package").alias("src"), F.col("imports").alias("dst"))
    return rounded(graph.pagerank(s.select(F.col("package").alias("id")).distinct(), e), "rank", digits=9)


@query(base._recursive("+c AS (SELECT id AS seed, id FROM nodes UNION SELECT c.seed, dst FROM c JOIN edges ON src = c.id), s AS (SELECT a.seed AS id, min(a.id) AS component FROM c a JOIN c b ON a.id = b.seed AND b.id = a.seed GROUP BY a.seed) SELECT component, count(*) AS members FROM s GROUP BY 1 HAVING count(*) >= 2"))
def gr08_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = graph.strong_components(*base._graph(spark, sf_dir))
    return c.groupBy("component").agg(F.count("*").alias("members")).where("members >= 2")


@query("""+g AS (SELECT community, count(*) AS members, sum(rank) AS mass FROM symbols WHERE community > 0 GROUP BY 1), t AS (SELECT community, name, row_number() OVER (PARTITION BY community ORDER BY length(name) <= 2 OR lower(name) IN ('init', 'main', 'new', 'run'), rank DESC, id) AS place FROM symbols)
    SELECT community, members, round(mass, 6) AS mass, name AS top FROM g JOIN t USING (community) WHERE place = 1 ORDER BY mass DESC, community LIMIT 10""", *_S)  # fmt: skip
def gr26_communities_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = model.symbols(spark, sf_dir).where("community > 0")
    g = s.groupBy("community").agg(F.count("*").alias("members"), F.sum("rank").alias("mass"))
    top = sy.top_names(s, 1).select("community", F.col("name").alias("top"))
    return rounded(g.join(top, "community").orderBy(F.col("mass").desc(), "community").limit(10), "mass")


@query("""+f AS (SELECT *, substr(package, 1, 7) AS project FROM symbols), e AS (SELECT DISTINCT a.project AS src, b.project AS dst FROM typed_edges t JOIN f a ON a.id = t.src JOIN f b ON b.id = t.dst WHERE a.project <> b.project)
    SELECT project, (SELECT count(*) FROM e WHERE e.src = project) AS out_degree, (SELECT count(*) FROM e WHERE e.dst = project) AS in_degree FROM (SELECT DISTINCT project FROM f)""", *_SE)  # fmt: skip
def gr23_project_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = model.symbols(spark, sf_dir)
    project = F.substring("package", 1, 7)
    e = sy.project_graph(model.typed_edges(spark, sf_dir), s, project).select(F.col("src_project").alias("src"), F.col("dst_project").alias("dst"))
    d = graph.degrees(s.select(project.alias("id")).distinct(), e)
    return d.select(F.col("id").alias("project"), "out_degree", "in_degree")


@query("""+o AS (SELECT id, 1 AS seen FROM symbols WHERE id % 3 <> 0), n AS (SELECT id, 2 AS seen FROM symbols WHERE id % 2 = 0), m AS (SELECT id, max(seen) AS seen FROM (SELECT * FROM o UNION ALL SELECT * FROM n) GROUP BY id) SELECT id, 'full' AS build, seen::BIGINT AS seen FROM m WHERE seen >= 2 UNION ALL SELECT id, 'empty', seen FROM o""", *_S)
def gr01_build_and_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = model.symbols(spark, sf_dir)
    old = s.where("id % 3 <> 0").select("id", F.col("name").alias("hash"), F.lit(1).cast("long").alias("seen"))
    new = s.where("id % 2 = 0").select("id", F.col("name").alias("hash"))
    full, empty = (tables.rebuilt(old, x, 2).select("id", "seen").withColumn("build", F.lit(b)) for x, b in ((new, "full"), (new.limit(0), "empty")))
    return full.unionByName(empty)


# -- sources and sinks ----------------------------------------------------------------------------------------------------


@query("SELECT conv_id, count(*) AS turns, sum(length(text))::BIGINT AS letters FROM conversations GROUP BY conv_id")
def sc28_ndjson_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as one JSON line each and read again."""
    c = model.read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    path = shared_dir(spark)
    c.write.json(path)
    d = ingest.json_lines(spark, path, c.schema)
    return d.select("conv_id", F.size("turns").cast("long").alias("turns"), F.aggregate("turns", F.lit(0).cast("long"), lambda s, x: s + F.coalesce(F.length(x["text"]), F.lit(0))).alias("letters"))


@query("SELECT id, name, file, kind FROM symbols", *_S)
def sc49_jsonl_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = model.symbols(spark, sf_dir).select("id", "name", "file", "kind")
    path = shared_dir(spark)
    graph.dump(s, path)
    return ingest.json_lines(spark, path, s.schema)


@query("SELECT id, kind, src, dst FROM (SELECT src || '>' || dst || ':' || line AS id, kind, src, dst, row_number() OVER (PARTITION BY src, dst, line ORDER BY kind) AS r FROM typed_edges) WHERE r = 1", "typed_edges")
def sc36_graph_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = model.typed_edges(spark, sf_dir).select(F.concat_ws("", F.col("src").cast("string"), F.lit(">"), F.col("dst").cast("string"), F.lit(":"), F.col("line").cast("string")).alias("id"), "kind", "src", "dst")
    return sy.placed(e, ["id"], [F.col("kind")], 1).drop("place")


@query("+u AS (SELECT dir AS path, sha1(content) AS sha, id AS stamp FROM chunks) SELECT path, sha, max(stamp) AS stamp FROM u GROUP BY 1, 2", "chunks")
def sc40_chunk_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = model.chunks(spark, sf_dir).select(F.col("dir").alias("path"), F.sha1("content").alias("sha"), F.col("id").alias("stamp"))
    return tables.latest(c, ["path", "sha"], "stamp")


@query("SELECT id, CASE WHEN id % 2 = 0 THEN 9 ELSE 1 END::BIGINT AS seen FROM chunks", "chunks")
def sc41_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = model.chunks(spark, sf_dir).select("id", F.lit(1).cast("long").alias("seen"))
    return tables.replaced(c, c.where("id % 2 = 0").select("id", F.lit(9).cast("long").alias("seen")), "id", ["seen"])


@query("SELECT greatest(5, max(id) + 1) AS stamp FROM chunks", "chunks")
def sc43_monotonic_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.next_stamp(model.chunks(spark, sf_dir).select(F.col("id").alias("seen")), 5)


@query("""+h AS (SELECT s.id, c.id AS chunk, row_number() OVER (PARTITION BY s.id ORDER BY c.end_line - c.start_line, c.id) AS r FROM symbols s JOIN symbols c ON c.file = s.file AND c.kind IN ('type', 'struct') AND c.start_line <= s.start_line AND s.end_line <= c.end_line) SELECT id, chunk FROM h WHERE r = 1""", *_S)
def sc48_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = model.symbols(spark, sf_dir, False)
    return sy.linked(s, s.where("kind IN ('type', 'struct')"))


# -- functions and windows ------------------------------------------------------------------------------------------------


@query("+w AS (SELECT id, unnest(['error', 'db', 'none', CASE WHEN id % 2 = 0 THEN 'cache' ELSE 'log' END]) AS w FROM symbols WHERE id < 50) SELECT id, string_agg(CASE w WHEN 'error' THEN 'error err result exception panic fault' WHEN 'db' THEN 'db database sql query transaction migration schema store' WHEN 'cache' THEN 'cache redis ttl invalidate evict memcache' WHEN 'log' THEN 'log logger logging trace debug warn' ELSE w END, ' ' ORDER BY CASE w WHEN 'error' THEN 0 WHEN 'db' THEN 1 WHEN 'none' THEN 2 ELSE 3 END) AS words FROM w GROUP BY id", *_S)
def fn05_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(F.lit("error"), F.lit("db"), F.lit("none"), F.when(F.col("id") % 2 == 0, "cache").otherwise("log"))
    return model.symbols(spark, sf_dir).where("id < 50").select("id", F.array_join(search.expanded(words), " ").alias("words"))


@query("""SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda w: length(w) >= 3 AND w NOT IN ('a','an','the','is','are','was','were','be','been','being','have','has','had','do','does','did','will','would','could','should','may','might','shall','can','to','of','in','on','at','by','for','with','from','as','or','and','but','not','it','its','this','that','these','those','which','who','whom','what','so','if')))), ' ') AS words FROM benchmark""")
def fn07_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.read(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.sort_array(search.keywords(F.col("text"))), " ").alias("words"))


@query("SELECT id, name AS bare, length(name) AS n FROM symbols", *_S)
def fn40_bare_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = tx.bare_name(F.col("qualified"))
    return model.symbols(spark, sf_dir).select("id", bare.alias("bare"), F.length(bare).cast("long").alias("n"))


_IDS = r"""q AS (SELECT id, CASE id % 4 WHEN 0 THEN 'does (*Store).Find call ' || name || ' or Other' WHEN 1 THEN name WHEN 2 THEN 'what of markDirty and ' || lower(name) ELSE 'plain words only' END AS text FROM symbols),
    r AS (SELECT id, text, regexp_replace(text, '\(\*?[A-Z][A-Za-z0-9_]*\)\.[A-Za-z_][A-Za-z0-9_]*|\b[A-Z][A-Za-z0-9_]*\.[A-Za-z_][A-Za-z0-9_]*\b', ' ', 'g') AS rest FROM q),
    f AS (SELECT id, text, list_concat(list_concat(regexp_extract_all(text, '\(\*?[A-Z][A-Za-z0-9_]*\)\.[A-Za-z_][A-Za-z0-9_]*|\b[A-Z][A-Za-z0-9_]*\.[A-Za-z_][A-Za-z0-9_]*\b'), regexp_extract_all(rest, '\b[A-Z][A-Za-z0-9_]{2,}\b')), list_concat(regexp_extract_all(rest, '\b[a-z][a-z0-9]*[A-Z][A-Za-z0-9_]*\b'), regexp_extract_all(rest, '\b[a-z][a-z0-9_]*_[a-z0-9_]+\b'))) AS f FROM r)"""


@query(f"+{_IDS} SELECT id, array_to_string(list_sort(list_distinct(CASE WHEN len(f) > 0 THEN f WHEN regexp_matches(trim(text), '^[A-Za-z0-9_]{{3,32}}$') THEN [trim(text)] ELSE [] END)), ' ') AS names FROM f", *_S)
def pf34_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    text = (
        F.when(i % 4 == 0, F.concat(F.lit("does (*Store).Find call "), "name", F.lit(" or Other"))).when(i % 4 == 1, F.col("name"))
        .when(i % 4 == 2, F.concat(F.lit("what of markDirty and "), F.lower("name"))).otherwise("plain words only")
    )
    return model.symbols(spark, sf_dir).select("id", F.array_join(F.sort_array(surface.identifiers(text)), " ").alias("names"))


@query("SELECT vec_id AS id, label, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS place FROM embeddings")
def wn01_lane_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = model.vectors(spark, sf_dir).withColumn("x", F.col("embedding")[0])
    return sy.placed(v, ["label"], [F.col("x").desc(), F.col("id")]).select("id", "label", "place")


@query("SELECT id, round((length(content) % 100) / 100 * CASE WHEN count(*) OVER (PARTITION BY dir, id % 10) >= 2 THEN 1.15 ELSE 1 END, 6) AS score FROM chunks", "chunks")
def wn03_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = model.chunks(spark, sf_dir).withColumn("qid", F.col("id") % 10).withColumn("score", F.length("content") % 100 / 100)
    boost = F.when(F.count("*").over(Window.partitionBy("dir", "qid")) >= 2, 1.15).otherwise(1.0)
    return rounded(c.select("id", (F.col("score") * boost).alias("score")), "score")


@query("+p AS (SELECT id, (length(content) % 100) / 100 AS s, row_number() OVER (PARTITION BY dir ORDER BY length(content) % 100 DESC, id) AS r FROM chunks) SELECT id, round(s * pow(0.7, greatest(r - 2, 0)), 6) AS score FROM p", "chunks")
def wn04_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = model.chunks(spark, sf_dir).withColumn("n", F.length("content") % 100)
    c = c.withColumn("r", F.row_number().over(Window.partitionBy("dir").orderBy(F.col("n").desc(), "id")))
    return rounded(c.select("id", (F.col("n") / 100 * F.pow(F.lit(0.7), F.greatest(F.col("r") - 2, F.lit(0)))).alias("score")), "score")


@query("SELECT id, round(avg(CASE WHEN trim(text) = '' THEN 0 ELSE 1 END), 6) AS filled, count(*) AS lines FROM (SELECT id, unnest(string_split(content, chr(10))) AS text FROM chunks) GROUP BY id ORDER BY filled DESC, lines DESC, id LIMIT 50", "chunks")
def tk10_attention_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lines.lines(model.chunks(spark, sf_dir)).groupBy("id").agg(F.round(F.avg(F.when(F.trim("text") == "", 0).otherwise(1)), 6).alias("filled"), F.count("*").alias("lines"))
    return t.orderBy(F.col("filled").desc(), F.col("lines").desc(), "id").limit(50)


# -- text -----------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id AS id, sha1(regexp_replace(regexp_replace(coalesce(text, ''), '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')) AS hash FROM documents")
def tx04_light_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = model.read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.sha1(lines.light_cleanup(F.coalesce("text", F.lit("")))).alias("hash"))


@query("SELECT file, string_agg(name || ':' || start_line, chr(10) ORDER BY start_line, id) AS signatures FROM symbols WHERE kind IN ('function', 'method') GROUP BY file", *_S)
def tx32_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sy.signatures(model.symbols(spark, sf_dir))


@query("SELECT id, CASE WHEN t <= b THEN 'full' WHEN t / 5 <= b THEN 'map' WHEN t / 20 <= b THEN 'signatures' ELSE 'handle' END AS mode FROM (SELECT id, ceil(length(content) / 3.5) AS t, 20 + id % 300 AS b FROM chunks)", "chunks")
def tx33_read_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.chunks(spark, sf_dir).select("id", search.read_mode(prose.token_estimate(F.col("content")), 20 + F.col("id") % 300).alias("mode"))


@query(f"+{_L}, c AS (SELECT dir, text, count(DISTINCT id) AS n FROM lines JOIN chunks USING (id) WHERE line = 1 AND trim(text) <> '' GROUP BY 1, 2) SELECT dir, count(*) FILTER (n >= 2) AS shared, sum(n)::BIGINT AS heads FROM c GROUP BY dir", "chunks")
def tx29_shared_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = model.chunks(spark, sf_dir)
    h = lines.lines(c).where("line = 1 AND trim(text) <> ''").join(c.select("id", "dir"), "id").groupBy("dir", "text").agg(F.count_distinct("id").alias("n"))
    return h.groupBy("dir").agg(F.count_if(F.col("n") >= 2).alias("shared"), F.sum("n").alias("heads"))


# -- evaluation -----------------------------------------------------------------------------------------------------------


@query("WITH " + base._METRICS[1:] + " SELECT round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr, count(*) AS n FROM m")
def ev02_recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.means(base._metrics(spark, sf_dir)).select("recall", "mrr", "n"), "recall", "mrr")


@query(f"+{base._ITEMS}, {base._LEXICAL}, gold AS (SELECT item_id AS qid, doc_id AS id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)), n AS (SELECT qid, count(*) AS n FROM gold GROUP BY 1), h AS (SELECT qid, count(*) AS found, min(rank) AS f FROM lex JOIN gold USING (qid, id) WHERE rank <= 10 GROUP BY 1) SELECT qid, round(coalesce(found, 0) / n, 6) AS recall, round(coalesce(1 / f, 0), 6) AS rr FROM n LEFT JOIN h USING (qid)", "chunks", "tokens", "postings")
def ev08_eval_runner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of the benchmark as queries; the documents that contain an item whole are relevant."""
    items = model.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    docs = model.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    gold = evaluation.containing(items, docs)
    return rounded(evaluation.metrics(base._lexical(spark, sf_dir, items, 10), gold).select("qid", "recall", "rr"), "recall", "rr")


@query("+r AS (SELECT id % 10 AS qid, id, row_number() OVER (PARTITION BY id % 10 ORDER BY length(content) DESC, id) AS rank FROM chunks), g AS (SELECT qid, min(rank) AS first FROM r WHERE id % 7 = 0 GROUP BY qid) SELECT CASE WHEN first <= 1 THEN 'G1' WHEN first <= 5 THEN 'G2' ELSE 'G3' END AS class, count(*) AS n, round(avg(first + 1), 6) AS calls FROM g GROUP BY 1", "chunks")
def ev18_nav_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = model.chunks(spark, sf_dir).select((F.col("id") % 10).alias("qid"), "id", F.length("content").alias("n"), F.lit(1).alias("cost"))
    r = c.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("n").desc(), "id")).cast("long"))
    g = evaluation.navigation(r, r.where("id % 7 = 0").select("qid", "id")).withColumn("class", F.when(F.col("first") <= 1, "G1").when(F.col("first") <= 5, "G2").otherwise("G3"))
    return rounded(g.groupBy("class").agg(F.count("*").alias("n"), F.avg("calls").alias("calls")), "calls")


@query("SELECT l_shipmode, n, p50, p95 FROM (SELECT l_returnflag AS l_shipmode, count(*) AS n, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM lineitem GROUP BY 1)")
def ag32_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = model.read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("l_shipmode"))
    return rounded(g.agg(F.count("*").alias("n"), F.percentile("l_extendedprice", 0.5).alias("p50"), F.percentile("l_extendedprice", 0.95).alias("p95")), "p50", "p95", digits=4)


@query("""+f AS (SELECT source || '/' || lang AS d2, source AS d1, sha1(coalesce(text, '')) AS h FROM documents), a AS (SELECT d1, d2, sha256(string_agg(h, chr(10) ORDER BY h)) AS h FROM f GROUP BY 1, 2), b AS (SELECT d1, sha256(string_agg(h, chr(10) ORDER BY h)) AS h FROM a GROUP BY 1) SELECT d2 AS dir, h AS hash FROM a UNION ALL SELECT d1, h FROM b""".replace("+f AS", "WITH f AS", 1))
def ag31_tree_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = model.read(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("dir"), F.sha1(F.coalesce("text", F.lit(""))).alias("sha"))
    return ingest.tree_hashes(d)


# -- query surface --------------------------------------------------------------------------------------------------------


@query("""+h AS (SELECT file, start_line AS low, start_line + 4 AS high FROM symbols WHERE id % 20 = 0) SELECT DISTINCT s.id, s.name FROM h JOIN symbols s ON s.file = h.file AND start_line <= high AND end_line >= low""", *_S)
def ql06_changed_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = model.symbols(spark, sf_dir, False)
    hunks = s.where("id % 20 = 0").select("file", F.col("start_line").alias("low"), (F.col("start_line") + 4).alias("high"))
    hunks = hunks.select("file", F.col("low").alias("start_line"), F.col("high").alias("end_line"))
    at = spans.touched(s.select("file", F.col("start_line").alias("low"), F.col("end_line").alias("high")), hunks).toDF("file", "start_line", "end_line")
    return s.where("name <> ''").join(at, ["file", "start_line", "end_line"], "left_semi").select("id", "name").distinct()


@query("SELECT 'symbol' AS kind, id::VARCHAR AS id, file AS path, start_line AS first, end_line AS last, 'exact' AS prov FROM symbols UNION ALL SELECT 'chunk', id::VARCHAR, path, start_line, end_line, 'semantic' FROM chunks", "edges", "symbols", "chunks")
def ql11_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.refs(model.symbols(spark, sf_dir), "symbol", "file", "exact").unionByName(surface.refs(model.chunks(spark, sf_dir), "chunk", "path", "semantic"))


@query("SELECT id, regexp_matches(text, '^\\(?\\*?[A-Za-z_][A-Za-z0-9_]*\\)?([.:]+[A-Za-z_][A-Za-z0-9_]*)*(\\(\\))?$') AS symbol FROM (SELECT id, CASE id % 3 WHEN 0 THEN qualified WHEN 1 THEN name || '()' ELSE 'how is ' || name END AS text FROM (SELECT * REPLACE (replace(qualified, '#', '_') AS qualified) FROM symbols))", *_S)
def ql03_symbol_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    text = F.when(i % 3 == 0, F.replace("qualified", F.lit("#"), F.lit("_"))).when(i % 3 == 1, F.concat("name", F.lit("()"))).otherwise(F.concat(F.lit("how is "), "name"))
    return model.symbols(spark, sf_dir).select("id", surface.symbol_shape(text).alias("symbol"))


@query(f"+{_L}, t AS (SELECT path, line, text, row_number() OVER (ORDER BY path, line) AS n FROM lines JOIN chunks USING (id) WHERE regexp_matches(text, '[0-9]{{4}}')), c AS (SELECT count(*) AS total FROM t) SELECT path, line::INTEGER AS line, total > 20 AS truncated FROM t, c WHERE n <= 20", "chunks")
def pf22_grep_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = model.chunks(spark, sf_dir)
    rows = lines.lines(c).join(c.select("id", "path"), "id")
    return retrieval.grep_truncated(rows, r"[0-9]{4}", 20).select("path", "line", "truncated")


assert ORACLE  # the queries above are registered beside the others
