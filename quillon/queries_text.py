"""Queries of text functions, retrieval lanes, evaluation, telemetry and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import model
from .functions import paths, prose
from .functions import text as tx
from .operators import evaluation, lanes, lines, telemetry
from .operators import symbols as sy
from .registry import query, rounded
from .sources import tables

_S, _SE = ("edges", "symbols"), ("edges", "symbols", "typed_edges")
_L = "lines AS (SELECT id, generate_subscripts(l, 1) AS line, unnest(l) AS text FROM (SELECT id, string_split(content, chr(10)) AS l FROM chunks))"
_WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')"


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.read(spark, sf_dir, "conversations")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.lines(model.chunks(spark, sf_dir))


# -- functions of text ----------------------------------------------------------------------------------------------------


@query(r"SELECT id, name, regexp_matches(name, '^([a-z]+[a-z0-9]*([A-Z][A-Za-z0-9]*)+|([A-Z][a-z0-9]+){2,}|[A-Za-z0-9]+(_[A-Za-z0-9]+)+|[A-Za-z_]\w*(\.[A-Za-z_]\w*)+)$') AS identifier FROM symbols", *_S)
def fn01_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.symbols(spark, sf_dir).select("id", "name", tx.is_identifier(F.col("name")).alias("identifier"))


_IDENT = r"(regexp_matches(regexp_replace(regexp_replace(w, '^[(*&]+', ''), '\)+$', ''), '^[A-Za-z0-9_.:\-()*&]+$') AND regexp_matches(regexp_replace(regexp_replace(w, '^[(*&]+', ''), '\)+$', ''), '[A-Z._:]'))"
_STOP = "('where','is','defined','declared','located','implemented','find','locate','what','the','are','function','method','struct','type','class','interface','in','at')"
#: Questions made of the table's words, so that each class occurs.
_ASKED = "asked AS (SELECT id, CASE id % 5 WHEN 0 THEN 'where is ' || name || ' defined' WHEN 1 THEN name WHEN 2 THEN 'how does ' || replace(lower(name), '_', ' ') || ' work' WHEN 3 THEN 'find the ' || replace(lower(name), '_', ' ') ELSE qualified || ' ' || name END AS text FROM symbols)"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, low = F.col("id"), F.replace(F.lower("name"), F.lit("_"), F.lit(" "))
    text = (
        F.when(i % 5 == 0, F.concat(F.lit("where is "), "name", F.lit(" defined"))).when(i % 5 == 1, F.col("name"))
        .when(i % 5 == 2, F.concat(F.lit("how does "), low, F.lit(" work"))).when(i % 5 == 3, F.concat(F.lit("find the "), low)).otherwise(F.concat("qualified", F.lit(" "), "name"))
    )
    return model.symbols(spark, sf_dir).select("id", text.alias("text"))


@query(f"+{_ASKED}, t AS (SELECT id, unnest({_WORDS}) AS w FROM asked) SELECT id, count(*) FILTER ({_IDENT}) = 1 AND bool_and({_IDENT} OR lower(w) IN {_STOP}) AS definition FROM t GROUP BY id", *_S)
def fn02_definition_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("id", prose.definition_query(F.array_remove(F.split("text", r"\s+"), "")).alias("definition"))


_TYPE = f"""t AS (SELECT id, text, unnest({_WORDS}) AS w FROM asked), u AS (SELECT id, any_value(text) AS text, count(*) AS n, bool_and({_IDENT}) AS names, count(*) FILTER ({_IDENT}) = 1 AND bool_and({_IDENT} OR lower(w) IN {_STOP}) AS definition FROM t GROUP BY id),
    k AS (SELECT id, CASE WHEN contains(lower(text), 'where is') OR contains(lower(text), 'where are') THEN CASE WHEN definition THEN 'symbol' ELSE 'architecture' END
    WHEN regexp_matches(lower(text), 'how does|how is|architecture|design pattern|data flow|control flow|module structure|component') THEN 'architecture' WHEN names AND n <= 2 OR definition THEN 'symbol' ELSE 'nl' END AS type FROM u)"""


@query(f"+{_ASKED}, {_TYPE} SELECT id, type, CASE type WHEN 'symbol' THEN 1.4 WHEN 'architecture' THEN 0.6 ELSE 1.0 END::DOUBLE AS lexical, CASE type WHEN 'symbol' THEN 0.6 WHEN 'architecture' THEN 1.4 ELSE 1.0 END::DOUBLE AS dense FROM k", *_S)
def pf32_query_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _asked(spark, sf_dir).select("id", prose.query_type(F.col("text")).alias("type"))
    a, b = prose.rrf_weights(F.col("type"))
    return k.select("id", "type", a.cast("double").alias("lexical"), b.cast("double").alias("dense"))


@query(r"SELECT id, array_to_string(list_filter(string_split(lower(regexp_replace(qualified, '([a-z])([A-Z])', '\1 \2', 'g')), ' '), lambda x: length(x) >= 2), ' ') AS parts FROM symbols", *_S)
def fn04_camel_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.symbols(spark, sf_dir).select("id", F.array_join(tx.camel_split(F.col("qualified")), " ").alias("parts"))


@query("SELECT id, array_to_string(list_filter(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}]+'), lambda x: octet_length(encode(x)) >= 3), ' ') AS terms FROM chunks", "chunks")
def fn06_tfidf_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.chunks(spark, sf_dir).select("id", F.array_join(tx.keyword_tokens(F.col("content")), " ").alias("terms"))


@query("+m AS (SELECT dir, min(end_line) AS lo, max(end_line) AS hi FROM chunks GROUP BY dir) SELECT id, round(CASE WHEN hi = lo THEN 0 ELSE (end_line - lo) / (hi - lo) END, 6)::DOUBLE AS scaled FROM chunks JOIN m USING (dir)", "chunks")
def fn09_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(model.chunks(spark, sf_dir).select("id", lanes.scaled(F.col("end_line"), "dir").alias("scaled")), "scaled")


@query("SELECT unnest(generate_series(0, 4)) AS hop, round(pow(0.6, unnest(generate_series(0, 4))), 9) AS weight")
def fn10_hop_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spark.range(5).select(F.col("id").alias("hop"), F.pow(F.lit(0.6), F.col("id")).alias("weight")), "weight", digits=9)


@query("SELECT event_id, round(least(coalesce(value, 0) * exp(-epoch(ts - TIMESTAMP '2024-01-01') * ln(2) / 604800) + 1, 10), 6) AS weight FROM events")
def fn11_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import coupling

    e = model.read(spark, sf_dir, "events")
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / 1e6
    return rounded(e.select("event_id", F.least(coupling.decayed(F.coalesce("value", F.lit(0.0)), seconds) + 1, F.lit(10.0)).alias("weight")), "weight")


@query("SELECT vec_id AS id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS norm, round(embedding[2] / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS second FROM embeddings")
def fn15_l2_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = model.vectors(spark, sf_dir).select("id", tx.norm(F.col("embedding")).alias("norm"), F.col("embedding")[1].cast("double").alias("x"))
    return rounded(v.select("id", "norm", (F.col("x") / F.col("norm")).alias("second")), "norm", "second")


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: CAST(x[1] AS DOUBLE) * x[2])) / sqrt(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE) * x)) * list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def fn13_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = model.vectors(spark, sf_dir)
    b = v.select((F.col("id") - 1).alias("a"), F.col("id").alias("b"), F.col("embedding").alias("e"))
    return rounded(v.join(b, F.col("id") == F.col("a")).select("a", "b", tx.cosine(F.col("embedding"), F.col("e")).alias("cosine")), "cosine")


@query(f"SELECT conv_id, turn, round(CASE WHEN len({_WORDS}) > 0 THEN len(list_distinct({_WORDS})) / len({_WORDS}) ELSE 0 END, 6)::DOUBLE AS ratio FROM conversations")
def fn18_unique_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_conversations(spark, sf_dir).select("conv_id", "turn", prose.unique_ratio(F.col("text")).alias("ratio")), "ratio")


@query(rf"""+{_L}, w AS (SELECT id, trim(regexp_replace(text, '\s', ' ', 'g')) AS t FROM lines), x AS (SELECT id, CASE WHEN t = '' THEN 0.0 WHEN regexp_matches(lower(t), 'error|panic|fatal|exception|stderr') THEN 2.0
    WHEN regexp_matches(lower(t), '^(import |from |require\(|#include|use )') THEN 1.6 WHEN regexp_matches(lower(t), '^(func |function |def |class |type |struct |interface |enum |pub fn |fn )') THEN 1.5 WHEN length(t) > 1 AND regexp_matches(t, '^(//|#|\*)') THEN 1.2
    WHEN regexp_matches(lower(t), '^(return |yield )') THEN 1.0 WHEN regexp_matches(lower(t), '^(if |for |while |switch |match )') THEN 0.9 WHEN regexp_matches(lower(t), '^(assert|expect\(|test\(|it\(|describe\()') THEN 0.8 WHEN t IN ('}}', ')', ']') THEN 0.3 ELSE 0.5 END AS w FROM w)
    SELECT id, round(avg(w), 6) AS importance FROM x GROUP BY id""", "chunks")  # fmt: skip
def fn19_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(model.chunks(spark, sf_dir).select("id", prose.importance(F.col("content")).alias("importance")), "importance")


@query("+b AS (SELECT id, unnest(string_split(hex(encode(content)).regexp_replace('(..)', '\\1 ', 'g').rtrim(), ' ')) AS byte FROM chunks WHERE content <> ''), c AS (SELECT id, byte, count(*) AS c, sum(count(*)) OVER (PARTITION BY id) AS n FROM b GROUP BY 1, 2) SELECT id, round(-sum(c / n * log2(c / n)) + 0, 6) AS bits FROM c GROUP BY id", "chunks")
def fn20_byte_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lines.byte_entropy(model.chunks(spark, sf_dir)), "bits")


@query("+b AS (SELECT dir, unnest(string_split(hex(encode(content)).regexp_replace('(..)', '\\1 ', 'g').rtrim(), ' ')) AS byte FROM chunks WHERE content <> ''), c AS (SELECT dir, byte, count(*) AS c, sum(count(*)) OVER (PARTITION BY dir) AS n FROM b GROUP BY 1, 2) SELECT dir AS id, round(-sum(c / n * log2(c / n)) + 0, 6) AS bits FROM c GROUP BY dir", "chunks")
def fn21_file_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lines.byte_entropy(model.chunks(spark, sf_dir).select(F.col("dir").alias("id"), "content")), "bits")


@query("SELECT id, len(list_distinct(list_transform(generate_series(1, greatest(length(name) - 2, 0)), lambda i: name[i:i + 2])))::INTEGER AS grams FROM symbols", *_S)
def fn23_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.symbols(spark, sf_dir).select("id", F.size(tx.trigrams(F.col("name"))).alias("grams"))


@query(rf"+{_L} SELECT id, line::INTEGER AS line, CASE WHEN regexp_matches(text, '\w+/\w[^/\s]*\.\w+') OR regexp_matches(text, '[0-9]') OR regexp_matches(lower(text), 'error|warn|fail|fatal|panic|exception|critical|abort|traceback') OR len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: length(regexp_replace(x, '[^A-Za-z]', '', 'g')) >= 6)) >= 2 THEN 0.3 ELSE 0.0 END::DOUBLE AS score FROM lines", "chunks")
def fn24_marker_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("id", "line", prose.marker_score(F.col("text")).alias("score"))


@query(r"""+e AS (SELECT id, CASE id % 4 WHEN 0 THEN 'API_KEY=' WHEN 1 THEN 'HOME=' WHEN 2 THEN 'URL=postgres://u:pw' || id || '@h/' ELSE 'plain ' END || name AS line FROM symbols)
    SELECT id, CASE WHEN NOT contains(line, '=') THEN line WHEN starts_with(line, 'API_KEY=') THEN 'API_KEY=***' ELSE regexp_replace(line, '([a-zA-Z][a-zA-Z0-9+.\-]*://[^:/?#\s]*:)[^@/?#\s]+(@)', '\1***\2', 'g') END AS line FROM e""", *_S)  # fmt: skip
def fn28_env_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    head = F.when(i % 4 == 0, "API_KEY=").when(i % 4 == 1, "HOME=").when(i % 4 == 2, F.concat(F.lit("URL=postgres://u:pw"), i.cast("string"), F.lit("@h/"))).otherwise("plain ")
    return model.symbols(spark, sf_dir).select("id", prose.env_line(F.concat(head, "name")).alias("line"))


@query("SELECT id, regexp_replace(chr(27) || '[31m' || name || chr(27) || '[0m' || qualified, chr(27) || '\\[[0-9;]*[A-Za-z]', '', 'g') AS plain FROM symbols", *_S)
def fn29_strip_ansi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.symbols(spark, sf_dir).select("id", tx.strip_ansi(F.concat(F.lit("\x1b[31m"), "name", F.lit("\x1b[0m"), "qualified")).alias("plain"))


@query("SELECT id, CASE id % 4 WHEN 0 THEN 'The fn, of ' || name WHEN 1 THEN 'Cfg dirs ' || name WHEN 2 THEN 'msgs to ' || name || ' conn.' ELSE name END AS text FROM symbols", *_S)
def fn30_abbreviate(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    text = (
        F.when(i % 4 == 0, F.concat(F.lit("The function, of "), "name")).when(i % 4 == 1, F.concat(F.lit("Configuration dirs "), "name"))
        .when(i % 4 == 2, F.concat(F.lit("messages to "), "name", F.lit(" connection."))).otherwise(F.col("name"))
    )
    return model.symbols(spark, sf_dir).select("id", prose.abbreviated(text).alias("text"))


_SMALL = "('a','an','the','is','are','was','were','be','been','being','have','has','had','do','does','did','will','would','could','should','may','might','shall','can','to','of','in','on','at','by','for','with','from','as','or','and','but','not','it','its','this','that','these','those','which','who','whom','what','so','if')"


@query(f"+{_L} SELECT id, line::INTEGER AS line, CASE WHEN len({_WORDS}) > 20 THEN array_to_string(list_filter({_WORDS}, lambda x: NOT list_contains({_SMALL.replace('(', '[').replace(')', ']')}, lower(x))), ' ') ELSE text END AS text FROM lines", "chunks")
def fn31_function_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("id", "line", prose.without_function_words(F.col("text")).alias("text"))


@query("SELECT event_id, json_extract_string('{\"a\": {\"b\": [' || props || ', {\"c\": ' || event_id || '}]}}', '$.a.b[0].k') AS k, json_extract_string('{\"a\": {\"b\": [' || props || ', {\"c\": ' || event_id || '}]}}', '$.a.b[1].c') AS c FROM events")
def fn34_json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.concat(F.lit('{"a": {"b": ['), "props", F.lit(', {"c": '), F.col("event_id").cast("string"), F.lit("}]}}"))
    return model.read(spark, sf_dir, "events").select("event_id", F.get_json_object(doc, "$.a.b[0].k").alias("k"), F.get_json_object(doc, "$.a.b[1].c").alias("c"))


@query(r"SELECT item_id, replace(regexp_replace(lower(trim(text)), '[^a-z0-9 _-]', '', 'g'), ' ', '-') AS slug FROM benchmark")
def fn35_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.read(spark, sf_dir, "benchmark").select("item_id", tx.heading_slug(F.col("text")).alias("slug"))


@query("""+r AS (SELECT id, CASE id % 6 WHEN 0 THEN '<' || path || '> "t"' WHEN 1 THEN path || '#part' WHEN 2 THEN 'https://e.org/' || path WHEN 3 THEN path || ' "title"' WHEN 4 THEN '//cdn/' || path ELSE path END AS raw, path FROM paths) SELECT id, CASE WHEN id % 6 IN (2, 4) THEN '' ELSE path END AS target FROM r""", "paths")
def fn36_link_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, p = F.col("id"), F.col("path")
    raw = (
        F.when(i % 6 == 0, F.concat(F.lit("<"), p, F.lit('> "t"'))).when(i % 6 == 1, F.concat(p, F.lit("#part"))).when(i % 6 == 2, F.concat(F.lit("https://e.org/"), p))
        .when(i % 6 == 3, F.concat(p, F.lit(' "title"'))).when(i % 6 == 4, F.concat(F.lit("//cdn/"), p)).otherwise(p)
    )
    return model.paths(spark, sf_dir).select("id", prose.link_target(raw).alias("target"))


@query("SELECT id, path AS target FROM paths", "paths")
def fn37_wiki_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    raw = F.when(F.col("id") % 3 == 0, F.concat(p, F.lit("#head|alias"))).when(F.col("id") % 3 == 1, F.concat(p, F.lit(" | other"))).otherwise(p)
    return model.paths(spark, sf_dir).select("id", prose.wiki_target(raw).alias("target"))


@query("SELECT id, package || '/tail' AS package, 'tail' AS tail, CASE id % 3 WHEN 2 THEN '' ELSE 'T' || id END AS receiver, regexp_extract(qualified, '([^.]*)$', 1) AS bare FROM symbols", *_S)
def fn39_package_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    t = F.concat(F.lit("T"), i.cast("string"))
    full = F.when(i % 3 == 0, F.concat(F.lit("(*"), t, F.lit(")."), "name")).when(i % 3 == 1, F.concat(t, F.lit("."), "name")).otherwise(F.col("name"))
    package = F.concat("package", F.lit("/tail"))
    return model.symbols(spark, sf_dir).select("id", package.alias("package"), prose.package_tail(package).alias("tail"), prose.receiver(full).alias("receiver"), tx.bare_name(F.col("qualified")).alias("bare"))


@query("SELECT src, dst, kind, line, sha1(src || chr(0) || kind || chr(0) || dst || chr(0) || line) AS edge_id, concat_ws('::', 'm', src, kind) AS node_id FROM typed_edges", "typed_edges")
def fn41_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return model.typed_edges(spark, sf_dir).select("src", "dst", "kind", "line", prose.edge_id(c("src"), c("kind"), c("dst"), c("line")).alias("edge_id"), prose.node_id(F.lit("m"), c("src").cast("string"), c("kind")).alias("node_id"))


@query("SELECT id, substr(sha256(content), 1, 8) AS print FROM chunks", "chunks")
def fn42_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.chunks(spark, sf_dir).select("id", prose.fingerprint(F.col("content")).alias("print"))


@query("SELECT id, CASE WHEN in_degree <= 1 THEN 'Low' WHEN in_degree <= 4 THEN 'Medium' WHEN in_degree <= 10 THEN 'High' ELSE 'Critical' END AS level FROM symbols", *_S)
def fn44_risk_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.symbols(spark, sf_dir).select("id", tx.risk_level(F.col("in_degree")).alias("level"))


@query("SELECT id, CASE least(CASE WHEN id % 50 >= 30 THEN 2 WHEN id % 50 >= 10 THEN 1 ELSE 0 END + CASE WHEN substr(name, 1, 1) BETWEEN 'A' AND 'Z' THEN 1 ELSE 0 END, 2) WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS tier FROM symbols", *_S)
def fn45_hunk_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.symbols(spark, sf_dir).select("id", tx.hunk_risk(F.col("id") % 50, paths.exported(F.col("name"))).alias("tier"))


@query("""+f AS (SELECT id, name, in_degree, (id % 3)::BIGINT AS outd, (id % 4 % 3)::BIGINT AS pk, (id % 7) / 20 AS b FROM symbols) SELECT id, CASE WHEN in_degree = 0 AND outd = 0 AND pk = 0 AND b = 0 THEN '' WHEN in_degree >= 5 OR pk >= 2 THEN 'central:' || in_degree || CASE WHEN pk > 0 THEN '/' || pk || 'pkg' ELSE '' END
    WHEN b >= 0.1 THEN 'bridge:' || CAST(floor(b * 100) AS BIGINT) || '%' WHEN in_degree = 0 AND substr(name, 1, 1) BETWEEN 'A' AND 'Z' THEN 'exported-unused' WHEN outd = 0 AND in_degree > 0 THEN 'leaf' ELSE '' END AS role FROM f""", *_S)  # fmt: skip
def fn46_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    return model.symbols(spark, sf_dir).select("id", prose.role(F.col("name"), F.col("in_degree"), i % 3, i % 4 % 3, (i % 7) / 20).alias("role"))


@query("SELECT id, round(CASE WHEN id % 4 <= 1 OR in_degree <= 0 THEN 1 ELSE 1 + least(0.5, 0.5 * (1 - (id % 10) / 10) * in_degree / (in_degree + 20) * (id % 4 - 1)) END, 6)::DOUBLE AS factor FROM symbols", *_S)
def fn47_feedback_multiplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    return rounded(model.symbols(spark, sf_dir).select("id", telemetry.multiplier((i % 10) / 10, F.col("in_degree"), i % 4).alias("factor")), "factor")


@query("SELECT id, CASE WHEN id % 5 = 0 OR (id % 100) / 100 >= 0.58 OR id % 11 = 0 THEN 'high' WHEN (id % 100) / 100 >= 0.45 THEN 'medium' ELSE 'low' END AS level FROM symbols", *_S)
def fn48_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    return model.symbols(spark, sf_dir).select("id", prose.confidence((i % 5 == 0).cast("int"), (i % 100) / 100, i % 11 == 0).alias("level"))


@query("SELECT id, CASE greatest(id % 3, id % 2) WHEN 0 THEN 'exact' WHEN 1 THEN 'name-based' ELSE 'semantic' END AS provenance FROM symbols", *_S)
def fn49_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c: F.when(c == 0, "exact").when(c == 1, "name-based").otherwise("semantic")
    return model.symbols(spark, sf_dir).select("id", prose.weakest(name(F.col("id") % 3), name(F.col("id") % 2)).alias("provenance"))


@query("SELECT id, CAST(ceil(length(content) / 3.5) AS BIGINT) AS tokens FROM chunks", "chunks")
def fn50_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.chunks(spark, sf_dir).select("id", prose.token_estimate(F.col("content")).alias("tokens"))


@query(rf"+{_L}, r AS (SELECT id, line, text, sum(ceil(length(text) / 3.5)) OVER (PARTITION BY id ORDER BY line) AS used FROM lines) SELECT id, count(*) AS lines, max(used)::BIGINT AS tokens FROM r WHERE used <= 200 GROUP BY id", "chunks")
def fn52_clamp_to_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _lines(spark, sf_dir).select(F.col("id").alias("qid"), F.col("line").alias("rank"), prose.token_estimate(F.col("text")).alias("cost"))
    return lines.within_budget(r, 200).groupBy(F.col("qid").alias("id")).agg(F.count("*").alias("lines"), F.max("used").alias("tokens"))


@query(r"""WITH t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[\p{P}\p{S}]', '', 'g'), '\s+'), lambda x: x <> '') AS w FROM conversations), p AS (SELECT a.conv_id, a.turn, a.w AS a, b.w AS b FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
    x AS (SELECT conv_id, turn, unnest(a) AS w, 1 AS s FROM p UNION ALL SELECT conv_id, turn, unnest(b), 2 FROM p), c AS (SELECT conv_id, turn, w, count(*) FILTER (s = 1) AS x, count(*) FILTER (s = 2) AS y FROM x GROUP BY 1, 2, 3), s AS (SELECT conv_id, turn, sum(least(x, y)) AS shared FROM c GROUP BY 1, 2)
    SELECT p.conv_id, p.turn, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN CASE WHEN len(a) = len(b) THEN 1.0 ELSE 0.0 END ELSE 2.0 * shared / (len(a) + len(b)) END, 6)::DOUBLE AS f1, a = b AS exact FROM p LEFT JOIN s USING (conv_id, turn)""")  # fmt: skip
def fn53_answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _conversations(spark, sf_dir).select("conv_id", "turn", tx.answer_words(F.col("text")).alias("a"))
    p = c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b")), ["conv_id", "turn"])
    return rounded(p.select("conv_id", "turn", evaluation.token_f1(F.col("a"), F.col("b")).alias("f1"), (F.col("a") == F.col("b")).alias("exact")), "f1")


@query("SELECT id, CASE id % 3 WHEN 0 THEN name WHEN 1 THEN name ELSE 'Fix ' || name END AS subject FROM symbols", *_S)
def fn54_commit_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    raw = F.when(i % 3 == 0, F.concat(F.lit("feat(core)!: "), "name")).when(i % 3 == 1, F.concat(F.lit(" fix: "), "name", F.lit(" "))).otherwise(F.concat(F.lit("Fix "), "name"))
    return model.symbols(spark, sf_dir).select("id", prose.subject(raw).alias("subject"))


@query(rf"SELECT conv_id, turn, len({_WORDS}) >= 3 AND len(list_filter({_WORDS}, lambda x: regexp_matches(x, '[_/(){{}}\[\]<>=]|\w\.\w|[a-z][A-Z]'))) = 0 AS prose FROM conversations")
def fn55_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversations(spark, sf_dir).select("conv_id", "turn", prose.prose(F.col("text")).alias("prose"))


@query("SELECT id, CASE lower(regexp_extract(file, '\\.([^.]*)$', 1)) WHEN 'go' THEN 'go' WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'md' THEN 'markdown' END AS lang FROM symbols", *_S)
def fn56_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = paths.extension(F.col("file"))
    names = {e: name for name in ("markdown", "typescript", "python", "go") for e in paths.LANGUAGES[name].split()}
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return model.symbols(spark, sf_dir).select("id", F.try_element_at(table, ext).alias("lang"))


@query("SELECT id, CASE WHEN id % 3 < 2 THEN path END AS path, CASE WHEN id % 3 < 2 THEN (id % 90)::INTEGER END AS line FROM (SELECT id, path FROM paths WHERE regexp_matches(path, '^[A-Za-z0-9_./-]+\\.[A-Za-z0-9_]+$'))", "paths")
def fn57_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, p = F.col("id"), F.col("path")
    line = (i % 90).cast("string")
    raw = F.when(i % 3 == 0, F.concat(p, F.lit(":"), line)).when(i % 3 == 1, F.concat(F.lit("at "), p, F.lit(":"), line, F.lit(":7"))).otherwise("nothing here")
    r = model.paths(spark, sf_dir).where(p.rlike(r"^[A-Za-z0-9_./-]+\.[A-Za-z0-9_]+$")).select("id", prose.reference(raw).alias("r"))
    return r.select("id", "r.path", "r.line")


@query("SELECT id, CASE WHEN id % 2 > 0 THEN (id % 2)::DOUBLE WHEN id % 3 > 0 THEN (id % 3)::DOUBLE WHEN id % 5 > 0 THEN (id % 5)::DOUBLE ELSE -1.0 END AS score FROM symbols", *_S)
def fn59_display_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id").cast("double")
    return model.symbols(spark, sf_dir).select("id", prose.display_score(i % 2, i % 3, i % 5, F.lit(-1.0)).alias("score"))


# -- text passes ----------------------------------------------------------------------------------------------------------


@query("+s AS (SELECT id, content, regexp_replace(content, '[aeiou]', '', 'g') AS cut FROM chunks), t AS (SELECT *, ceil(length(content) / 3.5) AS a, ceil(length(cut) / 3.5) AS b FROM s) SELECT id, sha1(CASE WHEN b >= a OR (a < 2000 AND a - b < 0.05 * a) THEN content ELSE cut END) AS kept FROM t", "chunks")
def tx05_safeguard(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.regexp_replace("content", "[aeiou]", "")
    return model.chunks(spark, sf_dir).select("id", F.sha1(prose.safeguarded(F.col("content"), cut)).alias("kept"))


@query(rf"+{_L} SELECT id, line::INTEGER AS line FROM lines WHERE NOT (trim(text) = '' OR regexp_matches(trim(text), '^[-=_*#~]{{3,}}$'))", "chunks")
def tx08_decoration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).where(~lines.decoration(F.col("text"))).select("id", "line")


@query(rf"""+{_L}, g AS (SELECT id, substr(text, i, 3) AS g FROM (SELECT id, text, unnest(generate_series(1, length(text) - 2)) AS i FROM lines WHERE length(text) >= 3)), c AS (SELECT id, substr(g, 1, 2) AS ctx, g, count(*) AS n, sum(count(*)) OVER (PARTITION BY id, substr(g, 1, 2)) AS t FROM g GROUP BY 1, 2, 3)
    SELECT id, round(-sum(n * log2(n / t)) / sum(n) + 0, 6) AS bits FROM c GROUP BY id""", "chunks")  # fmt: skip
def tx11_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lines.cross_entropy(model.chunks(spark, sf_dir)), "bits")


@query(rf"+w AS (SELECT id, unnest(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]{{5,}}')) AS name FROM chunks), c AS (SELECT id, name, count(*) AS n, ceil(length(name) / 3.5) AS t FROM w GROUP BY 1, 2), g AS (SELECT id, name, CAST(n * (t - 1) - (t + 3) AS BIGINT) AS net FROM c WHERE n * (t - 1) - (t + 3) > 0), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY net DESC, name) AS place, count(*) OVER (PARTITION BY id) AS m FROM g) SELECT id, name, net, place FROM r WHERE m >= 3 AND place <= 23", "chunks")
def tx15_symbol_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.symbol_map(model.chunks(spark, sf_dir))


@query("SELECT id, round(2.5 + least(greatest(((id % 10) / 10 - 0.6) / 0.6, 0), 1), 6)::DOUBLE AS threshold FROM symbols", *_S)
def tx18_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(model.symbols(spark, sf_dir).select("id", lines.threshold((F.col("id") % 10) / 10).alias("threshold")), "threshold")


_NORM = r"regexp_replace(regexp_replace(regexp_replace(text, '\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?', '[TS]', 'g'), '\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b', '[UUID]', 'g'), '\b[0-9a-fA-F]{16,64}\b', '[HASH]', 'g')"


@query(f"+{_L}, n AS (SELECT *, {_NORM} AS norm FROM lines), r AS (SELECT *, sum(CASE WHEN norm IS NOT DISTINCT FROM prev THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY line) AS run FROM (SELECT *, lag(norm) OVER (PARTITION BY id ORDER BY line) AS prev FROM n)), c AS (SELECT id, count(*) AS before, count(DISTINCT run) AS after FROM r GROUP BY id) SELECT id, before, after FROM c WHERE before >= 10 AND after < before", "chunks")
def tx19_log_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.log_dedup(_lines(spark, sf_dir))


@query(rf"+{_L}, f AS (SELECT id, line, text, trim(text) = '' OR regexp_matches(trim(text), '^[-=_*#~]{{3,}}$') OR regexp_matches(trim(text), '^(commit [0-9a-f]{{7,40}}|diff --git|--- a/|\+\+\+ b/|index )') AS b, regexp_matches(text, '(?i)(error|warn|fatal|panic|exception|traceback|crash)') AS e FROM lines), k AS (SELECT id FROM f GROUP BY id HAVING count(*) >= 20 AND avg(CASE WHEN e THEN 1 ELSE 0 END) >= 0.2), g AS (SELECT id, line, {_NORM} AS norm, sum(CASE WHEN b THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY line) AS block FROM f WHERE id IN (SELECT id FROM k)) SELECT id, count(*) AS before, count(DISTINCT (block, norm)) AS after FROM g GROUP BY id", "chunks")
def tx20_log_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.log_blocks(_lines(spark, sf_dir))


# -- windows --------------------------------------------------------------------------------------------------------------


@query(f"+{_L}, w AS (SELECT id, line, unnest(list_distinct(list_transform(generate_series(1, greatest(length(text) - 2, 0)), lambda i: text[i:i + 2]))) AS g FROM lines), s AS (SELECT a.id, a.line, count(DISTINCT b.g) AS around FROM lines a JOIN w b ON b.id = a.id AND b.line BETWEEN a.line - 3 AND a.line + 3 AND b.line <> a.line GROUP BY 1, 2) SELECT l.id, l.line::INTEGER AS line, coalesce(around, 0)::INTEGER AS around FROM lines l LEFT JOIN s USING (id, line) WHERE l.id % 20 = 0", "chunks")
def wn12_trigram_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.around_trigrams(lines.lines(model.chunks(spark, sf_dir).where("id % 20 = 0")), 3).select("id", "line", F.size("around").alias("around"))


@query("+r AS (SELECT dir AS qid, id, row_number() OVER (PARTITION BY dir ORDER BY id) AS rank, length(content) AS cost FROM chunks), s AS (SELECT *, sum(cost) OVER (PARTITION BY qid ORDER BY rank) AS used FROM r) SELECT qid, id, used::BIGINT AS used FROM s WHERE used <= 20000", "chunks")
def wn14_budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = model.chunks(spark, sf_dir).select(F.col("dir").alias("qid"), "id", F.length("content").alias("cost"))
    r = c.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("id")))
    return lines.within_budget(r, 20000).select("qid", "id", "used")


@query("SELECT event_id, count(*) OVER (PARTITION BY session ORDER BY us RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW) AS calls FROM tool_events", "tool_events")
def wn15_rolling_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.rolling_calls(model.tool_events(spark, sf_dir), ["session"], 300).select("event_id", "calls")


# -- retrieval lanes ------------------------------------------------------------------------------------------------------

_HITS = "hits AS (SELECT id % 10 AS qid, path, dir, 1 AS start_line, (length(content) % 1000) / 1000 AS score, row_number() OVER (PARTITION BY id % 10 ORDER BY (length(content) % 1000) DESC, id) AS rank FROM chunks WHERE id % 4 < 2), second AS (SELECT id % 10 AS qid, path, dir, 1 AS start_line, row_number() OVER (PARTITION BY id % 10 ORDER BY end_line DESC, id) AS rank FROM chunks WHERE id % 4 IN (1, 2))"


def _hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = model.chunks(spark, sf_dir).withColumn("qid", F.col("id") % 10).withColumn("n", F.length("content") % 1000).withColumn("score", F.col("n") / 1000)
    w = Window.partitionBy("qid")
    a = c.where("id % 4 < 2").withColumn("rank", F.row_number().over(w.orderBy(F.col("n").desc(), "id")))
    b = c.where("id % 4 IN (1, 2)").withColumn("rank", F.row_number().over(w.orderBy(F.col("end_line").desc(), "id")))
    return a.select("qid", "path", "dir", "start_line", "score", "rank"), b.select("qid", "path", "dir", "start_line", "rank")


@query(f"+{_HITS}, r AS (SELECT qid, path, start_line, 1.0 / (60 + rank) AS s, 1 AS lane FROM hits UNION ALL SELECT qid, path, start_line, 1.0 / (60 + rank), 4 FROM second) SELECT qid, path, start_line, round(sum(s), 9)::DOUBLE AS score, sum(lane)::BIGINT AS lanes FROM r GROUP BY 1, 2, 3", "chunks")
def rt12_symbol_lane_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _hits(spark, sf_dir)
    return rounded(lanes.keyed_rrf([(a, 1.0, 1), (b, 1.0, 4)], ["qid", "path", "start_line"]), "score", digits=9)


@query(f"+{_HITS}, g AS (SELECT dir, min(start_line) AS hop FROM second GROUP BY dir), r AS (SELECT qid, path, 1.0 / (60 + rank) + coalesce(pow(0.6, g.hop) / (60 + rank), 0) AS s FROM hits LEFT JOIN g USING (dir)) SELECT qid, path, round(s, 9) AS score FROM r", "chunks")
def rt13_graph_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _hits(spark, sf_dir)
    hops = b.groupBy("dir").agg(F.min("start_line").alias("hop"))
    return rounded(lanes.graph_boosted(a, hops, 0.6), "score", digits=9)


@query(f"+{_HITS}, recent AS (SELECT DISTINCT dir FROM chunks ORDER BY dir LIMIT 20) SELECT qid, path, round(1.0 / (60 + rank) + CASE WHEN dir IN (SELECT dir FROM recent) THEN 1.0 / 60 ELSE 0 END, 9)::DOUBLE AS score FROM hits", "chunks")
def rt09_session_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, _ = _hits(spark, sf_dir)
    recent = model.chunks(spark, sf_dir).select("dir").distinct().orderBy("dir").limit(20)
    return rounded(lanes.with_bonus(lanes.rrf_score(a), recent.withColumn("bonus", F.lit(1 / 60)), "dir").select("qid", "path", "score"), "score", digits=9)


@query(f"+{_HITS}, w AS (SELECT dir, max(end_line) AS w FROM chunks GROUP BY dir ORDER BY w DESC, dir LIMIT 16), n AS (SELECT dir, w / max(w) OVER () AS w FROM w) SELECT qid, path, round(1.0 / (60 + rank) + coalesce(w, 0) * 0.5 / 60, 9) AS score FROM hits LEFT JOIN n USING (dir)", "chunks")
def rt10_coaccess_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, _ = _hits(spark, sf_dir)
    w = model.chunks(spark, sf_dir).groupBy("dir").agg(F.max("end_line").alias("w")).orderBy(F.col("w").desc(), "dir").limit(16)
    share = w.withColumn("bonus", F.col("w") / F.max("w").over(Window.partitionBy(F.lit(1))) * 0.5 / 60)  # 16 rows
    return rounded(lanes.with_bonus(lanes.rrf_score(a), share, "dir").select("qid", "path", "score"), "score", digits=9)


@query(f"+{_HITS}, t AS (SELECT DISTINCT qid, dir, path FROM hits) SELECT qid, path, round(score + CASE WHEN dir IN (SELECT dir FROM chunks ORDER BY id LIMIT 1) THEN 20.0 / 60 ELSE 0 END, 9)::DOUBLE AS score FROM hits", "chunks")
def rt11_bonus_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, _ = _hits(spark, sf_dir)
    first = model.chunks(spark, sf_dir).orderBy("id").limit(1).select("dir", F.lit(1 / 60).alias("bonus"))
    return rounded(lanes.with_bonus(a, first, "dir", scale=20.0).select("qid", "path", "score"), "score", digits=9)


@query(f"""+{_HITS}, s AS (SELECT dir AS path, 1.0 AS a, 0 AS turn FROM (SELECT DISTINCT dir FROM chunks WHERE id % 20 = 0) UNION ALL SELECT dir, 0.8, 1 FROM (SELECT DISTINCT dir FROM chunks WHERE id % 7 = 0) UNION ALL SELECT dir, max(score) / (SELECT max(score) FROM hits), 2 FROM hits GROUP BY dir)
    SELECT path, round(arg_min(a, turn), 6)::DOUBLE AS activation FROM s GROUP BY path""", "chunks")  # fmt: skip
def rt14_activation_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, _ = _hits(spark, sf_dir)
    c = model.chunks(spark, sf_dir)
    some = lambda m: c.where(F.col("id") % m == 0).select(F.col("dir").alias("path")).distinct()
    return rounded(lanes.activation_seeds(some(20), some(7), a.select(F.col("dir").alias("path"), "score")), "activation")


@query("+v AS (SELECT vec_id AS id, embedding FROM embeddings), q AS (SELECT embedding AS e FROM v WHERE id = 3) SELECT id, round(list_sum(list_transform(list_zip(e, embedding), lambda x: CAST(x[1] AS DOUBLE) * x[2])) / sqrt(list_sum(list_transform(e, lambda x: CAST(x AS DOUBLE) * x)) * list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS score FROM v, q WHERE id <> 3 ORDER BY round(score, 9) DESC, id LIMIT 10".replace("+v AS", "WITH v AS", 1))
def rt02_related_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sy.related_chunks(model.vectors(spark, sf_dir), 3, 10), "score")


@query("""WITH e AS (SELECT x.vec_id AS a, y.vec_id AS b, list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda p: CAST(p[1] AS DOUBLE) * p[2])) / sqrt(list_sum(list_transform(x.embedding, lambda p: CAST(p AS DOUBLE) * p)) * list_sum(list_transform(y.embedding, lambda p: CAST(p AS DOUBLE) * p))) AS s FROM embeddings x, embeddings y WHERE x.vec_id <> y.vec_id AND x.vec_id % 20 = 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(s, 9) DESC, b) AS r FROM e) SELECT least(a, b) AS a, greatest(a, b) AS b, round(max(s), 6) AS similarity FROM k WHERE r <= 11 AND s >= 0.3 GROUP BY 1, 2""")  # fmt: skip
def jn13_similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = model.vectors(spark, sf_dir)
    return rounded(lanes.similar_pairs(v, v.where("id % 20 = 0"), 10, 0.3), "similarity")


@query("SELECT kind AS intent, count(*) AS n, CASE kind WHEN 'function' THEN 120 WHEN 'method' THEN 60 ELSE 120 END AS max_lines, CASE kind WHEN 'function' THEN 40 WHEN 'method' THEN 20 ELSE 28 END AS max_kb FROM symbols GROUP BY kind", *_S)
def rt25_policy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = lanes.policy_table(spark, {"function": "dense", "method": "targeted"}, "assemble", model.symbols(spark, sf_dir).select(F.col("kind").alias("intent")))
    return table.groupBy("intent").agg(F.count("*").alias("n"), F.first("max_lines").alias("max_lines"), F.first("max_kb").alias("max_kb"))


# -- evaluation -----------------------------------------------------------------------------------------------------------

_REPORT = "WITH m AS (SELECT o_custkey AS qid, o_orderpriority AS type, (o_orderkey % 2) AS run, avg(o_totalprice) / 400000 AS ndcg FROM orders GROUP BY 1, 2, 3), a AS (SELECT qid, type, ndcg FROM m WHERE run = 0), b AS (SELECT qid, type, ndcg FROM m WHERE run = 1)"


def _reports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = model.read(spark, sf_dir, "orders")
    m = o.groupBy(F.col("o_custkey").alias("qid"), F.col("o_orderpriority").alias("type"), (F.col("o_orderkey") % 2).alias("run")).agg((F.avg("o_totalprice") / 400000).alias("ndcg"))
    return m.where("run = 0").drop("run"), m.where("run = 1").drop("run")


@query(_REPORT + " SELECT coalesce(a.qid, b.qid) AS qid, round(a.ndcg, 4) AS now, round(b.ndcg, 4) AS before, CASE WHEN b.ndcg IS NULL THEN 'only_now' WHEN a.ndcg IS NULL THEN 'only_before' WHEN a.ndcg < b.ndcg - 0.01 THEN 'worse' WHEN a.ndcg > b.ndcg + 0.01 THEN 'better' ELSE 'same' END AS state FROM (SELECT qid, max(ndcg) AS ndcg FROM a GROUP BY 1) a FULL JOIN (SELECT qid, max(ndcg) AS ndcg FROM b GROUP BY 1) b ON a.qid = b.qid")
def ev10_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (x.groupBy("qid").agg(F.max("ndcg").alias("ndcg")) for x in _reports(spark, sf_dir))
    return rounded(evaluation.regressions(a, b), "now", "before", digits=4)


@query(_REPORT + " SELECT type, count(*) AS n, round(avg(a.ndcg - b.ndcg), 6) AS change, avg(a.ndcg - b.ndcg) < -0.01 AS worse FROM a JOIN b USING (qid, type) GROUP BY type HAVING count(*) >= 5")
def ev11_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.type_regressions(*_reports(spark, sf_dir), 0.01, 5), "change")


@query("SELECT sha256(string_agg(text, chr(10) ORDER BY text)) AS hash, count(*) AS n FROM (SELECT DISTINCT text FROM benchmark WHERE text IS NOT NULL)")
def ev12_query_set_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.query_set_hash(model.read(spark, sf_dir, "benchmark"))


_TOK = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: length(x) >= 3))"


@query(f"""WITH p AS (SELECT a.conv_id, a.turn, a.text AS answer, b.text AS evidence FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1), s AS (SELECT conv_id, turn, unnest(regexp_split_to_array(answer, '[.!?]+')) AS sentence, {_TOK.format('evidence')} AS e FROM p),
    t AS (SELECT conv_id, turn, {_TOK.format('sentence')} AS w, e FROM s), g AS (SELECT conv_id, turn, len(list_intersect(w, e)) >= 0.5 * len(w) AS ok FROM t WHERE len(w) >= 3 AND len(e) > 0)
    SELECT conv_id, turn, count(*) AS scored, count(*) FILTER (ok) AS grounded FROM g GROUP BY 1, 2""")  # fmt: skip
def ev13_faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _conversations(spark, sf_dir)
    p = c.select("conv_id", "turn", F.col("text").alias("answer")).join(c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("evidence")), ["conv_id", "turn"])
    return evaluation.grounded(p, ["conv_id", "turn"])


@query("WITH f AS (SELECT l_orderkey AS id, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) SELECT o_orderkey AS id, min(l_suppkey) AS first FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN f ON f.id = o_orderkey WHERE n BETWEEN 1 AND 5 AND length(o_orderpriority) >= 5 GROUP BY o_orderkey")
def ev03_golden_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = model.commits(spark, sf_dir)
    o = model.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit"), F.col("o_orderpriority").alias("subject"))
    return evaluation.golden_commits(o, li, 5, 5, distinct=False).select(F.col("commit").alias("id"), F.col("files")[0].alias("first"))


@query("""+c AS (SELECT *, count(*) OVER (PARTITION BY commit_id) AS n FROM commits QUALIFY n BETWEEN 2 AND 4), o AS (SELECT a.commit_id, a.file AS anchor, string_agg(b.file::VARCHAR, ',' ORDER BY b.file) AS others FROM c a JOIN c b ON a.commit_id = b.commit_id AND a.file <> b.file GROUP BY 1, 2) SELECT anchor, others, min(commit_id) AS commit FROM o GROUP BY 1, 2""", "commits")
def ev04_blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.blast_radius(model.commits(spark, sf_dir), 4)


@query("SELECT item_id AS id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' WHEN row_number() OVER (PARTITION BY text ORDER BY item_id) > 1 THEN 'duplicate' WHEN length(text) < 60 THEN 'short' ELSE 'ok' END AS verdict FROM benchmark")
def ev07_golden_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.validated(model.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"), 60)


@query("SELECT l_returnflag AS repo, l_linestatus AS set_name, count(*) AS n, round(avg(l_discount), 6) AS mean FROM lineitem GROUP BY 1, 2")
def ev23_corpus_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = model.read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("repo"), F.col("l_linestatus").alias("set_name"))
    return rounded(li.agg(F.count("*").alias("n"), F.avg("l_discount").alias("mean")), "mean")


@query("+r AS (SELECT id % 10 AS qid, id, row_number() OVER (PARTITION BY id % 10 ORDER BY length(content) DESC, id) AS rank, ceil(length(content) / 3.5) AS cost FROM chunks), g AS (SELECT qid, min(rank) AS first FROM r WHERE id % 7 = 0 GROUP BY qid) SELECT qid, first, CAST(1 + first AS BIGINT) AS calls, sum(cost)::BIGINT AS tokens FROM r JOIN g USING (qid) WHERE rank <= first GROUP BY 1, 2", "chunks")
def ev17_nav_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = model.chunks(spark, sf_dir).select((F.col("id") % 10).alias("qid"), "id", F.length("content").alias("n"), prose.token_estimate(F.col("content")).alias("cost"))
    r = c.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("n").desc(), "id")).cast("long"))
    return evaluation.navigation(r, r.where("id % 7 = 0").select("qid", "id"))


# -- telemetry and sinks --------------------------------------------------------------------------------------------------


@query("+p AS (SELECT path, sum(1) AS n, max(us) AS us FROM tool_events WHERE path IS NOT NULL GROUP BY path), d AS (SELECT path, n * exp(-((SELECT max(us) FROM p) - us) / 1e6 * ln(2) / 604800) AS w FROM p) SELECT path, round(w, 6) AS weight FROM d WHERE w >= 5", "tool_events")
def sm07_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = model.tool_events(spark, sf_dir).where("path IS NOT NULL").groupBy("path").agg(F.count("*").alias("weight"), F.max("us").alias("us"))
    return rounded(telemetry.faded(p, 5.0).select("path", "weight"), "weight")


@query("SELECT session, path, max(us) AS touched, count(*) AS touches FROM tool_events WHERE path IS NOT NULL GROUP BY 1, 2", "tool_events")
def sm08_session_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.tool_events(spark, sf_dir).where("path IS NOT NULL").groupBy("session", "path").agg(F.max("us").alias("touched"), F.count("*").alias("touches"))


@query("+n AS (SELECT session, event_id, path, row_number() OVER (PARTITION BY session ORDER BY us, event_id) AS turn, row_number() OVER (PARTITION BY session, path ORDER BY us, event_id) AS nth FROM tool_events WHERE path IS NOT NULL), f AS (SELECT session, path, turn AS first FROM n WHERE nth = 1) SELECT event_id, turn, first AS seen_at FROM n JOIN f USING (session, path) WHERE nth > 1", "tool_events")
def sm09_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.seen_again(model.tool_events(spark, sf_dir))


@query("+n AS (SELECT *, lead(event) OVER (PARTITION BY session, path ORDER BY us, event_id) AS later FROM tool_events WHERE path IS NOT NULL) SELECT path, count(*) AS bounces FROM n WHERE event = 'ask' AND later = 'consume' GROUP BY path", "tool_events")
def sm10_bounces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.bounces(model.tool_events(spark, sf_dir), "ask", "consume")


@query("SELECT id, kind || chr(10) || path || chr(10) || content AS text FROM (SELECT id, kind, path, substr(content, 1, 100) AS content FROM chunks)", "chunks")
def sc18_embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = model.chunks(spark, sf_dir).withColumn("content", F.substring("content", 1, 100))
    return c.select("id", tables.embed_text(c).alias("text"))


@query("+c AS (SELECT id, sha1(content) AS sha FROM chunks), k AS (SELECT sha1(content) AS sha, min(id) AS vec FROM chunks WHERE id % 2 = 0 GROUP BY 1) SELECT c.id, vec, vec IS NOT NULL AS hit FROM c LEFT JOIN k USING (sha)", "chunks")
def sc22_vector_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = model.chunks(spark, sf_dir).select("id", F.sha1("content").alias("sha"))
    return tables.cached(c, c.where("id % 2 = 0").groupBy("sha").agg(F.min("id").alias("vec")), "sha").select("id", "vec", "hit")


@query("SELECT path, round(0.25 * pow(2.0, -((SELECT max(us) FROM tool_events) - max(us)) / 3.6e9 / 48) + CASE WHEN bool_or(event = 'other') THEN 0.1 ELSE 0 END, 6) AS bonus FROM tool_events WHERE path IS NOT NULL AND us >= (SELECT max(us) FROM tool_events) - 14 * 86400000000 GROUP BY path", "tool_events")
def sc26_recency_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(telemetry.recent_files(model.tool_events(spark, sf_dir), F.col("event") == "other"), "bonus")


@query("SELECT dir, id, row_number() OVER (PARTITION BY dir ORDER BY start_line, id) AS place FROM chunks", "chunks")
def sc35_chunk_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sy.placed(model.chunks(spark, sf_dir), ["dir"], [F.col("start_line"), F.col("id")]).select("dir", "id", "place")


@query("SELECT count(*) AS edges, count(*) FILTER (src % 3 > 0 AND dst % 3 > 0) AS kept FROM typed_edges", "typed_edges")
def sc37_view_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = model.typed_edges(spark, sf_dir)
    view = tables.without_dangling(e, model.symbols(spark, sf_dir).where("id % 3 > 0"))
    return e.agg(F.count("*").alias("edges")).crossJoin(F.broadcast(view.agg(F.count("*").alias("kept"))))  # one row each


@query("SELECT id, path FROM paths WHERE NOT starts_with(path, (SELECT min(regexp_replace(path, '/.*$', '')) FROM paths) || '/')", "paths")
def sc44_delete_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = model.paths(spark, sf_dir)
    first = p.agg(F.min(F.regexp_replace("path", "/.*$", ""))).first()[0]
    return tables.without_prefix(p, first + "/").select("id", "path")


@query("""+o AS (SELECT id, name AS hash, CAST(1 AS BIGINT) AS seen FROM symbols WHERE id % 3 <> 0), n AS (SELECT id, CASE WHEN id % 5 = 0 THEN upper(name) ELSE name END AS hash FROM symbols WHERE id % 2 = 0)
    SELECT coalesce(n.id, o.id) AS id, coalesce(n.hash, o.hash) AS hash, CASE WHEN n.id IS NULL THEN 1 ELSE 2 END::BIGINT AS seen, CASE WHEN n.id IS NULL THEN 'kept' WHEN o.id IS NULL THEN 'inserted' WHEN o.hash = n.hash THEN 'touched' ELSE 'updated' END AS action FROM o FULL JOIN n ON o.id = n.id""", *_S)  # fmt: skip
def sc45_node_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = model.symbols(spark, sf_dir)
    old = s.where("id % 3 <> 0").select("id", F.col("name").alias("hash"), F.lit(1).cast("long").alias("seen"))
    new = s.where("id % 2 = 0").select("id", F.when(F.col("id") % 5 == 0, F.upper("name")).otherwise(F.col("name")).alias("hash"))
    return tables.upserted(old, new, 2)


@query("SELECT id, seen FROM (SELECT id, (id % 10) AS seen FROM symbols) WHERE seen >= 4", *_S)
def sc46_graph_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources import ingest

    return ingest.pruned(model.symbols(spark, sf_dir).select("id", (F.col("id") % 10).alias("seen")), 4)


@query("SELECT id, CASE WHEN id % 2 = 0 THEN round(rank * 2, 6) ELSE round(rank, 6) END AS rank FROM symbols", *_S)
def sc47_centrality_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = model.symbols(spark, sf_dir).select("id", "rank")
    return rounded(tables.replaced(s, s.where("id % 2 = 0").select("id", (F.col("rank") * 2).alias("rank")), "id", ["rank"]), "rank")


@query("+c AS (SELECT id, path, length(content) AS n, sum(length(content)) OVER (ORDER BY id) AS used FROM chunks) SELECT id, used::BIGINT AS used FROM c WHERE used <= 100000", "chunks")
def sc50_compact_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.dump_prefix(model.chunks(spark, sf_dir).select("id", F.length("content").alias("n")), "id", 100_000).select("id", "used")


@query("+h AS (SELECT dir AS path, sha256(string_agg(sha1(content), chr(10) ORDER BY sha1(content))) AS hash FROM chunks GROUP BY dir), o AS (SELECT path, CASE WHEN length(path) % 2 = 0 THEN hash ELSE 'old' END AS hash FROM h) SELECT h.path, h.hash <> o.hash AS stale FROM h JOIN o USING (path)", "chunks")
def sc51_stale_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources import ingest

    h = ingest.directory_hashes(model.chunks(spark, sf_dir).select("dir", F.sha1("content").alias("sha"))).withColumnRenamed("dir", "path")
    old = h.select("path", F.when(F.length("path") % 2 == 0, F.col("hash")).otherwise("old").alias("hash"))
    return tables.stale(h, old)


@query("SELECT path, CASE WHEN regexp_matches(text, '-----BEGIN') THEN true ELSE regexp_matches(text, 'AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{82}|xox[baprs]-[A-Za-z0-9-]{10,}|\\bsk-(?:proj-)?[A-Za-z0-9_-]{20,}|AIza[0-9A-Za-z_-]{35}|sk_live_[0-9a-zA-Z]{24,}|rk_live_[0-9a-zA-Z]{24,}|glpat-[A-Za-z0-9_-]{20,}|SG\\.[A-Za-z0-9_-]{22,}\\.[A-Za-z0-9_-]+') END AS secret FROM (SELECT path, substr(content, 1, 65536) AS text FROM chunks)", "chunks")
def sc07_secret_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.chunks(spark, sf_dir).select("path", tx.has_secret(F.col("content")).alias("secret"))


@query("SELECT path, contains(substr(content, 1, 8192), chr(0)) AS binary_text FROM chunks", "chunks")
def sc06_binary_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources import ingest

    return model.chunks(spark, sf_dir).select("path", ingest.binary(F.col("content")).alias("binary_text"))
