"""Scores, reductions and classes of lines, texts and questions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of little content, and short forms of long words.
FUNCTION_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might shall can to of in on at by for with "
    "from as or and but not it its this that these those which who whom what so if"
).split()
ABBREVIATIONS = dict(x.split(":") for x in (
    "configuration:cfg directory:dir maximum:max minimum:min function:fn parameter:param parameters:params argument:arg arguments:args message:msg "
    "messages:msgs response:resp responses:resps request:req requests:reqs implementation:impl implementations:impls information:info number:num "
    "numbers:nums boolean:bool database:db databases:dbs environment:env environments:envs temporary:tmp address:addr addresses:addrs "
    "connection:conn connections:conns timeout:tmo timestamp:ts pointer:ptr buffer:buf buffers:bufs iterator:iter"
).split())
#: What makes a line a marker, and words that open a line of code.
MARKER_WORDS = "error|warn|fail|fatal|panic|exception|critical|abort|traceback"
PATH_SHAPE = r"\w+/\w[^/\s]*\.\w+"
#: Words that ask where something is, and phrases that ask how something is built.
LOOKUP_WORDS = "where is defined declared located implemented find locate what the are function method struct type class interface in at".split()
STRUCTURE_PHRASES = "how does|how is|architecture|design pattern|data flow|control flow|module structure|component"
#: Names of environment variables whose values are secret.
SECRET_KEYS = "KEY SECRET TOKEN PASSWORD PASSWD PASSPHRASE CREDENTIALS AUTH API_KEY PRIVATE CERT DSN CONNECTION SALT SESSION PEM SIGNING ENCRYPTION".split()
#: Fixed value: the marks before the subject of a commit.
COMMIT_PREFIX = r"^[a-z]+(\([^)]*\))?!?:\s*"
#: What opens a block of a log.
BLOCK_START = r"^(commit [0-9a-f]{7,40}|diff --git|--- a/|\+\+\+ b/|index )"


def line_weight(line: Column) -> Column:
    """How much attention a line of code deserves."""
    t = F.trim(F.regexp_replace(line, r"\s", " "))
    low = F.lower(t)
    opens = lambda *words: low.rlike("^(?:" + "|".join(words) + ")")
    return (
        F.when(t == "", 0.0).when(low.rlike("error|panic|fatal|exception|stderr"), 2.0).when(opens("import ", "from ", r"require\(", "#include", "use "), 1.6)
        .when(opens("func ", "function ", "def ", "class ", "type ", "struct ", "interface ", "enum ", "pub fn ", "fn "), 1.5)
        .when((F.length(t) > 1) & t.rlike(r"^(?://|#|\*|/\*\*)"), 1.2).when(opens("return ", "yield "), 1.0).when(opens("if ", "for ", "while ", "switch ", "match "), 0.9)
        .when(opens("assert", r"expect\(", r"test\(", r"it\(", r"describe\("), 0.8).when(t.isin("}", ")", "]"), 0.3).otherwise(0.5)
    )


def importance(text: Column) -> Column:
    """The mean weight of the lines."""
    rows = F.split(text, "\n")
    return F.aggregate(F.transform(rows, line_weight), F.lit(0.0), lambda s, x: s + x) / F.size(rows)


def marker_score(line: Column) -> Column:
    """0.3 for a line with a path, a digit, a word of failure, or two words of six letters or more."""
    long_words = F.size(F.filter(F.split(line, r"\s+"), lambda w: F.length(F.regexp_replace(w, "[^A-Za-z]", "")) >= 6)) >= 2
    return F.when(line.rlike(PATH_SHAPE) | line.rlike("[0-9]") | F.lower(line).rlike(MARKER_WORDS) | long_words, 0.3).otherwise(0.0)


def unique_ratio(text: Column) -> Column:
    """Distinct words over words; 0 without words."""
    w = F.array_remove(F.split(text, r"\s+"), "")
    return F.when(F.size(w) > 0, F.size(F.array_distinct(w)) / F.size(w)).otherwise(F.lit(0.0))


def without_function_words(line: Column, more_than: int = 20) -> Column:
    """A line of more than so many words without those of little content; others stay."""
    w = F.array_remove(F.split(line, r"\s+"), "")
    return F.when(F.size(w) > more_than, F.array_join(F.filter(w, lambda x: ~F.lower(x).isin(FUNCTION_WORDS)), " ")).otherwise(line)


def abbreviated(line: Column) -> Column:
    """Words with a short form in it; marks at their ends and a capital stay."""
    table = F.create_map(*(F.lit(x) for pair in ABBREVIATIONS.items() for x in pair))

    def short(w: Column) -> Column:
        stem, tail = F.regexp_extract(w, r"^(.*?)([.,;:!?)]*)$", 1), F.regexp_extract(w, r"^(.*?)([.,;:!?)]*)$", 2)
        s = F.try_element_at(table, F.lower(stem))
        capital = F.when(stem.rlike("^[A-Z]"), F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 20))).otherwise(s)
        return F.when(s.isNotNull(), F.concat(capital, tail)).otherwise(w)

    return F.array_join(F.transform(F.split(line, " "), short), " ")


def token_estimate(text: Column) -> Column:
    """Tokens by the number of characters."""
    return F.ceil(F.length(text) / 3.5)


def safeguarded(original: Column, shorter: Column) -> Column:
    """The shorter text, unless it isn't, or saves less than 5 % of under 2000 tokens."""
    a, b = token_estimate(original), token_estimate(shorter)
    return F.when((b >= a) | ((a < 2000) & ((a - b) < 0.05 * a)), original).otherwise(shorter)


def identifier(token: Column) -> Column:
    """Whether a word of a question has the shape of a name in code."""
    t = F.regexp_replace(F.regexp_replace(token, r"^[(*&]+", ""), r"\)+$", "")
    return t.rlike(r"^[A-Za-z0-9_.:\-()*&]+$") & (t.rlike("[A-Z]") | t.rlike(r"[._:]"))


def definition_query(words: Column) -> Column:
    """One identifier, and else only words that ask where it is."""
    names = F.size(F.filter(words, identifier))
    rest = F.forall(words, lambda w: identifier(w) | F.lower(w).isin(LOOKUP_WORDS))
    return (names == 1) & rest


def query_type(question: Column) -> Column:
    """symbol, architecture or nl."""
    words, low = F.array_remove(F.split(question, r"\s+"), ""), F.lower(question)
    where = low.rlike("where is|where are")
    names = F.forall(words, identifier) & F.size(words).isin(1, 2)
    return (
        F.when(F.size(words) == 0, "nl").when(where, F.when(definition_query(words), "symbol").otherwise("architecture"))
        .when(low.rlike(STRUCTURE_PHRASES), "architecture").when(names | definition_query(words), "symbol").otherwise("nl")
    )


def rrf_weights(kind: Column) -> tuple[Column, Column]:
    """Weights of the lexical and the dense leg by query type."""
    return F.when(kind == "symbol", 1.4).when(kind == "architecture", 0.6).otherwise(1.0), F.when(kind == "symbol", 0.6).when(kind == "architecture", 1.4).otherwise(1.0)


def secret_key(name: Column) -> Column:
    return F.upper(name).rlike("|".join(SECRET_KEYS))


def env_line(line: Column) -> Column:
    """KEY=value with the value hidden where the key, or the value itself, is secret; passwords in URLs as well."""
    from .text import has_secret, redact_urls

    key, value = F.regexp_extract(line, "^([^=]+)=(.*)$", 1), F.regexp_extract(line, "^([^=]+)=(.*)$", 2)
    return F.when(key == "", line).when(secret_key(key) | has_secret(value), F.concat(key, F.lit("=***"))).otherwise(F.concat(key, F.lit("="), redact_urls(value)))


def subject(text: Column) -> Column:
    """A commit's subject without its conventional prefix."""
    return F.trim(F.regexp_replace(F.trim(text), COMMIT_PREFIX, ""))


def prose(text: Column) -> Column:
    """Three words or more, none of which has the shape of code."""
    w = F.array_remove(F.split(text, r"\s+"), "")
    return (F.size(w) >= 3) & ~F.exists(w, lambda x: x.rlike(r"[_/(){}\[\]<>=]|\w\.\w|[a-z][A-Z]"))


def reference(text: Column) -> Column:
    """path and line of a reference path:line[:column], or nulls."""
    at = r"([\w./-]+\.\w+):(\d+)"
    path, line = F.regexp_extract(text, at, 1), F.regexp_extract(text, at, 2)
    return F.struct(F.when(path != "", path).alias("path"), F.when(path != "", F.try_to_number(line, F.lit("999999999"))).cast("int").alias("line"))


def link_target(text: Column) -> Column:
    """The file that a markdown link names: without <>, title and anchor; empty for other sites."""
    t = F.regexp_replace(F.trim(text), r"^<([^>]*)>.*$", "$1")
    t = F.regexp_replace(F.regexp_replace(t, r"\s+[\"'(].*$", ""), "#.*$", "")
    return F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:|^//"), "").otherwise(t)


def wiki_target(text: Column) -> Column:
    """The note that a wikilink names: without alias and anchor."""
    return F.trim(F.split_part(F.split_part(text, F.lit("|"), F.lit(1)), F.lit("#"), F.lit(1)))


def package_tail(package: Column) -> Column:
    return F.regexp_extract(package, r"([^/]*)$", 1)


def receiver(qualified: Column) -> Column:
    """T of (*T).name or T.name; empty for others."""
    return F.regexp_extract(qualified, r"^\(?\*?([A-Za-z_]\w*)\)?\.", 1)


def node_id(*parts: Column) -> Column:
    return F.concat_ws("::", *parts)


def edge_id(*parts: Column) -> Column:
    """The digest of the parts with a zero byte between them."""
    return F.sha1(F.concat_ws("\0", *(p.cast("string") for p in parts)))


def fingerprint(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 8)


def role(name: Column, in_degree: Column, out_degree: Column, packages: Column, between: Column) -> Column:
    """central, bridge, exported-unused or leaf, with numbers; empty without any edge."""
    none = (in_degree == 0) & (out_degree == 0) & (packages == 0) & (between == 0)
    central = F.concat(F.lit("central:"), in_degree.cast("string"), F.when(packages > 0, F.concat(F.lit("/"), packages.cast("string"), F.lit("pkg"))).otherwise(""))
    bridge = F.concat(F.lit("bridge:"), F.floor(between * 100).cast("string"), F.lit("%"))
    return (
        F.when(none, "").when((in_degree >= 5) | (packages >= 2), central).when(between >= 0.1, bridge)
        .when((in_degree == 0) & name.rlike(r"^\p{Lu}"), "exported-unused").when((out_degree == 0) & (in_degree > 0), "leaf").otherwise("")
    )


def confidence(symbols: Column, score: Column, strong: Column) -> Column:
    return F.when((symbols > 0) | (score >= 0.58) | strong, "high").when(score >= 0.45, "medium").otherwise("low")


def weakest(*provenance: Column) -> Column:
    """The weakest of provenances: exact, name-based, semantic."""
    rank = [F.when(p == "exact", 0).when(p == "name-based", 1).otherwise(2) for p in provenance]
    return F.element_at(F.array(F.lit("exact"), F.lit("name-based"), F.lit("semantic")), F.greatest(*rank) + 1)


def display_score(sort: Column, rerank: Column, rrf: Column, cosine: Column) -> Column:
    """The first positive of the scores, else the cosine."""
    return F.when(sort > 0, sort).when(rerank > 0, rerank).when(rrf > 0, rrf).otherwise(cosine)


def block_boundary(line: Column) -> Column:
    t = F.trim(line)
    return (t == "") | t.rlike(r"^[-=_*#~]{3,}$") | t.rlike(BLOCK_START)


def error_line(line: Column) -> Column:
    return line.rlike("(?i)(error|warn|fatal|panic|exception|traceback|crash)")


def terse(text: Column, level: int, least: float = 0.03) -> Column:
    """A text with its lines' words of little content (1) left out and long words abbreviated (2), unless that saves less
    than 3 % of its tokens."""
    short = F.transform(F.split(text, "\n"), lambda x: without_function_words(x))
    if level >= 2:
        short = F.transform(short, abbreviated)
    out = F.array_join(short, "\n")
    return F.when((text != "") & (token_estimate(text) - token_estimate(out) >= least * token_estimate(text)), out).otherwise(text)
