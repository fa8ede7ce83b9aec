"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and what they fold to.
FOLD_FROM, FOLD_TO = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
#: What counts as white space at the ends of text.
EDGES = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(text), FOLD_FROM, FOLD_TO)


def tokens(text: Column) -> Column:
    """Runs of letters and digits of the folded text."""
    return F.array_remove(F.split(fold(text), r"[^\p{L}\p{N}]+"), "")


def keyword_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits of three bytes or more."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: F.octet_length(x) >= 3)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, EDGES, "")


def camel_split(name: Column) -> Column:
    """Parts of an identifier between lower and upper case, of two letters or more, in lower case."""
    return F.filter(F.split(F.lower(F.regexp_replace(name, r"(\p{Ll})(\p{Lu})", "$1 $2")), " "), lambda x: F.length(x) >= 2)


def is_identifier(text: Column) -> Column:
    """Camel case, Pascal case of two humps, snake case or a qualified name."""
    return text.rlike(r"^(?:[a-z]+[a-z0-9]*(?:[A-Z][A-Za-z0-9]*)+|(?:[A-Z][a-z0-9]+){2,}|[A-Za-z0-9]+(?:_[A-Za-z0-9]+)+|[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+)$")


def bare_name(name: Column) -> Column:
    """What follows the last dot."""
    return F.regexp_extract(name, r"([^.]*)$", 1)


def heading_slug(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(title)), r"[^a-z0-9 _-]", ""), " ", "-")


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(...))"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 for two empty ones."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def glob_to_like(pattern: str, substring: bool = False) -> str:
    """* and ? to LIKE's marks, others escaped; a pattern without marks may stand for any text around it."""
    if substring and "*" not in pattern and "?" not in pattern:
        pattern = f"*{pattern}*"
    return "".join({"*": "%", "?": "_", "%": r"\%", "_": r"\_", "\\": "\\\\"}.get(c, c) for c in pattern)


#: Shapes of secrets.
SECRETS = (
    r"AKIA[0-9A-Z]{16}",
    r"ASIA[0-9A-Z]{16}",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    r"ghp_[A-Za-z0-9]{36}",
    r"github_pat_[A-Za-z0-9_]{82}",
    r"xox[baprs]-[A-Za-z0-9-]{10,}",
    r"\bsk-(?:proj-)?[A-Za-z0-9_-]{20,}",
    r"AIza[0-9A-Za-z_-]{35}",
    r"sk_live_[0-9a-zA-Z]{24,}",
    r"rk_live_[0-9a-zA-Z]{24,}",
    r"glpat-[A-Za-z0-9_-]{20,}",
    r"SG\.[A-Za-z0-9_-]{22,}\.[A-Za-z0-9_-]+",
)
#: A password in a URL, and a line that assigns a value to a key.
CREDENTIAL_URL = r"([a-zA-Z][a-zA-Z0-9+.\-]*://[^:/?#\s]*:)[^@/?#\s]+(@)"
ASSIGNMENT = r"^(\s*(?:[-|]\s*)?[A-Za-z0-9_.\-]+)(\s*[:=]\s*)(.+?)\s*$"


def redact_tokens(text: Column) -> Column:
    return F.regexp_replace(text, "|".join(f"(?:{x})" for x in SECRETS), "***")


def redact_urls(text: Column) -> Column:
    """Passwords in URLs as ***."""
    return F.regexp_replace(text, CREDENTIAL_URL, "$1***$2")


def redact_line(line: Column) -> Column:
    """Passwords in URLs become ***; then the whole value of an assignment to a secret key, or else each secret token."""
    from .prose import secret_key

    urls = redact_urls(line)
    key = F.regexp_extract(urls, ASSIGNMENT, 1)
    return F.when((key != "") & secret_key(key), F.concat(key, F.regexp_extract(urls, ASSIGNMENT, 2), F.lit("***"))).otherwise(redact_tokens(urls))


def redact_text(text: Column) -> Column:
    """redact_line() of every line."""
    return F.array_join(F.transform(F.split(text, "\n"), redact_line), "\n")


def has_secret(text: Column) -> Column:
    return F.substring(text, 1, 65536).rlike("|".join(f"(?:{x})" for x in SECRETS))


def normalise_log(text: Column) -> Column:
    """Times, long hexadecimal numbers and UUIDs as marks."""
    text = F.regexp_replace(text, r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?", "[TS]")
    text = F.regexp_replace(text, r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "[UUID]")
    return F.regexp_replace(text, r"\b[0-9a-fA-F]{16,64}\b", "[HASH]")


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, r"\x1B\[[0-9;]*[A-Za-z]", "")


def answer_words(text: Column) -> Column:
    """Words of an answer: lower case, marks dropped."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), r"[\p{P}\p{S}]", ""), r"\s+"), "")


def minified(text: Column) -> Column:
    size = F.octet_length(text)
    return (size >= 8192) & (F.floor(size / (F.regexp_count(text, F.lit("\n")) + 1)) >= 400)


def risk_level(n: Column) -> Column:
    return F.when(n <= 1, "Low").when(n <= 4, "Medium").when(n <= 10, "High").otherwise("Critical")


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot / (norm(a) * norm(b))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def hunk_risk(changed: Column, exported: Column) -> Column:
    """Of a change of so many lines; one tier more where an exported symbol is touched."""
    tier = F.when(changed >= 30, 2).when(changed >= 10, 1).otherwise(0)
    return F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.least(tier + exported.cast("int"), F.lit(2)) + 1)
