"""Predicates and labels of file paths as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions by the name of a language.
LANGUAGES = {
    "typescript": "ts tsx", "javascript": "js jsx mjs cjs", "c++": "cpp hpp cc hh", "cpp": "cpp hpp cc hh", "cc": "cpp hpp cc hh", "ruby": "rb", "kotlin": "kt kts",
    "yaml": "yaml yml", "yml": "yaml yml", "python": "py", "java": "java", "go": "go", "rust": "rs", "c": "c h", "swift": "swift", "scala": "scala", "shell": "sh bash",
    "bash": "sh bash", "html": "html htm", "css": "css", "json": "json", "markdown": "md mdx", "proto": "proto", "sql": "sql", "toml": "toml",
}
#: Names of tests, and folders of fixtures, of old code and of examples.
TEST_NAME = r"(?:_test\.go|\.test\.tsx?|\.test\.jsx?|\.spec\.tsx?|\.spec\.jsx?|_test\.py|_spec\.rb|_test\.rs)$"
TEST_START = r"^test_.*\.py$"
FIXTURE_DIRS = "testdata|__fixtures__|testutil|mock|mocks|stub|stubs|fake|fakes"
LEGACY_DIRS = "compat|legacy|deprecated"
EXAMPLE_DIRS = "examples|example|demo|docs_src|samples|tutorials|cookbook"
BARRELS = ("index.ts", "index.tsx", "__init__.py", "package-info.java", "mod.rs")
DOC_END, BUILD_END, BUILD_NAMES = r"\.(?:md|rst|txt|adoc|mdx)$", r"\.(?:yml|yaml|toml|sh|bash|zsh|fish)$", ("Dockerfile", "Makefile", "Taskfile.yml", "Taskfile.yaml")


def base(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def directory(path: Column) -> Column:
    """What is before the last slash; "." at the root."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(".")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base(path), r"\.([^.]*)$", 1))


def extensions_of(languages: list[str]) -> list[str]:
    """The extensions of languages by name; what is no name is taken as an extension."""
    out: dict[str, None] = {}
    for name in (x.strip().lower() for x in languages):
        out.update(dict.fromkeys(LANGUAGES[name].split() if name in LANGUAGES else [name.removeprefix(".")]))
    return list(out)


def under(path: Column, folders: str) -> Column:
    """Whether a whole segment of the path is one of the folders (joined by |)."""
    return path.rlike(rf"(?:^|/)(?:{folders})(?:/|$)")


def is_test(path: Column) -> Column:
    return under(path, FIXTURE_DIRS) | base(path).rlike(TEST_NAME) | base(path).rlike(TEST_START)


def penalty(path: Column) -> Column:
    """How much a hit in a test, old code, an example, a re-export or a type stub counts: the product of their shares."""
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    shares = ((is_test(p), 0.3), (under(p, LEGACY_DIRS), 0.3), (under(p, EXAMPLE_DIRS), 0.3), (base(p).isin(*BARRELS), 0.5), (p.rlike(r"(?:\.d\.ts|\.pyi)$"), 0.7))
    out = F.lit(1.0)
    for found, share in shares:
        out = out * F.when(found, share).otherwise(1.0)
    return out


def tags(path: Column) -> Column:
    """doc, build, test and fixture, as far as they apply."""
    fixture = under(path, FIXTURE_DIRS)
    test = fixture | base(path).rlike(TEST_NAME) | base(path).rlike(TEST_START)
    return F.array_compact(F.array(F.when(path.rlike(DOC_END), "doc"), F.when(path.rlike(BUILD_END) | base(path).isin(*BUILD_NAMES), "build"), F.when(test, "test"), F.when(fixture, "fixture")))


def vendored(path: Column) -> Column:
    """Whether a package is a fixture or a vendored module."""
    return path.rlike(r"(?:^|/)(?:testdata|vendor)/")


def glob_regex(pattern: str) -> str:
    """A glob of one path as a regular expression: * and ? stay within a segment, ** spans segments."""
    out = ""
    for token in re.findall(r"/?\*\*/?|\*|\?|\[[^\]]*\]|.", pattern):
        if "**" in token:
            out += r"(?:.*/)?" if token.endswith("/") else r"(?:/.*)?" if token.startswith("/") else ".*"
            out = out if not (token.startswith("/") and token.endswith("/")) else out[: -len(r"(?:.*/)?")] + r"/(?:.*/)?"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(token, token if token.startswith("[") and len(token) > 2 else re.escape(token))
    return f"^{out}$"


def globbed(path: Column, pattern: str) -> Column:
    return path.rlike(glob_regex(pattern))


def excluded(path: Column, entries: list[str]) -> Column:
    """Whether the path equals, begins with, or is matched by one of the entries."""
    out = F.lit(False)
    for x in filter(None, entries):
        found = globbed(path, x) | globbed(base(path), x) if re.search(r"[*?\[]", x) else path.startswith(x)
        out = out | found
    return out


def definition_kind(kind: Column) -> Column:
    """Whether a chunk's kind is a declaration; windows of long ones are not."""
    return kind.rlike(r"function|method|class|struct|interface|type_decl|impl_item") & ~kind.endswith(":window")


def boostable_kind(kind: Column) -> Column:
    return (kind == "orphan") | definition_kind(kind)


def exported(name: Column) -> Column:
    return name.rlike(r"^\p{Lu}")
