"""Scalar functions over text columns, all built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Category, pattern with the value in its last group. Patterns of our own.
SECRETS = [
    ("password", r"(?i)((?:password|passwd|pwd)\s*[:=]\s*)([\"']?[^\s\"',;]{4,}[\"']?)"),
    ("token", r"(?i)((?:api[_-]?key|secret|token)\s*[:=]\s*)([\"']?[A-Za-z0-9_\-./+]{8,}[\"']?)"),
    ("aws_key", r"()(\bAKIA[0-9A-Z]{16}\b)"),
    ("private_key", r"()(-----BEGIN [A-Z ]*PRIVATE KEY-----)"),
]


def squash(c: Column, limit: int) -> Column:
    """White space to one blank, trimmed, at most ``limit`` characters."""
    return F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, limit)


def signature(code: Column, limit: int = 200) -> Column:
    """First line that isn't blank, trimmed."""
    lines = F.filter(F.transform(F.split(code, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.substring(F.coalesce(F.get(lines, 0), F.lit("")), 1, limit)


def redact(c: Column) -> Column:
    """Secret values replaced, their keys kept."""
    for _, pattern in SECRETS:
        c = F.regexp_replace(c, pattern, "$1[REDACTED]")
    return c


def redact_text(text: str) -> str:
    """``redact`` for a text on the driver."""
    for _, pattern in SECRETS:
        text = re.sub(pattern, r"\1[REDACTED]", text)
    return text


def secret_categories(c: Column) -> Column:
    """Sorted names of the kinds of secrets found."""
    return F.array_sort(F.array_compact(F.array(*(F.when(c.rlike(p), F.lit(n)) for n, p in SECRETS))))


def matches_any(c: Column, patterns: list[str]) -> Column:
    """Whether a text matches one of the patterns; null matches none. What is unsafe is the caller's to say."""
    found = F.lit(False)
    for p in patterns:
        found = found | c.rlike(p)
    return F.coalesce(found, F.lit(False))


def markdown(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\`*_{}\[\]()#+|<>-])", r"\\$1")


def html(c: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def label(c: Column, limit: int = 48) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 1), F.lit("…"))).otherwise(c)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def tokens(c: Column) -> Column:
    """Estimate of a prompt's tokens: a quarter of its characters."""
    return F.floor(F.length(c) / 4)


def call_core(pattern: Column) -> Column:
    """A call pattern without its bracket; null unless it is a dotted name."""
    core = F.regexp_replace(pattern, r"\($", "")
    return F.when(core.rlike(r"^[A-Za-z_$][\w$]*(\.[A-Za-z_$][\w$]*)*$"), core)


def segment_match(name: Column, core: Column) -> Column:
    """Whether the segments of ``core`` are a contiguous run of those of ``name``."""
    return F.contains(F.concat(F.lit("."), name, F.lit(".")), F.concat(F.lit("."), core, F.lit(".")))


def source_kind(url: Column) -> Column:
    """git, url, zip or null (a local path is told apart on the driver)."""
    low = F.lower(F.trim(url))
    hosts = r"^https?://(?:www\.)?(github\.com|gitlab\.com|bitbucket\.org|codeberg\.org)/"
    return (
        F.when(low.rlike(r"^(git@|git://|ssh://)"), "git")
        .when(low.rlike(r"^https?://"), F.when(low.rlike(r"\.git/?$") | low.rlike(hosts), "git").otherwise("url"))
        .when(low.rlike(r"^file://"), F.when(low.rlike(r"\.git/?$"), "git"))
        .when(low.rlike(r"\.zip$"), "zip")
    )


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./?#]+)(?:[?#].*)?$", 1))


def shebang(code: Column) -> Column:
    """Interpreter of the first line, without version; empty if there is none."""
    line = F.substring(F.regexp_extract(code, r"^#!([^\n]*)", 1), 1, 254)
    words = F.filter(F.split(F.trim(line), r"\s+"), lambda w: w != "")
    first = F.element_at(F.split(F.coalesce(F.get(words, 0), F.lit("")), "/"), -1)
    after = F.filter(F.slice(words, 2, 1000), lambda w: ~w.startswith("-"))
    name = F.when(first == "env", F.element_at(F.split(F.coalesce(F.get(after, 0), F.lit("")), "/"), -1)).otherwise(first)
    return F.regexp_replace(name, r"[0-9.]+$", "")
