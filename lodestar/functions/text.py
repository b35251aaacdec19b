"""Text semantics as Columns: terms, phrases, wildcards."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = r"[\p{L}\p{Nd}][\p{L}\p{Nd}']*"


def tokens(c: Column) -> Column:
    """Lower-case runs of letters, digits and apostrophes that start with a letter or digit; apostrophes at the end go."""
    plain = F.translate(F.lower(c), "\u0092’", "''")
    return F.transform(F.regexp_extract_all(plain, F.lit(_TOKEN), F.lit(0)), lambda t: F.regexp_replace(t, "'+$", ""))


def analyzed(c: Column, analyzer: str | None = None) -> Column:
    """The terms of a field: of its text (also without tags), the whole value in lower case, or none at all."""
    if analyzer == "OpaqueTextAnalyzer":
        return F.when(c.isNotNull(), F.array(F.lower(c)))
    if analyzer == "NullAnalyzer":
        return F.when(c.isNotNull(), F.array().cast("array<string>"))
    return tokens(F.regexp_replace(c, r"(?s)<[^>]*>", " ") if analyzer == "HTMLAnalyzer" else c)


def matches(c: Column, pattern: str) -> Column:
    """A regular expression that takes the whole value in lower case."""
    return F.lower(c).rlike(f"^(?:{pattern})$")


def wildcard(value: str, full: bool = True) -> str:
    """A regular expression, in lower case, for a value with * and ?."""
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in value.lower())
    return f"(?s)^{body}$" if full else body


def equals(c: Column, value: str) -> Column:
    if "*" in value or "?" in value:
        return (c != "") & F.lower(c).rlike(wildcard(value))
    return F.lower(c) == value.lower()


def contains(c: Column, value: str, analyzer: str | None = None) -> Column:
    """The value's tokens, wildcards allowed, stand in the text one after the other."""
    if analyzer == "OpaqueTextAnalyzer":
        return equals(c, value)
    words = re.findall(r"[\w*?][\w'*?]*", value.lower().replace("’", "'"))
    words = [w.rstrip("'") for w in words]
    if not words:
        return F.lit(False)
    line = F.concat(F.lit(" "), F.array_join(analyzed(c, analyzer), " "), F.lit(" "))
    if any("*" in w or "?" in w for w in words):
        body = " ".join("".join(r"\S*" if ch == "*" else r"\S" if ch == "?" else re.escape(ch) for ch in w) for w in words)
        return line.rlike(f" {body} ")
    return line.contains(f" {' '.join(words)} ")
