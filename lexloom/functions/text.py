"""Scalar text functions as column expressions, with Unicode semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word characters by Unicode; a plain \w would be ASCII only.
WORD = r"([\p{L}\p{N}_]+)"
SPACE = r"(?U)\s+"
CITATION = r"\[(C\d+)\]"
#: Phrases of answers that decline; fixed values.
ABSTENTION = "The supplied financial regulation context does not contain sufficient legal evidence to answer the query."


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """Lower-cased words in order; none for null or blank texts."""
    return F.coalesce(F.regexp_extract_all(F.lower(_col(text)), F.lit(WORD), F.lit(1)), F.array().cast("array<string>"))


def strip(text: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(_col(text), r"(?U)^\s+|\s+$", "")


def words(text: Column | str) -> Column:
    """Pieces between white space."""
    bare = strip(text)
    return F.when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def word_set(text: Column | str) -> Column:
    return F.array_distinct(words(F.lower(_col(text))))


def word_count(text: Column | str) -> Column:
    return F.size(words(text))


def token_estimate(text: Column | str) -> Column:
    """A quarter of the characters, at least 1; 0 for the empty text."""
    n = F.length(F.coalesce(_col(text), F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4).cast("int")))


def citation_tags(answer: Column | str) -> Column:
    """All citation tags in order, repeats included."""
    return F.coalesce(F.regexp_extract_all(_col(answer), F.lit(CITATION), F.lit(1)), F.array().cast("array<string>"))


def claims(answer: Column | str) -> Column:
    """Pieces that end at . ! ? newline or ; before white space, of more than 5 characters."""
    pieces = F.transform(F.split(strip(answer), r"(?U)(?<=[.!?\n;])\s+"), strip)
    return F.coalesce(F.filter(pieces, lambda c: F.length(c) > 5), F.array().cast("array<string>"))


def base_path(path: Column | str) -> Column:
    """The structural path without a part suffix."""
    return strip(F.regexp_replace(strip(path), r"(?iU)\s*\[part\s+\d+/\d+\]\s*$", ""))


def canonical_key(document: Column | str, path: Column | str, start: Column | str, end: Column | str) -> Column:
    return F.concat_ws(":", _col(document).cast("string"), base_path(path), _col(start).cast("string"), _col(end).cast("string"))


def mentions_conflict(answer: Column | str) -> Column:
    return F.coalesce(F.lower(_col(answer)).contains("conflict"), F.lit(False))


def contextual(source: str, kind: str, number: str, title: str, path: str, start: str, end: str, text: str) -> Column:
    """The text under a header that names its regulation, place and pages."""
    c = F.col
    return F.concat(F.lit("["), c(source), F.lit(" - "), c(kind), F.lit(" No. "), c(number), F.lit("] "), c(title), F.lit("\nHierarki: "), c(path), F.lit("\nHalaman: "), c(start).cast("string"), F.lit(" - "), c(end).cast("string"), F.lit("\n\n"), c(text))


def display_citation(source: str, kind: str, number: str, path: str, page: str) -> Column:
    c = F.col
    return F.concat(F.lit("["), c(source), F.lit(", "), c(kind), F.lit(" No. "), c(number), F.lit(", "), c(path), F.lit(", p. "), c(page).cast("string"), F.lit("]"))
