"""Column functions for document text: tokens, keywords, titles, dates, lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words dropped from keywords (as the reference lists them).
STOPWORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "from", "as", "is", "was", "are", "were", "been",
    "be", "have", "has", "had", "do", "does", "did", "will", "would",
    "could", "should", "may", "might", "must", "shall", "can", "need",
    "this", "that", "these", "those", "i", "you", "he", "she", "it",
    "we", "they", "what", "which", "who", "when", "where", "why", "how",
]
KEYWORD_MIN_LEN = 4     # words longer than 3 characters
KEYWORD_CAP = 20

# A word is a maximal run of Unicode letters, digits and underscore.
WORD_RE = r"[\p{L}\p{N}_]+"
# Line-level horizontal whitespace (what str.strip removes, minus newline).
HWS = r"[ \t\x0B\f\r]"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: str | Column) -> Column:
    """All words of the text, in order."""
    return F.regexp_extract_all(_c(text), F.lit(WORD_RE), 0)


def keywords(text: str | Column, cap: int = KEYWORD_CAP) -> Column:
    """Lower-cased words longer than 3 characters, stop words removed,
    de-duplicated by first occurrence, at most ``cap``."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    ws = F.filter(words(F.lower(_c(text))),
                  lambda w: (F.length(w) >= KEYWORD_MIN_LEN) & ~F.array_contains(stop, w))
    return F.slice(F.array_distinct(ws), 1, cap)


def occurrences(text: str | Column, sub: str | Column) -> Column:
    """Non-overlapping occurrences of ``sub`` in ``text`` (like str.count)."""
    t, s = _c(text), _c(sub)
    return ((F.length(t) - F.length(F.replace(t, s, F.lit("")))) / F.length(s)).cast("long")


def strip(c: str | Column) -> Column:
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def title(text: str | Column) -> Column:
    """First line that, stripped, starts with '# ': the rest, stripped; else 'Untitled'."""
    t = F.regexp_extract(_c(text), rf"(?m)^{HWS}*# {HWS}*(\S[^\n]*?){HWS}*$", 1)
    return F.when(t == "", F.lit("Untitled")).otherwise(t)


def doc_date(name: str | Column, fallback: str | Column) -> Column:
    """Date from a name: yyyy-mm-dd, or yyyymmdd (the form the report writer
    uses), else the fallback."""
    n = _c(name)
    dash = F.regexp_extract(n, r"(\d{4}-\d{2}-\d{2})", 1)
    compact = F.regexp_extract(n, r"(\d{4})(\d{2})(\d{2})", 0)
    compact_fmt = F.concat_ws("-", F.substring(compact, 1, 4), F.substring(compact, 5, 2),
                              F.substring(compact, 7, 2))
    return (F.when(dash != "", dash).when(compact != "", compact_fmt)
            .otherwise(_c(fallback).cast("string")))
