"""Column helpers for text: three tokenizers, trimming, normalization, sentence units."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that lexical retrieval leaves out.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "do", "does", "for", "from", "how", "i", "in", "is", "it", "of",
    "on", "or", "that", "the", "this", "to", "was", "what", "when", "where", "which", "who", "why", "with",
]

#: Bytes of tokens in lower case, all others as blanks (those of characters outside ASCII are among them).
LOWERED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

_BLANK = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    """Trims all Unicode blanks."""
    return F.regexp_replace(c, rf"(?U)\A{_BLANK}+|{_BLANK}+\z", "")


def squeeze(c: Column) -> Column:
    """Runs of blanks become one, the ends none."""
    return strip(F.regexp_replace(c, rf"(?U){_BLANK}+", " "))


_STOPPED = f"(?<![a-zA-Z0-9])(?!(?i:{'|'.join(STOP_WORDS)})(?![a-zA-Z0-9]))[a-zA-Z0-9]+"


def _runs(c: Column, pattern: str) -> Column:
    """All matches (of ASCII letters and digits) in lower case; they are lowered in one go, not one by one."""
    found = F.array_join(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0)), " ")
    return F.transform(F.array(found), lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(F.lower(s), " ")))[0]


def all_tokens(c: Column) -> Column:
    """Lower-cased ASCII letter and digit runs."""
    return _runs(c, "[a-zA-Z0-9]+")


def tokenize(c: Column) -> Column:
    """Tokens for retrieval: as all_tokens, without stop words."""
    return _runs(c, _STOPPED)


def token_set(c: Column) -> Column:
    """Distinct tokens of two or more characters."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[a-zA-Z0-9]{2,}"), F.lit(0)), lambda t: F.lower(t)))


@F.pandas_udf(T.StringType())
def _compatible(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalize_text(c: Column) -> Column:
    """NFKC, one kind of line end, squeezed and trimmed lines, at most one empty line in a row.

    Only rows with characters outside ASCII go through Python, for Spark has no NFKC."""
    plain = F.regexp_replace(c, "\x00", "")
    plain = F.when(plain.rlike(r"\A\p{ASCII}*\z"), plain).otherwise(_compatible(plain))
    lines = F.regexp_replace(plain, "\r\n|[\r\x0b\f\x1c-\x1e\x85\u2028\u2029]", "\n")
    lines = F.regexp_replace(lines, r"[\t ]+", " ")
    lines = F.regexp_replace(lines, r"(?Udm)^[\s\x1f&&[^\n]]+|[\s\x1f&&[^\n]]+$", "")
    return strip(F.regexp_replace(lines, r"\n{3,}", "\n\n"))


def units(c: Column) -> Column:
    """Paragraphs cut after sentence ends, trimmed, without empty ones."""
    parts = F.flatten(F.transform(F.split(c, "\n\n"), lambda p: F.split(strip(p), r"(?U)(?<=[.!?])\s+")))
    return F.filter(F.transform(parts, strip), lambda u: u != "")


def coverage(query: Column, text: Column, tokens=tokenize) -> Column:
    """Share of the query's distinct tokens that the text has; 0 for a query without any."""
    return token_coverage(tokens(query), tokens(text))


def token_coverage(query: Column, text: Column) -> Column:
    """As coverage(), of arrays of tokens."""
    q = F.array_distinct(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, text)) / F.size(q)).otherwise(F.lit(0.0))


def phrase_bonus(query: Column, text: Column) -> Column:
    """1 if the query's tokens, joined by blanks, occur in the text's; queries of under five characters get 0."""
    return token_phrase(tokenize(query), tokenize(text))


def token_phrase(query: Column, text: Column) -> Column:
    """As phrase_bonus(), of arrays of tokens."""
    return joined_phrase(query, F.array_join(text, " "))


def joined_phrase(query: Column, text: Column) -> Column:
    """As token_phrase(), of a text whose tokens are joined by blanks."""
    q = F.array_join(query, " ")
    return F.when((F.length(q) >= 5) & F.contains(text, q), F.lit(1.0)).otherwise(F.lit(0.0))
