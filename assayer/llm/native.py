"""Column helpers for the operators that use DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows up to which a small side is broadcast after it has been counted; beyond, the join is a shuffled one.
BROADCAST_ROWS = 200_000


def let(value: Column, use) -> Column:
    """use(value) with value computed once; a plain reference inside a lambda may be computed for each element."""
    return F.transform(F.array(value), use)[0]


def small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it has at most BROADCAST_ROWS rows of fixed width."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def row_key(text: str) -> Column:
    """Tells rows with one id but different texts apart."""
    return F.xxhash64(F.col(text))


def words(text: Column) -> Column:
    """Lower-cased blank-separated words."""
    cut = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(cut == "", F.array().cast("array<string>")).otherwise(F.split(F.lower(cut), "[ \\t\\n\\x0B\\f\\r]+"))


def shingles(text: Column, k: int) -> Column:
    """Hashes of all runs of k words, in order; empty where there are fewer."""
    def runs(h: Column) -> Column:
        at = lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)])
        return F.when(F.size(h) >= k, F.transform(F.sequence(F.lit(0), F.size(h) - k), at)).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), runs)
