"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import native
from .common import stored

#: Names that more than 1 / HOT_SHARE of all rows bear (and HOT_LEAST rows) are broadcast; at most HOT_SHARE can be so.
HOT_SHARE = 1 << 16
HOT_LEAST = 1024


def named(rows: DataFrame, names: DataFrame, on: str) -> DataFrame:
    """rows with the other column of names (a stored table, with a row for each value of `on`; null where there is none).

    Few names are broadcast. Of many, only those that a large share of the rows bear, so that no task gathers their rows."""
    if names.limit(native.BROADCAST_ROWS + 1).count() <= native.BROADCAST_ROWS:
        return rows.join(F.broadcast(names), on, "left")
    rows = stored(rows, "rows")
    (top,) = (c for c in names.columns if c != on)
    sizes = rows.groupBy(on).agg(F.count("*").alias("_n"))
    limit = max(HOT_LEAST, rows.count() // HOT_SHARE)
    hot = stored(names.join(sizes.filter(F.col("_n") > limit), on).select(on, top), "hot")
    marked = rows.join(F.broadcast(hot.withColumnRenamed(top, "_hot")), on, "left")
    often = marked.filter("_hot is not null").withColumn(top, F.col("_hot")).drop("_hot")
    rest = marked.filter("_hot is null").drop("_hot").join(names.join(F.broadcast(hot.select(on)), on, "left_anti"), on, "left")
    return often.unionByName(rest)


def _lowest(edges: DataFrame, n: int) -> DataFrame:
    """k and m, the least neighbour of each node that has any; made for a join on k that can be split where a node is hot."""
    low = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
    return F.broadcast(low) if n <= native.BROADCAST_ROWS // 2 else stored(low, "low")


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component), for every node of edges(u, v: long). Each round is written to
    the shared folder, so lineage stays short; joins meet minima, so that no node's neighbours are gathered."""
    sign = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    last = sign(now)
    while last[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _lowest(both, last[0]).select("k", F.least("k", "m").alias("m"))
        large = both.filter("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        pair = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
        now = stored(large.join(_lowest(large, last[0]), F.col("u") == F.col("k")).select(pair.alias("e")).select("e.*").filter("u <> v").distinct(), "edges")
        before, last = last, sign(now)
        if last == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
