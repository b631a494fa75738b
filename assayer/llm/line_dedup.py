"""Line dedup by overlapping three-line windows, in DataFrame functions only.

Lines are what '\\n' separates, unchanged. A window is three consecutive lines of one document. The first occurrence
of a window (smallest doc_id, then earliest line) stays; each later one covers its three lines, and covered lines go.

Each window is an exploded row of hashes (96 bits); its first place is a minimum, combined map-side, so a window that
is everywhere costs one row per task. Back to the documents go the places that are first: one row per distinct window.

Rows with a null text have no lines and stay as they are; texts of fewer than three lines have no window. Rows alike in
id and text are one document, and stay or lose lines together; a null id comes before all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import let, row_key

WINDOW = 3


def _windows(lines: Column) -> Column:
    def of(pairs: Column) -> Column:
        def at(i: Column) -> Column:
            three = [F.get(pairs, i + j) for j in range(WINDOW)]
            return F.struct(i.alias("pos"), F.xxhash64(*[x["a"] for x in three]).alias("w"), F.hash(*[x["b"] for x in three]).alias("v"))

        return F.transform(F.sequence(F.lit(0), F.size(pairs) - WINDOW), at)

    pairs = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.hash(x).alias("b")))
    return F.when(F.size(lines) >= WINDOW, let(pairs, of))


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs as the struct `row`, with `lines` and `kept` (the numbers of the lines that stay)."""
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("d"), row_key(text_col).alias("t"), F.col(text_col).alias("x"))
    places = rows.select("d", "t", F.inline(_windows(F.split("x", "\n"))))
    first = places.groupBy("w", "v").agg(F.min(F.struct("d", "t", "pos")).alias("f")).select("f.*")
    own = first.groupBy("d", "t").agg(F.collect_list("pos").alias("own")).withColumnsRenamed({"d": "od", "t": "ot"})
    joined = rows.join(own, rows.d.eqNullSafe(own.od) & (rows.t == own.ot), "left")
    lines = F.split("x", "\n")

    def kept(n: Column) -> Column:
        start = F.array_except(F.sequence(F.lit(0), n - WINDOW), F.coalesce("own", F.array().cast("array<int>")))
        cover = F.flatten(F.transform(start, lambda p: F.array(*[p + j for j in range(WINDOW)])))
        return F.when(n >= WINDOW, F.array_except(F.sequence(F.lit(0), n - 1), cover)).otherwise(F.sequence(F.lit(0), n - 1))

    return joined.select("row", lines.alias("lines"), let(F.size(lines), kept).alias("kept"))


def _text() -> Column:
    return F.array_join(let(F.col("lines"), lambda all_: F.transform("kept", lambda i: F.get(all_, i))), "\n")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of docs, with the text that is left and, if there is one, n_chars renewed."""
    left = marked(docs, id_col, text_col).select("row", F.when(F.col("row")[text_col].isNotNull(), _text()).alias("left"))
    new = {text_col: F.col("left")} | ({"n_chars": F.length("left").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return left.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed and kept_sha256 (of the text that is left; null for a null text) of every row."""
    null = F.col("row")[text_col].isNull()
    n = F.when(null, F.lit(0)).otherwise(F.size("lines")).cast("long")
    return marked(docs, id_col, text_col).select(
        F.col("row")[id_col].cast("long").alias("doc_id"),
        n.alias("n_lines"),
        F.when(null, F.lit(0)).otherwise(F.size("lines") - F.size("kept")).cast("long").alias("n_removed"),
        F.when(~null, F.sha2(_text().cast("binary"), 256)).alias("kept_sha256"),
    )


ORACLE = """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, p, lines[p] || chr(10) || lines[p + 1] || chr(10) || lines[p + 2] AS win
      FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS p FROM d)),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) AS rn FROM w),
gone AS (SELECT DISTINCT doc_id, p + o AS i FROM f, (SELECT unnest([0, 1, 2]) AS o) WHERE rn > 1),
l AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM d),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
             coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS kept
      FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
SELECT documents.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(kept) AS kept_sha256
FROM documents LEFT JOIN k ON documents.doc_id = k.doc_id
"""
