"""Deterministic chunks of pages, and ingestion."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip, units
from .storage import small_batches, stored

PROBE_CHARS = 80


def bounded(parts: list[str], size: int) -> Iterator[str]:
    """Units no longer than size: long ones are cut at their last blank in the second half, else at size."""
    for rest in parts:
        while len(rest) > size:
            at = rest.rfind(" ", size // 2, size)
            at = at if at >= 0 else size
            head, rest = rest[:at].strip(), rest[at:].strip()
            yield head
        if rest:
            yield rest


def tail(text: str, n: int) -> str:
    """The last n characters from the first blank on (all of them without one)."""
    return text[-n:].split(" ", 1)[-1] if n > 0 else ""


def packed(parts: list[str], size: int, overlap: int) -> Iterator[str]:
    """Units joined by blanks up to size; each text begins with the end of the one before."""
    held = ""
    for unit in bounded(parts, size):
        if held and len(held) + 1 + len(unit) > size:
            yield held
            room, again = max(0, size - len(unit) - 1), tail(held, overlap)
            again = tail(again, room) if len(again) > room else again
            held = f"{again} {unit}".strip()
        else:
            held = f"{held} {unit}".strip()
    if held.strip():
        yield held.strip()


def placed(page: str, texts: Iterator[str], overlap: int) -> Iterator[tuple[str, int, int]]:
    """Each text with its start and end in the page; the start is 0 where its beginning isn't found."""
    cursor = 0
    for t in texts:
        start = max(0, page.find(t[:PROBE_CHARS], max(0, cursor - overlap)))
        cursor = min(len(page), start + len(t))
        yield t, start, cursor


def chunk_pages(pages: DataFrame, size: int | str = 1800, overlap: int | str = 220, keep: list[str] | None = None) -> DataFrame:
    """pages (document_hash, source_doc, page_number, text) to chunks: chunk_id, document_hash, source_doc, page_number,
    text, char_start, char_end; with further columns to keep. Pages without text have no chunks. The fold over units depends on
    the data, so it runs in Arrow batches; a page is handled where it is read. size and overlap are numbers, or columns to keep
    that give each page its own."""
    keep = keep or []
    each = lambda b, x: b.column(x).to_pylist() if isinstance(x, str) else [x] * b.num_rows
    names = [*keep, "chunk_id", "document_hash", "source_doc", "page_number", "text", "char_start", "char_end"]
    own = [pages.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, rows = [], []
            columns = (b.column(c).to_pylist() for c in ("document_hash", "source_doc", "page_number", "text", "parts"))
            for i, (key, name, number, text, parts, most, again) in enumerate(zip(*columns, each(b, size), each(b, overlap), strict=True)):
                for k, (t, start, end) in enumerate(placed(text, packed(parts, most, again), again), 1):
                    take.append(i)
                    rows.append((f"{key[:12]}_p{number}_c{k}", key, name, number, t, start, end))
            kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
            cols = zip(*rows, strict=True) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(take, pa.int32())) for c in keep), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names)

    ready = small_batches(pages).filter(F.col("text").isNotNull()).select(*keep, "document_hash", "source_doc", F.col("page_number").cast("int"), "text", units(F.col("text")).alias("parts"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in own)
    return ready.mapInArrow(run, f"{fields}chunk_id string, document_hash string, source_doc string, page_number int, text string, char_start int, char_end int")


def chunk_grid(pages: DataFrame, cells: list[tuple[str, int, int]]) -> DataFrame:
    """pages as of chunk_pages() to the chunks of each cell (name, size, overlap) of a grid: collection (the name), chunk_id,
    source_doc, text. A page's units are made once for all cells."""
    names = ["collection", "chunk_id", "source_doc", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*(b.column(c).to_pylist() for c in ("document_hash", "source_doc", "page_number", "parts")), strict=True))
            for cell, size, overlap in cells:
                ids, docs, texts = [], [], []
                for key, name, number, parts in rows:
                    for k, t in enumerate(packed(parts, size, overlap), 1):
                        ids.append(f"{key[:12]}_p{number}_c{k}")
                        docs.append(name)
                        texts.append(t)
                yield pa.RecordBatch.from_arrays([pa.array([cell] * len(ids), pa.string()), *(pa.array(x, pa.string()) for x in (ids, docs, texts))], names)

    return _units_of(pages).mapInArrow(run, "collection string, chunk_id string, source_doc string, text string")


def grid_counts(pages: DataFrame, cells: list[tuple[str, int, int]]) -> DataFrame:
    """collection and indexed_chunks, the number of chunks, for each cell of chunk_grid() that has any; no chunk leaves a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [0] * len(cells)
        for b in batches:
            for parts in b.column("parts").to_pylist():
                for i, (_, size, overlap) in enumerate(cells):
                    n[i] += sum(1 for _ in packed(parts, size, overlap))
        yield pa.RecordBatch.from_arrays([pa.array([c for c, *_ in cells], pa.string()), pa.array(n, pa.int64())], ["collection", "n"])

    found = _units_of(pages).select("parts").mapInArrow(run, "collection string, n long")
    return found.groupBy("collection").agg(F.sum("n").alias("indexed_chunks")).filter("indexed_chunks > 0")


def _units_of(pages: DataFrame) -> DataFrame:
    return small_batches(pages).filter(F.col("text").isNotNull()).select("document_hash", "source_doc", F.col("page_number").cast("int"), units(F.col("text")).alias("parts"))


def manifest(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """document_hash, source_doc, pages (with text), chunks, warnings, error_code (no_chunks beside the parsers' own)."""
    p = pages.groupBy("document_hash", "source_doc").agg(F.count("page_number").alias("pages"), F.first("warnings").alias("warnings"), F.max("error_code").alias("error_code"))
    c = chunks.groupBy("document_hash").agg(F.count("*").alias("chunks"))
    done = p.join(c, "document_hash", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0).cast("long")))
    return done.withColumn("error_code", F.coalesce("error_code", F.when(F.col("chunks") == 0, "no_chunks")))


def admit(uploads: DataFrame, limit: int, present: int = 0, session: str = "session_id", order: str = "seq", n: str = "chunks") -> DataFrame:
    """Adds `admitted`: in upload order, a file is taken if it still fits the session's limit; later smaller ones may.

    A fold over one session's uploads (bounded by the upload limit), all sessions at once."""
    each = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(n).cast("long").alias("n"))))
    kept = F.struct(F.lit(present).cast("long").alias("total"), F.array().cast(f"array<{uploads.schema[order].dataType.simpleString()}>").alias("taken"))
    step = lambda acc, x: F.when(acc["total"] + x["n"] <= limit, F.struct((acc["total"] + x["n"]).alias("total"), F.array_append(acc["taken"], x["o"]).alias("taken"))).otherwise(acc)
    taken = uploads.groupBy(session).agg(F.aggregate(each, kept, step)["taken"].alias("taken"))
    return uploads.join(taken, session).withColumn("admitted", F.array_contains("taken", F.col(order))).drop("taken")


def upsert(old: DataFrame, new: DataFrame, key: str | list[str] = "chunk_id") -> DataFrame:
    """New rows in place of old ones with the same key; of new rows with one key, the last by seq if there is one."""
    if "seq" in new.columns:
        w = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(F.desc("seq"))
        new = new.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "seq")
    return old.join(new.select(key), key, "left_anti").select(old.columns).unionByName(new)


def collection_name(session: Column, prefix: str = "evidence_") -> Column:
    """A session's collection: letters and digits of its id, 40 at most."""
    return F.concat(F.lit(prefix), F.coalesce(F.nullif(F.substring(F.regexp_replace(session, "[^a-zA-Z0-9]", ""), 1, 40), F.lit("")), F.lit("session")))


def all_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks that can be shown: with a text that isn't blank, and with what names their place."""
    return chunks.filter((strip(F.col("text")) != "") & F.col("document_hash").isNotNull() & F.col("source_doc").isNotNull() & F.col("page_number").isNotNull())


def document_names(chunks: DataFrame) -> DataFrame:
    """source_doc of each document, in order without regard to case."""
    return chunks.select("source_doc").distinct().orderBy(F.lower("source_doc"), "source_doc")


def guarded(uploads: DataFrame, limit: int, session: str = "session_id") -> DataFrame:
    """Adds `taken`: whether a session's uploads are looked at; none of them is, if there are more than the limit."""
    return uploads.join(uploads.groupBy(session).agg((F.count("*") <= limit).alias("taken")), session)


def ingest(files: DataFrame, limits, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """files (filename, content) of one session to chunks and a manifest: counted against limits.max_files, checked, hashed,
    parsed, packed and admitted. limits: a sources.config.Config. known: the chunks (document_hash) that the session has.

    Files that bring no chunks have an error_code: why they are refused or can't be parsed; `duplicate`, whose content is in
    known or in a valid file before it: by seq, the order of upload, if there is one, else by name; and `session_limit`, whose
    chunks don't fit limits.max_session_chunks any more. A file that is refused takes no other's place."""
    from ..sources import uploads

    if files.count() > limits.max_files:
        raise ValueError(f"at most {limits.max_files} files at once")
    at = F.col("seq").cast("long") if "seq" in files.columns else F.lit(0).cast("long")
    named = files.select(at.alias("_at"), uploads.sanitize_filename(F.col("filename")).alias("source_doc"), "content", uploads.document_hash(F.col("content")).alias("document_hash"), uploads.upload_error(F.col("filename"), F.col("content"), limits.max_file_mb * 1024 * 1024).alias("error_code"))
    n = F.row_number().over(Window.partitionBy("document_hash", F.col("error_code").isNull()).orderBy("_at", "source_doc"))
    seen, present = F.lit(False), 0
    if known is not None:
        present = known.count()
        named = named.join(known.select("document_hash").distinct().withColumn("_known", F.lit(True)), "document_hash", "left")
        seen = F.col("_known").isNotNull()
    named = named.withColumn("error_code", F.coalesce("error_code", F.when(seen | (n > 1), "duplicate"))).drop("_known")
    valid = named.filter("error_code is null")
    pages = uploads.parse_documents(valid.drop("_at"), limits.max_pages)
    chunks = chunk_pages(pages, limits.chunk_size_chars, limits.chunk_overlap_chars)
    told = stored(manifest(pages, chunks).join(valid.select("document_hash", "_at"), "document_hash"), "manifest", keep=True)
    over = F.lit(False)
    if present + total_chunks(told).first().total_chunks > limits.max_session_chunks:
        # One session's uploads, of which there are at most max_files: in their order, each that still fits.
        order = F.struct("_at", "source_doc", "document_hash")
        told = admit(told.withColumns({"_order": order, "_session": F.lit(0)}), limits.max_session_chunks, present, "_session", "_order")
        over = ~F.col("admitted") & (F.col("chunks") > 0)
    told = told.withColumns({"error_code": F.coalesce("error_code", F.when(over, "session_limit")), "chunks": F.when(over, 0).otherwise(F.col("chunks"))})
    none = F.array().cast("array<string>")
    columns = ["document_hash", "source_doc", "pages", "warnings", "error_code", "chunks"]
    refused = named.filter("error_code is not null").select("document_hash", "source_doc", F.lit(0).cast("long").alias("pages"), none.alias("warnings"), "error_code", F.lit(0).cast("long").alias("chunks"))
    kept = chunks.join(told.filter("error_code is null").select("document_hash"), "document_hash", "left_semi").select(chunks.columns)
    return kept, told.select(columns).unionByName(refused)


def total_chunks(done: DataFrame) -> DataFrame:
    """One row: the chunks of a manifest's documents."""
    return done.agg(F.coalesce(F.sum("chunks"), F.lit(0).cast("long")).alias("total_chunks"))


def indexed(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """The documents (by document_hash) that have chunks."""
    return documents.join(chunks.select("document_hash"), "document_hash", "left_semi")


def without_collection(chunks: DataFrame, collection: str) -> DataFrame:
    """What is left when a collection is cleared."""
    return chunks.filter(~F.col("collection").eqNullSafe(collection))
