"""All queries by name, and for each the DuckDB SQL that gives the same rows where SQL can."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import citations, text
from ..functions.numeric import py_round
from ..operators import ann, answering, chunking, embedding, evaluation, evidence, inverted, lab, reports, retrieval, storage, tables
from ..operators.grouped import small
from ..sources import config, labels, regression_set, uploads
from ..streaming.landing import latency_windows

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def r(x: str, digits: int = 4) -> str:
    """SQL for rounding the exact binary value."""
    return f"(printf('%.{digits}f', ({x})::DOUBLE)::DOUBLE + 0.0)"


STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


def tok(c: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({c}, '[a-zA-Z0-9]+'), lambda t: lower(t)), lambda t: t NOT IN ({STOP}))"


# ---- sources, identity, text -------------------------------------------------------------------------------------


@query("doc_identity", "SELECT doc_id, sha256(text) AS document_hash, doc_id = min(doc_id) OVER w AS is_first, count(*) OVER w AS copies FROM documents WINDOW w AS (PARTITION BY sha256(text))")
def doc_identity(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("document_hash"))
    first = rows.groupBy("document_hash").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    return rows.join(first, "document_hash").select("doc_id", "document_hash", (F.col("doc_id") == F.col("first")).alias("is_first"), "copies")


NAME_SQL = r"coalesce(nullif(substr(regexp_replace(trim(list_last(string_split(regexp_replace(replace(url, chr(92), '/'), '(/\.?)+$', ''), '/'))), '[^A-Za-z0-9._ -]+', '_', 'g'), 1, 160), ''), 'document')"


@query("filename_sanitize", rf"SELECT page_id, {NAME_SQL} AS safe_name, lower(regexp_extract({NAME_SQL}, '^.+(\.[^.]+)$', 1)) AS extension FROM pages")
def filename_sanitize(spark, sf_dir):
    name = uploads.sanitize_filename(F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", name.alias("safe_name"), uploads.extension(name).alias("extension"))


@query("upload_check", r"""SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'unsupported_type' WHEN strlen(html) = 0 THEN 'empty' WHEN strlen(html) > 2000 THEN 'too_large' WHEN contains(html, chr(0)) THEN 'binary_text' END AS error_code FROM pages""")
def upload_check(spark, sf_dir):
    name = F.concat(F.lit("page."), F.when(F.col("page_id") % 5 == 0, "html").otherwise("md"))
    return read(spark, sf_dir, "pages").select("page_id", uploads.upload_error(name, F.col("html").cast("binary"), 2000).alias("error_code"))


@query("formula_guard", r"SELECT doc_id, sha256(CASE WHEN regexp_matches(text, '^\s*[=+\-@]') THEN '''' || text ELSE text END) AS guarded_sha256 FROM documents")
def formula_guard(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(uploads.guard_formula(F.col("text")).cast("binary"), 256).alias("guarded_sha256"))


NORMAL_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(text, '[\t\r ]+', ' ', 'g'), '(?m)^ +| +$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))"


@query("normalize_text", f"SELECT doc_id, length(x) AS n_chars, sha256(x) AS text_sha256 FROM (SELECT doc_id, {NORMAL_SQL} AS x FROM documents)")
def normalize_text(spark, sf_dir):
    x = read(spark, sf_dir, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("x"))
    return x.select("doc_id", F.length("x").cast("long").alias("n_chars"), F.sha2(F.col("x").cast("binary"), 256).alias("text_sha256"))


UNITS_SQL = r"list_filter(list_transform(string_split(regexp_replace(replace(text, chr(10) || chr(10), chr(1)), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda u: regexp_replace(u, '^\s+|\s+$', '', 'g')), lambda u: u <> '')"


@query("sentence_units", f"SELECT doc_id, len(u) AS n_units, sha256(array_to_string(u, chr(1))) AS units_sha256 FROM (SELECT doc_id, {UNITS_SQL} AS u FROM documents)")
def sentence_units(spark, sf_dir):
    u = read(spark, sf_dir, "documents").select("doc_id", text.units(F.col("text")).alias("u"))
    return u.select("doc_id", F.size("u").cast("long").alias("n_units"), F.sha2(F.array_join("u", "\x01").cast("binary"), 256).alias("units_sha256"))


def doc_pages(spark, sf_dir) -> DataFrame:
    """Documents as parsed pages: the name is the id's."""
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("document_hash"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_doc"), F.lit(1).alias("page_number"), "text")


def trim_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def tail_sql(x: str, n: str) -> str:
    """The end of x, n characters at most, from behind its first blank on."""
    return f"(CASE WHEN {n} <= 0 THEN '' WHEN contains(right({x}, {n}), ' ') THEN substr(right({x}, {n}), strpos(right({x}, {n}), ' ') + 1) ELSE right({x}, {n}) END)"


def chunks_sql(pages: str, size: int = 1800, overlap: int = 220) -> str:
    """CTEs up to ch (id, k, text, char_start, char_end) from the pages (id, text): units, hard splits, packing, places."""
    seed, cut = tail_sql("held", str(overlap)), f"greatest(0, {size} - length(u) - 1)"
    return f"""pg AS ({pages}),
un AS (SELECT id, generate_subscripts(u, 1) AS i, unnest(u) AS u FROM (SELECT id, {UNITS_SQL} AS u FROM pg)),
hs AS (SELECT id, i, 0 AS j, NULL::VARCHAR AS head, u AS rest FROM un UNION ALL
  SELECT id, i, j + 1, {trim_sql('left(rest, cut)')}, {trim_sql('substr(rest, cut + 1)')} FROM (SELECT *, CASE WHEN contains(substr(rest, {size // 2 + 1}, {size - size // 2}), ' ') THEN {size // 2} + length(regexp_extract(substr(rest, {size // 2 + 1}, {size - size // 2}), '(?s)^(.*) ', 1)) ELSE {size} END AS cut FROM hs WHERE length(rest) > {size})),
pc AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY i, j) AS n, u FROM (SELECT id, i, j, head AS u FROM hs WHERE j > 0 UNION ALL SELECT id, i, j + 1, rest FROM hs WHERE length(rest) <= {size} AND rest <> '')),
pk AS (SELECT id, 0::BIGINT AS n, '' AS held, NULL::VARCHAR AS done FROM pg UNION ALL
  SELECT id, n, CASE WHEN full_ THEN {trim_sql(f"(CASE WHEN length(seed) > {cut} THEN {tail_sql('seed', cut)} ELSE seed END) || ' ' || u")} ELSE {trim_sql("held || ' ' || u")} END, CASE WHEN full_ THEN held END
  FROM (SELECT pk.id, pc.n, held, u, held <> '' AND length(held) + 1 + length(u) > {size} AS full_, {seed} AS seed FROM pk JOIN pc ON pc.id = pk.id AND pc.n = pk.n + 1)),
tx AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY n) AS k, t AS text FROM (SELECT id, n, done AS t FROM pk WHERE done IS NOT NULL UNION ALL SELECT id, 1000000000, arg_max(held, n) FROM pk GROUP BY id HAVING arg_max(held, n) <> '')),
ch AS (SELECT id, 0::BIGINT AS k, NULL::VARCHAR AS text, 0::BIGINT AS char_start, 0::BIGINT AS char_end FROM pg UNION ALL
  SELECT id, k, t, place, least(whole, place + length(t)) FROM (SELECT id, k, t, whole, CASE WHEN found > 0 THEN begin + found - 1 ELSE 0 END AS place FROM (SELECT tx.id, tx.k, tx.text AS t, length(pg.text) AS whole, greatest(0, ch.char_end - {overlap}) AS begin, strpos(substr(pg.text, greatest(0, ch.char_end - {overlap}) + 1), left(tx.text, 80)) AS found FROM ch JOIN tx ON tx.id = ch.id AND tx.k = ch.k + 1 JOIN pg ON pg.id = ch.id)))"""


ALL_PAGES_SQL = "SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL"


@query("chunk_greedy", f"""WITH RECURSIVE {chunks_sql(ALL_PAGES_SQL)} SELECT doc_id, left(sha256(d.text), 12) || '_p1_c' || k AS chunk_id, sha256(d.text) AS document_hash, 'doc-' || doc_id || '.txt' AS source_doc, 1::INTEGER AS page_number, ch.text, char_start::INTEGER AS char_start, char_end::INTEGER AS char_end
FROM ch JOIN documents d ON d.doc_id = ch.id WHERE k > 0""")
def chunk_greedy(spark, sf_dir):
    return chunking.chunk_pages(doc_pages(spark, sf_dir), keep=["doc_id"])


@query("ingest_manifest", f"""WITH RECURSIVE {chunks_sql(ALL_PAGES_SQL)}, n AS (SELECT sha256(d.text) AS h, count(*) AS chunks FROM ch JOIN documents d ON d.doc_id = ch.id WHERE k > 0 GROUP BY h)
SELECT sha256(text) AS document_hash, 'doc-' || doc_id || '.txt' AS source_doc, 1::BIGINT AS pages, '' AS warnings, CASE WHEN coalesce(chunks, 0) = 0 THEN 'no_chunks' END AS error_code, coalesce(chunks, 0) AS chunks FROM documents LEFT JOIN n ON n.h = sha256(text)""")
def ingest_manifest(spark, sf_dir):
    pages = doc_pages(spark, sf_dir).withColumns({"warnings": F.array().cast("array<string>"), "error_code": F.lit(None).cast("string")})
    return chunking.manifest(pages, chunking.chunk_pages(pages)).withColumn("warnings", F.array_join("warnings", ","))


@query("ingest_uploads", """WITH f AS (SELECT 2 * doc_id AS seq, 'doc-' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.exe' ELSE '.md' END AS source_doc, text FROM documents
UNION ALL SELECT 2 * doc_id + 1, 'doc-' || doc_id || '.txt', text FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY text, source_doc LIKE '%.exe' ORDER BY seq) AS n FROM f)
SELECT sha256(text) AS document_hash, source_doc, CASE WHEN source_doc LIKE '%.exe' THEN 'unsupported_type' WHEN n > 1 THEN 'duplicate' END AS error_code FROM n WHERE text <> ''""")
def ingest_uploads(spark, sf_dir):
    """Every document uploaded twice, under another name; a third of the first ones with a name that is refused."""
    d = read(spark, sf_dir, "documents").filter("text <> ''")
    name = lambda end: F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), end)
    first = d.select((2 * F.col("doc_id")).alias("seq"), name(F.when(F.col("doc_id") % 3 == 0, ".exe").otherwise(".md")).alias("filename"), F.col("text").cast("binary").alias("content"))
    second = d.select((2 * F.col("doc_id") + 1).alias("seq"), name(F.lit(".txt")).alias("filename"), F.col("text").cast("binary").alias("content"))
    limits = replace(config.Config(), max_files=2**62, max_session_chunks=2**62)
    return chunking.ingest(first.unionByName(second), limits)[1].select("document_hash", "source_doc", "error_code")


@query("session_admission", """WITH RECURSIVE t AS (SELECT conv_id, turn, trunc(1 + length(text) / 100.0)::BIGINT AS chunks, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
a AS (SELECT DISTINCT conv_id, 0::BIGINT AS n, 0::BIGINT AS total, false AS ok FROM t UNION ALL SELECT t.conv_id, t.n, CASE WHEN a.total + t.chunks <= 12 THEN a.total + t.chunks ELSE a.total END, a.total + t.chunks <= 12 FROM a JOIN t ON t.conv_id = a.conv_id AND t.n = a.n + 1)
SELECT t.conv_id, t.turn, t.chunks, a.ok AS admitted FROM t JOIN a ON a.conv_id = t.conv_id AND a.n = t.n""")
def session_admission(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", (1 + F.length("text") / 100).cast("long").alias("chunks"))
    return chunking.admit(turns, 12, session="conv_id", order="turn")


@query("upsert_latest", "SELECT doc_id AS chunk_id, CASE WHEN doc_id % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents")
def upsert_latest(spark, sf_dir):
    old = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "n_chars")
    new = old.filter("chunk_id % 7 = 0")
    both = new.withColumn("seq", F.lit(1)).unionByName(new.select("chunk_id", (F.col("n_chars") + 1).alias("n_chars"), F.lit(2).alias("seq")))
    return chunking.upsert(old, both)


STORED_SQL = """st AS (SELECT coalesce(lang, '') AS collection, doc_id AS chunk_id, CASE WHEN doc_id % 7 = 0 THEN text || ' revised revised' ELSE text END AS text
  FROM documents WHERE coalesce(lang, '') <> 'fr' AND doc_id % 11 <> 0 UNION ALL SELECT coalesce(lang, ''), doc_id, text FROM documents WHERE coalesce(lang, '') = 'fr' AND doc_id % 5 = 0)"""


def changed_table(spark, sf_dir) -> tables.ChunkTable:
    """Documents as a stored table in collections by language: some revised (twice in one change), some deleted, a collection
    cleared and filled again in part."""
    d = read(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("")).alias("collection"), F.col("doc_id").alias("chunk_id"), "text")
    table = tables.ChunkTable(spark, storage.place(spark, "table"), "collection string, chunk_id long, text string")
    table.upsert(d)
    revised = d.filter("chunk_id % 7 = 0")
    text_of = lambda n: F.concat("text", F.lit(" revised" * n)).alias("text")
    table.upsert(revised.select(*tables.KEY, text_of(1), F.lit(1).alias("seq")).unionByName(revised.select(*tables.KEY, text_of(2), F.lit(2).alias("seq"))))
    table.delete(d.filter("chunk_id % 11 = 0"))
    table.clear("fr")
    table.upsert(d.filter("collection = 'fr' and chunk_id % 5 = 0"))
    return table


@query("stored_chunks", f"WITH {STORED_SQL} SELECT collection, chunk_id, sha256(text) AS text_sha256 FROM st")
def stored_chunks(spark, sf_dir):
    with storage.scratch(spark):
        rows = changed_table(spark, sf_dir).read()
        return storage.stored(rows.select(*tables.KEY, F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")), "rows", keep=True)


@query("stored_term_stats", f"""WITH {STORED_SQL}, tk AS (SELECT collection, chunk_id, {tok('text')} AS t FROM st),
tf AS (SELECT collection, chunk_id, term, count(*) AS n FROM (SELECT collection, chunk_id, unnest(t) AS term FROM tk) GROUP BY ALL)
SELECT collection, NULL::VARCHAR AS term, count(*) AS chunks, sum(len(t))::BIGINT AS tokens, 0::BIGINT AS df, 0::BIGINT AS total_tf FROM tk GROUP BY collection
UNION ALL SELECT collection, term, 0, 0, count(*), sum(n)::BIGINT FROM tf GROUP BY collection, term""")
def stored_term_stats(spark, sf_dir):
    """The table's statistics, from the deltas of its changes."""
    with storage.scratch(spark):
        return storage.stored(changed_table(spark, sf_dir).statistics(), "statistics", keep=True)


@query("document_names", "SELECT DISTINCT source AS source_doc FROM documents")
def document_names(spark, sf_dir):
    return chunking.document_names(read(spark, sf_dir, "documents").withColumnRenamed("source", "source_doc"))


def files(spark, sf_dir) -> DataFrame:
    """Documents as uploads: UTF-8 text, a CSV with a formula, text in another encoding, and DOCX, by turns."""
    @F.udf("binary")
    def docx(t):
        return uploads.docx_bytes([x for x in (t or "").split("\n")])

    d, turn, number = read(spark, sf_dir, "documents"), F.col("doc_id") % 4, F.col("doc_id").cast("string")
    table = F.concat(F.lit("id,lang,note\n"), number, F.lit(","), F.coalesce("lang", F.lit("none")), F.lit(",=1+"), number).cast("binary")
    latin = F.concat(F.unhex(F.lit("636166E920")), number.cast("binary"))
    content = F.when(turn == 0, F.col("text").cast("binary")).when(turn == 1, table).when(turn == 2, latin).otherwise(docx("text"))
    name = F.concat(F.lit("doc-"), number, F.lit("."), F.when(turn == 0, "txt").when(turn == 1, "csv").when(turn == 2, "md").otherwise("docx"))
    return d.select("doc_id", name.alias("source_doc"), content.alias("content"), F.sha2(content, 256).alias("document_hash"))


PARSED_SQL = f"""SELECT doc_id, 'doc-' || doc_id || '.' || ['txt', 'csv', 'md', 'docx'][doc_id % 4 + 1] AS source_doc, CASE doc_id % 4 WHEN 0 THEN {NORMAL_SQL} WHEN 1 THEN 'Row 1: id | lang | note' || chr(10) || 'Row 2: ' || doc_id || ' | ' || coalesce(lang, 'none') || ' | ''=1+' || doc_id WHEN 2 THEN 'café ' || doc_id ELSE (SELECT {NORMAL_SQL} FROM (SELECT array_to_string(list_filter(string_split(d.text, chr(10)), lambda p: NOT regexp_matches(p, '^\\s*$')), chr(10) || chr(10)) AS text)) END AS page FROM documents d"""


@query("parse_files", f"SELECT source_doc, CASE WHEN page <> '' THEN 1 END::INTEGER AS page_number, CASE WHEN page <> '' THEN sha256(page) END AS text_sha256, CASE WHEN page = '' THEN 'no_text' END AS error_code FROM ({PARSED_SQL})")
def parse_files(spark, sf_dir):
    done = uploads.parse_documents(files(spark, sf_dir).select("document_hash", "source_doc", "content"))
    return done.select("source_doc", "page_number", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "error_code")


@query("upload_guard", "SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) <= 5 AS taken FROM conversations")
def upload_guard(spark, sf_dir):
    return chunking.guarded(read(spark, sf_dir, "conversations").select("conv_id", "turn"), 5, "conv_id")


@query("total_chunks", f"WITH RECURSIVE {chunks_sql('SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL')} SELECT count(*) AS total_chunks FROM ch WHERE k > 0")
def total_chunks(spark, sf_dir):
    return chunking.total_chunks(chunking.chunk_pages(doc_pages(spark, sf_dir)).groupBy("document_hash").agg(F.count("*").alias("chunks")))


def doc_rows(spark, sf_dir) -> DataFrame:
    """Documents as rows of an index: some with a blank text, some without a name, in collections by language."""
    d = read(spark, sf_dir, "documents")
    text_ = F.when(F.col("doc_id") % 5 == 0, F.lit(" \n")).otherwise(F.col("text"))
    return d.select(F.col("doc_id").alias("chunk_id"), F.sha2(F.col("text").cast("binary"), 256).alias("document_hash"), F.when(F.col("doc_id") % 7 != 0, F.col("source")).alias("source_doc"), F.lit(1).alias("page_number"), text_.alias("text"), chunking.collection_name(F.concat(F.col("lang"), F.lit("-"), F.col("source"))).alias("collection"))


ROWS_SQL = "rows_ AS (SELECT doc_id AS chunk_id, sha256(text) AS document_hash, CASE WHEN doc_id % 7 <> 0 THEN source END AS source_doc, CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE text END AS text, 'evidence_' || coalesce(nullif(left(regexp_replace(lang || '-' || source, '[^a-zA-Z0-9]', '', 'g'), 40), ''), 'session') AS collection FROM documents)"


@query("all_chunks", f"WITH {ROWS_SQL} SELECT chunk_id, source_doc, collection FROM rows_ WHERE NOT regexp_matches(text, '^\\s*$') AND source_doc IS NOT NULL")
def all_chunks(spark, sf_dir):
    return chunking.all_chunks(doc_rows(spark, sf_dir)).select("chunk_id", "source_doc", "collection")


@query("clear_collection", f"WITH {ROWS_SQL} SELECT collection, count(*) AS chunks FROM rows_ WHERE collection IS DISTINCT FROM 'evidence_enweb' GROUP BY collection")
def clear_collection(spark, sf_dir):
    return chunking.without_collection(doc_rows(spark, sf_dir), "evidence_enweb").groupBy("collection").agg(F.count("*").alias("chunks"))


@query("contains_document", "SELECT doc_id, sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0) AS known FROM documents")
def contains_document(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("document_hash"))
    found = chunking.indexed(d, d.filter("doc_id % 3 = 0")).select("doc_id", F.lit(True).alias("known"))
    return d.select("doc_id").join(found, "doc_id", "left").fillna(False, ["known"])


@query("label_lines", """SELECT item_id * 2 + 1 AS line_no, CASE item_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'invalid JSON' WHEN 2 THEN 'query is missing' WHEN 3 THEN 'expected_answerable is neither true nor false' WHEN 4 THEN 'an answerable case needs an answer or evidence' ELSE 'duplicate case_id c0' END AS error,
CASE WHEN item_id % 6 = 0 THEN 'c' || item_id END AS case_id, CASE WHEN item_id % 6 = 0 THEN trim(text, ' ' || chr(10)) END AS query, CASE WHEN item_id % 6 = 0 THEN 'user' END AS role FROM benchmark""")
def label_lines(spark, sf_dir):
    """Labelled cases from JSON lines, most of them wrong in some way, between empty lines and remarks."""
    b, turn = read(spark, sf_dir, "benchmark"), F.col("item_id") % 6
    word = F.concat(F.lit("c"), F.col("item_id").cast("string"))
    turns = F.array(F.struct(F.lit("user").alias("role"), F.lit("hi").alias("content")))
    full = lambda case, query, answerable, answer: F.to_json(F.struct(case.alias("case_id"), query.alias("query"), answerable.alias("expected_answerable"), answer.alias("expected_answer"), turns.alias("history")))
    yes, some = F.lit(True), F.lit("x")
    line = (
        F.when(turn == 1, F.lit("{")).when(turn == 2, full(word, F.lit(" "), yes, some)).when(turn == 3, full(word, F.col("text"), F.lit("yes"), some))
        .when(turn == 4, full(word, F.col("text"), yes, F.lit(None).cast("string"))).when(turn == 5, full(F.lit("c0"), F.col("text"), yes, some)).otherwise(full(word, F.col("text"), yes, some))
    )
    lines = b.select(F.explode(F.array(F.struct((F.col("item_id") * 2 + 1).alias("line_no"), line.alias("value")), F.struct((F.col("item_id") * 2 + 2).alias("line_no"), F.lit("# note").alias("value")))).alias("l")).select("l.*")
    cases_, refused = labels.parse_cases(lines)
    number = (F.substring("case_id", 2, 20).cast("long") * 2 + 1).alias("line_no")
    good = cases_.select(number, F.lit(None).cast("string").alias("error"), "case_id", "query", F.get("history", F.lit(0))["role"].alias("role"))
    null = F.lit(None).cast("string")
    return good.unionByName(refused.select("line_no", "error", null.alias("case_id"), null.alias("query"), null.alias("role")))


# ---- retrieval ---------------------------------------------------------------------------------------------------


def questions(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def doc_chunks(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


DOC_CHUNKS_SQL, ITEMS_SQL = "SELECT doc_id AS chunk_id, text FROM documents", "SELECT item_id AS query_id, text AS query FROM benchmark"


def tf_sql(chunks: str = DOC_CHUNKS_SQL) -> str:
    return f"""cks AS ({chunks}), dt AS (SELECT chunk_id, {tok('text')} AS tokens FROM cks),
tf AS (SELECT chunk_id, len(tokens) AS length, term, count(*) AS tf FROM (SELECT chunk_id, tokens, unnest(tokens) AS term FROM dt) GROUP BY chunk_id, length, term)"""


@query("term_stats", f"WITH {tf_sql()} SELECT term, count(*) AS df, sum(tf)::BIGINT AS total_tf FROM tf GROUP BY term")
def term_stats(spark, sf_dir):
    return retrieval.term_stats(doc_chunks(spark, sf_dir))


def lexical_sql(k: int, chunks: str = DOC_CHUNKS_SQL, asks: str = ITEMS_SQL) -> str:
    return f"""{tf_sql(chunks)}, qs AS ({asks}),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tok('query')}) AS term FROM qs) GROUP BY query_id, term),
st AS (SELECT count(*) AS n, greatest(1.0, avg(len(tokens))) AS mean_length FROM dt),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT query_id, chunk_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / greatest(tf + 1.5 * (1 - 0.75 + 0.75 * length / mean_length), 1e-12)) AS raw FROM qt JOIN tf USING (term) JOIN dfs USING (term), st GROUP BY query_id, chunk_id),
sc AS (SELECT query_id, chunk_id, {r('raw / max(raw) OVER (PARTITION BY query_id)', 6)} AS score FROM raw),
al AS (SELECT qs.query_id, cks.chunk_id, coalesce(sc.score, 0.0) AS score FROM qs CROSS JOIN cks LEFT JOIN sc ON sc.query_id = qs.query_id AND sc.chunk_id = cks.chunk_id),
lex AS (SELECT query_id, chunk_id, {r('score')} AS lexical_score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM al QUALIFY rank <= {k})"""


@query("bm25_topk", f"WITH {lexical_sql(10)} SELECT * FROM lex")
def bm25_topk(spark, sf_dir):
    return retrieval.lexical_topk(questions(spark, sf_dir), doc_chunks(spark, sf_dir), 10)


@query("coverage_phrase", f"""WITH {lexical_sql(10)},
p AS (SELECT lex.query_id, lex.chunk_id, {tok('q.text')} AS qt, {tok('d.text')} AS dt FROM lex JOIN benchmark q ON q.item_id = lex.query_id JOIN documents d ON d.doc_id = lex.chunk_id)
SELECT query_id, chunk_id, CASE WHEN len(qt) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct(qt), list_distinct(dt)))::DOUBLE / len(list_distinct(qt)) END AS coverage,
CASE WHEN length(array_to_string(qt, ' ')) >= 5 AND contains(array_to_string(dt, ' '), array_to_string(qt, ' ')) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS phrase FROM p""")
def coverage_phrase(spark, sf_dir):
    q, d = questions(spark, sf_dir), doc_chunks(spark, sf_dir)
    pairs = retrieval.lexical_topk(q, d, 10).join(d, "chunk_id").join(q, "query_id")
    return pairs.select("query_id", "chunk_id", text.coverage(F.col("query"), F.col("text")).alias("coverage"), text.phrase_bonus(F.col("query"), F.col("text")).alias("phrase"))


@query("inverted_topk", ORACLES["bm25_topk"])
def inverted_topk(spark, sf_dir):
    """bm25_topk through a stored index."""
    with storage.scratch(spark):
        index = inverted.build(doc_chunks(spark, sf_dir), storage.place(spark, "index"))
        return storage.stored(inverted.search(index, questions(spark, sf_dir), 10), "found", keep=True)


@query("inverted_matches", ORACLES["coverage_phrase"])
def inverted_matches(spark, sf_dir):
    """coverage_phrase from the index's positions: no text is read again."""
    with storage.scratch(spark):
        index = inverted.build(doc_chunks(spark, sf_dir), storage.place(spark, "index"))
        found = inverted.search(index, questions(spark, sf_dir), 10)
        return storage.stored(inverted.matches(index, found, questions(spark, sf_dir)), "matches", keep=True)


def vector_queries(spark, sf_dir) -> DataFrame:
    """The fixed query set: every vector whose id is divisible by 100."""
    return read(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))


def vector_chunks(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"), F.col("label").cast("string").alias("source_doc"))


def dense_sql(k: int) -> str:
    return f"""sims AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, {r('list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[])')} AS dense_score FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense_score DESC, chunk_id)::INTEGER AS rank FROM sims QUALIFY rank <= {k})"""


@query("dense_topk", f"WITH {dense_sql(10)} SELECT query_id, chunk_id, dense_score, rank FROM dense")
def dense_topk(spark, sf_dir):
    return retrieval.dense_topk(vector_queries(spark, sf_dir), vector_chunks(spark, sf_dir), 10)


@query("dense_index_topk")
def dense_index_topk(spark, sf_dir):
    """As dense_topk through a stored index of lists; approximate, so tests measure its recall instead of SQL."""
    with storage.scratch(spark):
        index = ann.build(vector_chunks(spark, sf_dir), storage.place(spark, "index"))
        return storage.stored(ann.search(index, vector_queries(spark, sf_dir), 10), "nearest", keep=True)


HASHED_SQL = """{n}t AS (SELECT {id} AS id, (('0x' || substr(md5(lower(t)), 1, 4))::BIGINT % 64) AS i, count(*) AS c FROM (SELECT {id}, unnest(regexp_extract_all(text, '[a-zA-Z0-9]+')) AS t FROM {n}) GROUP BY 1, 2),
{n}n AS (SELECT id, sqrt(sum(c * c)) AS norm FROM {n}t GROUP BY id)"""


RERANK_SQL = """greatest(0.0, least(1.0, (1.0::DOUBLE - 0.2::DOUBLE) * (0.6::DOUBLE * greatest(0.0, dense_score) + (1.0::DOUBLE - 0.6::DOUBLE) * greatest(0.0, lexical_score)) + 0.2::DOUBLE * (0.55::DOUBLE * (CASE WHEN len(qt) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct(qt), list_distinct(dt)))::DOUBLE / len(list_distinct(qt)) END) + 0.25::DOUBLE * (CASE WHEN length(array_to_string(qt, ' ')) >= 5 AND contains(array_to_string(dt, ' '), array_to_string(qt, ' ')) THEN 1.0 ELSE 0.0 END)::DOUBLE + 0.20::DOUBLE * least(1.0::DOUBLE, fused * 30.5::DOUBLE))))"""


@query("hybrid_topk", f"""WITH {lexical_sql(40)}, {HASHED_SQL.format(n='documents', id='doc_id')}, {HASHED_SQL.format(n='benchmark', id='item_id')},
dots AS (SELECT q.id AS query_id, d.id AS chunk_id, sum(q.c * d.c) AS dot FROM benchmarkt q JOIN documentst d ON q.i = d.i GROUP BY 1, 2),
al2 AS (SELECT q.item_id AS query_id, d.doc_id AS chunk_id, {r('greatest(-1, least(1, coalesce(dot / (qn.norm * dn.norm), 0.0)))')} AS dense_score FROM benchmark q CROSS JOIN documents d LEFT JOIN dots ON dots.query_id = q.item_id AND dots.chunk_id = d.doc_id LEFT JOIN benchmarkn qn ON qn.id = q.item_id LEFT JOIN documentsn dn ON dn.id = d.doc_id),
den AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense_score DESC, chunk_id) AS rank FROM al2 QUALIFY rank <= 40),
m AS (SELECT coalesce(den.query_id, lex.query_id) AS query_id, coalesce(den.chunk_id, lex.chunk_id) AS chunk_id, coalesce(dense_score, 0.0) AS dense_score, coalesce(lexical_score, 0.0) AS lexical_score, coalesce(1.0::DOUBLE / (60 + den.rank), 0.0) + coalesce(1.0::DOUBLE / (60 + lex.rank), 0.0) AS fused FROM den FULL JOIN lex ON den.query_id = lex.query_id AND den.chunk_id = lex.chunk_id),
p AS (SELECT m.*, {tok('q.text')} AS qt, {tok('d.text')} AS dt FROM m JOIN benchmark q ON q.item_id = m.query_id JOIN documents d ON d.doc_id = m.chunk_id),
f AS (SELECT query_id, chunk_id, dense_score, lexical_score, {r(RERANK_SQL, 6)} AS rerank_score FROM p)
SELECT query_id, chunk_id, dense_score, lexical_score, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, chunk_id)::INTEGER AS rank FROM f QUALIFY rank <= 10""")
def hybrid_topk(spark, sf_dir):
    q, d = questions(spark, sf_dir), doc_chunks(spark, sf_dir)
    return retrieval.hybrid_topk(embedding.embed(q, "query"), embedding.embed(d), 10)


# ---- retrieval within collections --------------------------------------------------------------------------------


def shelf_chunks(spark, sf_dir) -> DataFrame:
    """Documents in collections by language and source."""
    shelf = F.concat_ws("/", F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")))
    return read(spark, sf_dir, "documents").select(shelf.alias("collection"), F.col("doc_id").alias("chunk_id"), "text")


def shelf_questions(spark, sf_dir) -> DataFrame:
    """Every benchmark item, asked in each collection."""
    return shelf_chunks(spark, sf_dir).select("collection").distinct().crossJoin(F.broadcast(questions(spark, sf_dir)))


BY_COLLECTION_SQL = f"""qs AS (SELECT collection, item_id AS query_id, text AS query, {tok('text')} AS qt FROM (SELECT DISTINCT collection FROM cks), benchmark),
tf AS (SELECT collection, chunk_id, length, term, count(*) AS tf FROM (SELECT collection, chunk_id, len(dt) AS length, unnest(dt) AS term FROM cks) GROUP BY ALL),
qf AS (SELECT collection, query_id, term, count(*) AS qtf FROM (SELECT collection, query_id, unnest(qt) AS term FROM qs) GROUP BY ALL),
st AS (SELECT collection, count(*) AS n, greatest(1.0, avg(len(dt))) AS mean_length FROM cks GROUP BY collection),
dfs AS (SELECT collection, term, count(*) AS df FROM tf GROUP BY ALL),
raw AS (SELECT collection, query_id, chunk_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / greatest(tf + 1.5 * (1 - 0.75 + 0.75 * length / mean_length), 1e-12)) AS raw
  FROM qf JOIN tf USING (collection, term) JOIN dfs USING (collection, term) JOIN st USING (collection) GROUP BY ALL),
sc AS (SELECT collection, query_id, chunk_id, {r('raw / max(raw) OVER (PARTITION BY collection, query_id)', 6)} AS score FROM raw),
al AS (SELECT qs.collection, qs.query_id, cks.chunk_id, coalesce(sc.score, 0.0) AS score FROM qs JOIN cks USING (collection) LEFT JOIN sc ON sc.collection = qs.collection AND sc.query_id = qs.query_id AND sc.chunk_id = cks.chunk_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY collection, query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM al)"""
SHELF_LEXICAL_SQL = f"""cks AS (SELECT coalesce(lang, '') || '/' || coalesce(source, '') AS collection, doc_id AS chunk_id, text, {tok('text')} AS dt FROM documents),
{BY_COLLECTION_SQL}"""


def near_sql(chunks: str, chunk_id: str) -> str:
    """CTEs up to near, the chunks by likeness within collections; behind cks and qs."""
    return f"""{HASHED_SQL.format(n=chunks, id=chunk_id)}, {HASHED_SQL.format(n='benchmark', id='item_id')},
dots AS (SELECT q.id AS query_id, d.id AS chunk_id, sum(q.c * d.c) AS dot FROM benchmarkt q JOIN {chunks}t d ON q.i = d.i GROUP BY 1, 2),
sims AS (SELECT collection, query_id, chunk_id, {r('greatest(-1, least(1, coalesce(dot / (qn.norm * dn.norm), 0.0)))')} AS dense_score
  FROM qs JOIN cks USING (collection) LEFT JOIN dots USING (query_id, chunk_id) LEFT JOIN benchmarkn qn ON qn.id = query_id LEFT JOIN {chunks}n dn ON dn.id = chunk_id),
near AS (SELECT *, row_number() OVER (PARTITION BY collection, query_id ORDER BY dense_score DESC, chunk_id)::INTEGER AS rank FROM sims)"""


SHELF_DENSE_SQL = near_sql("documents", "doc_id")
FUSED_SQL = f"""m AS (SELECT collection, query_id, chunk_id, coalesce(dense_score, 0.0) AS dense_score, coalesce(lexical_score, 0.0) AS lexical_score, coalesce(1.0::DOUBLE / (60 + d.rank), 0.0) + coalesce(1.0::DOUBLE / (60 + x.rank), 0.0) AS fused
  FROM (SELECT * FROM near WHERE rank <= 40) d FULL JOIN (SELECT *, {r('score')} AS lexical_score FROM ranked WHERE rank <= 40) x USING (collection, query_id, chunk_id)),
p AS (SELECT m.*, qt, dt FROM m JOIN qs USING (collection, query_id) JOIN cks USING (collection, chunk_id)),
f AS (SELECT collection, query_id, chunk_id, dense_score, lexical_score, {r(RERANK_SQL, 6)} AS rerank_score FROM p)"""


@query("bm25_by_collection", f"WITH {SHELF_LEXICAL_SQL} SELECT collection, query_id, chunk_id, {r('score')} AS lexical_score, rank FROM ranked WHERE rank <= 10")
def bm25_by_collection(spark, sf_dir):
    return retrieval.lexical_topk(shelf_questions(spark, sf_dir), shelf_chunks(spark, sf_dir), 10)


@query("dense_by_collection", f"WITH {SHELF_LEXICAL_SQL}, {SHELF_DENSE_SQL} SELECT collection, query_id, chunk_id, dense_score, rank FROM near WHERE rank <= 10")
def dense_by_collection(spark, sf_dir):
    asked = embedding.embed(questions(spark, sf_dir), "query")
    asked = shelf_chunks(spark, sf_dir).select("collection").distinct().crossJoin(F.broadcast(asked))
    return retrieval.dense_topk(asked, embedding.embed(shelf_chunks(spark, sf_dir)), 10)


@query("hybrid_by_collection", f"""WITH {SHELF_LEXICAL_SQL}, {SHELF_DENSE_SQL},
{FUSED_SQL}
SELECT *, row_number() OVER (PARTITION BY collection, query_id ORDER BY rerank_score DESC, chunk_id)::INTEGER AS rank FROM f QUALIFY rank <= 10""")
def hybrid_by_collection(spark, sf_dir):
    asked = embedding.embed(questions(spark, sf_dir), "query")
    asked = shelf_chunks(spark, sf_dir).select("collection").distinct().crossJoin(F.broadcast(asked))
    return retrieval.hybrid_topk(asked, embedding.embed(shelf_chunks(spark, sf_dir)), 10)


# ---- gate, context, citations ------------------------------------------------------------------------------------


@query("evidence_gate", f"""WITH {dense_sql(12)}, g AS (SELECT *, max(dense_score) OVER (PARTITION BY query_id) AS top_similarity, row_number() OVER (PARTITION BY query_id, dense_score >= 0.9 ORDER BY rank) AS k FROM dense)
SELECT query_id, chunk_id, rank, top_similarity, top_similarity >= 0.9 AS passed, CASE WHEN top_similarity >= 0.9 THEN dense_score >= 0.9 AND k <= 4 ELSE rank <= 4 END AS shown FROM g""")
def evidence_gate(spark, sf_dir):
    found = retrieval.retrieve(vector_queries(spark, sf_dir), vector_chunks(spark, sf_dir), 12)
    return answering.gate(found, 0.9, 4).select("query_id", "chunk_id", "rank", "top_similarity", "passed", "shown")


@query("context_pack", f"""WITH RECURSIVE {lexical_sql(6)},
b AS (SELECT query_id, chunk_id, rank AS position, '<EVIDENCE id="S' || rank || '" document="doc-' || chunk_id || '" page="1" score="' || printf('%.3f', lexical_score) || '">' || chr(10) AS head, d.text FROM lex JOIN documents d ON d.doc_id = chunk_id),
c AS (SELECT query_id, chunk_id, position, head || (CASE WHEN position = 1 THEN left(text, greatest(0, 6000 - length(head) - 12)) ELSE text END) || chr(10) || '</EVIDENCE>' AS block FROM b),
u AS (SELECT *, sum(length(block) + CASE WHEN position > 1 THEN 2 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY position) AS used FROM c)
SELECT query_id, chunk_id, position, sha256(block) AS block_sha256 FROM u WHERE used <= 6000""")
def context_pack(spark, sf_dir):
    d = doc_chunks(spark, sf_dir)
    found = retrieval.retrieve(questions(spark, sf_dir), d, 6, "lexical").join(d, "chunk_id").withColumns({"source_doc": F.concat(F.lit("doc-"), F.col("chunk_id").cast("string")), "page_number": F.lit(1)})
    return answering.pack_context(found, 6000).select("query_id", "chunk_id", "position", F.sha2(F.col("block").cast("binary"), 256).alias("block_sha256"))


@query("history_window", "SELECT conv_id, turn, coalesce(string_agg(role || ': ' || left(text, 800), chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS history FROM conversations")
def history_window(spark, sf_dir):
    return answering.history_text(read(spark, sf_dir, "conversations")).select("conv_id", "turn", "history")


@query("rewrite_queries", "WITH h AS (SELECT conv_id, turn, role, text, coalesce(string_agg(role || ': ' || left(text, 800), chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS history FROM conversations) SELECT conv_id, turn, history <> '' AS asked, false AS rewrite_failed, CASE WHEN history = '' THEN text ELSE coalesce(nullif(left(replace(trim(left(list_last(string_split('CONVERSATION:' || chr(10) || history, ': ')), 100) || ' ' || text, ' ' || chr(10)), chr(10), ' '), 300), ''), text) END AS standalone_query FROM h WHERE role = 'user'")
def rewrite_queries(spark, sf_dir):
    turns = answering.history_text(read(spark, sf_dir, "conversations")).filter("role = 'user'").withColumnRenamed("text", "query")
    done = answering.rewrite(turns.select("conv_id", "turn", "query", "history"), answering.LastQuestion())
    return done.select("conv_id", "turn", (F.col("history") != "").alias("asked"), "rewrite_failed", "standalone_query")


SAID_SQL = "text || ' [S' || (turn + 1) || ', source 2]' || chr(10) || '- one more short claim 【S3】 [not one] [S4 and S5].'"


def said(spark, sf_dir) -> DataFrame:
    x = F.concat("text", F.lit(" [S"), (F.col("turn") + 1).cast("string"), F.lit(", source 2]\n- one more short claim 【S3】 [not one] [S4 and S5]."))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", x.alias("said"))


@query("confidence", f"""SELECT event_id, CASE WHEN t - 0.4::DOUBLE >= 0.25 AND c >= 0.95 THEN 'High' WHEN t - 0.4::DOUBLE >= 0.08 AND c >= 0.7 THEN 'Medium' ELSE 'Low' END AS label, CASE WHEN t <= 0.4::DOUBLE THEN 0.0 ELSE {r('0.75::DOUBLE * least(1.0, greatest(0.0, (t - 0.4::DOUBLE) / 0.6::DOUBLE)) + 0.25::DOUBLE * c')} END AS score,
CASE WHEN event_id % 3 = 0 THEN least(1.0, t) WHEN t - 0.4::DOUBLE >= 0.25 AND c >= 0.95 THEN 0.85::DOUBLE WHEN t - 0.4::DOUBLE >= 0.08 AND c >= 0.7 THEN 0.65::DOUBLE ELSE 0.25::DOUBLE END AS stated FROM (SELECT event_id, (user_id % 113) / 100.0::DOUBLE AS t, (event_id % 11) / 10.0::DOUBLE AS c FROM events)""")
def confidence(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", ((F.col("user_id") % 113) / 100).alias("t"), ((F.col("event_id") % 11) / 10).alias("c"))
    label = answering.confidence_label(F.col("t"), 0.4, F.col("c"))
    stated = evaluation.stated_confidence(F.when(F.col("event_id") % 3 == 0, F.col("t")), label)
    return e.select("event_id", label.alias("label"), answering.confidence_score(F.col("t"), 0.4, F.col("c")).alias("score"), stated.alias("stated"))


@query("usage_cost", f"SELECT event_id, greatest(0, a - b) AS prompt_tokens, greatest(0, b - a) AS completion_tokens, CASE WHEN a <> b THEN {r('greatest(0, a - b) / 1000000.0::DOUBLE * 0.5::DOUBLE + greatest(0, b - a) / 1000000.0::DOUBLE * 1.5::DOUBLE', 8)} END AS cost FROM (SELECT event_id, user_id % 100 AS a, event_id % 50 AS b FROM events)")
def usage_cost(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 100).alias("a"), (F.col("event_id") % 50).alias("b"))
    u = e.select("event_id", answering.usage(F.col("b"), F.col("a")).alias("prompt_tokens"), answering.usage(F.col("a"), F.col("b")).alias("completion_tokens"))
    return u.withColumn("cost", answering.cost(F.col("prompt_tokens"), F.col("completion_tokens"), 0.5, 1.5))


@query("structured_answers", r"""SELECT conv_id, turn, CASE k WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false END AS can_answer, CASE k WHEN 0 THEN '- Claim ' || turn || ' holds [S1] [S2].' WHEN 1 THEN '- no mark [S2]' WHEN 2 THEN '' END AS answer, CASE k WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN 'too little' END AS reason, k > 2 AS refused FROM (SELECT conv_id, turn, turn % 7 AS k FROM conversations)""")
def structured_answers(spark, sf_dir):
    """Models' outputs in turn: strict JSON, fenced JSON in other words, a refusal; then those that are refused."""
    k, turn = F.col("turn") % 7, F.col("turn").cast("string")
    out = (
        F.when(k == 0, F.concat(F.lit('{"can_answer": true, "items": [{"claim": " - Claim '), turn, F.lit('  holds.", "source_ids": ["S1", "Source 2", "S1"]}]}')))
        .when(k == 1, F.lit('```json\n{"can_answer": true, "items": [{"claim": "no mark", "source_ids": ["s2"]}]}\n```')).when(k == 2, F.lit('Well: {"can_answer": false, "reason": "too  little"} .'))
        .when(k == 3, F.lit('{"can_answer": "true", "items": []}')).when(k == 4, F.lit('{"can_answer": true, "items": []}'))
        .when(k == 5, F.lit('{"can_answer": true, "items": [{"claim": "x", "source_ids": ["S9"]}]}')).otherwise(F.lit("no JSON"))
    )
    found = read(spark, sf_dir, "conversations").withColumn("p", citations.structured_answer(out, F.lit(2)))
    return found.select("conv_id", "turn", "p.can_answer", "p.answer", "p.reason", F.col("p.error").isNotNull().alias("refused"))


@query("citation_ids", f"""WITH s AS (SELECT conv_id, turn, replace(replace({SAID_SQL}, '【', '['), '】', ']') AS x FROM conversations),
g AS (SELECT conv_id, turn, list_filter(regexp_extract_all(x, '\\[[^\\]\\r\\n]{{1,80}}\\]'), lambda g: regexp_matches(g, '(?i)^\\[\\s*(?:S|Source)\\s*\\d+(?:\\s*(?:,|;|&|\\band\\b)\\s*(?:S|Source)\\s*\\d+)*\\s*\\]$')) AS gs FROM s)
SELECT conv_id, turn, array_to_string(flatten(list_transform(gs, lambda g: regexp_extract_all(g, '(?i)\\b(?:S|Source)\\s*(\\d+)\\b', 1))), ',') AS ids FROM g""")
def citation_ids(spark, sf_dir):
    return said(spark, sf_dir).select("conv_id", "turn", F.array_join(citations.cited_ids(F.col("said")), ",").alias("ids"))


@query("citation_canonical", """SELECT conv_id, turn, sha256(text || ' [S' || (turn + 1) || '] [S2]' || chr(10) || '- one more short claim [S3] [not one] [S4] [S5].') AS canonical_sha256 FROM conversations""")
def citation_canonical(spark, sf_dir):
    return said(spark, sf_dir).select("conv_id", "turn", F.sha2(citations.canonical(F.col("said")).cast("binary"), 256).alias("canonical_sha256"))


def claims_sql(x: str) -> str:
    """A list of [is cited] for each claim of the text."""
    lines = f"list_transform(string_split(regexp_replace({x}, '\\r\\n|[\\n\\r]', chr(10), 'g'), chr(10)), lambda l: {trim_sql('l')})"
    busy = f"list_filter({lines}, lambda l: NOT (l = '' OR starts_with(l, '#') OR starts_with(l, '```') OR (starts_with(l, '**') AND ends_with(l, '**'))))"
    bullet = "^(?:[-*+]\\s+|\\d+[.)]\\s+)"
    parts = f"flatten(list_transform({busy}, lambda l: CASE WHEN regexp_matches(l, '{bullet}') THEN [regexp_replace(l, '{bullet}', '')] ELSE string_split(regexp_replace(l, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) END))"
    claims = f"list_filter({parts}, lambda p: len(list_distinct(list_transform(regexp_extract_all(p, '[a-zA-Z0-9]{{2,}}'), lambda t: lower(t)))) >= 3)"
    return f"list_transform({claims}, lambda p: len({cited_sql('p')}) > 0)"


def cited_sql(x: str) -> str:
    groups = f"list_filter(regexp_extract_all(replace(replace({x}, '【', '['), '】', ']'), '\\[[^\\]\\r\\n]{{1,80}}\\]'), lambda g: regexp_matches(g, '(?i)^\\[\\s*(?:S|Source)\\s*\\d+(?:\\s*(?:,|;|&|\\band\\b)\\s*(?:S|Source)\\s*\\d+)*\\s*\\]$'))"
    return f"flatten(list_transform({groups}, lambda g: regexp_extract_all(g, '(?i)\\b(?:S|Source)\\s*(\\d+)\\b', 1)))"


def covered_sql(claims: str, x: str) -> str:
    return f"(CASE WHEN len({claims}) > 0 THEN {r(f'len(list_filter({claims}, lambda c: c)) / len({claims})', 3)} WHEN {trim_sql(x)} = '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"


@query("claim_coverage", f"""WITH s AS (SELECT conv_id, turn, {SAID_SQL} AS x FROM conversations), c AS (SELECT conv_id, turn, x, {claims_sql('x')} AS cl, {cited_sql('x')} AS ids FROM s)
SELECT conv_id, turn, {covered_sql('cl', 'x')} AS coverage, CASE WHEN len(ids) > 0 THEN {r("len(list_filter(ids, lambda i: regexp_matches(i, '^[1-9][0-9]{0,8}$') AND i::BIGINT <= 4)) / len(ids)", 3)} END AS validity FROM c""")
def claim_coverage(spark, sf_dir):
    x = F.col("said")
    return said(spark, sf_dir).select("conv_id", "turn", citations.claim_coverage(x).alias("coverage"), citations.citation_validity(x, F.lit(4)).alias("validity"))


INDEXED_SQL = f"""{chunks_sql("SELECT min(doc_id) AS id, any_value(text) AS text FROM documents WHERE text IS NOT NULL GROUP BY sha256(text)")},
ix AS (SELECT left(sha256(pg.text), 12) || '_p1_c' || ch.k AS chunk_id, 'doc-' || pg.id || '.txt' AS source_doc, ch.text FROM ch JOIN pg ON pg.id = ch.id WHERE ch.k > 0)"""


def answers_sql(asks: str, t: float) -> str:
    """CTEs up to tr, the traces of the extractive provider over the indexed documents. asks: query_id, query, standalone."""
    first = trim_sql("it.text")
    flat = f"regexp_replace({trim_sql('replace(replace(left(sentence, 300), chr(91), chr(40)), chr(93), chr(41))')}, '\\s+', ' ', 'g')"
    good = "len(claims) > 0 AND len(list_filter(claims, lambda c: c)) = len(claims)"
    refusal = "CASE WHEN NOT passed THEN 'similarity_threshold' WHEN NOT good THEN 'citation_validation' END"
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return f"""{INDEXED_SQL}, asks AS ({asks}), {lexical_sql(12, "SELECT chunk_id, text FROM ix", "SELECT query_id, standalone AS query FROM asks")},
ga AS (SELECT *, max(lexical_score) OVER (PARTITION BY query_id) AS top, row_number() OVER (PARTITION BY query_id, lexical_score >= {t} ORDER BY rank) AS kk FROM lex),
sh AS (SELECT query_id, chunk_id, lexical_score, top, top >= {t} AS passed, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS position FROM ga WHERE CASE WHEN top >= {t} THEN lexical_score >= {t} AND kk <= 4 ELSE rank <= 4 END),
it AS (SELECT sh.*, ix.source_doc, ix.text FROM sh JOIN ix ON ix.chunk_id = sh.chunk_id),
bl AS (SELECT query_id, position, regexp_replace({flat}, '^[-*+ ]+', '') AS cl FROM (SELECT query_id, position, CASE WHEN regexp_matches({first}, '[.!?]\\s') THEN regexp_extract({first}, '(?s)^(.*?[.!?])\\s', 1) ELSE {first} END AS sentence FROM it WHERE passed)),
dr AS (SELECT query_id, string_agg('- ' || CASE WHEN right(cl, 1) IN ('.', '!', '?') THEN left(cl, length(cl) - 1) || ' [S' || position || ']' || right(cl, 1) ELSE cl || ' [S' || position || ']' END, chr(10) ORDER BY position) AS draft FROM bl GROUP BY query_id),
sm AS (SELECT query_id, any_value(top) AS top, bool_or(passed) AS passed, count(*)::INTEGER AS sources, list(source_doc ORDER BY position) AS docs, string_agg(chr(10) || '- [S' || position || '] ' || source_doc || ', page 1, score ' || printf('%.3f', lexical_score), '' ORDER BY position) AS listed FROM it GROUP BY query_id),
jd AS (SELECT asks.*, sm.* EXCLUDE (query_id), draft, {claims_sql("coalesce(draft, '')")} AS claims FROM asks JOIN sm ON sm.query_id = asks.query_id LEFT JOIN dr ON dr.query_id = asks.query_id),
rf AS (SELECT *, {refusal} AS refusal_reason, {covered_sql('claims', "coalesce(draft, '')")} AS covered FROM (SELECT *, {good} AS good FROM jd)),
tr AS (SELECT *, refusal_reason IS NOT NULL AS is_refusal, draft AS generated, CASE refusal_reason WHEN 'similarity_threshold' THEN {quote(answering.INSUFFICIENT)} WHEN 'citation_validation' THEN {quote(answering.UNVERIFIED)} ELSE draft END AS answer,
  CASE WHEN NOT passed THEN 'Low (safe refusal)' WHEN top - {t}::DOUBLE >= 0.25 AND covered >= 0.95 THEN 'High' WHEN top - {t}::DOUBLE >= 0.08 AND covered >= 0.7 THEN 'Medium' ELSE 'Low' END AS confidence,
  CASE WHEN refusal_reason IS NULL THEN CASE WHEN top <= {t}::DOUBLE THEN 0.0::DOUBLE ELSE {r(f'0.75::DOUBLE * least(1.0, greatest(0.0, (top - {t}::DOUBLE) / {1.0 - t}::DOUBLE)) + 0.25::DOUBLE * covered')} END END AS confidence_score FROM rf)"""


def indexed_pages(spark, sf_dir) -> DataFrame:
    """Chunk ids follow the content: of documents alike in content the first is indexed. Stored, as they are read several times."""
    pages = doc_pages(spark, sf_dir)
    hashes = storage.stored(pages.select("document_hash", "doc_id"), "hashes")
    first = hashes.groupBy("document_hash").agg(F.min("doc_id").alias("doc_id"))
    # Copies are few: as they alone are broadcast, texts stay where they are read.
    again = hashes.join(first, ["document_hash", "doc_id"], "left_anti")
    return storage.stored(pages.filter("document_hash is not null").join(small(again), ["document_hash", "doc_id"], "left_anti").select(pages.columns), "indexed")


def _answers(spark, sf_dir, threshold=0.05):
    with storage.scratch(spark):
        chunks = storage.stored(chunking.chunk_pages(indexed_pages(spark, sf_dir)), "chunks")
        return storage.stored(answering.turn(questions(spark, sf_dir), chunks, answering.Extractive(), "lexical", threshold), "answers", keep=True)


ASKS_SQL = "SELECT query_id, query, query AS standalone FROM (SELECT item_id AS query_id, left(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 2000) AS query FROM benchmark)"


@query("answer_traces", f"""WITH RECURSIVE {answers_sql(ASKS_SQL, 0.05)} SELECT query_id, query, standalone AS standalone_query, false AS rewrite_failed, 'lexical' AS retrieval_mode, is_refusal, refusal_reason, confidence, confidence_score, {r('top')} AS top_similarity, sources,
CASE WHEN refusal_reason = 'citation_validation' THEN 'incomplete_claim_citations' END AS citation_validation_error, coalesce(passed AND NOT good, false) AS citation_repair_used, '' AS invalid_citations, 'extractive' AS provider, 'first-sentence' AS model FROM tr""")
def answer_traces(spark, sf_dir):
    """The trace's columns but for times, which differ each time."""
    t = reports.trace_view(_answers(spark, sf_dir)).drop("retrieval_ms", "generation_ms", "total_ms", "total_tokens", "estimated_cost_usd")
    return t.withColumn("invalid_citations", F.array_join("invalid_citations", ","))


@query("answer_reports", f"""WITH RECURSIVE {answers_sql(ASKS_SQL, 0.05)} SELECT query_id, '# ' || query || chr(10) || chr(10) || answer || chr(10) || chr(10) || 'Confidence: ' || confidence || chr(10) || chr(10) || '## Sources' || chr(10) || listed AS report_md FROM tr""")
def answer_reports(spark, sf_dir):
    return reports.report_markdown(_answers(spark, sf_dir))


@query("answer_evidence", f"""WITH RECURSIVE {answers_sql(ASKS_SQL, 0.05)} SELECT query_id, position::INTEGER AS position, chunk_id, source_doc, 1::INTEGER AS page_number, lexical_score AS similarity, NULL::DOUBLE AS dense_score, lexical_score, lexical_score AS rerank_score, 'lexical' AS retrieval_method, text FROM it""")
def answer_evidence(spark, sf_dir):
    return reports.evidence_view(_answers(spark, sf_dir))


@query("answer_diagnostics", f"""WITH RECURSIVE {answers_sql(ASKS_SQL, 0.05)}, x AS (SELECT *, coalesce(generated, answer) AS said, list_distinct(list_transform(regexp_extract_all(standalone, '[a-zA-Z0-9]{{2,}}'), lambda t: lower(t))) AS qt FROM tr),
y AS (SELECT *, list_distinct(list_transform(regexp_extract_all(said, '[a-zA-Z0-9]{{2,}}'), lambda t: lower(t))) AS st, {claims_sql('said')} AS cl, {cited_sql('said')} AS ids FROM x), z AS (SELECT query_id, count(*) FILTER (WHERE lexical_score >= 0.05) AS above FROM it GROUP BY query_id)
SELECT y.query_id, {covered_sql('cl', 'said')} AS citation_coverage, CASE WHEN len(ids) > 0 THEN {r("len(list_filter(ids, lambda i: i::BIGINT BETWEEN 1 AND sources)) / len(ids)", 3)} END AS citation_validity, CASE WHEN len(qt) = 0 THEN 0.0 ELSE {r('len(list_intersect(qt, st)) / len(qt)', 3)} END AS answer_relevance_proxy, {r('above / sources', 3)} AS context_precision_proxy FROM y JOIN z ON z.query_id = y.query_id""")
def answer_diagnostics(spark, sf_dir):
    return _answers(spark, sf_dir).select("query_id", "metrics.*").drop("latency_seconds")


# ---- labelled metrics --------------------------------------------------------------------------------------------

CLEAN_SQL = r"regexp_replace(lower(trim(regexp_replace(regexp_replace({c}, '(?i)\[(?:S|Source)\s*\d+(?:\s*(?:,|;|&|and)\s*(?:S|Source)\s*\d+)*\]', ' ', 'g'), '(?m)^\s*(?:[-*+]\s+|\d+[.)]\s+)', '', 'g'), ' ' || chr(9) || chr(10) || chr(13))), '\s+', ' ', 'g')"


@query("token_f1", f"""WITH p AS (SELECT conv_id, turn, {CLEAN_SQL.format(c='text')} AS b, {CLEAN_SQL.format(c='prev')} AS a FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) WHERE prev IS NOT NULL),
x AS (SELECT conv_id, turn, t, count(*) AS n FROM (SELECT conv_id, turn, unnest(regexp_extract_all(a, '[a-z0-9]+')) AS t FROM p) GROUP BY ALL),
y AS (SELECT conv_id, turn, t, count(*) AS n FROM (SELECT conv_id, turn, unnest(regexp_extract_all(b, '[a-z0-9]+')) AS t FROM p) GROUP BY ALL),
c AS (SELECT x.conv_id, x.turn, sum(least(x.n, y.n)) AS bth FROM x JOIN y ON x.conv_id = y.conv_id AND x.turn = y.turn AND x.t = y.t GROUP BY ALL)
SELECT p.conv_id, p.turn, CASE WHEN na = 0 AND nb = 0 THEN 1.0::DOUBLE WHEN na = 0 OR nb = 0 OR bth IS NULL THEN 0.0::DOUBLE ELSE {r('2 * (bth / na) * (bth / nb) / (bth / na + bth / nb)')} END AS token_f1, (a = b)::INTEGER::DOUBLE AS exact_match
FROM (SELECT *, len(regexp_extract_all(a, '[a-z0-9]+'))::DOUBLE AS na, len(regexp_extract_all(b, '[a-z0-9]+'))::DOUBLE AS nb FROM p) p LEFT JOIN c ON c.conv_id = p.conv_id AND c.turn = p.turn""")
def token_f1(spark, sf_dir):
    from pyspark.sql import Window

    rows = read(spark, sf_dir, "conversations").withColumn("prev", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("prev is not null")
    a, b = F.col("prev"), F.col("text")
    return rows.select("conv_id", "turn", evaluation.token_f1(a, b).alias("token_f1"), evaluation.exact_match(a, b).alias("exact_match"))


def vector_gold(spark, sf_dir) -> DataFrame:
    """Cases over the fixed query set: the neighbours wanted are those of its own label."""
    e = read(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0")
    empty = F.array().cast("array<bigint>")
    return e.select(F.col("vec_id").alias("case_id"), (F.col("label") % 2 == 0).alias("expected_answerable"), empty.alias("expected_chunk_ids"), F.array(F.col("label").cast("string")).alias("expected_source_docs"))


def vector_probes(spark, sf_dir, k=8) -> DataFrame:
    c = vector_chunks(spark, sf_dir)
    return lab.probes(vector_gold(spark, sf_dir), retrieval.retrieve(vector_queries(spark, sf_dir), c, k), c)


@query("retrieval_hits", f"""WITH {dense_sql(8)}, h AS (SELECT query_id, min(rank) FILTER (WHERE e.label = q.label) AS first FROM dense JOIN embeddings e ON e.vec_id = chunk_id JOIN embeddings q ON q.vec_id = query_id GROUP BY query_id)
SELECT query_id AS case_id, CASE WHEN first IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS recall, CASE WHEN first IS NULL THEN 0.0::DOUBLE ELSE {r('1.0 / first')} END AS reciprocal_rank FROM h""")
def retrieval_hits(spark, sf_dir):
    ids = F.transform("candidates", lambda c: c["source_doc"])
    return vector_probes(spark, sf_dir).select("case_id", evaluation.hits(F.col("expected_source_docs"), ids).alias("h")).select("case_id", "h.*")


def sweep_sql(cells: str) -> str:
    return f"""{dense_sql(8)}, grid AS ({cells}),
h AS (SELECT g.seq, g.top_k, g.threshold, query_id, any_value(q.label % 2 = 0) AS e, max(dense_score) FILTER (WHERE rank = 1) >= g.threshold AS yes, min(rank) FILTER (WHERE e.label = q.label AND rank <= g.top_k AND dense_score >= g.threshold) AS first
      FROM dense JOIN embeddings e ON e.vec_id = chunk_id JOIN embeddings q ON q.vec_id = query_id, grid g GROUP BY g.seq, g.top_k, g.threshold, query_id),
a AS (SELECT seq, top_k, threshold, count(*) AS cases, count(first) AS found, sum(CASE WHEN first IS NULL THEN 0 ELSE ({r('1.0 / first')} * 10000)::BIGINT END) AS rr, count(*) FILTER (WHERE e AND yes) AS tp, count(*) FILTER (WHERE NOT e AND NOT yes) AS tn, count(*) FILTER (WHERE NOT e AND yes) AS fp, count(*) FILTER (WHERE e AND NOT yes) AS fn FROM h GROUP BY ALL),
s AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fn) END AS r, CASE WHEN tn + fp = 0 THEN 0.0 ELSE tn::DOUBLE / (tn + fp) END AS sp FROM a),
o AS (SELECT 'dense' AS mode, seq, top_k, {r('threshold', 3)} AS threshold, cases, {r('found / cases')} AS retrieval_recall_at_k, {r('rr / (10000.0 * cases)')} AS mrr, tp, tn, fp, fn, {r('(tp + tn)::DOUBLE / cases')} AS answerability_accuracy, {r('p')} AS answerable_precision, {r('r')} AS answerable_recall, {r('CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END')} AS answerable_f1, {r('(r + sp) / 2')} AS balanced_accuracy FROM s)"""


@query("threshold_sweep", f"WITH {sweep_sql('SELECT (range - 2)::INTEGER AS seq, 4::INTEGER AS top_k, range::DOUBLE / 20 AS threshold FROM range(2, 17)')} SELECT *, row_number() OVER (ORDER BY balanced_accuracy DESC, retrieval_recall_at_k DESC, abs(threshold - 0.4::DOUBLE), seq) = 1 AS recommended FROM o")
def threshold_sweep(spark, sf_dir):
    return lab.threshold_sweep(vector_probes(spark, sf_dir))


@query("retrieval_ablation", f"WITH {sweep_sql('SELECT (row_number() OVER (ORDER BY k, t) - 1)::INTEGER AS seq, k::INTEGER AS top_k, t::DOUBLE AS threshold FROM (SELECT unnest([3, 4, 6, 8]) AS k), (SELECT unnest([0.3, 0.4, 0.5]) AS t)')} SELECT * FROM o")
def retrieval_ablation(spark, sf_dir):
    return lab.retrieval_ablation(vector_probes(spark, sf_dir))


CASE_SQL = f"""cases AS (SELECT d.doc_id AS case_id, quality = 1 AS expected_answerable, toxic = 0 AS predicted_answerable, (quality = 1) = (toxic = 0) AND n_chars % 3 <> 0 AS correct, (n_chars % 101) / 100.0::DOUBLE AS confidence_score,
CASE WHEN n_chars % 11 <> 0 THEN (n_chars % 5) / 4.0::DOUBLE END AS retrieval_recall, {r('1.0::DOUBLE / (1 + n_chars % 4)')} AS reciprocal_rank, {r('(n_chars % 7) / 6.0::DOUBLE')} AS citation_f1, (n_chars % 3) / 2.0::DOUBLE AS citation_recall,
CASE WHEN n_chars % 2 = 0 THEN (n_chars % 13) / 12.0::DOUBLE END AS answer_token_f1, CASE WHEN n_chars % 17 = 0 THEN 0.5::DOUBLE END AS rewrite_token_f1, (n_chars % 9000) / 1000.0::DOUBLE AS latency_seconds, lang, source, d.doc_id % 2 AS half FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""


def cases(spark, sf_dir) -> DataFrame:
    """Case evaluations derived from the labels and the texts' lengths."""
    n = F.col("n_chars")
    c = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").select(
        F.col("doc_id").alias("case_id"), (F.col("quality") == 1).alias("expected_answerable"), (F.col("toxic") == 0).alias("predicted_answerable"), (((F.col("quality") == 1) == (F.col("toxic") == 0)) & (n % 3 != 0)).alias("correct"),
        ((n % 101) / 100).alias("confidence_score"), F.when(n % 11 != 0, (n % 5) / 4).alias("retrieval_recall"), py_round(1 / (1 + n % 4), 4).alias("reciprocal_rank"), py_round((n % 7) / 6, 4).alias("citation_f1"), ((n % 3) / 2).alias("citation_recall"),
        F.when(n % 2 == 0, (n % 13) / 12).alias("answer_token_f1"), F.when(n % 17 == 0, F.lit(0.5)).alias("rewrite_token_f1"), ((n % 9000) / 1000).alias("latency_seconds"), F.array("lang", "source").alias("tags"), (F.col("doc_id") % 2).alias("half"),
    )
    wrong = evaluation.failures(F.col("expected_answerable"), F.col("predicted_answerable"), F.col("correct"), F.col("retrieval_recall"), F.col("citation_recall"), F.col("rewrite_token_f1"), F.col("answer_token_f1"), F.col("confidence_score"), F.col("latency_seconds"), 8.0)
    null = F.lit(None).cast("double")
    return c.withColumns({"failures": wrong, "answer_exact_match": null, "citation_precision": null})


FAIL_SQL = """f AS (SELECT *, list_filter([CASE WHEN expected_answerable AND NOT predicted_answerable THEN 'WRONG_REFUSAL' END, CASE WHEN NOT expected_answerable AND predicted_answerable THEN 'WRONG_ANSWERABILITY' END, CASE WHEN expected_answerable AND retrieval_recall = 0 THEN 'RETRIEVAL_MISS' END,
CASE WHEN rewrite_token_f1 < 0.8 THEN 'QUERY_REWRITE_DRIFT' END, CASE WHEN predicted_answerable AND answer_token_f1 < 0.8 THEN 'ANSWER_MISMATCH' END, CASE WHEN expected_answerable AND predicted_answerable AND citation_recall = 0 THEN 'CITATION_MISS' END, CASE WHEN citation_recall > 0 AND citation_recall < 1 THEN 'CITATION_OFF_GOLD' END,
CASE WHEN NOT correct AND confidence_score >= 0.8 THEN 'OVERCONFIDENT_ERROR' END, CASE WHEN predicted_answerable AND correct AND confidence_score <= 0.4 THEN 'UNDERCONFIDENT_CORRECT' END, CASE WHEN latency_seconds > 8 THEN 'LATENCY_REGRESSION' END], lambda x: x IS NOT NULL) AS failures FROM cases)"""


@query("failure_taxonomy", f"WITH {CASE_SQL}, {FAIL_SQL} SELECT case_id, array_to_string(failures, ',') AS failures FROM f")
def failure_taxonomy(spark, sf_dir):
    return cases(spark, sf_dir).select("case_id", F.array_join("failures", ",").alias("failures"))


def mean_sql(c: str) -> str:
    return r(f"sum(round({c} * 10000)::BIGINT) / (10000.0::DOUBLE * count({c}))")


@query("run_documents", f"""WITH {CASE_SQL}, {FAIL_SQL} SELECT variant, v.half AS half, count(*) AS cases, {mean_sql('correct::INTEGER')} AS overall_accuracy, {mean_sql('retrieval_recall')} AS retrieval_recall_at_k, count(*) FILTER (WHERE expected_answerable AND predicted_answerable) AS tp, sum(len(failures))::BIGINT AS failures
FROM f JOIN (SELECT unnest(['model::a', 'model::b']) AS variant, unnest([0, 1]) AS half) v ON v.half = f.half GROUP BY ALL""")
def run_documents(spark, sf_dir):
    """Two runs written as JSON documents, read back strictly, and merged with known ones by id."""
    path = f"{storage.shared_dir(spark).rstrip('/')}/runs-{uuid.uuid4().hex}"
    for i, variant in enumerate(("model::a", "model::b")):
        c = cases(spark, sf_dir).filter(F.col("half") == i).withColumns({"case_id": F.col("case_id").cast("string"), "query": F.lit("q"), "failures": F.col("failures")})
        labels.write_jsonl(reports.benchmark_run(c, variant), f"{path}/{i}")
    runs = labels.read_runs(spark, f"{path}/*")
    every = reports.add_runs(runs.filter("variant = 'model::a'"), runs)
    shown = reports.run_history(every).join(every.select("run_id", "confusion", "failure_counts", F.size("cases").alias("n")), "run_id")
    total = F.aggregate(F.map_values("failure_counts"), F.lit(0).cast("long"), lambda a, b: a + b)
    return shown.select("variant", F.when(F.col("variant") == "model::a", 0).otherwise(1).alias("half"), F.col("n").cast("long").alias("cases"), "overall_accuracy", "retrieval_recall_at_k", F.col("confusion")["tp"].alias("tp"), total.alias("failures"))


@query("case_audit", f"""WITH {CASE_SQL}, {FAIL_SQL} SELECT case_id, expected_answerable, predicted_answerable, correct, array_to_string(failures, ', ') AS failures, confidence_score FROM f WHERE NOT correct OR len(failures) > 0""")
def case_audit(spark, sf_dir):
    return reports.case_audit(cases(spark, sf_dir).withColumn("query", F.lit(""))).drop("query")


@query("failure_counts", f"WITH {CASE_SQL}, {FAIL_SQL} SELECT failure, count(*) AS count FROM (SELECT unnest(failures) AS failure FROM f) GROUP BY failure")
def failure_counts(spark, sf_dir):
    return reports.failure_counts(cases(spark, sf_dir))


CONFUSION_SQL = "count(*) FILTER (WHERE expected_answerable AND predicted_answerable) AS tp, count(*) FILTER (WHERE NOT expected_answerable AND NOT predicted_answerable) AS tn, count(*) FILTER (WHERE NOT expected_answerable AND predicted_answerable) AS fp, count(*) FILTER (WHERE expected_answerable AND NOT predicted_answerable) AS fn"


@query("confusion_refusal", f"""WITH {CASE_SQL}, c AS (SELECT {CONFUSION_SQL} FROM cases), p AS (SELECT *, CASE WHEN tn + fn = 0 THEN 0.0::DOUBLE ELSE {r('tn::DOUBLE / (tn + fn)')} END AS refusal_precision, CASE WHEN tn + fp = 0 THEN 0.0::DOUBLE ELSE {r('tn::DOUBLE / (tn + fp)')} END AS refusal_recall FROM c)
SELECT *, CASE WHEN refusal_precision + refusal_recall = 0 THEN 0.0::DOUBLE ELSE {r('2 * refusal_precision * refusal_recall / (refusal_precision + refusal_recall)')} END AS refusal_f1 FROM p""")
def confusion_refusal(spark, sf_dir):
    return reports.refusal_scores(reports.confusion(cases(spark, sf_dir)))


BIN_SQL = "least(9, floor(confidence_score * 10))::INTEGER AS bin"


@query("calibration", f"""WITH {CASE_SQL}, b AS (SELECT {BIN_SQL}, count(*) AS n, avg(confidence_score) AS mc, avg(correct::INTEGER) AS mo, sum((confidence_score - correct::INTEGER) ** 2) AS sq FROM cases GROUP BY bin)
SELECT {r('sum(n * abs(mo - mc)) / sum(n)')} AS ece, {r('sum(sq) / sum(n)')} AS brier_score FROM b""")
def calibration(spark, sf_dir):
    return reports.calibration_error(cases(spark, sf_dir))


@query("calibration_bins", f"""WITH {CASE_SQL}, b AS (SELECT {BIN_SQL}, count(*) AS count, {r('avg(confidence_score)')} AS mean_confidence, {mean_sql('correct::INTEGER')} AS accuracy FROM cases GROUP BY bin)
SELECT {r('bin / 10.0', 2)} AS bin_lower, {r('(bin + 1) / 10.0', 2)} AS bin_upper, count, mean_confidence, accuracy FROM b""")
def calibration_bins(spark, sf_dir):
    return reports.calibration_bins(cases(spark, sf_dir))


@query("slice_metrics", f"""WITH {CASE_SQL}, s AS (SELECT *, unnest([lang, source]) AS slice FROM cases)
SELECT slice, count(*) AS cases, {mean_sql('correct::INTEGER')} AS accuracy, {mean_sql('retrieval_recall')} AS retrieval_recall, {mean_sql('citation_f1')} AS citation_f1, {mean_sql('rewrite_token_f1')} AS rewrite_f1, {mean_sql('latency_seconds')} AS mean_latency_seconds FROM s GROUP BY slice""")
def slice_metrics(spark, sf_dir):
    return reports.slices(cases(spark, sf_dir))


@query("safety_summary", f"""WITH {CASE_SQL} SELECT count(*) FILTER (WHERE lang = 'en') AS red_team_cases, {r("sum(CASE WHEN lang = 'en' AND correct THEN 10000 ELSE 0 END) / (10000.0::DOUBLE * count(*) FILTER (WHERE lang = 'en'))")} AS red_team_pass_rate,
count(*) FILTER (WHERE lang = 'de') AS safe_refusal_cases, {r("sum(CASE WHEN lang = 'de' AND correct THEN 10000 ELSE 0 END) / (10000.0::DOUBLE * count(*) FILTER (WHERE lang = 'de'))")} AS safe_refusal_pass_rate FROM cases""")
def safety_summary(spark, sf_dir):
    return reports.safety_summary(cases(spark, sf_dir), {"en": "red_team", "de": "safe_refusal"})


METRICS_SQL = f"""met AS (SELECT half, {mean_sql('correct::INTEGER')} AS overall_accuracy, {mean_sql('(expected_answerable = predicted_answerable)::INTEGER')} AS answerability_accuracy, {mean_sql('answer_token_f1')} AS answer_token_f1, {mean_sql('retrieval_recall')} AS retrieval_recall_at_k, {mean_sql('reciprocal_rank')} AS mrr,
{mean_sql('citation_recall')} AS citation_recall, {mean_sql('citation_f1')} AS citation_f1, {mean_sql('rewrite_token_f1')} AS rewrite_token_f1, {mean_sql('latency_seconds')} AS mean_latency_seconds, {CONFUSION_SQL} FROM cases GROUP BY half),
ref AS (SELECT *, CASE WHEN tn + fn = 0 THEN 0.0::DOUBLE ELSE {r('tn::DOUBLE / (tn + fn)')} END AS refusal_precision, CASE WHEN tn + fp = 0 THEN 0.0::DOUBLE ELSE {r('tn::DOUBLE / (tn + fp)')} END AS refusal_recall FROM met),
cal AS (SELECT half, {r('sum(n * abs(mo - mc)) / sum(n)')} AS ece, {r('sum(sq) / sum(n)')} AS brier_score FROM (SELECT half, {BIN_SQL}, count(*) AS n, avg(confidence_score) AS mc, avg(correct::INTEGER) AS mo, sum((confidence_score - correct::INTEGER) ** 2) AS sq FROM cases WHERE predicted_answerable GROUP BY half, bin) GROUP BY half),
wide AS (SELECT ref.* EXCLUDE (tp, tn, fp, fn), CASE WHEN refusal_precision + refusal_recall = 0 THEN 0.0::DOUBLE ELSE {r('2 * refusal_precision * refusal_recall / (refusal_precision + refusal_recall)')} END AS refusal_f1, ece, brier_score FROM ref JOIN cal ON ref.half = cal.half),
long AS (UNPIVOT wide ON COLUMNS(* EXCLUDE half) INTO NAME metric VALUE value),
cmp AS (SELECT b.metric, b.value AS b, c.value AS c, c.value - b.value AS d FROM long b JOIN long c ON b.metric = c.metric AND b.half = 0 AND c.half = 1)"""
HIGHER_SQL = ", ".join(f"'{m}'" for m in lab.HIGHER)


def halves(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c = cases(spark, sf_dir)
    return tuple(reports.metrics_long(reports.run_metrics(c.filter(F.col("half") == h))) for h in (0, 1))


@query("compare_runs", f"WITH {CASE_SQL}, {METRICS_SQL} SELECT metric, {r('b')} AS baseline, {r('c')} AS candidate, {r('d')} AS delta, CASE WHEN metric IN ({HIGHER_SQL}) THEN d < -0.02::DOUBLE ELSE d > 0.02::DOUBLE END AS regression FROM cmp")
def compare_runs(spark, sf_dir):
    return lab.compare_runs(*halves(spark, sf_dir))


TOLERANCE_SQL = "CASE metric " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in lab.TOLERANCES.items()) + " ELSE 0.02::DOUBLE END"


@query("regression_gate", f"""WITH {CASE_SQL}, {METRICS_SQL}, g AS (SELECT metric, {r('b')} AS baseline, {r('c')} AS candidate, {r('d')} AS delta, CASE WHEN metric IN ({HIGHER_SQL}) THEN d < 0 ELSE d > 0 END AS regression, {TOLERANCE_SQL} AS tolerance FROM cmp),
h AS (SELECT *, CASE WHEN metric IN ({HIGHER_SQL}) THEN delta < -tolerance ELSE delta > tolerance END AS gate_failed FROM g) SELECT *, NOT bool_or(gate_failed) OVER () AS passed FROM h""")
def regression_gate(spark, sf_dir):
    return lab.regression_gate(*halves(spark, sf_dir))


@query("run_metrics", f"""WITH {CASE_SQL.replace('d.doc_id % 2 AS half', '0 AS half')}, {METRICS_SQL} SELECT (SELECT count(*) FROM cases) AS cases, wide.* EXCLUDE (half), NULL::DOUBLE AS answer_exact_match, NULL::DOUBLE AS citation_precision, tp, tn, fp, fn FROM wide JOIN ref ON ref.half = wide.half""")
def run_metrics(spark, sf_dir):
    return reports.run_metrics(cases(spark, sf_dir))


@query("efficiency", f"""SELECT {r('avg(v)')} AS mean_latency_seconds, {r('quantile_cont(v, 0.5)')} AS p50_latency_seconds, {r('quantile_cont(v, 0.95)')} AS p95_latency_seconds, {r('avg(p)', 2)} AS mean_prompt_tokens, {r('avg(c)', 2)} AS mean_completion_tokens, {r('avg(p + c)', 2)} AS mean_total_tokens, sum(p + c)::BIGINT AS total_tokens,
{r('avg(u)', 8)} AS mean_estimated_cost_usd, {r('sum(u)', 8)} AS total_estimated_cost_usd FROM (SELECT *, {r('p / 1000000.0::DOUBLE * 0.5::DOUBLE + c / 1000000.0::DOUBLE * 1.5::DOUBLE', 8)} AS u FROM (SELECT value / 1000 AS v, user_id % 100 AS p, event_id % 50 AS c FROM events))""")
def efficiency(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("value").alias("total_ms"), (F.col("user_id") % 100).alias("prompt_tokens"), (F.col("event_id") % 50).alias("completion_tokens"))
    spent = py_round(F.col("prompt_tokens") / 1_000_000 * 0.5 + F.col("completion_tokens") / 1_000_000 * 1.5, 8)
    return reports.efficiency(e.withColumns({"total_tokens": F.col("prompt_tokens") + F.col("completion_tokens"), "estimated_cost_usd": spent}))


@query("latency_windows", f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, {r('avg(value)')} AS mean_value, max(value) AS max_value FROM events GROUP BY ALL")
def windows_of_latency(spark, sf_dir):
    return latency_windows(read(spark, sf_dir, "events")).withColumn("mean_value", py_round(F.col("mean_value"), 4))


# ---- whole runs over the regression set --------------------------------------------------------------------------


def full_run(spark: SparkSession, mode: str = "hybrid", threshold: float = 0.3, gold: DataFrame | None = None, chunks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Case evaluations and traces of labelled cases (the built-in ones), each asked in its own words with its history; the
    labels are seen by the evaluation alone. Without a model: the extractive provider, and the last question as rewriter."""
    gold = regression_set.cases(spark) if gold is None else gold
    chunks = embedding.embed(chunking.chunk_pages(regression_set.pages(spark), 800, 100)) if chunks is None else chunks
    asked = gold.select(F.col("case_id").alias("query_id"), "query", answering.history_of(F.col("history")).alias("history"))
    traces = answering.turn(asked, chunks, answering.Extractive(), mode, threshold, embedder=embedding.embed, rewriter=answering.LastQuestion()).withColumnRenamed("query_id", "case_id")
    return evaluation.evaluate(gold, traces, latency_slo_seconds=8.0), traces


def conversation_cases(spark, sf_dir, pages: DataFrame | None = None) -> DataFrame:
    """document_cases() as conversations: the first half of an item is said before, the second half is asked."""
    half = F.floor(F.length("query") / 2).cast("int")
    said = F.struct(F.lit("user").alias("role"), F.expr("substring(query, 1, cast(floor(length(query) / 2) as int))").alias("content"))
    asked = F.expr("substring(query, cast(floor(length(query) / 2) as int) + 1)")
    c = document_cases(spark, sf_dir, pages).withColumns({"expected_answer": F.lit(None).cast("string"), "expected_standalone_query": F.col("query"), "history": F.when(half > 0, F.array(said)), "tags": F.array(F.lit("conversational"))})
    return c.withColumn("query", asked)


F1_SQL = """xs AS (SELECT case_id, t, count(*) AS n FROM (SELECT case_id, unnest(regexp_extract_all(a, '[a-z0-9]+')) AS t FROM {of}) GROUP BY ALL), ys AS (SELECT case_id, t, count(*) AS n FROM (SELECT case_id, unnest(regexp_extract_all(b, '[a-z0-9]+')) AS t FROM {of}) GROUP BY ALL),
bt AS (SELECT xs.case_id, sum(least(xs.n, ys.n)) AS bth FROM xs JOIN ys ON xs.case_id = ys.case_id AND xs.t = ys.t GROUP BY xs.case_id)"""
CONVERSATION_SQL = r"SELECT query_id, query, CASE WHEN half > 0 THEN left(trim(left(left(text, half), 100) || ' ' || query), 300) ELSE query END AS standalone FROM (SELECT item_id AS query_id, text, length(text) // 2 AS half, regexp_replace(substr(text, length(text) // 2 + 1), '^\s+|\s+$', '', 'g') AS query FROM benchmark)"
RUN_SQL = f"""{answers_sql(CONVERSATION_SQL, 0.3)},
fl AS (SELECT item_id AS case_id, text AS whole, substr(text, length(text) // 2 + 1) AS query, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS flat FROM benchmark),
gd AS (SELECT fl.case_id, list_sort(list(DISTINCT 'doc-' || pg.id || '.txt')) AS goal FROM fl JOIN pg ON contains(trim(regexp_replace(lower(pg.text), '\\s+', ' ', 'g')), flat) WHERE flat <> '' GROUP BY fl.case_id),
cs AS (SELECT fl.case_id, fl.query, fl.whole, goal IS NOT NULL AS e, coalesce(goal, []) AS goal, tr.docs, NOT is_refusal AS p, coalesce(generated, answer) AS said, standalone, confidence, confidence_score, {CLEAN_SQL.format(c='standalone')} AS a, {CLEAN_SQL.format(c='whole')} AS b FROM fl JOIN tr ON tr.query_id = fl.case_id LEFT JOIN gd ON gd.case_id = fl.case_id),
{F1_SQL.format(of='cs')},
m1 AS (SELECT cs.*, len(list_intersect(goal, docs)) AS found, list_min(list_filter(list_transform(goal, lambda g: list_position(docs, g)), lambda i: i > 0)) AS first, list_distinct(list_transform(list_filter({cited_sql('said')}, lambda i: i::BIGINT BETWEEN 1 AND len(docs)), lambda i: docs[i::BIGINT])) AS cited, len(regexp_extract_all(a, '[a-z0-9]+'))::DOUBLE AS na, len(regexp_extract_all(b, '[a-z0-9]+'))::DOUBLE AS nb, bth FROM cs LEFT JOIN bt ON bt.case_id = cs.case_id),
m2 AS (SELECT *, CASE WHEN len(goal) > 0 THEN {r('found / len(goal)')} END AS recall, CASE WHEN len(goal) > 0 THEN CASE WHEN first IS NULL THEN 0.0::DOUBLE ELSE {r('1.0 / first')} END END AS rr, len(list_intersect(cited, goal)) AS hit, CASE WHEN na = 0 AND nb = 0 THEN 1.0::DOUBLE WHEN na = 0 OR nb = 0 OR bth IS NULL THEN 0.0::DOUBLE ELSE {r('2 * (bth / na) * (bth / nb) / (bth / na + bth / nb)')} END AS rewrite_token_f1 FROM m1),
m3 AS (SELECT *, CASE WHEN len(goal) > 0 THEN CASE WHEN len(cited) = 0 THEN 0.0::DOUBLE ELSE {r('hit / len(cited)')} END END AS cp, CASE WHEN len(goal) > 0 THEN {r('hit / len(goal)')} END AS cr, CASE WHEN len(goal) > 0 THEN CASE WHEN hit = 0 THEN 0.0::DOUBLE ELSE {r('2 * (hit::DOUBLE / len(cited)) * (hit::DOUBLE / len(goal)) / (hit::DOUBLE / len(cited) + hit::DOUBLE / len(goal))')} END END AS cf,
  CASE WHEN NOT e THEN NOT p WHEN NOT p THEN false ELSE recall > 0 END AS correct, CASE WHEN confidence_score IS NOT NULL THEN confidence_score WHEN confidence = 'High' THEN 0.85::DOUBLE WHEN confidence = 'Medium' THEN 0.65::DOUBLE ELSE 0.25::DOUBLE END AS conf FROM m2),
ev AS (SELECT case_id, query, e AS expected_answerable, p AS predicted_answerable, correct, NULL::DOUBLE AS answer_exact_match, NULL::DOUBLE AS answer_token_f1, recall AS retrieval_recall, rr AS reciprocal_rank, cp AS citation_precision, cr AS citation_recall, cf AS citation_f1, rewrite_token_f1, conf AS confidence_score,
array_to_string(list_filter([CASE WHEN e AND NOT p THEN 'WRONG_REFUSAL' END, CASE WHEN NOT e AND p THEN 'WRONG_ANSWERABILITY' END, CASE WHEN e AND recall = 0 THEN 'RETRIEVAL_MISS' END, CASE WHEN rewrite_token_f1 < 0.8 THEN 'QUERY_REWRITE_DRIFT' END, CASE WHEN e AND p AND cr = 0 THEN 'CITATION_MISS' END,
CASE WHEN cr > 0 AND cr < 1 THEN 'CITATION_OFF_GOLD' END, CASE WHEN NOT correct AND conf >= 0.8 THEN 'OVERCONFIDENT_ERROR' END, CASE WHEN p AND correct AND conf <= 0.4 THEN 'UNDERCONFIDENT_CORRECT' END], lambda x: x IS NOT NULL), ',') AS failures, 'conversational' AS tags FROM m3)"""


@query("labelled_run", f"WITH RECURSIVE {RUN_SQL} SELECT * FROM ev")
def labelled_run(spark, sf_dir):
    """Evaluations but for the latency, which differs each time."""
    with storage.scratch(spark):
        pages = indexed_pages(spark, sf_dir)
        chunks = storage.stored(chunking.chunk_pages(pages), "chunks")
        gold = storage.stored(conversation_cases(spark, sf_dir, pages), "cases")
        c = storage.stored(full_run(spark, "lexical", 0.3, gold, chunks)[0], "evaluations", keep=True)
    return c.withColumns({"failures": F.array_join(F.array_remove("failures", "LATENCY_REGRESSION"), ","), "tags": F.array_join("tags", ",")}).drop("latency_seconds")


def document_cases(spark, sf_dir, pages: DataFrame | None = None) -> DataFrame:
    """A case for each benchmark item: answerable if an indexed document (pages, if they are stored) holds its text, but for
    case and blanks."""
    items = questions(spark, sf_dir)
    with storage.scratch(spark):
        held = evidence.holders(items, indexed_pages(spark, sf_dir) if pages is None else pages, "query_id", "query", "source_doc", "text")
        held = storage.stored(held, "labels", keep=True)
    docs = held.groupBy("query_id").agg(F.array_sort(F.collect_set("source_doc")).alias("docs"))
    none = F.array().cast("array<string>")
    return items.join(docs, "query_id", "left").select(
        F.col("query_id").alias("case_id"), "query", F.lit(None).cast("string").alias("expected_standalone_query"), F.col("docs").isNotNull().alias("expected_answerable"),
        none.alias("expected_chunk_ids"), F.coalesce("docs", none).alias("expected_source_docs"),
    )


def grid_sql(modes: dict[str, str], cells: str) -> str:
    """CTEs up to o, the figures of each collection, mode and cell (seq, top_k, threshold) of a grid; behind cks (collection,
    chunk_id, source_doc, text, dt) and pg, the indexed documents. modes: of each the rows collection, query_id, chunk_id, similarity, rank."""
    every = " UNION ALL ".join(f"SELECT '{m}' AS mode, * FROM ({x})" for m, x in modes.items())
    return f"""fl AS (SELECT item_id AS case_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS flat FROM benchmark),
gd AS (SELECT fl.case_id, list_distinct(list(lower('doc-' || pg.id || '.txt'))) AS goal FROM fl JOIN pg ON contains(trim(regexp_replace(lower(pg.text), '\\s+', ' ', 'g')), flat) WHERE flat <> '' GROUP BY fl.case_id),
cs AS (SELECT fl.case_id, goal IS NOT NULL AS e, coalesce(goal, []) AS goal FROM fl LEFT JOIN gd ON gd.case_id = fl.case_id),
hit AS (SELECT x.*, lower(cks.source_doc) AS doc FROM ({every}) x JOIN cks USING (collection, chunk_id)), grid AS ({cells}),
h AS (SELECT collection, mode, g.seq, g.top_k, g.threshold, case_id, any_value(e) AS e, any_value(len(goal)) AS goals, coalesce(max(similarity) FILTER (WHERE rank = 1), -1) >= g.threshold AS yes,
  count(DISTINCT doc) FILTER (WHERE rank <= g.top_k AND similarity >= g.threshold AND list_contains(goal, doc)) AS found, min(rank) FILTER (WHERE rank <= g.top_k AND similarity >= g.threshold AND list_contains(goal, doc)) AS first
  FROM cs JOIN hit ON hit.query_id = case_id, grid g GROUP BY collection, mode, g.seq, g.top_k, g.threshold, case_id),
h2 AS (SELECT *, CASE WHEN goals > 0 THEN {r('found / goals')} END AS recall, CASE WHEN goals > 0 THEN CASE WHEN first IS NULL THEN 0.0::DOUBLE ELSE {r('1.0 / first')} END END AS rr FROM h),
a AS (SELECT collection, mode, seq, top_k, threshold, count(*) AS cases, coalesce({mean_sql('recall')}, 0.0) AS recall, coalesce({mean_sql('rr')}, 0.0) AS mrr, count(*) FILTER (WHERE e AND yes) AS tp, count(*) FILTER (WHERE NOT e AND NOT yes) AS tn, count(*) FILTER (WHERE NOT e AND yes) AS fp, count(*) FILTER (WHERE e AND NOT yes) AS fn FROM h2 GROUP BY ALL),
s AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fn) END AS r, CASE WHEN tn + fp = 0 THEN 0.0 ELSE tn::DOUBLE / (tn + fp) END AS sp FROM a),
o AS (SELECT collection, mode, seq, top_k, {r('threshold', 3)} AS threshold, cases, recall AS retrieval_recall_at_k, mrr, tp, tn, fp, fn, {r('(tp + tn)::DOUBLE / cases')} AS answerability_accuracy, {r('p')} AS answerable_precision, {r('r')} AS answerable_recall, {r('CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END')} AS answerable_f1, {r('(r + sp) / 2')} AS balanced_accuracy FROM s)"""


FIRST_PAGES_SQL = "SELECT min(doc_id) AS id, any_value(text) AS text FROM documents WHERE text IS NOT NULL GROUP BY sha256(text)"
HYBRID_RANKED_SQL = "SELECT collection, query_id, chunk_id, rerank_score AS similarity, row_number() OVER (PARTITION BY collection, query_id ORDER BY rerank_score DESC, chunk_id)::INTEGER AS rank FROM f"
MODES_SQL = {
    "dense": "SELECT collection, query_id, chunk_id, dense_score AS similarity, rank FROM near",
    "lexical": f"SELECT collection, query_id, chunk_id, {r('score')} AS similarity, rank FROM ranked",
    "hybrid": HYBRID_RANKED_SQL,
}
CELLS_SQL = f"SELECT (row_number() OVER (ORDER BY k, t) - 1)::INTEGER AS seq, k::INTEGER AS top_k, t::DOUBLE AS threshold FROM (SELECT unnest({lab.TOP_KS}) AS k), (SELECT unnest({lab.ABLATION_THRESHOLDS}) AS t)"
ABLATED_SQL = f"""pg AS ({FIRST_PAGES_SQL}),
cks AS (SELECT '' AS collection, id::VARCHAR AS chunk_id, 'doc-' || id || '.txt' AS source_doc, text, {tok('text')} AS dt FROM pg),
{BY_COLLECTION_SQL}, {near_sql('cks', 'chunk_id')}, {FUSED_SQL}, {grid_sql(MODES_SQL, CELLS_SQL)}"""
VARIANTS = [(s, o) for s in lab.CHUNK_SIZES for o in lab.OVERLAPS]
# Ids of chunks are led by the cell's, as they are unique within it alone.
VARIANTS_SQL = " UNION ALL ".join(f"""SELECT * FROM (WITH RECURSIVE {chunks_sql(FIRST_PAGES_SQL, s, o)} SELECT '{i}' AS collection, '{i}#' || left(sha256(pg.text), 12) || '_p1_c' || ch.k AS chunk_id, 'doc-' || pg.id || '.txt' AS source_doc, ch.text FROM ch JOIN pg ON pg.id = ch.id WHERE ch.k > 0)""" for i, (s, o) in enumerate(VARIANTS))
CHUNKED_SQL = f"""pg AS ({FIRST_PAGES_SQL}), cks AS MATERIALIZED (SELECT *, {tok('text')} AS dt FROM ({VARIANTS_SQL})),
{BY_COLLECTION_SQL}, {near_sql('cks', 'chunk_id')}, {FUSED_SQL}, {grid_sql({'hybrid': HYBRID_RANKED_SQL}, 'SELECT 4::INTEGER AS top_k, 0.4::DOUBLE AS threshold, 0 AS seq')},
vs AS (SELECT collection, count(*) AS indexed_chunks FROM cks GROUP BY collection), va AS (SELECT (row_number() OVER (ORDER BY s, o) - 1)::INTEGER AS seq, s::INTEGER AS chunk_size, o::INTEGER AS overlap FROM (SELECT unnest({lab.CHUNK_SIZES}) AS s), (SELECT unnest({lab.OVERLAPS}) AS o))"""


@query("evidence_labels", f"""SELECT item_id, 'doc-' || pg.id || '.txt' AS source_doc FROM benchmark b JOIN ({FIRST_PAGES_SQL}) pg ON contains(trim(regexp_replace(lower(pg.text), '\\s+', ' ', 'g')), trim(regexp_replace(lower(b.text), '\\s+', ' ', 'g'))) WHERE trim(regexp_replace(lower(b.text), '\\s+', ' ', 'g')) <> ''""")
def evidence_labels(spark, sf_dir):
    """Each benchmark item with the indexed documents that hold it, but for case and blanks."""
    with storage.scratch(spark):
        return storage.stored(evidence.holders(read(spark, sf_dir, "benchmark"), indexed_pages(spark, sf_dir), "item_id", "text", "source_doc", "text"), "labels", keep=True)


@query("retrieval_ablation_modes", f"WITH {ABLATED_SQL} SELECT * EXCLUDE (collection) FROM o")
def retrieval_ablation_modes(spark, sf_dir):
    """All 36 cells: benchmark against documents in every mode. retrieval_ablation has the dense ones over embeddings, as its SQL."""
    with storage.scratch(spark):
        pages = indexed_pages(spark, sf_dir)
        gold = storage.stored(document_cases(spark, sf_dir, pages), "cases")
        docs = pages.withColumn("chunk_id", F.col("doc_id").cast("string")).filter("text is not null")
        found = retrieval.every_mode(embedding.embed(lab.probe_queries(gold), "query"), embedding.embed(docs), max(lab.TOP_KS))
        cases = storage.stored(lab.probes(gold, found, docs), "probes", keep=True)
    return lab.retrieval_ablation(cases)


@query("chunking_ablation", f"WITH RECURSIVE {CHUNKED_SQL} SELECT o.* EXCLUDE (collection, seq), va.*, indexed_chunks FROM o JOIN vs USING (collection) JOIN va ON va.seq = o.collection::INTEGER")
def chunking_ablation(spark, sf_dir):
    """The whole default grid of sizes and overlaps over all documents."""
    with storage.scratch(spark):
        pages = indexed_pages(spark, sf_dir)
        gold = storage.stored(document_cases(spark, sf_dir, pages), "cases")
        rows = lab.chunking_ablation(gold, pages, embedding.embed)
        rows = storage.stored(rows, "rows", keep=True)
    return rows.orderBy(F.desc("balanced_accuracy"), F.desc("retrieval_recall_at_k"), F.desc("mrr"), "chunk_size", "overlap")
