import io
import zipfile

import pytest
from pyspark.sql import functions as F

from assayer.operators import chunking
from assayer.sources import config, labels, providers, regression_set, uploads


def test_names_and_errors(spark):
    rows = [("C:\\x\\..\\My file (1).txt", b"a"), ("a/b/", b"a"), ("", b"a"), (".txt", b"a"), ("x.TXT", b""), ("x.md", b"1234567"), ("x.csv", b"a\x00"), ("x.pdf", b"a\x00"), ("x.exe", b"")]
    df = spark.createDataFrame([(i, n, bytearray(b)) for i, (n, b) in enumerate(rows)], "i int, name string, content binary")
    got = df.select("i", uploads.sanitize_filename(F.col("name")).alias("safe"), uploads.upload_error(F.col("name"), F.col("content"), 6).alias("e")).orderBy("i").collect()
    assert [r.safe for r in got][:4] == ["My file _1_.txt", "b", "document", ".txt"]
    assert [r.e for r in got] == [None, "unsupported_type", "unsupported_type", "unsupported_type", "empty", "too_large", "binary_text", None, "unsupported_type"]


def test_guard(spark):
    df = spark.createDataFrame([("=1+1",), (" \t-2",), ("a=1",), ("@x",), ("",)], "t string")
    assert [r.x for r in df.select(uploads.guard_formula(F.col("t")).alias("x")).collect()] == ["'=1+1", "' \t-2", "a=1", "'@x", ""]


def docx() -> bytes:
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = p("First") + f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>" + p(" ") + p("Second")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_parsers():
    assert uploads.parse_file(docx(), ".docx", 9)[0] == [(1, "First\n\nSecond\n\na | b")]
    assert uploads.parse_file(b"n;v\nx; =1\n", ".csv", 9)[0] == [(1, "Row 1: n | v\nRow 2: x | '=1")]
    assert uploads.parse_file("\ufeffé".encode(), ".txt", 9)[0] == [(1, "é")]
    assert uploads.parse_file(b"caf\xe9 \x80", ".md", 9)[0] == [(1, "café €")]
    for raw, ext in ((b"no zip", ".docx"), (b"no pdf", ".pdf"), (b"a\n" * 10_001, ".csv")):
        with pytest.raises(ValueError, match="."):
            uploads.parse_file(raw, ext, 9)


def test_upload_folder(spark, tmp_path):
    for name, raw in {"a.txt": b"One. Two.", "b.md": b"One. Two.", "c.docx": docx(), "d.docx": b"broken", "e.exe": b"x", "f.txt": b"  ", "g.txt": b"known"}.items():
        (tmp_path / name).write_bytes(raw)
    known = spark.createDataFrame([(b"known",)], "c binary").select(F.sha2("c", 256).alias("document_hash"))
    files, refused = uploads.read_uploads(spark, str(tmp_path), 10_000, known)
    pages = uploads.parse_documents(files)
    got = {r.source_doc: (r.page_number, r.error_code) for r in pages.collect()}
    assert got == {"a.txt": (1, None), "c.docx": (1, None), "d.docx": (None, "parse_error"), "f.txt": (None, "no_text")}
    assert [(r.source_doc, r.error_code) for r in refused.collect()] == [("e.exe", "unsupported_type")]
    m = {r.source_doc: r for r in chunking.manifest(pages, chunking.chunk_pages(pages)).collect()}
    assert (m["a.txt"].pages, m["a.txt"].chunks, m["a.txt"].error_code) == (1, 1, None) and m["d.docx"].error_code == "parse_error"


def test_config():
    c = config.load_config({"ASSAYER_TOP_K": "7", "ASSAYER_RETRIEVAL_MODE": "Hybrid"})
    assert (c.top_k, c.retrieval_mode, c.chunk_size_chars, c.provider_ready) == (7, "hybrid", 1800, False)
    for bad in ({"TOP_K": "13"}, {"TOP_K": "x"}, {"PROVIDER": "other"}, {"CHUNK_SIZE_CHARS": "400", "CHUNK_OVERLAP_CHARS": "400"}, {"SIMILARITY_THRESHOLD": "1.5"}):
        with pytest.raises(ValueError, match="must be"):
            config.load_config({f"ASSAYER_{k}": v for k, v in bad.items()})


def test_cases(spark):
    good = '{"case_id": "a", "query": " q ", "expected_answerable": true, "expected_answer": " x ", "tags": ["t"], "history": [{"role": "user", "content": "hi"}]}'
    lines = ["# note", "", good, good, "{", "[]", '{"case_id": "b"}', '{"case_id": "c", "query": "q", "expected_answerable": "yes"}', '{"case_id": "d", "query": "q", "expected_answerable": true}', '{"case_id": "e", "query": "q", "expected_answerable": false, "tags": [" "]}']
    cases, refused = labels.parse_cases(spark.createDataFrame(list(enumerate(lines, 1)), "line_no long, value string"))
    r = cases.collect()
    assert len(r) == 1 and (r[0].query, r[0].expected_answer, r[0].history[0].content) == ("q", "x", "hi")
    assert [x.line_no for x in refused.orderBy("line_no").collect()] == [4, 5, 6, 7, 8, 9, 10]
    assert labels.load_cases(spark, good).count() == 1
    for bad in ("", "# only", good + "\n" + good, "{"):
        with pytest.raises(ValueError, match="."):
            labels.load_cases(spark, bad)


def test_regression_set(spark, tmp_path):
    c = regression_set.cases(spark)
    assert c.count() == c.select("case_id").distinct().count() == 160
    assert {t for r in c.collect() for t in r.tags} == {"plain", "reworded", "conversational", "safe-refusal", "red-team", "multi-document"}
    labels.write_jsonl(c.coalesce(1), f"{tmp_path}/gold")
    text = spark.read.text(f"{tmp_path}/gold").collect()
    assert labels.load_cases(spark, "\n".join(r.value for r in text)).count() == 160


def test_providers():
    assert providers.judge('x {"score": 1.5, "unsupported_claims": ["a"], "reasoning": "r"} y') == (1.0, ["a"], "r")
    with pytest.raises(providers.ProviderError):
        providers.judge("none")
    p = providers.build_provider(config.Config())
    assert providers.with_model(p, "other").model == "other" and providers.with_model(p, "other").url == p.url
    assert providers.error_text(429) != providers.error_text(None)
    assert providers.HttpChat("ollama", "m", "http://127.0.0.1:9/x", timeout=1).complete([("s", "u")]) == [None]
    assert providers.build_provider(config.Config(provider="extractive")).name == "extractive"
