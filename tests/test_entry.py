import __spark_entry__ as entry


def test_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 35


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "chunk_id", "lexical_score", "rank"] and df.count() == 400


def test_stream(spark, tmp_path):
    from assayer.streaming.landing import landed

    (tmp_path / "in").mkdir()
    for name, raw in {"a.txt": b"One", "b.txt": b"One", "c.exe": b"x"}.items():
        (tmp_path / "in" / name).write_bytes(raw)
    q = landed(spark, str(tmp_path / "in"), 100).writeStream.format("memory").queryName("landed").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT count(*) FROM landed").first()[0] == 1
