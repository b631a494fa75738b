import pytest
from pyspark.sql import functions as F

from assayer.operators import chunking, retrieval, tables

SCHEMA = "collection string, chunk_id string, text string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frame(spark, *found):
    return spark.createDataFrame(list(found), SCHEMA)


@pytest.fixture
def table(spark, tmp_path):
    t = tables.ChunkTable(spark, str(tmp_path / "t"), SCHEMA)
    t.upsert(frame(spark, ("a", "1", "red kite"), ("a", "2", "red fee fee"), ("b", "1", "red kite days"), ("b", "3", None)))
    return t


def fresh(df):
    """Statistics of the rows, counted anew."""
    out = []
    for c in sorted({r.collection for r in df.collect()}):
        own = df.filter(F.col("collection") == c)
        n = retrieval.lengths(own).agg(F.count("*"), F.sum("length")).first()
        out += [(c, None, n[0], n[1], 0, 0), *((c, r.term, 0, 0, r.df, r.total_tf) for r in retrieval.term_stats(own).collect())]
    return sorted(out, key=repr)


def test_changes_are_read_back_and_statistics_follow(spark, table):
    state = {("a", "1"): "red kite", ("a", "2"): "red fee fee", ("b", "1"): "red kite days", ("b", "3"): None}
    steps = [
        lambda: (table.upsert(frame(spark, ("a", "1", "blue kite kite"), ("c", "9", "new fee"))), state.update({("a", "1"): "blue kite kite", ("c", "9"): "new fee"})),
        lambda: (table.delete(frame(spark, ("a", "2", ""), ("a", "none", ""))), state.pop(("a", "2"))),
        lambda: (table.upsert(frame(spark, ("a", "2", "back again"))), state.update({("a", "2"): "back again"})),
        lambda: (table.clear("b"), state.pop(("b", "1")), state.pop(("b", "3"))),
        lambda: (table.upsert(frame(spark, ("b", "3", "red"))), state.update({("b", "3"): "red"})),
        lambda: table.clear("nothing"),
        lambda: table.compact(),
        lambda: table.vacuum(),
        lambda: (table.upsert(frame(spark, ("b", "3", "red red"))), state.update({("b", "3"): "red red"})),
    ]
    for step in steps:
        step()
        got = table.read()
        assert rows(got) == sorted(((*k, v) for k, v in state.items()), key=repr)
        assert rows(table.statistics()) == fresh(got)
    assert table.count() == len(state)
    assert [r.collection for r in chunking.document_names(table.read().withColumnRenamed("collection", "source_doc")).select(F.col("source_doc").alias("collection")).collect()] == ["a", "b", "c"]


def test_old_snapshots_and_killed_writes(spark, table, monkeypatch):
    before, version = rows(table.read()), table.version()
    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        def killed(*_):
            raise KeyboardInterrupt

        m.setattr(table, "_commit", killed)
        table.upsert(frame(spark, ("a", "1", "lost")))
    assert table.version() == version and rows(table.read()) == before
    table.upsert(frame(spark, ("a", "1", "kept")))
    assert rows(table.read(version)) == before and ("a", "1", "kept") in rows(table.read())
    again = tables.ChunkTable(spark, table.path)
    assert again.version() == version + 1 and rows(again.read()) == rows(table.read())
    table.vacuum()
    assert rows(again.read()) == rows(table.read())


def test_of_two_writers_one_fails(spark, table, monkeypatch):
    other = tables.ChunkTable(spark, table.path)
    version = table.version()
    monkeypatch.setattr(other, "version", lambda: version)
    table.upsert(frame(spark, ("a", "1", "first")))
    with pytest.raises(tables.Conflict):
        other.upsert(frame(spark, ("a", "1", "second")))
    assert ("a", "1", "first") in rows(table.read())


def test_of_repeated_keys_the_last_counts_and_tables_must_be_there(spark, table, tmp_path):
    table.upsert(spark.createDataFrame([("a", "7", "one", 1), ("a", "7", "two", 2)], f"{SCHEMA}, seq int"))
    assert ("a", "7", "two") in rows(table.read())
    with pytest.raises(FileNotFoundError):
        tables.ChunkTable(spark, str(tmp_path / "none"))
    empty = tables.ChunkTable(spark, str(tmp_path / "empty"), SCHEMA)
    assert rows(empty.read()) == [] and rows(empty.statistics()) == []
