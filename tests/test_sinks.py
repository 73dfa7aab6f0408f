"""Keyed tables and batches on files: what is rewritten, what comes again, what is undone."""

import os

import pytest

from docweave.sinks.batches import BatchSink, Write
from docweave.sinks.keyed import KeyedTable

SCHEMA = "id long, part string, value double"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows(table):
    return {tuple(r) for r in table.rows().collect()}


@pytest.fixture
def make(spark, tmp_path):
    return lambda name="t", **more: KeyedTable(spark, f"{tmp_path}/{name}", SCHEMA, more.pop("keys", ["id"]), buckets=16, **more)


def test_upsert_rewrites_the_buckets_of_its_keys(spark, make, tmp_path):
    table = make()
    assert rows(table) == set()
    table.upsert(spark.createDataFrame([(i, "a", 1.0) for i in range(400)], SCHEMA))
    before = files(tmp_path)
    new = spark.createDataFrame([(7, "b", 2.0), (1000, "b", 3.0)], SCHEMA)
    buckets = table.upsert(new, batch="one")
    after = files(tmp_path)
    assert len(before) == 16 and len(buckets) <= 2
    assert len(set(before) - set(after)) <= len(buckets) and len(set(before) & set(after)) >= 14
    assert rows(table) == {(i, "a", 1.0) for i in range(400) if i != 7} | {(7, "b", 2.0), (1000, "b", 3.0)}
    assert table.upsert(new, batch="one") == [] and files(tmp_path) == after
    table.upsert(new)  # without a number the batch is written again, to the same rows
    assert rows(table) == {(i, "a", 1.0) for i in range(400) if i != 7} | {(7, "b", 2.0), (1000, "b", 3.0)}


def test_other_writes(spark, make):
    table = make()
    table.upsert(spark.createDataFrame([(1, "a", 1.0), (1, "b", 0.5), (2, "a", 1.0), (None, "n", 1.0)], SCHEMA))
    assert rows(table) == {(1, "b", 0.5), (2, "a", 1.0), (None, "n", 1.0)}
    table.insert_missing(spark.createDataFrame([(1, "x", 9.0), (3, "x", 9.0)], SCHEMA))
    table.set_values(spark.createDataFrame([(2, 5.0), (3, None), (77, 1.0)], "id long, value double"))
    assert rows(table) == {(1, "b", 0.5), (2, "a", 5.0), (3, "x", 9.0), (None, "n", 1.0)}
    table.delete(spark.createDataFrame([(1,), (2,), (3,)], "id long"))
    assert rows(table) == {(None, "n", 1.0)}
    table.upsert(spark.createDataFrame([], SCHEMA))
    assert rows(table) == {(None, "n", 1.0)}


def test_groups_are_replaced(spark, make):
    table = make(keys=["part", "id"], group=["part"])
    table.upsert(spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.0), (1, "b", 1.0)], SCHEMA))
    table.replace_groups(spark.createDataFrame([(9, "a", 2.0)], SCHEMA))
    assert rows(table) == {(9, "a", 2.0), (1, "b", 1.0)}


def sink_of(spark, make, tmp_path, fail):
    one, two = make("one"), make("two")

    def writes(batch, n):
        def broken(rows):
            if n in fail:
                raise RuntimeError("second store is down")
            return rows

        two.last_of_key = lambda rows, f=KeyedTable.last_of_key: broken(f(two, rows))
        return [Write(one, "upsert", batch), Write(two, "upsert", batch.selectExpr("id", "'two' as part", "value"))]

    return one, two, BatchSink(spark, f"{tmp_path}/sink", [one, two], writes)


def test_failure_between_two_tables_is_undone(spark, make, tmp_path):
    fail = set()
    one, two, sink = sink_of(spark, make, tmp_path, fail)
    assert sink.apply(spark.createDataFrame([(i, "a", 1.0) for i in range(50)], SCHEMA), 0)
    before = rows(one), rows(two)
    fail.add("1")
    new = spark.createDataFrame([(5, "b", 2.0), (60, "b", 2.0)], SCHEMA)
    with pytest.raises(RuntimeError):
        sink.apply(new, 1)
    assert (rows(one), rows(two)) == before
    fail.clear()
    assert sink.apply(new, 1) and (5, "b", 2.0) in rows(one) and (60, "two", 2.0) in rows(two)
    kept = files(tmp_path)
    assert not sink.apply(new, 1) and files(tmp_path) == kept


def test_lost_driver_between_two_tables(spark, make, tmp_path, monkeypatch):
    fail = {"0"}
    one, two, sink = sink_of(spark, make, tmp_path, fail)
    rows_in = spark.createDataFrame([(1, "a", 1.0)], SCHEMA)
    monkeypatch.setattr(sink, "undo", lambda batch: 0)  # as if the driver were gone
    with pytest.raises(RuntimeError):
        sink.apply(rows_in, 0)
    assert rows(one) == {(1, "a", 1.0)} and rows(two) == set()
    fail.clear()
    again = BatchSink(spark, sink.folder, sink.tables, lambda batch, n: [Write(one, "upsert", batch.where("id > 1")), Write(two, "upsert", batch)])
    assert again.apply(spark.createDataFrame([(2, "a", 1.0)], SCHEMA), 0)
    assert rows(one) == {(2, "a", 1.0)} and rows(two) == {(2, "a", 1.0)}


def test_stream_is_written_once(spark, make, tmp_path):
    fail = set()
    one, two, sink = sink_of(spark, make, tmp_path, fail)
    for k in range(3):
        spark.createDataFrame([(i, "a", float(k)) for i in range(k, k + 4)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    fail.add("1")
    with pytest.raises(Exception, match="second store is down"):
        sink.drain(stream).awaitTermination()
    assert {r[0] for r in rows(two)} == {r[0] for r in rows(one)} and len(rows(one)) == 4
    fail.clear()
    sink.drain(stream).awaitTermination()
    assert {r[0] for r in rows(one)} == {r[0] for r in rows(two)} == set(range(6))
