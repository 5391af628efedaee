"""Streams that stop and start again, and sinks that meet a key twice."""

import os

import pytest
from pyspark.sql import functions as F

from provenant.operators import capture
from provenant.sources import tables
from provenant.streaming import index as streaming

SCHEMA = "msg_id string, session long, turn_seq long, role string, text string, seen date"


def batch(spark, n, start=0):
    rows = spark.range(start, start + n).select(F.col("id").cast("string").alias("msg_id"), (F.col("id") % 5).alias("session"), F.col("id").alias("turn_seq"), F.lit("assistant").alias("role"), F.concat(F.lit("Fact "), F.col("id") % 7, F.lit(" stands at https://site.org/"), F.col("id") % 4, F.lit(".")).alias("text"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 9).cast("int")).alias("seen"))
    return rows.coalesce(1)


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("fold", [streaming.fold_index, streaming.fold_claims])
def test_a_stream_that_is_stopped_goes_on_where_it_was(spark, tmp_path, fold):
    source, top = str(tmp_path / "in"), str(tmp_path / "out")
    batch(spark, 30).write.parquet(source)
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(source)
    assert rows(streaming.keep(stream(), top, fold)) == rows(fold(None, spark.read.parquet(source)))
    batch(spark, 25, 30).write.mode("append").parquet(source)
    whole = rows(fold(None, spark.read.parquet(source)))
    assert rows(streaming.keep(stream(), top, fold)) == whole
    assert rows(streaming.keep(stream(), top, fold)) == whole
    # A batch whose commit was lost is run again and counts once.
    commits = sorted((f for f in os.listdir(f"{top}/progress/commits") if f.isdigit()), key=int)
    for f in (commits[-1], f".{commits[-1]}.crc"):
        if os.path.exists(f"{top}/progress/commits/{f}"):
            os.remove(f"{top}/progress/commits/{f}")
    assert rows(streaming.keep(stream(), top, fold)) == whole


def test_an_empty_stream(spark, tmp_path):
    os.mkdir(tmp_path / "in")
    assert streaming.keep_index(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), str(tmp_path / "out")).count() == 0


def test_claims_are_refused_at_the_cap(spark):
    first, more = batch(spark, 40), batch(spark, 70)
    old = streaming.claims(3)(None, first)
    new = streaming.claims(3)(old, more)
    assert max(r["count"] for r in new.groupBy("url").count().collect()) == 3
    keys = lambda df: {(r["url"], r["claim"]) for r in df.collect()}
    assert keys(old) == keys(new) and new.agg(F.sum("times_seen")).first()[0] > old.agg(F.sum("times_seen")).first()[0]


def test_incidents_and_operations(spark):
    found = spark.createDataFrame([("a", "stale"), ("b", "stale")], "incident_id string, kind string")
    old = streaming.fold_incidents(None, found).withColumn("status", F.when(F.col("incident_id") == "a", "acknowledged").otherwise(F.col("status")))
    assert {r["incident_id"]: r["status"] for r in streaming.fold_incidents(old, found).collect()} == {"a": "acknowledged", "b": "open"}
    one = spark.createDataFrame([("x", "start", 1), ("y", "start", 2), ("x", "step", 3)], "op_id string, event string, ts long")
    two = spark.createDataFrame([("x", "end", 5), ("y", "step", 4)], "op_id string, event string, ts long")
    kept = streaming.fold_operations(streaming.fold_operations(None, one), two)
    assert {r["op_id"]: (r["started"], r["last"], r["ended"]) for r in kept.collect()} == {"x": (1, 5, True), "y": (2, 4, False)}


def test_sinks_that_meet_a_key_twice(spark):
    old = spark.createDataFrame([("a", 1, None), ("b", 2, "h")], "k string, n int, hash string")
    changes = spark.createDataFrame([("a", 5, "x", 1), ("a", None, "y", 2), ("c", 9, "z", 3)], "k string, n int, hash string, at int")
    assert rows(tables.update_by_key(old, changes, "k", ("hash",), "at")) == rows(spark.createDataFrame([("a", 5, "y"), ("b", 2, "h")], "k string, n int, hash string"))
    new = spark.createDataFrame([("a", 7, "q"), ("c", 4, "q"), ("c", 3, "r")], "k string, n int, hash string")
    assert rows(tables.insert_absent(old, new, "k")) == rows(old.unionByName(spark.createDataFrame([("c", 3, "r")], old.schema)))


def test_write_once_and_dependents_and_defaults(spark):
    old = spark.createDataFrame([("a", None, None), ("b", "s", "v1"), ("c", "s", "v0"), ("d", "s", "v1")], "k string, sketch string, algo string")
    new = spark.createDataFrame([("a", "n"), ("b", "n"), ("c", "n")], "k string, sketch string")
    assert {r["k"]: (r["sketch"], r["algo"]) for r in tables.write_once(old, new, "k", "sketch", "algo", "v1").collect()} == {"a": ("n", "v1"), "b": ("s", "v1"), "c": ("n", "v1"), "d": ("s", "v1")}
    tags = spark.createDataFrame([("a", "t"), ("b", "t")], "k string, tag string")
    left, also = tables.delete_with(old, tags, spark.createDataFrame([("a",)], "k string"), "k")
    assert left.count() == 3 and [r["k"] for r in also.collect()] == ["b"]
    assert [tuple(r) for r in tables.with_schema(tags.limit(1), spark.createDataFrame([], "k string, tag string, bytes long, more int"), {"bytes": -1}).collect()] == [("a", "t", -1, None)]


def test_a_target_of_another_identity_is_refused(spark):
    names = "api_origin string, library_type string, library_id string, collection_key string"
    mine, other = ("o", "user", "1", "c"), ("o", "user", "2", "c")
    held, empty, full = spark.createDataFrame([mine], names), spark.createDataFrame([], names), spark.createDataFrame([(1,)], "x int")
    assert tuple(tables.require_identity(full, held, mine).first()) == mine
    assert tuple(tables.require_identity(full, empty, other, adopt=True).first()) == other
    assert tuple(tables.require_identity(full.limit(0), held, other, adopt=True).first()) == other
    for adopt in (False, True):
        with pytest.raises(ValueError):
            tables.require_identity(full, held, other, adopt)
    with pytest.raises(ValueError):
        tables.require_identity(full, empty, other)


def test_logs_are_appended_and_torn_lines_skipped(spark, tmp_path):
    where = str(tmp_path / "log")
    tables.append_json(spark.createDataFrame([("o", 1, "start", "u", "t")], "op_id string, seq long, event string, target string, ts string"), where)
    with open(f"{where}/more.json", "w") as f:
        f.write('{"op_id": "o", "seq": 2, "event": "end"}\n{"op_id": "p", "se')
    assert sorted((r["op_id"], r["seq"]) for r in tables.journal(spark, where).collect()) == [("o", 1), ("o", 2)]
    assert capture.REPORT
