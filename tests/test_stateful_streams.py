"""Streams with state by key against their batch results, over several runs, with late and repeated rows and lost commits."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from provenant.operators import capture, reports, upkeep
from provenant.streaming import stateful
from provenant.streaming.buckets import Buckets, newest

T0 = datetime.datetime(2024, 1, 1)
MESSAGES = "session long, turn_seq long, role string, ts timestamp"
EVENTS = "kind string, id string, event string, ts timestamp, seq long, target string"


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*(columns or sorted(df.columns))).collect()), key=repr)


class Source:
    """A folder that files are put into, one a run, and the stream over it."""

    def __init__(self, spark, tmp_path, schema):
        self.spark, self.where, self.schema, self.top = spark, str(tmp_path / "in"), schema, str(tmp_path / "out")
        os.mkdir(self.where)

    def add(self, data):
        self.spark.createDataFrame(data, self.schema).coalesce(1).write.mode("append").parquet(self.where)

    def stream(self):
        return self.spark.readStream.schema(self.schema).parquet(self.where)

    def batch(self):
        return self.spark.read.schema(self.schema).parquet(self.where)


def forget_last_commit(progress):
    last = max(int(f) for f in os.listdir(f"{progress}/commits") if f.isdigit())
    for f in (f"{last}", f".{last}.crc"):
        if os.path.exists(f"{progress}/commits/{f}"):
            os.remove(f"{progress}/commits/{f}")


def test_turns_of_a_stream_equal_the_batch(spark, tmp_path):
    source = Source(spark, tmp_path, MESSAGES)
    said = [(s, k, "user" if (s + k) % 3 == 0 else "assistant", at(60 * k + s)) for s in range(4) for k in range(12)]
    late = [m for m in said if m[1] % 5 == 2]
    source.add([m for m in said if m not in late][:25])
    assert stateful.drain(stateful.turns(source.stream(), "20 minutes"), source.top).count() == 0
    source.add([m for m in said if m not in late][20:] + late + late[:3])
    source.add([(99, 1, "user", at(3000))])
    out = rows(stateful.drain(stateful.turns(source.stream(), "20 minutes"), source.top))
    want = rows(capture.turn_segments(spark.createDataFrame(said, MESSAGES)))
    assert out == want
    # Too late, and once more: what is out stays as it is.
    source.add([(0, 3, "user", at(185)), (0, 3, "user", at(5000)), (98, 1, "user", at(9000))])
    again = rows(stateful.drain(stateful.turns(source.stream(), "20 minutes"), source.top))
    assert again == sorted(want + [("user", 1, 99, 1)], key=repr)
    forget_last_commit(f"{source.top}/progress")
    assert rows(stateful.drain(stateful.turns(source.stream(), "20 minutes"), source.top)) == again


def test_abandoned_work_equals_unfinished_and_is_taken_back(spark, tmp_path):
    source = Source(spark, tmp_path, EVENTS)
    start = [("operation", f"o{k}", "start", at(10 * k), None, None) for k in range(12)] + [("claim", f"u{k}", "start", at(k), None, None) for k in range(4)]
    steps = [("operation", f"o{k}", "step", at(10 * k + j), j, f"t{(k * j) % 5}") for k in range(12) for j in range(k % 4)]
    ends = [("operation", f"o{k}", "end", at(10 * k + 60), None, None) for k in range(0, 12, 3)] + [("claim", "u1", "end", at(100), None, None), ("operation", "never begun", "end", at(5), None, None)]
    source.add(start + steps + ends)
    assert stateful.drain(stateful.abandoned(source.stream(), "1 minute"), source.top).count() == 0
    source.add([("claim", "later", "start", at(4000), None, None)])
    changes = stateful.drain(stateful.abandoned(source.stream(), "1 minute"), source.top)
    given = source.batch().filter("kind = 'operation'").withColumnRenamed("id", "op_id")
    part = lambda e: given.filter(F.col("event") == e).select("op_id", "seq", "target")
    want = rows(upkeep.unfinished(part("start"), part("step"), part("end")), "op_id", "steps", "last_target")
    open_ = stateful.still_open(changes)
    assert rows(open_.filter("kind = 'operation'"), "id", "steps", "last_target") == want and len(want) == 8
    assert rows(open_.filter("kind = 'claim'"), "id") == [("u0",), ("u2",), ("u3",)]
    # An end and a step that come after the timer.
    source.add([("operation", "o1", "end", at(3990), None, None), ("operation", "o2", "step", at(3995), 9, "last"), ("claim", "u0", "end", at(4000), None, None)])
    changes = stateful.drain(stateful.abandoned(source.stream(), "1 minute"), source.top)
    left = stateful.still_open(changes)
    assert rows(left.filter("kind = 'operation'"), "id") == [(w[0],) for w in want if w[0] != "o1"]
    assert rows(left.filter("id = 'o2'"), "steps", "last_target") == [(3, "last")]
    assert rows(left.filter("kind = 'claim'"), "id") == [("u2",), ("u3",)]
    assert rows(changes.filter("id = 'o1'"), "state", "revision") == [("abandoned", 1), ("taken_back", 2)]


def test_recency_windows_equal_the_batch_and_set_the_future_aside(spark, tmp_path):
    schema = "n long, ts timestamp, arrived timestamp, refused_kind string"
    source = Source(spark, tmp_path, schema)
    made = [(k, at(977 * k), at(20 * 977), "x" if k % 7 == 0 else None) for k in range(40)] + [(50, None, at(0), None)]
    future = [(60, at(10**8), at(20 * 977), None), (61, at(20 * 977 + 3601), at(20 * 977), "x")]
    source.add(made[::2] + future)
    stateful.recency(source.stream(), source.top)
    source.add(made[1::2])
    hours, ahead = stateful.recency(source.stream(), source.top)
    batch = reports.hourly(source.batch(), "ts", F.col("arrived"))
    assert rows(hours, "hour", "records", "refused") == rows(batch.filter("hour IS NOT NULL"), "hour", "records", "refused")
    assert ahead.count() == batch.filter("hour IS NULL").first()["records"] == len([1 for _, t, a, _ in made + future if t and t > a + datetime.timedelta(hours=1)])
    forget_last_commit(f"{source.top}/hours/progress")
    assert rows(stateful.recency(source.stream(), source.top)[0]) == rows(hours)


def kept_index(spark, top):
    index = Buckets(spark, top, "url", 8)
    made = spark.range(40).select(F.concat(F.lit("https://site.org/"), "id").alias("url"), F.lit("h").alias("content_hash"), F.when(F.col("id") % 4 > 0, F.lit("2023-01-01").cast("timestamp") + F.make_dt_interval(F.col("id").cast("int"))).alias("verified_at"), F.lit(None).cast("string").alias("verify_outcome"))
    index.merge(0, made, newest("url"))
    return index


def test_verify_runs_move_the_cursor_once(spark, tmp_path):
    index = kept_index(spark, str(tmp_path / "index"))
    order = [r["url"] for r in upkeep.needs_verify(index.read(), 40).collect()]
    reads = spark.createDataFrame([(u,) for u in order], "url string").select("url", F.explode(F.array(F.lit(1), F.lit(2))).alias("read_no"), F.lit(200).alias("status"), F.when(F.col("url").endswith("4"), "other").otherwise("h").alias("digest"))
    source = Source(spark, tmp_path, "run_at timestamp, n int")
    run = lambda: stateful.verify_runs(spark, source.stream(), reads, source.top, index)
    done = lambda day: {r["url"] for r in index.read().filter(F.col("verified_at") == F.lit(day).cast("timestamp")).collect()}
    source.add([(datetime.datetime(2024, 1, 1), 7)])
    run()
    assert done("2024-01-01") == set(order[:7])
    source.add([(datetime.datetime(2024, 1, 2), 7), (datetime.datetime(2024, 1, 3), 3)])
    run()
    assert done("2024-01-01") == set(order[:7]) and done("2024-01-02") == set(order[7:14]) and done("2024-01-03") == set(order[14:17])
    assert {r["verify_outcome"] for r in index.read().filter("url LIKE '%4' AND verified_at >= '2024-01-01'").collect()} <= {"changed"}
    # A run whose commit was lost chooses the same rows again and moves no others; one that is killed before its manifest has moved none.
    forget_last_commit(f"{source.top}/progress")
    before = rows(index.read())
    run()
    assert rows(index.read()) == before
    with pytest.raises(Exception, match="killed"):
        index.merge(9000, index.read().limit(3), lambda old, new: old.withColumn("content_hash", F.raise_error(F.lit("killed"))))
    assert rows(index.read()) == before


def written(top, epoch):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, files in os.walk(f"{top}/data/epoch={epoch}") for f in files if f.endswith(".parquet"))


def test_a_batch_rewrites_only_the_buckets_that_it_touches(spark, tmp_path):
    top = str(tmp_path / "t")
    table = Buckets(spark, top, "k", 64)
    assert table.read() is None and table.last_epoch() == -1
    every = spark.range(20000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    assert table.merge(0, every, newest("k")) == 64
    one = every.filter("k < 2").withColumn("v", F.lit("new"))
    assert table.merge(1, one, newest("k")) == 2
    assert written(top, 1) < 0.1 * written(top, 0)
    want = rows(every.filter("k >= 2").unionByName(one))
    assert rows(table.read()) == want
    # Run again, as after a lost commit of the stream.
    assert table.merge(1, one, newest("k")) == 2 and rows(table.read()) == want
    assert rows(table.read(before=1)) == rows(every)
    assert table.merge(2, every.limit(0), newest("k")) == 0 and rows(table.read()) == want
    # Buckets that come out empty are not named any more, and files that no kept manifest names are gone.
    table.merge(3, every, lambda old, new: old.limit(0))
    assert table.read() is None
    for epoch in (4, 5, 6):
        table.merge(epoch, one, newest("k"))
    assert rows(table.read()) == rows(one)
    assert sorted(os.listdir(f"{top}/manifest")) == ["epoch=5", "epoch=6"]
    assert {d for d in os.listdir(f"{top}/data") if os.listdir(f"{top}/data/{d}") and any(x.startswith("bucket=") for x in os.listdir(f"{top}/data/{d}"))} == {"epoch=5", "epoch=6"}


def test_many_pieces_of_work_take_few_calls(spark, tmp_path, monkeypatch):
    """Pieces share state and timers; each is due by its own start, up to the instant that the watermark has reached, and late ends and steps find theirs."""
    monkeypatch.setattr(stateful, "SHARES", 3, raising=False)
    monkeypatch.setattr(stateful, "SLOTS", 2, raising=False)
    source = Source(spark, tmp_path, EVENTS)
    source.add([("operation", f"o{k}", "start", at(k), None, None) for k in range(300)] + [("operation", f"o{k}", "step", at(k + 1), 1, None) for k in range(0, 300, 2)] + [("operation", f"o{k}", "end", at(k + 2), None, None) for k in range(0, 300, 5)])
    progress = stateful._started(stateful.abandoned(source.stream(), "3 minutes"), source.top).recentProgress
    timers = sum(int(op["customMetrics"]["numRegisteredTimers"]) for p in progress for op in p["stateOperators"])
    assert 0 < timers <= 2 * 3 and source.spark.read.parquet(f"{source.top}/rows").count() == 0
    # The watermark comes to rest where piece 150 is due.
    source.add([("claim", "later", "start", at(150 + 180 + 180), None, None)])
    changes = stateful.drain(stateful.abandoned(source.stream(), "3 minutes"), source.top)
    due = {f"o{k}" for k in range(151) if k % 5}
    assert {r["id"] for r in changes.collect()} == due and changes.count() == len(due)
    source.add([("operation", "o1", "end", at(511), None, None), ("operation", "o2", "step", at(511), 5, "t"), ("operation", "o151", "end", at(511), None, None), ("claim", "last", "start", at(2000), None, None)])
    changes = stateful.drain(stateful.abandoned(source.stream(), "3 minutes"), source.top)
    left = {(r["id"], r["steps"], r["last_target"]) for r in stateful.still_open(changes).collect()}
    assert left == {(f"o{k}", 1 - k % 2, None) for k in range(300) if k % 5 and k not in (1, 2, 151)} | {("o2", 2, "t"), ("later", 0, None)}
