"""The log source, health of a log, and scans and writes that count themselves."""

import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from provenant.operators import health
from provenant.sources import counted, logs

def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_lines_of_any_cut(spark, tmp_path, monkeypatch):
    texts = {"a.log": "one\ntwo\n\nfour é\n", "b/c.log": "".join(f"line {k} {'x' * (k % 90)}\n" for k in range(900)) + "torn", "d.log": "", "e.log": "only", "_hidden": "no\n", "f.log": "\n\n"}
    for name, text in texts.items():
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    want = []
    for name, text in texts.items():
        if name != "_hidden":
            data = text.encode()
            for line in data.split(b"\n")[: None if data and not data.endswith(b"\n") else -1]:
                at = sum(len(w[2].encode()) + 1 for w in want if w[0] == name)
                want.append((name, at, line.decode(), data[at + len(line) : at + len(line) + 1] == b"\n"))
    read = lambda: sorted((os.path.relpath(r["src"], tmp_path), r["seq"], r["value"], r["terminated"]) for r in logs.read_log(spark, str(tmp_path)).collect())
    assert read() == sorted(want)
    for size in (1, 7, 64, 4096):
        monkeypatch.setattr(logs, "RANGE", size)
        monkeypatch.setattr(logs, "BLOCK", 5)
        parts = logs._ranges({}, logs._sizes(str(tmp_path)))
        got = [(os.path.relpath(r["src"], tmp_path), r["seq"], r["value"], r["terminated"]) for p in parts for batch in logs._lines(str(tmp_path), p) for r in batch.to_pylist()]
        assert sorted(got) == sorted(want), size


def test_a_torn_line_is_held_back_and_counts_once(spark, tmp_path):
    where, top = tmp_path / "log", tmp_path / "out"
    where.mkdir()
    log = where / "a.log"

    def run():
        query = logs.stream_log(spark, str(where)).writeStream.format("parquet").option("path", f"{top}/rows").option("checkpointLocation", f"{top}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
        return [r["value"] for r in spark.read.schema(logs.SCHEMA).parquet(f"{top}/rows").orderBy("src", "seq").collect()]

    log.write_text("one\ntwo\nthr")
    assert run() == ["one", "two"]
    assert run() == ["one", "two"]
    with log.open("a") as f:
        f.write("ee\nfour")
    (where / "b.log").write_text("other\n")
    assert run() == ["one", "two", "three", "other"]
    with log.open("a") as f:
        f.write("\n")
    assert run() == ["one", "two", "three", "four", "other"]


def line(ts, **fields):
    return json.dumps({"ts": ts} | fields)


def test_health_of_a_log(spark):
    day = "2024-01-02T12:00:00"
    log = {
        "good": [line(day + "+0000", urls_seen=1), line(day + "-04:00", version="1", errors=[{"code": "E1", "message": "m", "url": "u"}, {"code": "E2"}]), line("2024-01-02T13:00:00Z", urls_seen=2, errors=[])],
        "old faults": [line("2023-12-30T00:00:00Z", refused="prose", refused_kind="k"), line("2023-12-30T00:00:00Z", urls_seen=1, errors=[{"code": "E"}]), line(day + "Z", urls_seen=0)],
        "refused": [line(f"2024-01-02T{h:02}:00:00Z", refused="some prose", **({"refused_kind": f"k{h}"} if h else {})) for h in range(20)] + [line(day + "Z", event="stale_install")],
        "ahead": [line("2099-01-01T00:00:00Z", refused="x"), line("2024-01-03T00:59:59Z", urls_seen=1)],
        "naive": [line(day, urls_seen=1), line(day + "Z", urls_seen=1), "[1, 2]", '"text"', "  "],
        "blind": ["plain", "{half", line(17)],
        "tail": [line(day + "Z"), "junk", "junk"],
        "torn": [line(day + "Z"), '{"ts": "2024'],
        "all torn": ['{"ts"'],
    }
    given = [(src, k, value, not (k == len(lines) - 1 and "torn" in src)) for src, lines in log.items() for k, value in enumerate(lines)]
    made = health.evaluate(spark.createDataFrame(given, logs.SCHEMA), F.lit("2024-01-03 00:00:00").cast("timestamp")).cache()
    got = {r["src"]: r for r in made.collect()}
    assert {s: (r["lines"], r["records"], r["naive"], r["future"], r["torn"], r["tail"]) for s, r in got.items()} == {
        "good": (3, 3, 0, 0, 0, 0), "old faults": (3, 3, 0, 0, 0, 0), "refused": (21, 21, 0, 0, 0, 0), "ahead": (2, 2, 0, 1, 0, 0), "naive": (4, 1, 1, 0, 0, 2), "blind": (3, 0, 0, 0, 0, 3), "tail": (3, 1, 0, 0, 0, 2), "torn": (2, 1, 0, 0, 1, 0), "all torn": (1, 0, 0, 0, 1, 0)
    }
    assert {s: (r["refusals"], r["errors"]) for s, r in got.items() if r["refusals"] or r["errors"]} == {"good": (0, 2), "refused": (21, 0)}
    assert got["good"]["newest_error"].asDict() == {"code": "E1", "message": "m", "url": "u"} and len(got["refused"]["kinds"]) == health.KINDS and got["refused"]["newest_refusal"] == datetime.datetime(2024, 1, 2, 19)
    ledger = spark.createDataFrame([("i", "stale", "open"), ("j", "stale", "acknowledged"), ("k", "unverified", "open")], "incident_id string, kind string, status string")
    said = {(r["src"], r["ord"]): r["warning"] for r in health.warnings(made, ledger).collect()}
    assert set(said) == {("good", 4), ("refused", 3), ("ahead", 2), ("naive", 1), ("blind", 0), ("tail", 1), ("all torn", 0), (None, -1)}
    assert said["good", 4] == "2 capture error(s): E1 (m) for u" and said[None, -1] == "2 open integrity incident(s) [stale, unverified]" and "3 line(s)" in said["blind", 0]
    assert health.warnings(made.limit(0), ledger.limit(0)).collect() == []


def test_a_short_scan_is_refused(spark, tmp_path):
    df = spark.range(100).withColumn("x", F.lit("y"))
    assert counted.land(df, 100, str(tmp_path)).count() == 100
    assert counted.land(df.limit(0), 0, str(tmp_path)).count() == 0
    for declared in (99, 101):
        with pytest.raises(counted.ShortScan):
            counted.land(df, declared, str(tmp_path))


def test_counters_are_those_of_the_written_rows(spark, tmp_path):
    df = spark.range(60).select(F.expr("CASE id % 4 WHEN 0 THEN 'recovered' WHEN 1 THEN 'failed' WHEN 2 THEN 'odd' END").alias("outcome"), (F.col("id") * 2).alias("bytes"))
    where = str(tmp_path / "t")
    got = counted.write_counted(df, where, "outcome", counted.JOBS["drain"], ["bytes"]).asDict()
    assert got == {"rows": 60, "recovered": 15, "deferred": 0, "failed": 15, "abandoned": 0, "other": 30, "sum_bytes": 60 * 59}
    lines = counted.report(df, where, "drain").orderBy("ord").collect()
    assert [(r["line"], r["n"]) for r in lines] == [("recovered", 15), ("deferred", 0), ("failed", 15), ("abandoned", 0), ("other", 30), ("rows", 60)]
    written = spark.read.parquet(where)
    assert written.count() == 120 and rows(written.groupBy("outcome").count(), "outcome", "count") == rows(df.unionByName(df).groupBy("outcome").count(), "outcome", "count")
    assert counted.write_counted(df.limit(0), where, "outcome", ("recovered",)).asDict() == {"rows": 0, "recovered": 0, "other": 0}
