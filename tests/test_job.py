"""The capture job, transcripts, replay, the snapshot pass and host names, against expectations written by hand."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from provenant.functions import extract, names, urls
from provenant.operators import capture, content, job, snapshot
from provenant.sources.tables import transcripts
from provenant.streaming.buckets import Buckets, newest

DAY = datetime.date


def got(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_transcripts_keep_turns_and_order(spark, tmp_path):
    text = lambda *parts: [{"type": "text", "text": p} for p in parts]
    record = lambda kind, content, **more: json.dumps({"type": kind, "sessionId": "s", "message": {"content": content}} | more)
    lines = [
        record("user", "no address here"), record("assistant", text("first https://a.org/1", "second part")), record("user", [{"type": "tool_result", "content": "x"}], toolUseResult={"ok": True}), record("user", [{"type": "tool_result"}]),
        record("assistant", [{"type": "tool_use", "input": {}}]), record("assistant", "plain string https://a.org/2"), record("user", text("and now?")), record("assistant", text("last"), isSidechain=True), '{"type": "assistant", "mess', "", record("assistant", text("[not an array]")), json.dumps({"type": "summary"}), record("assistant", "[1, 2]"),
    ]
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "s.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "other.jsonl").write_text(json.dumps({"type": "user", "message": {"content": "alone"}}))
    rows = transcripts(spark, str(tmp_path))
    mine = [(r["role"], r["text"]) for r in rows.filter("session = 's'").orderBy("turn_seq").collect()]
    assert mine == [("user", "no address here"), ("assistant", "first https://a.org/1\nsecond part"), ("assistant", "plain string https://a.org/2"), ("user", "and now?"), ("assistant", "[not an array]"), ("assistant", "[1, 2]")]
    assert [r["text"] for r in rows.filter("session LIKE '%other.jsonl'").collect()] == ["alone"]
    segments = capture.turn_segments(rows.filter("session = 's'"))
    assert [r["segment"] for r in segments.orderBy("turn_seq").collect()] == [1, 1, 1, 2, 2, 2]
    assert [r["text"] for r in job.live_turns(rows.filter("session = 's'")).collect()] == ["plain string https://a.org/2"]


MESSAGES = "msg_id string, session string, turn_seq long, role string, text string, seen date, project string"
GIVEN = [
    ("m1", "s", 1, "user", "Look at https://wells.org/known and https://wells.org/claimed.", DAY(2024, 1, 5), "p"),
    ("m2", "s", 2, "assistant", "The log says so: https://wells.org/new holds it. [SOURCE-CONTEXT: water]", DAY(2024, 1, 6), "p"),
    ("m3", "s", 3, "assistant", "https://wells.org/new", DAY(2024, 1, 7), "q"),
    ("m4", "t", 1, "assistant", "The log says so: https://wells.org/new holds it. [SOURCE-CONTEXT: water] And http://localhost/x.", DAY(2024, 1, 4), None),
    ("m5", "t", 2, "assistant", "nothing", DAY(2024, 1, 4), None),
]


def test_capture_from_messages_to_outbox(spark):
    messages = spark.createDataFrame(GIVEN, MESSAGES)
    index = spark.createDataFrame([("https://wells.org/known", "K1"), ("https://wells.org/claimed", None)], "url string, item_key string")
    made = job.run(messages, index, failures=spark.createDataFrame([("m2", "https://wells.org/new"), ("m2", "https://wells.org/new")], "msg_id string, url string"))
    assert got(made.counters, "msg_id", "seen", "new", "recurring", "excluded", "deferred", "claims", "errors") == [("m1", 2, 0, 1, 0, 1, 2, 0), ("m2", 1, 0, 1, 0, 0, 1, 1), ("m3", 1, 0, 1, 0, 0, 0, 0), ("m4", 2, 1, 0, 1, 0, 1, 0), ("m5", 0, 0, 0, 0, 0, 0, 0)]
    assert got(made.index_rows, "url", "first_seen", "last_seen", "times_seen") == [("https://wells.org/known", DAY(2024, 1, 5), DAY(2024, 1, 5), 1), ("https://wells.org/new", DAY(2024, 1, 4), DAY(2024, 1, 7), 3)]
    claim = [r for r in made.claims.collect() if r["url"].endswith("/new")]
    assert [(r["times_seen"], r["first_seen"], r["project"], r["context"], r["origin"]) for r in claim] == [(2, DAY(2024, 1, 4), None, "water", "assistant")]
    assert {r["context"] for r in made.claims.collect() if r["url"].endswith("/known")} == {"user-shared"}
    assert {"seen:2024-01-04", "seen:2024-01-06", "seen:2024-01-07", "context:water", "context:general", "project:home", "project:p", "project:q"} == {r["tag"] for r in made.tags.filter("url LIKE '%new'").collect()}
    (document,) = [json.loads(r["document"]) for r in made.outbox.collect()]
    assert document["url"] == "https://wells.org/new" and document["accessDate"] == "2024-01-04"
    assert json.loads(made.log.filter("msg_id = 'm1'").first()["value"]) == {"message": "m1", "urls_seen": 2, "urls_new": 0, "urls_recurring": 1, "urls_excluded": 0, "urls_deferred": 1, "claims": 2, "errors": 0}
    empty = job.run(messages.limit(0), index.limit(0))
    assert all(df.count() == 0 for df in empty)


def test_replay_keeps_dates_and_tells_deferred_from_recovered(spark):
    day = DAY(2024, 1, 2)
    queue = [(u, "p", "c", day, 1, 1, n, "e") for u, n in (("known", 1), ("claimed", 4), ("stored", 2), ("failed", 3), ("untried", 1), ("worn out", 5))]
    left, outcomes = job.replay(
        spark.createDataFrame(queue, "url string, project string, context string, seen_date date, first_failed int, last_failed int, attempts int, last_error string"),
        spark.createDataFrame([("known", "K"), ("claimed", None)], "url string, item_key string"), spark.createDataFrame([("stored", True), ("failed", False), ("worn out", True)], "url string, ok boolean"), F.lit(9),
    )
    assert got(outcomes, "url", "outcome") == [("claimed", "deferred"), ("failed", "failed"), ("known", "recovered"), ("stored", "recovered"), ("untried", "waiting"), ("worn out", "abandoned")]
    assert got(left, "url", "attempts", "last_failed") == [("claimed", 4, 1), ("failed", 4, 9), ("untried", 1, 1)] and {r["seen_date"] for r in outcomes.collect()} == {day}


def test_snapshot_stores_once_and_keeps_our_faults_apart(spark, tmp_path):
    names_ = ["ok", "cut", "late", "gone", "bracket(", "ours", "unsafe", "hashed", "no item", "failed", "unread", "moved/ok"]
    rows = [(f"https://wells.org/a/{n}", None if n == "no item" else "K", "old" if n == "hashed" else None, "timeout" if n == "failed" else None, DAY(2024, 1, 1)) for n in names_]
    empty = {"hash_bytes": "long", "hash_truncated": "boolean", "final_url": "string", "content_sketch": "array<string>", "content_sketch_algo": "string", "hashed_at": "timestamp", "last_attempt_at": "timestamp"}
    made = spark.createDataFrame(rows, "url string, item_key string, content_hash string, last_outcome string, first_seen date").select("*", *(F.lit(None).cast(t).alias(c) for c, t in empty.items()))
    index = Buckets(spark, str(tmp_path), "url", 4)
    index.merge(0, made, newest("url"))
    answer = {"ok": (200, None), "cut": (200, None), "late": (None, "timeout"), "gone": (404, None), "bracket(": (404, None), "ours": (None, "bug"), "unsafe": (None, "unsafe_host"), "hashed": (200, None), "no item": (200, None), "failed": (200, None), "moved/ok": (200, None)}
    reads = [(f"https://wells.org/a/{n}", s, e, "https://moved.org/" if n == "moved/ok" else None, b"body of " + n.encode(), n != "cut") for n, (s, e) in answer.items()] + [("https://wells.org/a", 200, None, None, b"", True)]
    read = spark.createDataFrame(reads, "url string, status int, error string, final_url string, body binary, complete boolean")
    counts = snapshot.run(index, read, F.lit("2024-02-01").cast("timestamp"), 100)
    assert counts == {"ok": 3, "timeout": 1, "gone": 1, "malformed": 1, "internal_error": 2}
    after = {r["url"][20:]: r for r in index.read().collect()}
    assert {n for n, r in after.items() if r["content_hash"]} == {"ok", "cut", "hashed", "moved/ok"} and after["hashed"]["content_hash"] == "old" and after["hashed"]["hashed_at"] is None
    assert {n: r["last_outcome"] for n, r in after.items()} == {"ok": "ok", "cut": "ok", "moved/ok": "ok", "late": "timeout", "gone": "gone", "bracket(": "malformed", "ours": None, "unsafe": None, "hashed": None, "no item": None, "failed": "timeout", "unread": None}
    assert (after["cut"]["hash_truncated"], after["ok"]["hash_truncated"], after["ok"]["hash_bytes"], after["moved/ok"]["final_url"]) == (True, False, 10, "https://moved.org/") and after["ours"]["last_attempt_at"] is None
    # The next pass meets only our own faults, and writes nothing.
    epoch = index.last_epoch()
    assert snapshot.run(index, read, F.lit("2024-03-01").cast("timestamp"), 100) == {"internal_error": 2} and index.last_epoch() == epoch
    assert content.CONTENT_ALGO == after["ok"]["content_sketch_algo"]


VECTORS = {
    "example.org": "example.org", "BÜCHER.example": "xn--bcher-kva.example", "bücher。example": "xn--bcher-kva.example", "straße.de": "strasse.de", "Ｗｅｌｌｓ.org": "wells.org", "日本語.jp": "xn--wgv71a119e.jp", "пример.рф": "xn--e1afmkfd.xn--p1ai", "a­b.org": "ab.org", "a.ישראל": "a.xn--4dbrk0ce",
    "ä" * 58 + ".org": None, "ü" * 40 + ".org": names.encoded("ü" * 40) + ".org", "a..org": None, "": None, "x .org": None, "אa.org": None, "a" * 64 + ".org": None, ".".join(["ab" * 30] * 5): None, "ü.": "xn--tda.", "…": None, ".org": None,
}


def test_host_names_in_other_scripts(spark):
    assert {h: names.ascii_name(h) for h in VECTORS} == VECTORS
    assert len(names.encoded("ä" * 58)) > 63 >= len(names.encoded("ü" * 40))
    rows = spark.createDataFrame([(h,) for h in VECTORS] + [(None,)], "h string").select("h", names.ascii_names("h").alias("a"))
    assert {r["h"]: r["a"] for r in rows.collect()} == VECTORS | {None: None}


def test_links_to_other_scripts_and_names_that_no_resolver_finds(spark):
    assert extract.cited("[x](https://bücher.org/straße?q=ü) https://bücher.org/straße") == [("https://xn--bcher-kva.org/stra%C3%9Fe?q=%C3%BC", "link"), ("https://bücher.org/straße", "bare")]
    rows = spark.createDataFrame([("1", "s", 1, "user", "https://bücher.org/a https://" + "ä" * 58 + ".org/b https://wells.org/c", DAY(2024, 1, 1))], "msg_id string, session string, turn_seq long, role string, text string, seen date")
    assert [(r["url"][-2:], r["excluded_reason"]) for r in capture.citations(rows, urls.DEFAULT).orderBy("pos").collect()] == [("/a", None), ("/b", "no_name"), ("/c", None)]


@pytest.mark.parametrize("limit", [0, 3])
def test_work_lists_refuse_no_limit(spark, limit):
    from provenant.operators import upkeep

    index = spark.createDataFrame([(f"u{k}", "K", None, None, k) for k in range(5)], "url string, item_key string, content_hash string, last_outcome string, first_seen int")
    assert upkeep.needs_hash(index, limit).count() == limit
    with pytest.raises(ValueError, match="negative"):
        upkeep.needs_hash(index, -1)
    with pytest.raises(ValueError, match="negative"):
        upkeep.needs_verify(index.withColumn("verified_at", F.lit(1)), -1)


def test_repair_refuses_a_merge_without_a_live_survivor(spark):
    from provenant.operators import upkeep

    index = [("https://a.org/x**", "K1"), ("https://a.org/x", "K2"), ("https://a.org/y**", "K3"), ("https://a.org/y", "K4"), ("https://a.org/z**", "K5"), ("https://a.org/w**", "K6"), ("https://a.org/w", None)]
    items = [("K1", False), ("K2", False), ("K4", True), ("K3", None)]
    steps = upkeep.repair_steps(spark.createDataFrame(index, "url string, item_key string"), spark.createDataFrame(items, "key string, deleted boolean"))
    assert {r["url"]: r["action"] for r in steps.collect() if r["url"].endswith("**")} == {"https://a.org/x**": "merge", "https://a.org/y**": "refused_no_survivor", "https://a.org/z**": "rewrite", "https://a.org/w**": "refused_no_survivor"}
    assert {r["action"] for r in steps.collect() if not r["url"].endswith("**")} == {"keep"}


def test_first_address_of_a_doi_and_preprints(spark):
    from provenant.operators import gates

    sources = spark.createDataFrame([("https://doi.org/10.1000/b", 2), ("https://dx.doi.org/10.1000/b", 1), ("https://doi.org/10.1000/b", 3)], "url string, nth int")
    notices = spark.createDataFrame([], "doi string, finding string")
    assert [r["url"] for r in gates.doi_gate(sources, notices, "nth").collect()] == ["https://dx.doi.org/10.1000/b"]
    assert [r["url"] for r in gates.doi_gate(sources, notices).collect()] == ["https://doi.org/10.1000/b"]
    want = {"https://www.biorxiv.org/content/10.1101/2020.01.30.927871v1.full": "10.1101/2020.01.30.927871", "https://www.medrxiv.org/content/10.64898/2026.02.05.703842v3": "10.64898/2026.02.05.703842", "https://biorxiv.org/content/10.1101/269415v2": "10.1101/269415", "https://notbiorxiv.org/content/10.1101/269415v2": None, "https://www.biorxiv.org/about": None}
    rows = spark.createDataFrame([(u,) for u in want], "u string").select("u", urls.identifier(F.col("u")).alias("i"))
    assert {r["u"]: r["i"] and r["i"]["id"] for r in rows.collect()} == want


def test_history_before_a_run(spark):
    from provenant.operators import delta

    seen = [("a", DAY(2024, 1, 1)), ("a", DAY(2024, 1, 9)), ("a", DAY(2024, 1, 9)), ("a", DAY(2024, 1, 10)), ("b", DAY(2024, 1, 10)), ("c", DAY(2023, 6, 1)), ("d", DAY(2024, 2, 1))]
    df = spark.createDataFrame(seen, "url string, seen date")
    assert got(delta.spans(df, "2024-01-10"), "url", "prior", "span_days") == [("a", 2, 8), ("b", 0, None), ("c", 1, 0), ("d", 0, None)]
    assert got(delta.spans(df, "2024-01-10", 30), "url") == [("a",), ("b",), ("d",)]
    assert delta.earliest(df).first()[0] == DAY(2023, 6, 1) and delta.earliest(df.limit(0)).first()[0] is None
