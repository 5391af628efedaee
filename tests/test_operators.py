"""Small fixtures for the operators of citations, pages and upkeep."""

import datetime
import hashlib
import random
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from provenant.functions import align, stamps, urls
from provenant.operators import capture, content, coverage, delta, gates, incidents, ledger, upkeep
from provenant.sources import tables


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_canonical(spark):
    cases = {
        " HTTPS://Ex.Org:0/A/?utm_source=x&b=1&REF=2#top ": "https://ex.org/A?b=1",
        "http://User@H.com:8080//": "http://User@h.com:8080",
        "https://[2001:DB8::1]:8443/x/": "https://[2001:db8::1]:8443/x",
        "https://a.b/?%75tm_source=1": "https://a.b",
        "not a url": "not a url",
        "https://münchen.de/ä?q": "https://münchen.de/ä?q",
    }
    assert {k: one(spark, k, urls.canonical) for k in cases} == cases
    assert one(spark, None, urls.canonical) is None


def test_excluded(spark):
    cases = {"https://myexample.com/a": None, "https://www.example.com/": "reserved_name", "https://example.com.evil.co/": None, "http://x.test/": "reserved_name", "https://a.b/x.css": "asset", "https://a.b/blob/x.css": None, "https://doi.org/10.1000/x": None, "https://doi.org/x": "malformed_doi", "http://192.168.1.1/": "unsafe_address", "http://host/": "dotless", "ftp": "no_host"}
    assert {k: one(spark, k, urls.excluded_reason) for k in cases} == cases


def test_brackets_parents_identifiers(spark):
    assert [one(spark, u, urls.unbalanced) for u in ("a(b)", "a)(", "[a(])", "(", "")] == [False, True, False, True, False]
    assert [one(spark, u, urls.parent) for u in ("http://a.b/c/d/", "http://a.b/c", "http://a.b")] == ["http://a.b/c", None, None]
    assert tuple(one(spark, "https://github.com/o/r.git", urls.identifier)) == ("repo", "o/r") and one(spark, "https://a.b/", urls.identifier) is None


def messages(spark, rows):
    return spark.createDataFrame([(f"m{k}", 1, k, "assistant", t, datetime.date(2024, 1, k + 1)) for k, t in enumerate(rows)], "msg_id string, session long, turn_seq long, role string, text string, seen date")


def test_citations(spark):
    rows = ["See https://a.org/x. And (https://a.org/x/), [b](https://b.org/y?ref=1).", "`https://c.org` and\n```\nhttps://d.org\n```\nhttps://e.org/\x1b[31mz", "```\nhttps://open.fence", None, ""]
    got = [(r["msg_id"], r["pos"], r["url"]) for r in capture.citations(messages(spark, rows)).orderBy("msg_id", "pos").collect()]
    assert got == [("m0", 0, "https://a.org/x"), ("m0", 2, "https://b.org/y"), ("m1", 0, "https://e.org/z")]


def test_claims(spark):
    said = messages(spark, ["First one. The https://a.org/x.y page says so! Next.", "https://a.org/x.y", "word " * 100 + "https://a.org/x.y"])
    got = {r["claim"] for r in capture.claim_links(capture.citations(said), said).collect()}
    assert "The https://a.org/x.y page says so!" in got and len(got) == 2 and any(c.endswith(" […]") and len(c) <= 404 for c in got)


def test_merge_never_moves_back(spark):
    rows = capture.url_index(capture.citations(messages(spark, ["https://a.org", "https://a.org"])))
    twice = capture.merge_index(rows, rows.limit(0)).first()
    assert str(twice["first_seen"]) == "2024-01-01" and str(twice["last_seen"]) == "2024-01-02" and twice["times_seen"] == 2


def test_delta_buckets_exclude_each_other(spark):
    days = {"new": ["2024-01-05"], "persisting": ["2024-01-04", "2024-01-05"], "recurring": ["2024-01-01", "2024-01-04", "2024-01-05"], "dropped": ["2024-01-01"], "future": ["2024-02-01"]}
    seen = spark.createDataFrame([(u, d) for u, ds in days.items() for d in ds], "url string, seen string").withColumn("seen", F.to_date("seen"))
    got = {r["url"]: r["bucket"] for r in delta.buckets(seen, seen.select("url").filter("url = 'none'"), "2024-01-05").collect()}
    assert got == {"new": "new", "persisting": "persisting", "recurring": "recurring_untriaged", "dropped": "dropped", "future": None}


def cuts_brute(body):
    gear = [int.from_bytes(hashlib.sha256(bytes([b])).digest()[:8], "big") for b in range(256)]
    out, start = [], 0
    while start < len(body):
        rolled, end = 0, min(len(body), start + 1024)
        for k in range(start + 16, end):
            rolled = (rolled * 2 + gear[body[k]]) % 2**64
            if rolled % 64 == 0:
                end = k + 1
                break
        out.append(end)
        start = end
    return out


def test_chunks(spark):
    rng = random.Random(4)
    for n in (0, 1, 15, 16, 17, 22, 500, 20_000):
        body = bytes(rng.randrange(256) for _ in range(n))
        assert content.cut_points(body) == cuts_brute(body)
    assert content.cut_points(b"a" * 5000) == cuts_brute(b"a" * 5000)
    df = spark.createDataFrame([("u", bytearray(b"x" * 3000)), ("v", None)], "url string, body binary")
    assert content.chunks(df).agg(F.sum("nbytes")).first()[0] == 3000


def test_chunk_stats_has_every_page(spark):
    pages = spark.createDataFrame([("null", None), ("empty", bytearray()), ("one", bytearray(b"abc")), ("two", bytearray(b"a" * 1030))], "url string, body binary")
    got = {r["url"]: tuple(r)[1:] for r in content.chunk_stats(pages).collect()}
    assert got == {"null": (0, 0, None), "empty": (0, 0, None), "one": (1, 3, 3), "two": (2, 1030, 1024)} and len(cuts_brute(b"a" * 1030)) == 2


def test_bodies_of_over_200_000_chunks_are_cut_whole():
    body = random.Random(6).randbytes(21_000_000)
    batch = pa.RecordBatch.from_pydict({"url": ["u"], "body": [body]})
    out = list(content._chunks(iter([batch])))
    sizes = [n for b in out for n in b.column("nbytes").to_pylist()]
    assert len(sizes) > 200_000 and sum(sizes) == len(body) and max(b.num_rows for b in out) <= content.BATCH_CHUNKS
    assert [k for b in out for k in b.column("ord").to_pylist()] == list(range(len(sizes)))


def test_digests_cover_whole_bodies(spark):
    pages = spark.range(2).select(F.concat(F.repeat(F.lit("x"), 33 * 1024 * 1024), F.col("id").cast("string")).alias("html"))
    want = {hashlib.sha256(b"x" * 33 * 1024 * 1024 + k).hexdigest() for k in (b"0", b"1")}
    assert {r[0] for r in pages.select(content.content_hash(F.col("html"))).collect()} == want


def test_a_prefix_is_never_unchanged(spark):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    index = spark.createDataFrame([("whole", sha(b"abcdef"), 6, False), ("grown", sha(b"abc"), 3, False), ("prefix", sha(b"abc"), 3, True), ("moved", sha(b"abx"), 3, True), ("other", sha(b"zzzzzz"), 6, False), ("shorter", sha(b"abcdef"), 6, True), ("shrunk", sha(b"abcdef"), 6, True), ("apart", sha(b"q"), 1, False)], "url string, content_hash string, hash_bytes long, hash_truncated boolean")
    body = {"whole": (b"abcdef", True), "grown": (b"abc", False), "prefix": (b"abcdef", True), "moved": (b"abcdef", True), "other": (b"abc", False), "shorter": (b"abc", False), "shrunk": (b"abc", True)}
    rows = [(u, k, 200, bytearray(b), c) for u, (b, c) in body.items() for k in (1, 2)] + [("apart", 1, 200, bytearray(b"abc"), True), ("apart", 2, 200, bytearray(b"ab"), False)]
    reads = content.page_reads(spark.createDataFrame(rows, "url string, read_no int, status int, body binary, complete boolean"), index)
    assert {(r["url"], r["covers_bytes"], r["complete"]) for r in reads.filter("read_no = 1 AND url IN ('whole', 'prefix', 'grown')").collect()} == {("whole", 6, True), ("prefix", 3, False), ("grown", 3, False)}
    got = {r["url"]: r["verdict"] for r in content.verdicts(index, reads).collect()}
    assert got == {"whole": "unchanged", "grown": "prefix_agreed", "prefix": "prefix_agreed", "moved": "changed", "other": "incomparable", "shorter": "incomparable", "shrunk": "changed", "apart": "incomparable"}


def test_verify_looks_through_a_nonce(spark):
    rng = random.Random(9)
    page, strange = rng.randbytes(20_000), rng.randbytes(20_000)
    mine, other = (sorted({hashlib.sha256(b[i:j]).hexdigest()[:16] for i, j in zip([0, *cuts_brute(b)], cuts_brute(b), strict=False)})[:128] for b in (page, strange))
    algo = content.STABLE_ALGO
    index = [("same", "older", mine, algo), ("changed", "older", other, algo), ("first", "older", None, None), ("recut", "older", mine, ""), ("unread", "older", ["zz"], algo), ("rebuilt", "older", mine, algo), ("steady", "older", mine, algo), ("kept", hashlib.sha256(page).hexdigest(), mine, algo), ("down", "older", mine, algo)]
    rows = []
    for url, *_ in index:
        second = {"rebuilt": strange, "steady": page, "kept": strange}.get(url, page + b"<!-- nonce -->")
        rows += [(url, 1, 200, bytearray(page)), (url, 2, 503 if url == "down" else 200, bytearray(second))]
    found = content.verify(spark.createDataFrame(index, "url string, content_hash string, stable_sketch array<string>, stable_algo string"), spark.createDataFrame(rows, "url string, read_no int, status int, body binary")).collect()
    assert {r["url"]: r["verdict"] for r in found} == {"same": "stable_unchanged", "changed": "stable_changed", "first": "stable_baseline", "recut": "stable_rebaselined", "unread": "unstable", "rebuilt": "unstable", "steady": "changed", "kept": "unchanged", "down": "server_error"}
    held = {r["url"]: r["sketch"] for r in found if r["sketch"] is not None}
    assert set(held) == {"first", "recut"} and len(held["first"]) == 128 and len(set(held["first"]) & set(mine)) > 120


def test_title_behind_a_long_script(spark):
    page = spark.range(1).select(F.concat(F.lit("<head><script>"), F.repeat(F.lit("x = 1;\n"), 50_000), F.lit("</script><TITLE lang=en> Late\n title </TITLE>")).alias("html"))
    assert page.select(content.title(F.col("html"))).first()[0] == "Late title"


def test_similarity_is_null_without_evidence(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), (None, ["a"]), ([], ["a"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(content.similarity(F.col("a"), F.col("b"))).collect()] == [1 / 3, None, None]


def test_outcomes(spark):
    df = spark.createDataFrame([(204, None), (200, None), (410, None), (403, None), (429, None), (502, None), (418, None), (None, "timeout"), (None, "invalid_url"), (None, "reset")], "s int, e string")
    assert [r[0] for r in df.select(content.outcome(F.col("s"), F.col("e"))).collect()] == ["no_content", "ok", "gone", "blocked", "rate_limited", "server_error", "unreachable", "timeout", "malformed", "unreachable"]


def test_reconcile_sums_to_the_populations(spark):
    index = spark.createDataFrame([("u1", "k1", None), ("u2", "k2", None), ("u3", None, "k3"), ("u4", "k4", None)], "url string, item_key string, pending_key string")
    items = spark.createDataFrame([("k1", "u1"), ("k2", "other"), ("k3", "u3"), ("k5", "u1"), ("k6", "lost")], "key string, url string")
    assert {r["bucket"]: r["n"] for r in upkeep.reconcile(index, items).collect()} == {"ok": 1, "url_disagreement": 1, "orphan_pending_claim": 1, "orphan_duplicate": 1, "orphan_stranded": 1, "row_item_missing": 1}


def test_health_survives_bad_lines(spark):
    log = spark.createDataFrame([(1, 1, '{"ts": 5, "urls_new": 1}'), (1, 2, "{oops"), (1, 3, '{"ts": 9, "refused_kind": "stale"}'), (1, 4, "[]"), (1, 5, '{"ts":')], "src long, seq long, value string")
    r = upkeep.health(log).first()
    assert (r["lines"], r["records"], r["unparseable"], r["refused"], r["last_refused"], r["kinds"], r["tail"]) == (5, 2, 3, 1, 9, "stale", 2)


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "k string, n int, s string")
    new = spark.createDataFrame([("b", 9, "y"), ("c", 3, "z"), ("c", 3, "z")], "k string, n int, s string")
    assert {r["k"]: r["n"] for r in tables.insert_absent(old, new, "k").collect()} == {"a": 1, "b": 2, "c": 3}
    assert {r["k"]: (r["n"], r["s"]) for r in tables.update_by_key(old, new.dropDuplicates(), "k", once=("s",)).collect()} == {"a": (1, None), "b": (9, "x")}
    assert [r["k"] for r in tables.delete_keys(old, new, "k").collect()] == ["a"]
    assert tables.write_version(old, str(tmp_path / "t")).count() == 2 and tables.with_schema(old.drop("s"), old).columns == old.columns


def test_transcripts(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    lines = ['{"type":"assistant","sessionId":"s","turn":1,"message":{"content":[{"type":"text","text":"https://a.org"}]}}', '{"type":"assistant","isSidechain":true,"message":{"content":[{"type":"text","text":"https://b.org"}]}}', "{bad https://c.org", "{}"]
    (tmp_path / "d" / "e" / "x.jsonl").write_text("\n".join(lines))
    assert [(r["session"], r["text"]) for r in tables.transcripts(spark, str(tmp_path)).collect()] == [("s", "https://a.org")]


def test_names_in_addresses(spark):
    assert [one(spark, u, urls.doi_of) for u in ("https://doi.org/10.1000/a(b)?x", "https://www.medrxiv.org/content/10.1101/2020.1v2?a", "https://a.b/10.1000/x", "https://doi.org/10.1", None)] == ["10.1000/a(b)?x", "10.1101/2020.1v2", None, None, None]
    assert [one(spark, "https://github.com/" + u, urls.repo_slug) for u in ("o/r", "o/r.git", "o/r/", "o/r/tree/x", "orgs/r", "o", "o/.git")] == ["o/r", "o/r", "o/r", None, None, None, None]
    assert [one(spark, u, urls.lookup_name) for u in ("a.b", "-a.b", "a-.b", "a..b", "a_b.c", "münchen.de", "a" * 64 + ".b", "a.b.")] == [True, False, False, False, False, True, False, True]


def test_stamps(spark):
    assert [one(spark, t, lambda c: F.unix_seconds(stamps.offset_time(c))) for t in ("1970-01-01T00:00:01-0100", "1970-01-01T00:00:01+00:00", "1970-01-01T00:00:01", "junk", None)] == [3601, 1, None, None, None]
    rows = spark.createDataFrame([("1.10", "1.10"), ("1.010", "1.10"), ("1.10", "1.2"), ("1.10", "1.10.0"), ("v1", "v1"), (None, "1")], "a string, b string")
    assert [r[0] for r in rows.select(stamps.version_state(F.col("a"), F.col("b"))).collect()] == ["current", "current", "mismatch", "mismatch", "unknown", "unknown"]
    pairs = [("c1", "https://münchen.de/ä"), ("c1", None), ("c2", "")] + [(f"c{k}", f"https://a.b/{k}") for k in range(40)]
    got = spark.createDataFrame(pairs, "c string, u string").select(stamps.write_id(F.col("c"), F.col("u"))).collect()
    assert [r[0] for r in got] == [uuid.uuid5(uuid.UUID(stamps.WRITES), f"{c}\n{u or ''}").hex for c, u in pairs]


def test_projects(spark):
    places = {("/h/u/a/b", None): "a", ("/h/u", None): "home", ("/h/u/r/s/t", None): "s", ("/x/y/", None): "y", ("/x", "mine"): "mine", (None, None): "home", ("/", ""): "home", ("/h/united/q", None): "q"}
    roots = spark.createDataFrame([("/h/u/r",), ("/h/u/r/s",), ("/h/u/r",)], "path string")
    got = stamps.projects(spark.createDataFrame(list(places), "cwd string, override string"), roots, ("/h/u",))
    assert {(r["cwd"], r["override"]): r["project"] for r in got.collect()} == places


def test_retire_in_tiers_and_only_as_planned(spark):
    index = spark.createDataFrame([("https://a.b/{x}", "k1", None), ("https://a.b/x.css", "k2", None), ("https://a.b/ok", "k3", None), ("https://a.b/ok**", "k4", None), ("https://c.d/{y}", None, "p"), ("https://a.test/", None, None), (None, "k5", None), ("http://[::1]/x", "k6", None)], "url string, item_key string, pending_key string")
    plan = gates.retire_plan(index)
    assert {(r["item_key"], r["reason"]) for r in plan.collect()} == {("k1", "placeholder"), (None, "reserved_name")}
    assert {r["item_key"] for r in gates.retire_plan(index, policy=True).filter("tier = 'policy'").collect()} >= {"k2"}
    archive, kept, refused = gates.retire(index, plan.unionByName(spark.createDataFrame([("https://a.b/ok", "old", "hard", "x")], plan.schema)))
    assert archive.count() == 2 and kept.count() == 6 and [r["item_key"] for r in refused.collect()] == ["old"]


def test_gates(spark):
    sources = spark.createDataFrame([("https://doi.org/10.1000/b",), ("http://doi.org/10.1000/b",), ("https://doi.org/10.1000/c",), ("https://a.b/",), (None,)], "url string")
    notices = spark.createDataFrame([("10.1000/b", "retracted"), ("10.1000/b", None)], "doi string, finding string")
    assert {tuple(r) for r in gates.doi_gate(sources, notices).collect()} == {("10.1000/b", "http://doi.org/10.1000/b", True, "retracted"), ("10.1000/c", "https://doi.org/10.1000/c", False, None)}
    claims = spark.createDataFrame([("a", None, "k1", 0), ("b", None, "k2", 0), ("c", None, "k3", 900), ("d", None, "k4", None), ("e", "k5", "k5", 0)], "url string, item_key string, pending_key string, claimed_at int")
    got = gates.stale_claims(claims, spark.createDataFrame([("k1",), ("k1",)], "key string"), F.lit(1000))
    assert {r["url"]: r["action"] for r in got.collect()} == {"a": "complete", "b": "release", "c": "in_flight", "d": "in_flight"}


def test_incidents_reopen_nothing(spark):
    ledger = spark.createDataFrame([("a", "stale", "acknowledged"), ("b", "stale", "open")], "incident_id string, kind string, status string")
    found = spark.createDataFrame([("a", "stale"), ("b", "stale"), ("c", "unverified"), ("c", "unverified"), ("d", None), (None, "stale")], "incident_id string, kind string")
    opened = incidents.open_incidents(ledger, found)
    assert {(r["incident_id"], r["status"]) for r in opened.collect()} == {("a", "acknowledged"), ("b", "open"), ("c", "open")} and opened.count() == 3
    closed, unknown = incidents.acknowledge(opened, spark.createDataFrame([("a",), ("c",), ("zz",), ("zz",)], "incident_id string"))
    assert {(r["incident_id"], r["status"]) for r in closed.collect()} == {("a", "acknowledged"), ("b", "open"), ("c", "acknowledged")}
    assert {r["incident_id"] for r in unknown.collect()} == {"a", "zz"}


def test_coverage_of_nothing_has_no_percent(spark):
    cited = spark.createDataFrame([], "session long, turn_seq long, role string, url string")
    assert tuple(coverage.coverage(cited, cited.select("session", "turn_seq"), cited.select("url")).first()) == (0, 0, 0, None)


def test_extraction_diff(spark):
    old, new = (spark.createDataFrame(rows, "msg_id string, urls array<string>") for rows in ([("1", ["a.", "b"]), ("2", ["c"])], [("1", ["a", "b"]), ("3", ["d"])]))
    assert coverage.extraction_diff(old, new).first().asDict() == {"messages": 3, "changed": 3, "lost": 2, "gained": 2, "shortened": 1}


def test_agreed_counts_repeats(spark):
    rows = [("u", r, k, d, 10) for r, ds in ((1, "aab"), (2, "abbb")) for k, d in enumerate(ds)] + [("v", r, k, "x", 1) for r in (1, 2) for k in range(3)]
    got = {r["url"]: (r["kept"], r["total"], r["agreed"]) for r in coverage.agreed(spark.createDataFrame(rows, "url string, read_no int, ord int, digest string, nbytes int")).collect()}
    assert got == {"u": (20, 30, None), "v": (3, 3, True)}


def test_alignment_is_a_longest_common_subsequence():
    rng = np.random.default_rng(4)

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    for kinds in (1, 2, 6, 50):
        for _ in range(40):
            a, b = (rng.integers(0, kinds, int(rng.integers(0, 160))).tolist() for _ in range(2))
            found = align.aligned(a, b)
            assert align.places(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)).tolist() == [i for i, _ in found]
            assert all(a[i] == b[j] for i, j in found) and len(found) == longest(a, b)
            assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:], strict=False))
    long = rng.integers(0, 3, 30_000).tolist()
    assert len(align.aligned(long, long[:9000] + [7] * 50 + long[9000:])) == 30_000


def test_moved_blocks_do_not_agree(spark):
    parts = [f"unit {k}" for k in range(100)]
    forms = {"same": parts, "moved": parts[60:] + parts[:60], "swapped": [parts[1], parts[0], *parts[2:]], "nonce": parts[:50] + ["x"] + parts[51:], "empty": [], "second only": None}
    rows = [(u, r, k, d, 10) for u, second in forms.items() for r, ds in ((1, parts if second is not None else []), (2, parts if second is None else second)) for k, d in enumerate(ds)]
    units = spark.createDataFrame(rows, "url string, read_no int, ord int, digest string, nbytes int")
    got = {r["url"]: (r["kept"], r["total"], r["agreed"]) for r in coverage.agreed(units).collect()}
    assert got == {"same": (1000, 1000, True), "moved": (600, 1000, None), "swapped": (990, 1000, True), "nonce": (990, 1000, True), "empty": (0, 1000, None), "second only": (0, 0, None)}
    kept = {r["url"]: r["n"] for r in coverage.agreed_units(units).groupBy("url").agg(F.count("*").alias("n")).collect()}
    assert kept == {"same": 100, "swapped": 99, "nonce": 99}


def test_whole_reads_agree_as_their_units_do(spark):
    """One row a read, aligned without a frame or a row for each unit."""
    forms = {"same": ("abcab", "abcab"), "nonce": ("abcabcabcabc", "abcabcabcabx"), "moved": ("abcdef", "defabc"), "none": ("", "ab"), "once": ("ab", None), "unread": (None, "ab")}
    reads = [(u, r, list(d), [3] * len(d)) for u, two in forms.items() for r, d in ((1, two[0]), (2, two[1])) if d is not None]
    whole = spark.createDataFrame(reads, "url string, read_no int, digests array<string>, sizes array<int>")
    units = whole.select("url", "read_no", F.posexplode(F.arrays_zip("digests", "sizes")).alias("ord", "u")).select("url", "read_no", "ord", F.col("u.digests").alias("digest"), F.col("u.sizes").alias("nbytes"))
    got = {r["url"]: (r["kept"], r["total"], r["agreed"]) for r in coverage.agreed(whole).collect()}
    assert got == {"same": (15, 15, True), "nonce": (33, 36, True), "moved": (9, 18, None), "none": (0, 0, None), "once": (0, 6, None), "unread": (0, 0, None)}
    assert {r["url"]: (r["kept"], r["total"], r["agreed"]) for r in coverage.agreed(units).collect()} == got
    assert {r["url"]: sorted(r["digests"]) for r in coverage.agreed_reads(whole).collect()} == {"same": list("abc"), "nonce": list("abc")}
    plan = coverage.agreed(whole)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan and "Generate" not in plan


def test_verify_stores_what_is_missing_and_sizes_a_change(spark):
    rng = np.random.default_rng(8)
    body = lambda k: bytes(rng.integers(0, 256, 20_000, dtype=np.uint8)) if k else b""
    page, other = body(1), body(1)
    near = page[:9000] + b"one word more" + page[9000:]
    sketch = {k: r["sketch"] for k, r in ((r["url"], r) for r in content.sketches(content.chunks(spark.createDataFrame([("p", page), ("o", other)], "url string, body binary")), "url").collect())}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    index = [("kept", sha(page), None, None), ("has", sha(page), sketch["p"], content.CONTENT_ALGO), ("near", sha(page), sketch["p"], content.CONTENT_ALGO), ("far", sha(page), sketch["o"], content.CONTENT_ALGO), ("older", sha(page), sketch["p"], "v0"), ("bad", sha(page), ["xyz"], content.CONTENT_ALGO), ("none", sha(page), None, None)]
    now = {"kept": page, "has": page}
    reads = [(u, r, 200, now.get(u, near)) for u, *_ in index for r in (1, 2)]
    stored = spark.createDataFrame(index, "url string, content_hash string, content_sketch array<string>, content_sketch_algo string").withColumn("stable_sketch", F.lit(None).cast("array<string>")).withColumn("stable_algo", F.lit(None).cast("string"))
    got = {r["url"]: r for r in content.verify(stored, spark.createDataFrame(reads, "url string, read_no int, status int, body binary")).collect()}
    assert {u: r["verdict"] for u, r in got.items()} == {u: "unchanged" if u in now else "changed" for u, *_ in index}
    assert got["kept"]["content_sketch"] == sketch["p"] and got["has"]["content_sketch"] is None
    assert got["near"]["similarity"] > 0.9 and got["far"]["similarity"] < 0.1 and [got[u]["similarity"] for u in ("older", "bad", "none", "kept")] == [None] * 4


def test_bodies_are_sketched_in_one_row(spark):
    """The same sketches as of a row for each chunk, without a window, a frame or a shuffle of chunks."""
    rng = np.random.default_rng(5)
    body = lambda n: rng.integers(0, 256, n, dtype=np.uint8).tobytes()
    long, short = body(60_000), body(300)
    reads = [(u, r, b) for u, two in {"same": (long, long), "nonce": (long * 2, long * 2 + b"new"), "copies": (short * 50, short * 50 + b"x"), "apart": (long, long[::-1]), "empty": (b"", long), "null": (None, None), "once": (long, None)}.items() for r, b in zip((1, 2), two, strict=True)]
    given = spark.createDataFrame(reads, "url string, read_no int, body binary")
    held = lambda df: {r["url"]: r["sketch"] for r in df.collect()}
    first = given.filter("read_no = 1")
    found = held(content.body_sketches(first))
    assert found == held(content.sketches(content.chunks(first), "url")) and set(found) == {"same", "nonce", "copies", "apart", "once"} and len(found["same"]) == 128 and len(found["copies"]) < 128
    units = [content.chunks(given.filter(F.col("read_no") == k)).withColumn("read_no", F.lit(k)) for k in (1, 2)]
    agreed = content.stable_sketches(given)
    assert held(agreed) == held(content.sketches(coverage.agreed_units(units[0].unionByName(units[1])), "url")) and set(held(agreed)) == {"same", "nonce", "copies"}
    index = spark.createDataFrame([("same", "older", None, None)], "url string, content_hash string, stable_sketch array<string>, stable_algo string")
    plan = content.verify(index, given.withColumn("status", F.lit(200)))._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan and "Window" not in plan


def test_correction_never_invents_an_address(spark):
    cases = {"https://a.b/x_(y)": "https://a.b/x_(y)", "https://a.b/x_(y)).": "https://a.b/x_(y)", "https://a.b/x/**": "https://a.b/x", "https://a.b/x)**": "https://a.b/x", "https://a.b/d/{ID}.pdb": "https://a.b/d/{ID}.pdb", "https://a.b/x|`": "https://a.b/x", "https://a.b/f[n]|x": "https://a.b/f[n]|x", "https://a.b/x_(y": "https://a.b/x_(y", "https://a.b/": "https://a.b/"}
    assert {k: one(spark, k, upkeep.corrected) for k in cases} == cases and one(spark, None, upkeep.corrected) is None


def test_full_queue_refuses_new_entries_only(spark):
    queue = spark.createDataFrame([("a", 4, 1, 2), ("b", 1, 3, 3)], "url string, attempts int, first_failed int, last_failed int")
    failures = spark.createDataFrame([("a", 9), ("c", 8), ("c", 7), ("d", 7), ("e", 5), (None, 1)], "url string, failed int")
    for room, new in ((1, ""), (2, ""), (3, "e"), (4, "ce"), (5, "cde"), (9, "cde")):
        queued, refused = ledger.enqueue(queue, failures, room)
        assert {r["url"] for r in queued.collect()} == {"a", "b", *new} and {r["url"] for r in refused.collect()} == set("cde") - set(new)
        assert {tuple(r) for r in queued.filter("url = 'a'").collect()} == {("a", 5, 1, 9)}
    assert ledger.enqueue(queue.limit(0), failures.limit(0))[0].count() == 0


def test_titles_are_evidence(spark):
    rows = [("1", "https://a.b/x", "a.b/x/", ["title:unresolved", "t"]), ("2", "u", " ", ["title:unresolved"]), ("3", "v", "Real", ["title:unresolved"]), ("4", "u", "u", ["t"]), ("5", None, None, ["title:unresolved"]), ("6", "w", "w", None)]
    items = spark.createDataFrame(rows, "key string, url string, title string, tags array<string>")
    titles = spark.createDataFrame([("https://a.b/x", "A page"), ("u", "U"), ("u", None), (None, "n")], "url string, title string")
    got = {r["key"]: (r["title"], r["tags"], r["action"]) for r in ledger.backfill(items, titles).collect()}
    assert got == {"1": ("A page", ["t"], "resolved"), "2": (" ", ["title:unresolved"], "waiting"), "3": ("Real", [], "cleared"), "5": (None, ["title:unresolved"], "waiting")}


def test_repairs_move_tags_and_claims(spark):
    plan = spark.createDataFrame([("a**", "a", "merge"), ("a**", "a", "merge"), ("b)", "b", "rewrite"), ("{c}", "c", "skip_template")], "url string, corrected string, action string")
    tags = spark.createDataFrame([("a", "t"), ("a**", "t"), ("b)", "t"), ("{c}", "t"), (None, "t")], "url string, tag string")
    assert sorted(map(tuple, ledger.moved_tags(tags, plan).collect()), key=repr) == sorted([("a", "t"), ("b", "t"), ("{c}", "t"), (None, "t")], key=repr)
    links = spark.createDataFrame([("a", "s", 2, 3, 1), ("a**", "s", 1, 2, 4), ("b)", "s", 1, 1, 1)], "url string, claim string, first_seen int, last_seen int, times_seen int")
    assert {tuple(r) for r in ledger.moved_claims(links, plan).collect()} == {("a", "s", 1, 3, 5), ("b", "s", 1, 1, 1)}


def test_only_unknown_roots_are_imported(spark):
    found = spark.createDataFrame([("1", "/a", "stale"), ("2", "/b", "stale"), ("3", None, "stale")], "incident_id string, root string, kind string")
    assert {r["incident_id"] for r in ledger.open_roots(found, spark.createDataFrame([("/a",), (None,)], "root string")).collect()} == {"2", "3"}
