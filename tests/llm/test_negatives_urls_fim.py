"""Hard negatives, URL filters and fill-in-the-middle against brute force, on awkward rows and on the smallest tables."""

import hashlib
import math
import os
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from provenant.llm import fill_in_middle, hard_negatives, queries, url_filter

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, `key` string, cut int, `a.b` int"
VECS = "vec_id long, embedding array<float>, label int, id string, v int, size int"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_url_filters", "op13_fill_in_middle"])
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    cur = con.execute(queries.ORACLE[name])
    columns = sorted(d[0] for d in cur.description)
    want = sorted((tuple(dict(zip([d[0] for d in cur.description], r, strict=True))[c] for c in columns) for r in cur.fetchall()), key=repr)
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == columns and want
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want


# Hard negatives


def test_packed_products_are_exact():
    rng = np.random.default_rng(1)
    for reach, dims in ((1, 3), (200, 64), (1 << 20, 9), (1 << 40, 5), (7, 0)):
        c, a = (rng.integers(-reach, reach + 1, (n, dims)) for n in (37, 5))
        c[0], a[0] = reach, -reach
        c[1], a[1] = -reach, -reach
        block = hard_negatives.Packed(c, reach)
        assert block.fields >= 2
        assert [[int(x) for x in r] for r in block.scores(a)] == [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in a] for p in c]


def mined(rows, positives=5, negatives=3, low=50, high=95):
    sound, best = {}, []
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            sound[i] = min(sound.get(i, (label, list(v))), (label, list(v)))
    q = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in sound.items()}
    for a in (i for i in q if i % 50 == 0):
        score = {b: sum(x * y for x, y in zip(q[a][1], q[b][1], strict=True)) for b in q if b != a and len(q[b][1]) == len(q[a][1])}
        score = {b: s for b, s in score.items() if abs(s) < 1 << 63}
        order = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in order if q[b][0] == q[a][0]][:positives]:
            fit = [b for b in order if q[b][0] != q[a][0] and low * score[p] <= 100 * score[b] <= high * score[p]]
            best += [(a, p, k, b, score[p], score[b]) for k, b in enumerate(fit[:negatives], 1)]
    return sorted(best)


def vectors(spark):
    """Ties, one vector that a third of the rows share, repeated ids, nulls, other lengths, huge and non-finite components."""
    rng = np.random.default_rng(5)
    common = rng.normal(size=6).astype(np.float32).tolist()
    rows = [(i, common if i % 3 == 0 else rng.normal(size=6).round(1).astype(np.float32).tolist(), int(rng.integers(3))) for i in range(400)]
    rows += [(50, common, 0), (50, common, 2), (None, common, 1), (401, None, 1), (402, common, None), (403, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (404, [float("nan")] * 6, 1), (450, [float("inf")] * 6, 1)]
    rows += [(500, [1.0, 2.0], 1), (501, [1.0, 2.0], 1), (502, [1.0, 1.5], 2), (550, [], 1), (551, [], 1), (552, [], 0), (-50, common, 1)]
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], VECS), rows


def test_mining_against_brute_force(spark, monkeypatch):
    df, rows = vectors(spark)
    anchor = F.col("id") % 50 == 0
    want = mined(rows)
    assert {(w[0]) for w in want} >= {50, 500} and not {w[3] for w in want} & {401, 402, 403, 404, 450}
    assert sorted(map(tuple, hard_negatives.mine(df, anchor).collect())) == want
    for name, value in (("LEAST", 16), ("MOST", 16), ("AT_ONCE", 3)):
        monkeypatch.setattr(hard_negatives, name, value)
    assert hard_negatives._blocks(400) == 25
    assert sorted(map(tuple, hard_negatives.mine(df, anchor).collect())) == want
    assert sorted(map(tuple, hard_negatives.mine(df, anchor, positives=2, negatives=9, low=20, high=90).collect())) == mined(rows, 2, 9, 20, 90)


def test_mining_with_huge_components_and_empty_tables(spark):
    rows = [(0, [1e30, 1.0], 0), (1, [1e-30, 3.0], 0), (2, [0.0, 2.0], 1), (3, [1e30, 1e30], 0), (4, [0.0, 1.9], 2)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], VECS)
    got = sorted(map(tuple, hard_negatives.mine(df, F.col("id") == 0).collect()))
    exact = mined([(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows])
    assert got == exact and {g[1] for g in got} == {1}
    assert hard_negatives.mine(df.limit(0), F.col("id") % 50 == 0).collect() == []
    assert hard_negatives.mine(df, F.col("id") > 99).collect() == []


# URL filters

URLS = [
    "http://Example.ORG/en/1", "https://a.example.org/es/x", "https://example.org/fr/", "http://x.com/de/2#top", "http://x.com/fr", "https://x.com/fr/2", "http://evil.net/a/", "HTTPS://EVIL.net:443/a?utm_source=feed#x",
    "http://evil.net/a?id=1&ref=q", "http://evil.net/b", "ftp://evil.net", "no scheme", "", None, "://", "http://", "http://notexample.org/en/1", "http://evil.net?x=/en/", "http://org/", "http://ÄÖ.com/de/\n", "a://b://c/d", "http://evil.net/a",
]
LISTED = ["https://evil.net/a", "http://evil.net/a?id=1", "http://evil.net/a", None, "nothing", "http://x.com/fr/2"]


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?", url or "")
    low = lambda s: "".join(c.lower() if c.isascii() else c for c in s)
    return (low(m[1]), m[2], m[3] or "") if m else ("", "", None)


def canonical(url):
    host, path, query = parts(url)
    if query is None:
        return None
    fields = [f for f in query.split("&") if not re.match(r"(utm_[a-z]+|fbclid|gclid|ref)=", f)]
    return re.sub(":(80|443)$", "", host) + path.rstrip("/") + ("?" + "&".join(fields) if query and "&".join(fields) else "")


def verdict(url, listed):
    host, path, _ = parts(url)
    fits = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: (len(r.host + r.path), len(r.host)))
        return host, path, best.host + best.path, best.verdict
    return host, path, None, "block" if canonical(url) in listed else "allow"


@pytest.mark.parametrize("max_blocks", [1, 8, url_filter.MAX_BLOCKS])
def test_verdicts_against_brute_force(spark, max_blocks):
    more = [f"http://h{i % 97}.net/p{i}" for i in range(900)]
    pages = [(i, u, "k", True) for i, u in enumerate(URLS + more + [URLS[6]] * 40)] + [(None, URLS[6], "k", None), (3, URLS[3], "k", None)]
    listed = LISTED + more[::2]
    df = spark.createDataFrame(pages, "page_id long, url string, key string, hit boolean")
    known = {canonical(u) for u in listed} - {None}
    want = sorted(((i, *verdict(u, known)) for i, u, _, _ in pages), key=repr)
    got = url_filter.judge(df, spark.createDataFrame([(u,) for u in listed], "url string"), queries.URL_RULES, max_blocks=max_blocks)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert {w[4] for w in want} == {"allow", "block"} and len({w[3] for w in want}) == 6
    kept = url_filter.keep(df, spark.createDataFrame([(u,) for u in listed], "url string"), queries.URL_RULES, max_blocks=max_blocks)
    assert kept.columns == df.columns and kept.count() == sum(w[4] == "allow" for w in want)


def test_url_filter_of_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert [tuple(r) for r in url_filter.judge(pages, pages.limit(0)).collect()] == [(1, "a.net", "/", None, "allow")]
    assert url_filter.judge(pages.limit(0), pages).collect() == []


def test_bloom_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(20000).select(F.concat(F.lit("host.net/"), F.col("id").cast("string")).alias("key"))
    table, blocks = url_filter.bloom(keys)
    probe = spark.range(60000).select("id", F.concat(F.lit("host.net/"), F.col("id").cast("string")).alias("key"))
    probe = probe.withColumn("block", url_filter._block(F.col("key"), blocks)).join(table, "block", "left")
    hit = F.lit(True)
    for k, m in enumerate(url_filter._masks(F.col("key"))):
        hit = hit & (F.coalesce(f"w{k}", F.lit(0)).bitwiseAND(m) == m)
    inside, outside = probe.agg(F.count_if(hit & (F.col("id") < 20000)), F.count_if(hit & (F.col("id") >= 20000))).first()
    assert inside == 20000 and outside < 800
    assert blocks & (blocks - 1) == 0


def test_url_filter_runs_without_python(spark):
    plan = queries.op12_url_filters(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExternalRDD", plan) and "BroadcastHashJoin" in plan


# Fill in the middle

TEXTS = ["abc def", "", None, "x", "<P> here", "ends <S>", "<M", "ab<P", "éàü ßé abc, def! 12", "\U0001f600 smile \U0001f600", "word " * 30_000, "é" * 9000, "a" * 9000, "\n\t \r\n", "<" * 50, "A1b2C3" * 700 + "é"]


def filled(i, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    low, high = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:low]), "".join(tokens[low:high]), "".join(tokens[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return i, len(tokens), "plain", None, None, text
    if h4 % 100 < 20:
        return i, len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_against_brute_force(spark):
    rows = [(k * 40 + j, t) for k, t in enumerate(TEXTS) for j in range(12)] + [(None, "no id here"), (1, "twice"), (1, "twice"), (-3, "minus three")]
    df = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], DOCS)
    made = fill_in_middle.transform(df)
    want = sorted((filled(*r) for r in rows), key=repr)
    assert sorted(map(tuple, made.collect()), key=repr) == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    back = made.select("doc_id", fill_in_middle.restore(F.col("output"), F.col("form")).alias("text"))
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)
    assert fill_in_middle.transform(df.limit(0)).collect() == []


@pytest.mark.parametrize("block", [1, 2, 7, 4096])
def test_cuts_at_every_token(block):
    for text in TEXTS:
        text = (text or "")[:300]
        tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        blocks = fill_in_middle.Blocks(text.encode(), block)
        assert blocks.n == len(tokens)
        assert [blocks.chars_before(k) for k in range(len(tokens) + 1)] == [len("".join(tokens[:k])) for k in range(len(tokens) + 1)]


def test_fenwick_nodes_sum_their_ranges():
    values = np.arange(1, 38).reshape(-1, 1)
    tree = fill_in_middle.fenwick(values)
    assert [int(t) for t in tree[1:, 0]] == [int(values[i - (i & -i) : i].sum()) for i in range(1, 38)]
