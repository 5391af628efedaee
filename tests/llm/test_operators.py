"""Each operator against brute force, on small fixtures with awkward rows and on the smallest tables."""

import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenant.llm import chat, components, decontamination, exact_dedup, html_extraction, line_dedup, mixing, near_dedup, pii, substring_dedup, textops, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, source string, `__id` string, node long, `a.b` int"


def awkward(spark):
    """Nulls, empty and blank texts, ties, repeated rows, a long text, and columns whose names clash."""
    rng = np.random.default_rng(3)
    say = lambda n: " ".join(rng.choice(["alpha", "Beta", "gamma", "delta", "É", "ß", "omega"], n))
    long = say(30_000)
    a, b = say(60), say(80)
    rows = [(1, a, "s"), (2, a.upper(), "s"), (2, a.upper(), "s"), (None, a, None), (3, None, "t"), (4, "", "t"), (5, " \t\n", None), (6, "one", "u"), (7, "one two", "u"), (8, "ONE TWO", "s"), (9, long, "s"), (10, long + " end", "s"), (11, long, "v"), (12, b + " x", "v"), (13, b + " y", "v"), (14, b, "w"), (None, None, None), (15, "É é", "w"), (16, "é é", "w")]
    return spark.createDataFrame([(i, t, s, "x", 5, 1) for i, t, s in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def shingles(text):
    words = WORD.findall((text or "").translate(UPPER))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def near_brute(rows):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, x in enumerate(ids):
        for y in ids[:k]:
            for s in sets[x]:
                for t in sets[y]:
                    if s and t and 100 * len(s & t) >= 75 * len(s | t):
                        a, b = find(x), find(y)
                        root[max(a, b)] = min(a, b)
    return sorted(((i, len(shingles(t)), find(i) if i is not None else None, find(i) == i if i is not None else True) for i, t in rows), key=repr)


@pytest.mark.parametrize("make", [awkward, documents, empty])
def test_near_groups(spark, make):
    df = make(spark)
    want = near_brute([(r["doc_id"], r["text"]) for r in df.collect()])
    assert sorted(map(tuple, near_dedup.near_groups(df).collect()), key=repr) == want
    kept = near_dedup.dedup(df)
    assert kept.columns == df.columns and kept.count() == sum(w[3] for w in want)


def test_near_links_across_a_chain(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(words[20 * k : 20 * k + 200])) for k in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["component_id"] for r in near_dedup.near_groups(df).collect()} == {0}


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, x) for x in range(101, 140)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 21)} | {x: 100 for x in range(101, 140)}


@pytest.mark.parametrize("make", [awkward, documents, empty])
@pytest.mark.parametrize("block", [7, exact_dedup.BLOCK_BYTES])
def test_exact_dedup(spark, make, block):
    df = make(spark)
    if block == 7:
        df = df.withColumn("text", F.substring("text", 1, 90))
    rows = [(r["doc_id"], (r["text"] or "").translate(UPPER)) for r in df.collect()]
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = sorted(((i, best[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows), key=repr)
    out = exact_dedup.decide(df, block_bytes=block).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in out), key=repr) == want
    assert all(r["doc_id"] == r["keep_id"] for r in out if r["kept"]) and sum(r["kept"] for r in out) == len(groups)
    kept = exact_dedup.dedup(df)
    assert kept.columns == df.columns and sorted((r["text"] or "").translate(UPPER) for r in kept.collect()) == sorted(groups)


def test_blocks_that_share_a_key_are_told_apart(spark):
    rows = [(1, 1, 0, b"aa"), (2, 1, 0, b"bb"), (3, 1, 0, b"aa"), (4, 1, 0, b"cc")]
    blocks = spark.createDataFrame([(i, "s", n, p, bytearray(b)) for i, n, p, b in rows], "doc_id long, text_sha256 string, n_blocks int, pos int, block binary").withColumn("key", F.when(F.col("doc_id") < 4, 7).otherwise(8).cast("long"))
    name = {r["doc_id"]: r["name"] for r in exact_dedup._name_blocks(blocks).collect()}
    assert name[1] == name[3] and len({name[1], name[2], name[4]}) == 3


def substring_brute(rows, size=20):
    seen, out = set(), []
    for i, t in sorted(rows):
        words, gone = WORD.findall(t or ""), set()
        for s in range(len(words) - size + 1):
            w = tuple(words[s : s + size])
            if w in seen:
                gone.update(range(s, s + size))
            seen.add(w)
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return out


def test_substring_dedup(spark):
    rng = np.random.default_rng(5)
    say = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 500, n))
    shared, rep = say(35), say(22)
    rows = [(1, say(50) + " " + shared + " " + say(10)), (2, shared), (3, say(9) + "\n" + shared + "\t" + say(40)), (4, " ".join([rep] * 3)), (5, "a " * 70), (6, None), (7, ""), (8, say(19)), (9, shared[: len(shared) // 2] + " " + say(4)), (10, say(3) + " " + " ".join([rep] * 2) + " " + shared), (11, shared)]
    rows += [(r["doc_id"] + 100, r["text"]) for r in documents(spark).collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substring_dedup.dedup(df).collect())) == substring_brute(rows)
    assert substring_dedup.dedup(empty(spark)).count() == 0
    none = {r["doc_id"]: r for r in substring_dedup.dedup(awkward(spark).filter("doc_id IS NULL")).collect()}
    assert none[None]["n_removed"] == 0


def line_brute(rows):
    """What is left of each document: a line goes when it and a neighbour were seen before."""
    seen, out = set(), {}
    for i, text in sorted(r for r in rows if r[0] is not None):
        lines, gone = text.split("\n") if text else [], set()
        for k, pair in enumerate(zip(lines, lines[1:], strict=False)):
            gone |= {k, k + 1} if pair in seen else set()
            seen.add(pair)
        out[i] = (len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def test_line_dedup(spark):
    block = "\n".join(f"line {k} of a block" for k in range(12))
    rows = [(1, "head\n" + block), (2, "other\nhead lines\n" + block + "\ntail"), (3, "single"), (4, None), (5, ""), (None, block), (6, "x\ny\nz"), (7, "\n" * 300), (8, "\n".join(["x", "y"] * 200)), (9, "é\nß\n" * 3 + block)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r for r in line_dedup.dedup(df).collect()}
    want = line_brute(rows)
    assert {i: tuple(out[i])[1:] for i in want} == want
    assert out[2]["n_removed"] > 4 and out[None]["n_removed"] == 0 and line_dedup.dedup(empty(spark)).count() == 0


def test_chunk_boundaries_resist_shifts():
    lines = [f"line {k * k % 97} of a text".encode() for k in range(400)]
    ends = lambda got, shift: {s + n - shift for s, n in line_dedup.chunks(got)}
    here = ends(lines, 0)
    assert sum(n for _, n in line_dedup.chunks(lines)) == 400 and 60 < len(here) < 200
    for shift in (1, 3, 17):
        moved = ends([b"new %d" % k for k in range(shift)] + lines, shift)
        assert len(here - moved) <= 1 and len({e for e in moved - here if e > 0}) <= 1
    assert max(n for _, n in line_dedup.chunks([b"same"] * 500)) <= line_dedup.MOST


def test_line_dedup_removes_every_repeated_run(spark):
    rng = np.random.default_rng(5)
    passages = [[f"line {p}.{k}" for k in range(2 + p % 6)] for p in range(40)]
    rows = []
    for i in range(150):
        lines = [f"own {i}.{k}" for k in range(9)]
        for p in rng.choice(40, 2, replace=False):
            at = int(rng.integers(len(lines) + 1))
            lines[at:at] = passages[p]
        rows.append((i, "\n".join(lines)))
    rows.append((150, "\n".join(["same"] * 7 + ["end"])))
    want = {i: kept for i, (_, _, kept) in line_brute(rows).items()}
    kept = {r["doc_id"]: r["kept"] for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == want and kept[150] == "same\nend"
    assert {x for t in kept.values() for x in t.split("\n")} == {x for _, t in rows for x in t.split("\n")}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_decontamination(spark):
    rng = np.random.default_rng(8)
    say = lambda n: [f"q{x}" for x in rng.integers(0, 3000, n)]
    items = [(k, " ".join(say(n))) for k, n in enumerate((5, 12, 20, 33, 60, 60))] + [(50, None), (51, " ")]
    docs, want = [], {}
    for i in range(120):
        k = i % 6
        words, changes = items[k][1].split(), 0
        budget = int(decontamination.RATIO * len(words)) + (i % 3 == 2) * (3 + len(words) // 5)
        for _ in range(budget if i % 3 else 0):
            at = int(rng.integers(1, len(words) - 1))
            words = words[:at] + [[f"z{i}{at}"], [], [words[at], f"z{i}"]][int(rng.integers(3))] + words[at + 1 :]
            changes += 1
        docs.append((i, " ".join(say(30) + words + say(25)).title()))
        if i % 3 < 2:
            want[i] = k
    docs += [(200, None), (201, ""), (202, " ".join(say(500)))]
    found = {r["doc_id"]: r["found"] for r in decontamination.match(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    text = dict(docs)
    for i, k in want.items():
        assert found[i] is not None and found[i]["item_id"] == k, i
    for i, hit in found.items():
        if hit is not None:
            stretch = text[i].lower().split()[hit["start"] : hit["end"]]
            item = items[hit["item_id"]][1].split()
            assert edits(item, stretch) == hit["distance"] <= int(decontamination.RATIO * len(item))
        elif i < 120:
            item, words = items[i % 6][1].split(), text[i].lower().split()
            lows = [edits(item, words[s : s + n]) for s in range(20, 40) for n in range(len(item) - 12, len(item) + 13) if n > 0]
            assert min(lows) > int(decontamination.RATIO * len(item))
    assert found[202] is None and decontamination.clean(empty(spark), spark.createDataFrame(items, "item_id long, text string")).columns == empty(spark).columns
    assert decontamination.clean(awkward(spark), spark.createDataFrame([], "item_id long, text string")).count() == awkward(spark).count()


def within(item, words, most):
    """Whether some stretch of words is within so many edits of the item; first by shared words, then by the whole table."""
    if sum((collections.Counter(item) & collections.Counter(words)).values()) < len(item) - most:
        return False
    row = list(range(len(item) + 1))
    for w in words:
        new = [0]
        for i, x in enumerate(item, 1):
            new.append(min(row[i - 1] + (x != w), row[i] + 1, new[-1] + 1))
        row = new
        if row[-1] <= most:
            return True
    return row[-1] <= most


def test_decontamination_of_the_whole_table(spark):
    """Every document of the smallest tables against every item, by the whole edit table."""
    items = [(r["item_id"], r["text"].lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = decontamination.match(documents(spark), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
    want = {r["doc_id"] for r in rows if any(within(i, (r["text"] or "").lower().split(), int(0.2 * len(i))) for _, i in items)}
    assert {r["doc_id"] for r in rows if r["found"]} == want and want


def test_decontamination_recall_by_size(spark):
    """Documents that hold an item at the full number of edits: substitutions, mixed edits, or all in one part. Recall of the whole path, by size."""
    rng, docs, items = np.random.default_rng(9), [], []
    vocabulary = [f"q{x}" for x in range(20_000)]
    for n in (5, 10, 15, 29, 45, 59, 100, 200, 400):
        budget = int(decontamination.RATIO * n)
        texts = [[str(x) for x in rng.choice(vocabulary, n)] for _ in range(3)]
        items += [(1000 * n + k, " ".join(t)) for k, t in enumerate(texts)]
        for i in range(100):
            words = list(texts[i % 3])
            where = rng.choice(n, budget, replace=False) if i % 4 else np.arange(budget) + int(rng.integers(n - budget + 1))
            for e, at in enumerate(sorted(where.tolist(), reverse=True)):
                words[at : at + 1] = [[f"z{n}.{i}.{e}"], [], [words[at], f"z{n}.{i}.{e}"]][0 if i % 2 else int(rng.integers(3))]
            docs.append((1000 * n + i, " ".join([str(x) for x in rng.choice(vocabulary, 60)] + words + [str(x) for x in rng.choice(vocabulary, 60)])))
    docs += [(-k, " ".join(str(x) for x in rng.choice(vocabulary, 900))) for k in range(1, 40)]
    hit = collections.Counter()
    for r in decontamination.match(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect():
        if r["doc_id"] < 0:
            assert r["found"] is None
        else:
            hit[r["doc_id"] // 1000] += r["found"] is not None and r["found"]["item_id"] == r["doc_id"] // 1000 * 1000 + r["doc_id"] % 1000 % 3
    # Measured: 0.97 or more at each size, 0.99 over all.
    assert all(hit[n] >= 95 for n in (5, 10, 15, 29, 45, 59, 100, 200, 400)) and sum(hit.values()) >= 0.985 * 900, hit


def test_decontamination_of_items_of_common_words(spark):
    """Items made only of the 100 most frequent words, at the full number of edits: words that many items share must not cost them."""
    rng, items, docs = np.random.default_rng(31), [], []
    usual, rest = [f"u{x}" for x in range(100)], [f"r{x}" for x in range(3000)]
    for n in (12, 25, 40):
        budget = int(decontamination.RATIO * n)
        for k in range(80):
            text = [str(x) for x in rng.choice(usual, n)]
            items.append((1000 * n + k, " ".join(text)))
            for at in sorted(rng.choice(n, budget, replace=False).tolist(), reverse=True):
                text[at : at + 1] = [[f"z{n}.{k}.{at}"], [], [text[at], f"z{n}.{k}.{at}"]][int(rng.integers(3))]
            around = [[str(x) for x in rng.choice(rest, 50)] for _ in range(2)]
            docs.append((1000 * n + k, " ".join(around[0] + text + around[1])))
    found = {r["doc_id"]: r["found"] for r in decontamination.match(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for n in (12, 25, 40):
        assert sum(found[1000 * n + k] is not None for k in range(80)) >= 76, n


def test_decontamination_by_shuffles_alone(spark, monkeypatch):
    """The way that is taken where buckets and texts are too many to broadcast, with every key dealt out."""
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = documents(spark).unionByName(documents(spark)).unionByName(documents(spark))
    want = sorted((tuple(r) for r in decontamination.match(docs, items).select("doc_id", "found").collect()), key=repr)
    kept = sorted(r["doc_id"] for r in decontamination.clean(docs, items).collect())
    for module, name, value in ((decontamination, "BROADCAST_ROWS", 0), (decontamination, "BROADCAST_TEXTS", 0), (textops, "LEAST_HEAVY", 1), (textops, "HEAVY", 1 << 40), (textops, "SPREAD", 3)):
        monkeypatch.setattr(module, name, value)
    assert sorted((tuple(r) for r in decontamination.match(docs, items).select("doc_id", "found").collect()), key=repr) == want
    assert sorted(r["doc_id"] for r in decontamination.clean(docs, items).collect()) == kept and any(w[1] for w in want)


def test_decontamination_of_awkward_rows(spark):
    said = " ".join(f"k{x}" for x in range(30))
    items = spark.createDataFrame([(1, "other words are here"), (1, said), (1, said), (None, "x y z"), (2, None), (3, " ")], "item_id long, text string").withColumn("tid", F.lit(1)).withColumn("key", F.lit(2))
    docs = spark.createDataFrame([(1, said.upper(), 5), (1, said.upper(), 5), (2, "x y z", 5), (3, None, 5), (4, "", 5), (5, "pad " * 40_000 + said, 5), (None, said, 5)], "doc_id long, text string, `__found_0` int").withColumn("__found", F.lit("mine")).withColumn("found", F.lit("old")).withColumn("row", F.lit(1)).withColumn("tid", F.lit("t"))
    out = decontamination.match(docs, items).collect()
    assert sorted((r["doc_id"] or 0, r["found"]["start"]) for r in out if r["found"]) == [(0, 0), (1, 0), (1, 0), (5, 40_000)]
    left = decontamination.clean(docs, items)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [2, 3, 4] and {r["__found"] for r in left.collect()} == {"mine"}


def test_mixing(spark):
    docs = documents(spark)
    out = [r.asDict() for r in mixing.mix(docs).collect()]
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    order = sorted(sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if unit * weight[s] > 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] for s in full} if full else {s: unit * weight[s] for s in free}
        left -= sum(target[s] for s in full)
        free = free - full if full else set()
    taken, largest = collections.Counter(), collections.Counter()
    for r in out:
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in order)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in out}


def test_mixing_awkward_rows_and_copies(spark):
    df = awkward(spark).withColumn("copy_no", F.lit(0))
    out = mixing.mix(df).collect()
    assert len(out) == df.count() and all(r["taken"] == 0 for r in out if r["size"] == 0)
    copies = mixing.mixture(df)
    assert copies.columns == [*df.columns, "copy_no_"] and copies.count() == sum(r["copies"] for r in out)
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixture(empty(spark)).count() == 0


def test_the_same_rows_are_kept_and_taken_on_every_run(spark):
    """Rows that agree in id, source and size, or in id and text, but not in other columns."""
    rows = [(1, f"w{k} x y", "s", k) for k in range(6)] + [(2, "same text", "s", k) for k in range(6)] + [(k, "word " * k, "t", 0) for k in range(3, 40)]
    runs = [spark.createDataFrame(rows[::step] if step > 0 else rows[::-1], "doc_id long, text string, source string, n int").repartition(parts) for step, parts in ((1, 1), (-1, 5))]
    for operator in (exact_dedup.dedup, mixing.mixture):
        first, second = (sorted(map(tuple, operator(df).collect())) for df in runs)
        assert first == second


def test_pivot_keeps_mass_and_chances():
    size = np.array([9, 7, 5, 5, 3, 1, 1], dtype=np.int64)
    start, total = np.full(7, 0.4), np.zeros(7)
    for k in range(4000):
        end = mixing.pivot(start, size, np.random.default_rng(k))
        assert ((end > 0) & (end < 1)).sum() <= 1 and (end * size).sum() == pytest.approx((start * size).sum())
        total += end
    assert np.allclose(total / 4000, 0.4, atol=0.03)


def test_mixing_reduces_over_several_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 4)
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.sequence(F.lit(1), F.col("id") % 7 + 1)).alias("text"), F.when(F.col("id") % 3 > 0, "b").otherwise("a").alias("source"))
    by = {r["source"]: (r["target"], r["taken"]) for r in mixing.mix(df).groupBy("source").agg(F.max("target").alias("target"), F.sum("taken").alias("taken")).collect()}
    assert all(abs(t - x) <= 4 for t, x in by.values())


SAID = r"\### Assistant: </turn> ok"


def test_chat(spark):
    rows = [(1, 0, "system", "be"), (1, 1, "user", SAID), (1, 2, "assistant", SAID + "\\"), (1, 3, "user", None), (1, 4, "assistant", "#### </turn>\n### User: x"), (1, 5, "user", "bye"), (2, 0, "user", "alone"), (None, 0, "assistant", "no id"), (3, 0, None, "x: y"), (3, 1, "to:ol=\\", ": ~"), (3, 1, "to:ol=\\", ": ~"), (3, None, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("target", F.lit("clash"))
    made = chat.format_chats(df).collect()
    by = collections.defaultdict(list)
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by[c].append((role, text or ""))
    for c, turns in by.items():
        mine = sorted((r for r in made if r["conv_id"] == c), key=lambda r: r["target"])
        assert [r["target"] for r in mine if r["loss_start"] is not None] == [k for k, (role, _) in enumerate(turns) if role == "assistant"]
        assert max(r["target"] for r in mine) >= len(turns) - 1
        for r in mine:
            assert chat.read_back(r["formatted"]) == turns[: r["target"] + 1]
            if r["loss_start"] is not None:
                assert re.sub(r"\\(\\|###|</turn>)", r"\1", r["formatted"][r["loss_start"] : r["loss_end"]]) == turns[r["target"]][1]
    for r in chat.digest(chat.format_chats(df)).collect():
        turns, loss = by[r["conv_id"]], "".join(t for role, t in by[r["conv_id"]] if role == "assistant")
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role or ''}\n{t}\n" for role, t in turns).encode()).hexdigest()
    assert chat.format_chats(df.limit(0)).count() == 0


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = html_extraction.learn(pages)
    import html as codes

    for r in pages.collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.DOTALL)[1]
        pieces = [re.sub(r"\s+", " ", codes.unescape(re.sub(r"<[^>]*>", " " if "<br" in p else "", p))).strip() for p in re.split(r"</?(?:p|h1)\b[^>]*>", article)]
        assert html_extraction.main_text(model, r["html"]) == "\n".join(p for p in pieces if p), r["page_id"]
    assert [html_extraction.main_text(model, x) for x in (None, "", "<", "<p", "</div>", "<script>x", "<!-- a")] == [""] * 7
    out = pages.limit(3).withColumn("html", F.lit(None).cast("string")).select(html_extraction.extractor(model)("html").alias("t")).collect()
    assert [r["t"] for r in out] == [""] * 3


def test_pages_of_other_forms():
    model = html_extraction.train([])
    body = '<body><header><nav><ul><li><a href="/">Home</a></li></ul></nav></header><div id="cookie-notice"><p>Cookies!</p></div><main><article><h1>T &amp; U</h1><p>One <b>bold</b>\n  word.<p>Two &#8217; here<br>and there</p><div class="ad">Buy</div><form><p>Sign up</p></form><section class="comments"><p>First!</p></section></article></main><aside><p>Other</p></aside><footer>End</footer></body>'
    assert html_extraction.main_text(model, body) == "T & U\nOne bold word.\nTwo ’ here and there"


@pytest.mark.parametrize("tag", ["button", "select", "noscript", "svg", "math", "template"])
def test_an_element_left_open_swallows_no_text(tag):
    model = html_extraction.train([])
    page = lambda inside: f"<body><article><h1>Title of it</h1><p>First paragraph of the article, long enough.</p>{inside}<p>Second paragraph of the article, also long.</p></article></body>"
    want = "Title of it\nFirst paragraph of the article, long enough.\nSecond paragraph of the article, also long."
    assert html_extraction.main_text(model, page(f"<{tag}>")) == html_extraction.main_text(model, page(f"<{tag} class='x'>" * 3)) == want
    assert html_extraction.main_text(model, page(f"<{tag}>inside<i>more</i></{tag}>")) == html_extraction.main_text(model, page(f"<{tag}/>")) == want
    closed_later = page(f"<{tag}>").replace("</body>", f"<{tag}>late</{tag}></body>")
    assert html_extraction.main_text(model, closed_later) == want


def test_many_open_elements_are_read_in_linear_time():
    import time

    began = time.time()
    html_extraction.parse("<body>" + "<button>a<svg>b" * 40_000)
    assert time.time() - began < 5


def test_pages_with_awkward_rows(spark):
    model = html_extraction.train([])
    page = "<body><article><h1>Title</h1><p>A paragraph of words that is long enough to count.</p></article></body>"
    df = spark.createDataFrame([(1, page, "t", 5), (1, page, "t", 5), (None, page, None, None), (2, None, "x", 1), (3, " ", "x", 1), (4, page.replace("words", "words " * 50_000), "y", 2)], "page_id long, html string, text string, `n.chars` int")
    out = df.withColumn("main", html_extraction.extractor(model)("html"))
    got = sorted(((r["page_id"], len(r["main"])) for r in out.collect()), key=repr)
    n = len("Title\nA paragraph of words that is long enough to count.")
    assert got == sorted([(1, n), (1, n), (None, n), (2, 0), (3, 0), (4, n + 6 * 49_999)], key=repr)
    assert df.limit(0).withColumn("main", html_extraction.extractor(model)("html")).collect() == []
    assert html_extraction.learn(df.select("html").limit(0)).weights


def test_tree_marginals_are_exact():
    nodes, _ = html_extraction.parse("<body><div><p>a</p><p>b c d</p></div><ul><li>x</li></ul></body>")
    model = html_extraction.train([])
    own = model.evidence(nodes)
    total = np.zeros((len(nodes), 2))
    for code in range(2 ** len(nodes)):
        y = [code >> i & 1 for i in range(len(nodes))]
        p = np.exp(sum(o * v for o, v in zip(own, y, strict=True)) + sum(model.pair[y[n.parent]][y[i]] for i, n in enumerate(nodes) if i))
        for i, v in enumerate(y):
            total[i, v] += p
    assert np.allclose(model.marginals(nodes), np.log(total[:, 1] / total[:, 0]))


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lexicon = toxicity.learn(docs, labels.filter(~held))
    rows = docs.filter(held).join(labels, "doc_id").select("lang", "toxic", toxicity.scorer(lexicon)("text").alias("s")).collect()
    good = [r["s"] < 0.5 for r in rows if r["toxic"] == 0]
    bad = collections.defaultdict(list)
    for r in rows:
        if r["toxic"] == 1:
            bad[r["lang"]].append(r["s"] >= 0.5)
    assert np.mean(good) > 0.98 and np.mean(sum(bad.values(), [])) > 0.85 and all(np.mean(v) > 0.8 for v in bad.values()), bad
    auto = lexicon.automaton()
    score = lambda t: lexicon.score(lexicon.features(auto, t))
    assert score("y0u 1D10T and m0rоn, pathetic") > 0.5 > score("a trash can and another trash can") and 0 <= score(None) == score("") < 0.5
    for plain in ("follow the path to the river, it is worth the walk", "a disgruntled customer", "we put the trash in the bin", "the losses were stupendous", "clowning around, she won"):
        assert score(plain) < 0.5, plain
    assert score("Le réeuxment des chats") == score("Le re\u0301euxment des chats")


def naive_hits(lexicon, text):
    """All terms at all places by plain comparison, then the exceptions."""
    folded, hits, calm = toxicity.fold(text), {}, []
    for at in range(len(folded)):
        for term, weight in lexicon.terms.items():
            forms = [f" {term}", f" {term[:-1]}s "] if term.endswith(" ") else [f" {term}"]
            if any(folded.startswith(f, at) for f in forms):
                hits[at] = max(weight, hits.get(at, 0.0))
        calm += [(at, at + len(toxicity.fold(e)) - 1) for e in toxicity.EXCEPTIONS if folded.startswith(toxicity.fold(e), at)]
    return sum(w for at, w in hits.items() if not any(a <= at < b for a, b in calm))


def test_toxicity_equals_a_naive_scan(spark):
    lexicon = toxicity.Lexicon({"ioser ": 2.0, "idiot": 1.5, "trash ": 3.0, "idiotic ": 4.0, "réeux": 1.0}, (-3.0, 1.0, 0.5))
    texts = [None, "", " \n", "loser losers idiots idiotic", "the trash and trash", "l0ser 1d1ot; réeuxé reeux", "x" * 9 + " loser " * 4000, "loser bracket loser", "trash can trash", "trash can trash"]
    texts += [r["text"] for r in documents(spark).collect()]
    df = spark.createDataFrame([(t, 1.0) for t in texts], "text string, score double")
    auto = lexicon.automaton()
    for t in texts:
        total = naive_hits(lexicon, t if t is None or len(t) < 20000 else t[:2000])
        if t is None or len(t) < 20000:
            assert lexicon.features(auto, t)[0] == pytest.approx(np.log1p(total))
    got = [r["s"] for r in df.select(toxicity.scorer(lexicon)("text").alias("s"), "score").collect()]
    assert got == pytest.approx([lexicon.score(lexicon.features(auto, t)) for t in texts]) and got[8] == got[9]


def test_terms_give_way_to_longer_ones():
    found = [("pathe", 130, 50.0), ("pathetic ", 130, 50.0), ("stems", 90, 40.0), ("stemsa ", 30, 40.0), ("stemsb ", 30, 40.0)]
    assert set(toxicity.choose(found)) == {"pathetic ", "stems"}


def test_toxicity_without_labels(spark):
    lexicon = toxicity.learn(awkward(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    scores = [r[0] for r in awkward(spark).select(toxicity.scorer(lexicon)("text")).collect()]
    assert len(scores) == awkward(spark).count() and all(0 <= s < 0.5 for s in scores)


PII = "mail a.b+c@x-1.example.com, +1 (523) 555-1055 and 4111 1111 1111 1111 at 10.0.0.255 not 10.0.0.256"


def pii_brute(t):
    want = []
    for kind in pii.KINDS:
        for m in pii.FORMS[kind].finditer(t or ""):
            digits = re.sub(r"[^0-9]", "", m.group())
            double = [int(d) if j % 2 == 0 else sum(divmod(2 * int(d), 10)) for j, d in enumerate(digits[::-1])]
            if {"email": True, "ip": all(int(p or 0) < 256 for p in m.group().split(".")) if kind == "ip" else 0, "card": 13 <= len(digits) <= 19 and sum(double) % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]:
                want.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(want)


def test_pii(spark):
    texts = {1: PII, 2: None, 3: "", 4: "x@y 1.2.3 4111 1111 1111 1112 +12", 5: "pad " * 5000 + "é 8.8.8.8 " + "pad " * 9000 + "z@w.de", 6: PII}
    rows = [*texts.items(), (1, PII), *((r["doc_id"] + 100, r["text"]) for r in documents(spark).collect())]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pii", F.lit(1)).withColumn("spans", F.lit("mine"))
    model = pii.learn(df)
    made = pii.find_spans(df, model)
    assert made.columns == ["doc_id", "text", "spans", "pii"]
    for r in made.collect():
        assert r["pii"]["base"] == pii_brute(r["text"]) and r["spans"] == "mine"
        assert set(filter(None, r["pii"]["base"].split(","))) <= set(filter(None, r["pii"]["spans"].split(",")))
        if r["doc_id"] == 1:
            assert r["pii"]["n_email"] == r["pii"]["n_phone"] == r["pii"]["n_card"] == r["pii"]["n_ip"] == 1
    assert pii.find_spans(empty(spark), pii.learn(empty(spark))).count() == 0


def test_model_finds_held_out_variants(spark):
    """Texts that training never saw, their personal data rewritten: in the forms that training knows, and in forms kept from it."""
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("text RLIKE '[0-9@]'").orderBy("doc_id").limit(1500).collect()]
    model = pii.train([w for t in texts[:600] for w in pii.labelled(t)])
    figures = {}
    for forms in ("known", "kept"):
        found = total = right = all_found = 0
        rewritten = [v for t in texts[600:] if len(t) < 20000 for v in pii.variants(t, pii.HELD_OUT if forms == "kept" else pii.WAYS)]
        for (text, spans), (_, wide) in zip(rewritten, pii.all_spans(model, [t for t, _ in rewritten]), strict=True):
            near = lambda s: any(s[0] == k and a <= s[1] + 2 and s[2] - 2 <= b for k, a, b in spans)
            found += sum(any(s[0] == k and s[1] <= a + 2 and b - 2 <= s[2] for s in wide) for k, a, b in spans)
            total, right, all_found = total + len(spans), right + sum(map(near, wide)), all_found + len(wide)
        figures[forms] = (found / total, right / all_found, total)
    assert figures["known"][0] > 0.9 and figures["known"][1] > 0.9 and figures["kept"][0] >= 0.9 and figures["kept"][1] > 0.9, figures


def test_fast_emissions_are_those_of_training():
    rng, h = np.random.default_rng(3), pii.HIDDEN
    model = pii.Model([rng.normal(0, 1, (pii._CLASSES, 4 * h)).astype(np.float32) for _ in range(2)], [rng.normal(0, 1, (h, 4 * h)).astype(np.float32) for _ in range(2)], rng.normal(0, 1, (2 * h + 1, pii.TAGS)).astype(np.float32), np.zeros((pii.TAGS, pii.TAGS), np.float32))
    c = rng.integers(0, pii._CLASSES, (5, 40))
    assert np.allclose(model.fast()(c).transpose(0, 2, 1), model.emissions(c)[0], atol=1e-3)


def test_no_slices_of_digit_runs():
    for text in ("id 4902948293942007 x", "no 4111111111111111222233334444", "v 1.2.3.4.5 and 1.2.3.4.5.6", "run 12345678901234567890123"):
        for kind in range(4):
            for s in range(len(text)):
                for e in range(s + 1, len(text) + 1):
                    if pii.plausible(kind, text, s, e):
                        assert not (text[e : e + 1].isdigit() and text[e - 1].isdigit()) and not (s and text[s - 1].isdigit() and text[s].isdigit()), (text, text[s:e])


def test_digits_beside_a_number_are_no_part_of_it():
    for kind, piece, line in (("phone", "(555) 123-4567", "flat 12 (555) 123-4567 now"), ("phone", "555-123-4567", "room 12 555-123-4567, 3 pm"), ("ip", "8[.]8[.]4[.]4", "host 7 8[.]8[.]4[.]4 2"), ("card", "4111/1111/1111/1111", "no 5: 4111/1111/1111/1111 12"), ("email", "a_at_b_dot_org", "mail a_at_b_dot_org")):
        at = line.index(piece)
        assert pii.plausible(pii.KINDS.index(kind), line, at, at + len(piece)), line
    for kind, piece, line in (("phone", "555 123 4567", "12 555 123 4567"), ("phone", "555-123-4567", "1-555-123-4567-9"), ("card", "4111 1111 1111 1111", "4111 1111 1111 1111 2222"), ("ip", "1.2.3.4", "1.2.3.4.5"), ("phone", "(555) 123 4567", "1 (555) 123 4567 7")):
        at = line.index(piece)
        assert not pii.plausible(pii.KINDS.index(kind), line, at, at + len(piece)), line


def test_pruned_decoding_equals_viterbi_over_the_whole():
    rng = np.random.default_rng(12)
    for _ in range(30):
        e, move = rng.normal(size=(60, pii.TAGS)), rng.normal(size=(pii.TAGS, pii.TAGS))
        e[:, 0] += rng.choice([0.0, 6.0, 9.0], 60)
        best, back = e[0].copy(), []
        for j in range(1, 60):
            step = best[:, None] + move
            back.append(step.argmax(axis=0))
            best = e[j] + step.max(axis=0)
        tags = [int(best.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        assert pii.best_tags([e.astype(np.float32)], move.astype(np.float32))[0].tolist() == tags[::-1]


def test_crf_gradient_matches_differences():
    rng = np.random.default_rng(1)
    e, move, tags = rng.normal(size=(4, 2, pii.TAGS)), rng.normal(size=(pii.TAGS, pii.TAGS)), rng.integers(0, pii.TAGS, (2, 4))

    def loss(e, move):
        a = e[0]
        for j in range(1, 4):
            a = e[j] + pii._lse(a[:, :, None] + move[None], 1)
        gold = sum(e[j, n, tags[n, j]] + (move[tags[n, j - 1], tags[n, j]] if j else 0) for n in range(2) for j in range(4))
        return (pii._lse(a, 1).sum() - gold) / 2

    de, dm = pii._crf_gradient(e, move, tags)
    for at in ((0, 0, 1), (3, 1, 2), (1, 0, 0)):
        step = np.zeros_like(e)
        step[at] = 1e-5
        assert (loss(e + step, move) - loss(e - step, move)) / 2e-5 == pytest.approx(de[at], abs=1e-6)
    step = np.zeros_like(move)
    step[2, 3] = 1e-5
    assert (loss(e, move + step) - loss(e, move - step)) / 2e-5 == pytest.approx(dm[2, 3], abs=1e-6)


def test_words_are_those_of_the_pattern():
    text = "ab  cd\té f \x0b\n\x85x\u2003y " * 50
    whole = textops.word_hashes(text.encode())
    assert len(whole) == len(WORD.findall(text)) and len(set(whole.tolist())) == len(set(WORD.findall(text)))


def twins():
    """Two words of 1,024 letters that a polynomial hash modulo 2**64 cannot tell apart, whatever its base."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_twin_words_are_told_apart(spark):
    a, b = twins()
    say = " ".join(f"w{k}" for k in range(11))
    df = spark.createDataFrame([(0, f"{say} {a} {say}"), (1, f"{say} {b} {say}"), (2, " ".join([a] * 6)), (3, " ".join([b] * 6))], "doc_id long, text string")
    assert [r["n_removed"] for r in substring_dedup.dedup(df).orderBy("doc_id").collect()] == [0, 0, 0, 0]
    assert sorted(map(tuple, near_dedup.near_groups(df).collect())) == near_brute([tuple(r) for r in df.collect()])


def test_substring_factors(spark):
    """Each factor equals its source word for word, starts earlier there, and cannot be longer on it."""
    rng = np.random.default_rng(15)
    say = lambda n: [f"w{x}" for x in rng.integers(0, 400, n)]
    texts = {0: say(300)}
    for i in range(1, 40):
        words = say(10)
        for _ in range(3):
            src = texts[int(rng.integers(i))]
            at = int(rng.integers(max(1, len(src) - 60)))
            words += src[at : at + int(rng.integers(15, 90))] + say(int(rng.integers(0, 4)))
        texts[i] = words
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    found = substring_dedup.factors(df).collect()
    assert len(found) > 60
    by = collections.defaultdict(list)
    for f in found:
        mine, source = texts[f["doc_id"]], texts[f["source_id"]]
        a, n, b = f["start"], f["words"], f["source_start"]
        assert mine[a : a + n] == source[b : b + n] and n >= 20 and (f["source_id"], b) < (f["doc_id"], a)
        by[f["doc_id"]].append(a)
    assert all(len(set(v)) == len(v) for v in by.values())
    want = {r[0]: r[2] for r in substring_brute([(i, " ".join(w)) for i, w in texts.items()])}
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.dedup(df).collect()} == want


def test_greedy_parse_takes_the_longest_match():
    assert substring_dedup.parse([(0, 3, 1, 0, 7), (3, 4, 1, 0, 10), (2, 9, 5, 0, 0), (20, 1, 2, 0, 2)]) == [(0, 26, 1, 0, 7), (7, 23, 5, 0, 5), (20, 20, 2, 0, 2)]
    assert substring_dedup.parse([]) == []


def test_repeated_ids_are_documents_of_their_own(spark):
    words = " ".join(f"v{k}" for k in range(25))
    rows = [(0, words), (1, "x y " + words), (1, "short"), (1, "short"), (2, "a\nb\nc"), (2, "z\na\nb"), (2, "z\na\nb"), (None, "a\nb")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ord", F.lit("clash")).withColumn("content", F.lit(1))
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["kept"]) for r in substring_dedup.dedup(df).collect())
    assert got == sorted([(0, words), (1, "x y"), (1, "short"), (1, "short"), (2, "a b c"), (2, "z a b"), (2, "z a b"), (-1, "a b")])
    lines = [(r["doc_id"], r["n_removed"]) for r in line_dedup.dedup(df).collect()]
    first = sorted(("a\nb\nc", "z\na\nb"), key=lambda t: int(hashlib.sha256(t.encode()).hexdigest()[:15], 16))[0]
    assert collections.Counter(n for i, n in lines if i == 2) == ({0: 1, 2: 2} if first[0] == "a" else {0: 2, 2: 1})


def test_recall_at_exactly_the_similarity(spark):
    """Pairs of sets with 150 common shingles of 200: 75 of 100, each pair a component of its own."""
    rows = []
    for p in range(400):
        words = [f"p{p}.{k}" for k in range(204)]
        rows += [(2 * p, " ".join(words[:179])), (2 * p + 1, " ".join(words[25:]))]
    sets = [shingles(t) for _, t in rows]
    exact = sum(100 * len(sets[2 * p] & sets[2 * p + 1]) >= 75 * len(sets[2 * p] | sets[2 * p + 1]) for p in range(400))
    assert exact == 400
    linked = sum(not r["kept"] for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert linked == exact


@pytest.mark.parametrize(("split", "depth"), [(16, 2), (6, 4)])
def test_long_lists_are_split_by_more_coordinates(spark, monkeypatch, split, depth):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "SPLIT", split)
    monkeypatch.setattr(near_dedup, "DEPTH", depth)
    rng = np.random.default_rng(6)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(int(rng.integers(1, 12))):
            words[int(rng.integers(120))] = f"x{i}.{int(rng.integers(99))}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_dedup.near_groups(df).collect()), key=repr) == near_brute(rows)


def test_frequent_keys_are_dealt_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(textops, "LEAST_HEAVY", 3)
    rows = spark.createDataFrame([(k % 4 if k < 30 else 9, k) for k in range(100)], "key int, v int")
    once = rows.groupBy("key").agg(F.count(F.lit(1)).alias("times"), F.max("v").alias("m"))
    want = sorted(map(tuple, rows.join(once, "key").collect()))
    assert sorted(map(tuple, textops.meet(rows, once, ["key"]).collect())) == want
