"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact verification.

A document is contaminated by an item when some stretch of its words is within
``floor(RATIO * words of the item)`` word edits of the item. Items are cut into
equal parts of PART words or more; of the edits some part has no more than its
share, so windows of a part's size are what is searched for, whatever the size
of the item: the walks below drift apart as they get longer.

Every window of a document, and every part, is embedded by WALKS random walks
(CGK): a walk writes the word it stands on and moves on, or not, by a coin that
depends on step and word, so that few edits become few differing places.
Sampling SAMPLES places of a walk gives a bucket; a window and a part are
candidates when any of REPEATS buckets agrees. Recall over the whole path is
measured by the tests at the full number of edits. Candidates are verified on
true words, by the exact edit distance over all stretches around the window.

A window that holds fewer words of any item than the edits of its part leave
cannot be verified, so it is passed over before it is embedded.

Items, their buckets and the candidates are tables, joined by key. The tasks
that embed documents hold only two bit filters, of the items' words and of the
buckets in use, of at most MAX_FILTER bits each: what they let through by chance
finds no partner in the join.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenant.llm.textops import durable, hashed, meet, mix

RATIO = 0.2
#: Words of the smallest part of an item that is cut; shorter items are one part.
PART = 12
WALKS, REPEATS, SAMPLES = 6, 48, 4
#: Places are sampled from the first SPAN steps of a walk for each word of a part.
SPAN = 1.2
#: A word is common that more than this share of the items has, and more than so many of them.
COMMON, MIN_COMMON = 0.03, 5
#: Bits of the filter for each bucket in use, and its limits.
FILTER_RATE, MIN_FILTER, MAX_FILTER = 512, 1 << 23, 1 << 30
#: Bucket rows that are broadcast to meet the windows where they stand; more are shuffled.
BROADCAST_ROWS = 1_000_000
#: Texts with a finding that are broadcast to meet their rows, of about 100 bytes each; more are shuffled.
BROADCAST_TEXTS = 250_000
#: Words that are embedded at once.
CHUNK = 1 << 16

FOUND = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_MULTIPLIERS = np.random.default_rng(4).integers(1, 1 << 63, (REPEATS, SAMPLES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(body: bytes | None) -> list[bytes]:
    return (body or b"").split()


def size_class(m: int) -> int:
    """The smallest size that is sampled like m: sizes within a quarter of each other are."""
    low = 1
    while low + max(1, low // 4) <= m:
        low += max(1, low // 4)
    return low


@lru_cache(maxsize=None)
def sampled(low: int, repeat: int) -> np.ndarray:
    """Sorted places for parts of a size class. Parts too short for any edit are found by their first word."""
    if RATIO * low < 1:
        return np.zeros(SAMPLES, dtype=np.int64)
    return np.sort(np.random.default_rng((low, repeat)).choice(max(SAMPLES, int(SPAN * low)), SAMPLES, replace=False))


def walked(words: np.ndarray, start: np.ndarray, walk: int, steps: int) -> list[np.ndarray]:
    """For every start the word that the walk stands on at each step."""
    padded = np.append(words, np.zeros(steps, dtype=np.uint64))
    coins, at, out = mix(padded + np.uint64(2 * walk + 1)), start.copy(), []
    for step in range(steps):
        out.append(padded.take(at))
        at += ((coins.take(at) >> np.uint64(step % 61)) & np.uint64(1)).view(np.int64)
    return out


def bucket(walk: list[np.ndarray], low: int, repeat: int) -> np.ndarray:
    """The key of each start: the words at the sampled places, and which repetition and size class they are of."""
    key = np.uint64(((low << 8) + repeat) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for place, factor in zip(sampled(low, repeat).tolist(), _MULTIPLIERS[repeat], strict=True):
        key = key + walk[place] * factor
    return key


def steps_of(low: int) -> int:
    return max(SAMPLES, int(SPAN * low)) + 1


def parts_of(n: int) -> list[tuple[int, int]]:
    """(first word, words) of the parts of an item of n words."""
    k = max(1, n // PART)
    return [(n * j // k, n * (j + 1) // k - n * j // k) for j in range(k)]


def part_keys(words: list[bytes], common: frozenset[int] = frozenset()) -> tuple[list[tuple[int, int]], set[tuple[int, int]]]:
    """(key, first word of the part) of all parts of an item, and (words, least number of words that aren't common in its buckets) of the parts.

    Buckets with two words or more that aren't common find a part as well and
    meet few other windows; where these are less than half of a part's buckets,
    one such word is asked for, and where they still are, none.
    """
    h, out, sizes, long = hashed(words), [], set(), dict(parts_of(len(words)))
    for low in {size_class(m) for m in long.values()}:
        start = np.array([a for a, m in parts_of(len(words)) if size_class(m) == low])
        found: dict[int, list[tuple[int, int]]] = {}
        for walk in range(WALKS):
            made = walked(h, start, walk, steps_of(low))
            for repeat in range(walk, REPEATS, WALKS):
                at = [made[p].tolist() for p in sampled(low, repeat).tolist()]
                for k, key in enumerate(bucket(made, low, repeat).view(np.int64).tolist()):
                    found.setdefault(k, []).append((len({w[k] for w in at} - common), key))
        for k, keys in found.items():
            least = next(r for r in (2, 1, 0) if sum(rare >= r for rare, _ in keys) * 2 >= REPEATS)
            out += [(key, int(start[k])) for rare, key in keys if rare >= least]
            sizes.add((long[int(start[k])], least))
    return out, sizes


def _keys(common: frozenset[int]):
    """(kind, key, item, at, n): bucket keys of the parts, hashes of the words, and sizes of parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, body in zip(batch.column("item").to_pylist(), batch.column("body").to_pylist(), strict=True):
                words = words_of(body)
                if words:
                    keys, sizes = part_keys(words, common)
                    rows += [("bucket", key, item, at, len(words)) for key, at in keys]
                    rows += [("word", h, None, None, None) for h in hashed(list(set(words))).view(np.int64).tolist()]
                    rows += [("size", m, None, least, None) for m, least in sizes]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["kind", "key", "item", "at", "n"])

    return run


def _common(asked: DataFrame) -> frozenset[int]:
    """Hashes of the words that more than COMMON of all items have: at most 1 / COMMON times the words of an item."""
    words = asked.select("item", F.explode(F.array_distinct(F.split(F.col("body").cast("string"), r"[\x20\x09-\x0D]+"))).alias("word")).filter("word <> ''")
    often = words.groupBy("word").count().filter(F.col("count") > max(MIN_COMMON, COMMON * asked.count()))
    return frozenset(hashed([r["word"].encode() for r in often.collect()]).tolist())


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    """The slot of a key among 2**bits."""
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def _filter(keys: DataFrame) -> tuple[int, bytes]:
    """(bits, the filter of the keys as bytes); pieces of it are made by tasks, and all of them have MAX_FILTER bits at most."""
    size = min(MAX_FILTER, max(MIN_FILTER, 1 << (FILTER_RATE * keys.count()).bit_length()))
    bits = size.bit_length() - 1
    slot = F.shiftrightunsigned("key", 64 - bits)

    def piece(rows: pd.DataFrame) -> pd.DataFrame:
        made = np.zeros(1 << 17, dtype=np.uint8)
        made[rows["slot"].to_numpy() & 0x1FFFF] = 1
        return pd.DataFrame({"nth": [int(rows["slot"].iat[0]) >> 17], "piece": [np.packbits(made, bitorder="little").tobytes()]})

    pieces = keys.select(slot.alias("slot"), F.shiftright(slot, 17).alias("nth")).distinct().groupBy("nth").applyInPandas(piece, "nth long, piece binary")
    whole = bytearray(size // 8)
    for row in pieces.toLocalIterator():
        whole[row["nth"] << 14 : (row["nth"] + 1) << 14] = row["piece"]
    return bits, bytes(whole)


def _held(filter_: tuple[int, np.ndarray], keys: np.ndarray) -> np.ndarray:
    bits, table = filter_
    slot = _slots(keys, bits)
    return (table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def able(known: np.ndarray, rare: np.ndarray, sizes: list[tuple[int, int]]) -> np.ndarray:
    """Starts of the windows that hold enough words of items for a part of one of the sizes with its share of the edits, and enough that aren't common for its buckets."""
    n = len(known)
    count, special = (np.append(0, np.cumsum(x)) for x in (known, rare))
    here, good = np.arange(n), np.zeros(n, dtype=bool)
    for m, least in sizes:
        edits = int(RATIO * (m + 1))
        enough = count[np.minimum(here + m + edits, n)] - count[:-1] >= m - edits
        good |= enough & (special[np.minimum(here + steps_of(m), n)] - special[:-1] >= least)
    return np.flatnonzero(good)


def _hits(in_words: tuple, in_buckets: tuple, common: frozenset[int], sizes: list[tuple[int, int]]):
    """Per document text, the starts of windows whose bucket passes the filter: (tid, start, key). Filters are (bits, broadcast bytes)."""
    by_low: dict[int, list[tuple[int, int]]] = {}
    for m, least in sizes:
        by_low.setdefault(size_class(m), []).append((m, least))
    usual = np.array(sorted(common), dtype=np.uint64)

    def chunk(parts: list[np.ndarray], vocabulary: tuple, used: tuple) -> list:
        gap, out = np.zeros(1, dtype=np.uint64), []
        flat = np.concatenate([x for p in parts for x in (p, gap)])
        size = np.array([len(p) + 1 for p in parts])
        begin = np.cumsum(size) - size
        known = _held(vocabulary, flat)
        rare = known.copy()
        rare[known] = ~np.isin(flat[known], usual)
        for low, mine in by_low.items():
            start = able(known, rare, mine)
            for walk in range(WALKS):
                made = walked(flat, start, walk, steps_of(low))
                for repeat in range(walk, REPEATS, WALKS):
                    keys = bucket(made, low, repeat)
                    some = np.flatnonzero(_held(used, keys))
                    if len(some):
                        doc = np.searchsorted(begin, start[some], "right") - 1
                        out.append((doc, start[some] - begin[doc], keys[some].view(np.int64)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, used = ((bits, np.frombuffer(held.value, dtype=np.uint8)) for bits, held in (in_words, in_buckets))
        for batch in batches:
            tids = batch.column("tid")
            rows, parts, count, seen = [], [], 0, set()

            def flush() -> pa.RecordBatch:
                found = chunk(parts, vocabulary, used)
                doc, start, key = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
                return pa.RecordBatch.from_arrays([tids.take(pa.array(np.array(rows, np.int64)[doc])), pa.array(start.astype(np.int32)), pa.array(key)], names=["tid", "start", "key"])

            for i, body in enumerate(batch.column("body")):
                tid = tids[i].as_py()
                words = [] if tid in seen else words_of(body.as_py())
                seen.add(tid)
                if words:
                    rows.append(i)
                    parts.append(hashed(words))
                    count += len(words)
                if count >= CHUNK:
                    yield flush()
                    rows, parts, count = [], [], 0
            if parts:
                yield flush()

    return run


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words around the windows that an item may meet, joined where they overlap: (tid, item, at, stretch)."""
    for batch in batches:
        rows = []
        for tid, body, near in zip(batch.column("tid").to_pylist(), batch.column("body").to_pylist(), batch.column("near").to_pylist(), strict=True):
            words, by = words_of(body), {}
            for item, begin, n in sorted((c["item"], c["begin"], c["n"]) for c in near):
                slack = int(RATIO * n)
                lo, hi = max(0, begin - slack), min(len(words), begin + n + slack)
                held = by.setdefault(item, [])
                if held and lo <= held[-1][1]:
                    held[-1][1] = max(hi, held[-1][1])
                else:
                    held.append([lo, hi])
            rows += [(tid, item, lo, b" ".join(words[lo:hi])) for item, held in by.items() for lo, hi in held]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["tid", "item", "at", "stretch"])


def _last_row(item: np.ndarray, words: np.ndarray, anchored: bool) -> np.ndarray:
    """Edits between the whole item and a stretch that ends at each place; anchored: and that starts at 0."""
    steps = np.arange(len(item) + 1)
    row, out = steps.copy(), np.empty(len(words) + 1, dtype=np.int64)
    out[0] = row[-1]
    for j, word in enumerate(words, 1):
        new = np.empty_like(row)
        new[0] = j if anchored else 0
        np.minimum(row[:-1] + (item != word), row[1:] + 1, out=new[1:])
        row = np.minimum.accumulate(new - steps) + steps
        out[j] = row[-1]
    return out


def edit_distance(item: list[bytes], words: list[bytes], most: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the stretch of words nearest to the item: the first such end, then the shortest; None beyond most."""
    number = {w: k for k, w in enumerate(dict.fromkeys(item))}
    a, b = np.array([number[w] for w in item]), np.array([number.get(w, -1) for w in words])
    if np.minimum(np.bincount(a, minlength=len(number)), np.bincount(b[b >= 0], minlength=len(number))).sum() < len(a) - most:
        return None
    ends = _last_row(a, b, False)
    end = int(ends.argmin())
    if ends[end] > most:
        return None
    back = _last_row(a[::-1], b[:end][::-1], True)
    return int(ends[end]), end - int(back.argmin()), end


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for tid, item_id, body, at, stretch in zip(*(batch.column(c).to_pylist() for c in ("tid", "item_id", "body", "at", "stretch")), strict=True):
            item = words_of(body)
            near = edit_distance(item, words_of(stretch), int(RATIO * len(item)))
            if near:
                rows.append((tid, near[0], item_id, at + near[1], at + near[2]))
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["tid", "distance", "item_id", "start", "end"])


def _tid(text_col: str) -> Column:
    """Equal texts are one text to look at, however many rows have it."""
    return F.unhex(F.sha2(F.col(f"`{text_col}`").cast("string").cast("binary"), 256))


def _body(column: str) -> Column:
    return F.lower(F.col(f"`{column}`").cast("string")).cast("binary")


def _times(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("times"))


def _with(rows: DataFrame, texts: DataFrame, how: str) -> DataFrame:
    """rows joined with texts by tid. The rows of one text, however many, are met where they stand, or else in many tasks."""
    if texts.count() <= BROADCAST_TEXTS:
        return rows.join(F.broadcast(texts), "tid", how)
    counts = durable(_times(rows.select("tid").join(texts.select("tid"), "tid", "left_semi"), "tid"))
    return meet(rows, texts, ["tid"], counts=counts, how=how)


def nearest(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame | None:
    """(tid, distance, item_id, start, end) of the texts that an item contaminates; None where no item has words."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), _body(item_text).alias("body")).dropna().distinct().select(F.xxhash64("item_id", "body").alias("item"), "item_id", "body")
    common = _common(asked)
    made = durable(asked.select("item", "body").mapInArrow(_keys(common), "kind string, key long, item long, at int, n int"))
    sizes = sorted((r["key"], r["at"]) for r in made.filter("kind = 'size'").groupBy("key").agg(F.min("at").alias("at")).collect())
    if not sizes:
        return None
    keys = made.filter("kind = 'bucket'").select("key", "item", "at", "n").distinct()
    filters = []
    for kind in ("word", "bucket"):
        bits, table = _filter(made.filter(F.col("kind") == kind).select("key").distinct())
        filters.append((bits, spark.sparkContext.broadcast(table)))
    texts = docs.select(_tid(text_col).alias("tid"), _body(text_col).alias("body")).filter("body IS NOT NULL")
    hits = texts.mapInArrow(_hits(*filters, common, sizes), "tid binary, start int, key long")
    if made.count() <= BROADCAST_ROWS:
        met = hits.join(F.broadcast(keys), "key")
    else:
        hits = durable(hits)
        met = meet(hits, keys, ["key"], counts=durable(_times(hits, "key")))
    near = durable(met.select("tid", "item", (F.col("start") - F.col("at")).alias("begin"), "n").distinct())
    listed = near.groupBy("tid").agg(F.collect_list(F.struct("item", "begin", "n")).alias("near"))
    # Copies of a text are brought down to one within each task, before they are moved.
    once = _with(texts, near.select("tid").distinct(), "left_semi").groupBy("tid").agg(F.min("body").alias("body"))
    stretches = durable(once.join(listed, "tid").mapInArrow(_stretches, "tid binary, item long, at int, stretch binary"))
    paired = meet(stretches, asked, ["item"], counts=durable(_times(stretches, "item")))
    verified = paired.select("tid", "item_id", "body", "at", "stretch").mapInArrow(_verified, "tid binary, distance int, item_id long, start int, end int")
    best = verified.groupBy("tid").agg(F.min(F.struct("distance", "item_id", "start", "end")).alias("best"))
    return durable(best.select("tid", "best.*"))


def match(docs: DataFrame, items: DataFrame, text_col: str = "text", name: str = "found", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with a struct column: item_id, distance in words, start and end in words; null where clean.

    Words are runs of other characters than ASCII white space, A-Z and other
    capitals lower-cased. The nearest item wins, then the smallest id. Rows of
    one item_id are items each; items without id or words match nothing. Null
    and empty texts are clean, as is everything where there are no items; texts
    are read whole, and equal ones fare alike. A column of docs that is called
    name is replaced; all others stay, whatever their names.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != name]
    best = nearest(docs, items, text_col, item_id, item_text)
    if best is None:
        return docs.select(*others, F.lit(None).cast(FOUND).alias(name))
    rows = docs.select(F.struct(*others).alias("row"), _tid(text_col).alias("tid"))
    found = best.select("tid", F.struct(*(f.name for f in FOUND)).alias("found"))
    return _with(rows, found, "left").select("row.*", F.col("found").alias(name))


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that no item contaminates, with all their columns."""
    best = nearest(docs, items, text_col)
    if best is None:
        return docs
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _tid(text_col).alias("tid"))
    return _with(rows, best.select("tid"), "left_anti").select("row.*")
