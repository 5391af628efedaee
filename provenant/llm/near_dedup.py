"""Near duplicates by an inverted join on MinHash coordinates.

Texts with the same word sequence form one class. Each class is posted under its
COORDINATES coordinate-value pairs. Two sets with similarity 0.75 agree in about
three of four coordinates, and in fewer than MATCHES of 32 with a chance of
about 1 in 10 million. Pairs are ordered from the rarest to the most frequent,
the same everywhere: two classes that agree in MATCHES coordinates share one of
their first ``COORDINATES - MATCHES + 1``. So only that prefix is joined, and
what most classes have in common, last in the order, is skipped.

No posting list is expanded into all its pairs. Each member first meets the
leader of its list, and confirmed links are merged into components. Only lists
that still hold different components are then merged across components:
collisions are counted on a wider sketch, inside the task, and only pairs that
may reach the similarity leave it. A list far too long for one task is split by
a second coordinate first, what is still too long by a third, and so on: classes
that agree in MATCHES coordinates share k of their first
``COORDINATES - MATCHES + k``. Every link is confirmed on the full sets of true
words, computed from whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.components import components
from provenant.llm.textops import digest128, durable, meet, mix, shingle_set, shingles

SHINGLE, COORDINATES, MATCHES = 5, 32, 8
#: Similarity of a link, as the fraction LINK_NUM / LINK_DEN.
LINK_NUM, LINK_DEN = 75, 100
_SEEDS = np.random.default_rng(10).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Coordinates of the wide sketch, a byte each, and how many agree at least: at similarity 0.75, all but one pair in a hundred thousand.
WIDE, WIDE_MATCHES = 512, 342
_WIDE_SEEDS = np.random.default_rng(11).integers(1, 1 << 63, WIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Members of one list that are compared in one task; longer lists are cut into pairs of blocks.
BLOCK = 2048
#: Longer lists are split by another coordinate, up to DEPTH in all: beyond this the split makes fewer rows than pairs of blocks do.
SPLIT, DEPTH = COORDINATES * BLOCK, 4
_PIECE = 1024


def signature(shingles: np.ndarray, coordinates: int = COORDINATES, seeds: np.ndarray = _SEEDS) -> np.ndarray:
    """The least value of each random order, mixed with the number of its coordinate into one key."""
    seeds = seeds[:coordinates, None]
    least = np.full(coordinates, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), _PIECE):
        part = shingles[at : at + _PIECE]
        x = part[None, :] * seeds
        x ^= x >> np.uint64(29)
        np.minimum(least, (x * np.uint64(0x94D049BB133111EB)).min(axis=1), out=least)
    return mix(least ^ seeds[:, 0]).view(np.int64)


def _sketch(size: int, coordinates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, sigs, lengths = [], [], [], [0]
            for value in batch.column("body"):
                body = (value.as_py() or b"").lower()
                made = shingle_set(body, size)
                n.append(len(made))
                keys.append(digest128(b" ".join(body.split())) if len(made) else None)
                if len(made):
                    sigs.append(signature(made, coordinates))
                lengths.append(coordinates * len(sigs))
            flat = np.concatenate(sigs) if sigs else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat, pa.int64()))],
                names=["doc_id", "n_shingles", "seq_key", "sig"],
            )

    return run


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int = SHINGLE, coordinates: int = COORDINATES) -> DataFrame:
    body = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("body"))
    return body.mapInArrow(_sketch(size, coordinates), "doc_id long, n_shingles long, seq_key binary, sig array<long>")


def prefixes(classes: DataFrame, coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """(node, weight, keys): the rarest pairs of each class, without those that no other class has, in order and DEPTH - 1 more than its prefix.

    weight: how frequent all its pairs are together. The last DEPTH - 1 of keys only split long lists.
    """
    posts = classes.select("node", F.explode("sig").alias("key"))
    often = durable(posts.groupBy("key").agg(F.count(F.lit(1)).alias("often")).filter("often > 1"))
    shared = meet(posts, often, ["key"], "often").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("often", "key"))).alias("shared"))
    # Pairs that one class has alone come first in the order and need no posting.
    room = F.size("shared") - (matches - 1)
    weight = F.aggregate("shared", F.lit(0).cast("long"), lambda total, p: total + p["often"])
    return shared.filter(room > 0).select("node", weight.alias("weight"), F.transform(F.slice("shared", F.lit(1), room + DEPTH - 1), lambda p: p["key"]).alias("keys"))


def _posted(first: DataFrame) -> DataFrame:
    """(node, weight, key) of the prefixes."""
    return first.select("node", "weight", F.explode(F.slice("keys", F.lit(1), F.size("keys") - (DEPTH - 1))).alias("key"))


def _verify(size: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            u, v = [], []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "body_a", "body_b")), strict=True):
                if last is None or last[0] != a or last[1] != x:
                    last, held = (a, x), shingles(x, size)
                other = shingles(y, size)
                if not (held and other) or den * min(len(held), len(other)) < num * max(len(held), len(other)):
                    continue
                common = len(held & other)
                if den * common >= num * (len(held) + len(other) - common):
                    u.append(a)
                    v.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def confirm(pairs: DataFrame, bodies: DataFrame, size: int = SHINGLE, num: int = LINK_NUM, den: int = LINK_DEN) -> DataFrame:
    """The pairs (a, b) of document ids whose full sets of true words are similar enough, as (u, v). bodies: (id, body).

    A text that very many pairs name, as the original of many copies, is met by
    them in many tasks, on either side.
    """
    full = pairs
    for side in ("b", "a"):
        # A repeated id may have several texts: each of them meets all pairs of its id.
        times = durable(pairs.groupBy(side).agg(F.count(F.lit(1)).alias("times")))
        full = meet(full, bodies.select(F.col("id").alias(side), F.col("body").alias(f"body_{side}")), [side], counts=times)
    return full.select("a", "b", "body_a", "body_b").mapInArrow(_verify(size, num, den), "u long, v long")


def _leader_pairs(posts: DataFrame) -> DataFrame:
    """Each member of a list against its leader, the member whose pairs are the most frequent: copies of one text agree most with their original."""
    top = posts.groupBy("key").agg(F.max(F.struct("weight", "node")).alias("top"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    leaders = durable(top.select("key", F.col("top.node").alias("leader"), "times"))
    return meet(posts, leaders, ["key"]).filter("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()


def _wide(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = [signature(shingle_set(x.as_py(), size), WIDE, _WIDE_SEEDS).astype(np.uint8).tobytes() for x in batch.column("body")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(wide, pa.binary())], names=["node", "wide"])

    return run


def _across(best: bool, num: int, den: int):
    """Pairs of different components within one list, or between two blocks of a long one."""

    def one(rows: pd.DataFrame, out: list) -> None:
        root, n, node, block = (rows[c].to_numpy() for c in ("root", "n_shingles", "node", "block"))
        key, whole = rows["key"].iat[0], rows["lo"].iat[0] == rows["hi"].iat[0]
        bits = np.frombuffer(b"".join(rows["wide"]), dtype=np.uint8).reshape(len(rows), WIDE)
        keys, plain = rows["keys"].tolist(), bool(rows["plain"].iat[0])
        values, times = np.unique(root, return_counts=True)
        # A pair of different components has a member outside the most frequent one.
        for i in np.flatnonzero(root != values[times.argmax()]):
            able = np.flatnonzero((root != root[i]) & (den * np.minimum(n, n[i]) >= num * np.maximum(n, n[i])) & ((block != block[i]) | whole))
            if len(able):
                agree = (bits[able] == bits[i]).sum(axis=1)
                for j in able[[agree.argmax()]] if best and agree.max() >= WIDE_MATCHES else able[agree >= WIDE_MATCHES]:
                    if best or not plain or np.intersect1d(keys[i], keys[j], assume_unique=True)[0] == key:
                        out.append((min(node[i], node[j]), max(node[i], node[j])))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by list and blocks; a list may go on in the next frame."""
        held: list[pd.DataFrame] = []
        for frame in frames:
            ids = frame[["key", "lo", "hi"]].to_numpy()
            cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1 if len(frame) else []
            parts = [frame.iloc[x:y] for x, y in zip([0, *cuts], [*cuts, len(frame)], strict=True)]
            out: list = []
            for part in parts:
                if held and tuple(held[-1][["key", "lo", "hi"]].iloc[0]) != tuple(part[["key", "lo", "hi"]].iloc[0]):
                    one(pd.concat(held), out)
                    held = []
                held.append(part)
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64").drop_duplicates()
        out = []
        if held:
            one(pd.concat(held), out)
        yield pd.DataFrame(out, columns=["a", "b"], dtype="int64").drop_duplicates()

    return run


def _still_split(posts: DataFrame, roots: DataFrame) -> DataFrame:
    """Posts of the lists that hold members of several components, with the component of each. The one pair of a list of two has been tried."""
    rooted = posts.join(roots.select("node", "root"), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    split = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo <> hi AND size > 2").select("key", "size")
    return meet(rooted, durable(split), ["key"], "size")


def _cross_pairs(split: DataFrame, first: DataFrame, nodes: DataFrame, best: bool, num: int = LINK_NUM, den: int = LINK_DEN) -> DataFrame:
    """(a, b) across components that agree in enough of the wide sketch. nodes: (node, n_shingles, wide).

    A list longer than BLOCK is met block by block, which copies its rows once
    per block. A list longer than SPLIT is split by the coordinates of its
    members that come later in the order, again and again, so that its rows grow
    with the list and not with its square: of a pair that shares an earlier one,
    that one's list takes care. After DEPTH coordinates a list is met as it is.
    """
    short = split.filter(F.col("size") <= SPLIT)
    keys = short.groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    lists = short.select("key", "node", "root", "size", F.lit(True).alias("plain"))
    if (split.agg(F.max("size")).first()[0] or 0) > SPLIT:
        long = split.filter(F.col("size") > SPLIT).join(first.select("node", "keys"), "node").select("key", "node", "root", (F.array_position("keys", F.col("key")) - 1).alias("at"))
        for depth in range(2, DEPTH + 1):
            later = long.join(first.select("node", F.posexplode("keys").alias("pos", "next")), "node").filter("pos > at")
            made = later.select(F.xxhash64("key", "next").alias("key"), "node", "root", F.col("pos").alias("at"))
            held = made.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo <> hi").select("key", "size")
            rooted = durable(meet(made, durable(held), ["key"], "size"))
            done = rooted if depth == DEPTH else rooted.filter(F.col("size") <= SPLIT)
            lists = lists.unionByName(done.select("key", "node", "root", "size", F.lit(False).alias("plain")))
            long = rooted.filter(F.col("size") > SPLIT).drop("size")
            if depth == DEPTH or long.isEmpty():
                break
    rows = lists.join(nodes.join(keys, "node", "left"), "node").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "root", "n_shingles", "keys", "plain", "wide")
    return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInPandas(_across(best, num, den), "a long, b long").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles (counted by 64-bit hashes), component_id, kept.

    Texts link when 100 * intersection >= 75 * union of their sets of distinct
    5-word shingles (A-Z lower-cased). component_id is the smallest doc_id
    reachable over links; kept marks the document of that id. Null or wordless
    texts link with nothing and keep themselves. A row without doc_id cannot
    name a component: its component_id is null, it links nothing and is kept.
    Rows repeating a doc_id are one document; an empty table gives no rows.
    """
    every = durable(sketches(docs, id_col, text_col))
    made = every.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = durable(made.groupBy("n_shingles", "seq_key").agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("times")))
    first = durable(prefixes(classes))
    posts = durable(_posted(first))
    body = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("body"))
    bodies = durable(body.join(posts.select(F.col("node").alias("id")).distinct(), "id", "left_semi"))
    tried = durable(_leader_pairs(posts))
    links = durable(confirm(tried, bodies))
    roots = components(links)
    split = durable(_still_split(posts, roots))
    if not split.isEmpty():
        some = split.select(F.col("node").alias("id")).distinct()
        wide = bodies.join(some, "id", "left_semi").mapInArrow(_wide(SHINGLE), "node long, wide binary")
        nodes = durable(wide.join(classes.groupBy("node").agg(F.max("n_shingles").alias("n_shingles")), "node"))
        # First the likeliest partner of each member, which links most of what can be linked; then all that is left.
        for best in (True, False):
            pairs = durable(_cross_pairs(split, first, nodes, best).join(tried, ["a", "b"], "left_anti"))
            links = durable(links.unionByName(confirm(pairs, bodies)))
            roots = components(links)
            if best:
                tried, split = tried.unionByName(pairs), durable(_still_split(posts, roots))
    # Members of a class are linked to its node; a document repeated under one id joins its classes.
    ties = meet(made.select("doc_id", "n_shingles", "seq_key"), classes.select("n_shingles", "seq_key", "node", "times"), ["n_shingles", "seq_key"]).select(F.col("doc_id").alias("u"), F.col("node").alias("v")).filter("u <> v")
    grouped = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(ties))
    out = every.select("doc_id", "n_shingles").join(grouped.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left")
    component = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group stays: its smallest doc_id. All columns are returned; rows without doc_id stay."""
    gone = near_groups(docs, id_col, text_col).filter("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(id_col).alias("__id"))
    return rows.join(gone, F.col("__id") == F.col("__gone"), "left_anti").select("__row.*")
