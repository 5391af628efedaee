"""Substring dedup by relative Lempel-Ziv parsing over indexed blocks.

Every document is a sequence of words. A reference block is the stretch of words
around one anchor: the windows of WINDOW consecutive words that choose the same
ANCHOR-word phrase, the one with the least hash among the phrases in the window.
Equal windows choose equal phrases at equal places, so a window can only repeat
where its anchor repeats, and all blocks are indexed by their anchor. The
reference of the parse is the first occurrence of every block.

Blocks whose whole content stands earlier match over all their windows. Where
blocks with one anchor differ, a match ends inside them: only there, at factor
boundaries, single windows are looked up. Every match has a source, an earlier
document and place. The parse of a document then joins matches that continue
each other in their source and goes from left to right: each factor is the
longest match that covers the next place, and the next one starts where it ends.
Factors of at least WINDOW words are its duplicate spans; together they are
exactly the windows that also start earlier. Contents are told apart by 128-bit
BLAKE2b digests of their words, never by the hashes that choose anchors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.textops import Rolling, durable, hashed, meet, numbered, stretch_digests

WINDOW, ANCHOR = 20, 6
PLACE = ("doc_id", "ord", "start")
_INDEX = ["doc_id", "ord", "anchor", "c0", "c1", "start", "windows"]


def _least_in_windows(values: np.ndarray, size: int) -> np.ndarray:
    """Index of the leftmost least value of each run of size values, by doubling."""
    best = np.arange(len(values))
    span = 1
    while span < size:
        step = min(span, size - span)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(values[right] < values[left], right, left)
        span += step
    return best


def blocks(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, start, windows) arrays: consecutive windows with the same anchor place, 15 at most."""
    if len(words) < WINDOW:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    phrases = Rolling(hashed(words)).windows(ANCHOR)
    place = _least_in_windows(phrases, WINDOW - ANCHOR + 1)
    start = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    return phrases[place[start]].view(np.int64), start, np.diff(np.append(start, len(place)))


_KINDS = {"start": (np.int32, pa.int32()), "windows": (np.int32, pa.int32())}


def _batch(names: list[str], rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*rows, strict=True)] or [np.zeros(0, dtype=np.int64)] * len(names)
    kinds = [_KINDS.get(n, (np.int64, pa.int64())) for n in names]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(k), t) for c, (k, t) in zip(columns, kinds, strict=True)], names=names)


def _texts(batch: pa.RecordBatch):
    """(doc_id, ord, words) of each row."""
    for doc, nth, body in zip(batch.column("doc_id").to_pylist(), batch.column("ord").to_pylist(), batch.column("body"), strict=True):
        yield doc, nth, (body.as_py() or b"").split()


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, nth, words in _texts(batch):
            anchor, start, windows = blocks(words)
            if len(start):
                c = stretch_digests(words, start, windows + WINDOW - 1)
                rows.append((np.full(len(start), doc), np.full(len(start), nth), anchor, c[:, 0], c[:, 1], start, windows))
        yield _batch(_INDEX, rows)


def _outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document of WINDOW words or more: a digest of all its words, their number, and its anchors."""
    for batch in batches:
        rows, anchors, known = [], [], {}
        for doc, nth, words in _texts(batch):
            if len(words) >= WINDOW:
                c = stretch_digests(words, np.array([0]), len(words))
                rows.append((np.array([doc]), np.array([nth]), c[:, 0], c[:, 1], np.array([len(words)])))
                key = c.tobytes()
                if key not in known:
                    known[key] = blocks(words)[0]
                anchors.append(known[key])
        made = _batch(["doc_id", "ord", "c0", "c1", "n_words"], rows)
        flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, anchors)]), pa.int32()), pa.array(np.concatenate([*anchors, np.zeros(0, np.int64)]), pa.int64()))
        yield made.append_column("anchors", flat)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The single windows of the blocks that start at the given words."""
    for batch in batches:
        rows = []
        for (doc, nth, words), starts in zip(_texts(batch), batch.column("starts").to_pylist(), strict=True):
            _, start, windows = blocks(words)
            pick = np.searchsorted(start, np.unique(starts))
            count = windows[pick]
            at = np.repeat(start[pick] - np.cumsum(count) + count, count) + np.arange(count.sum())
            c = stretch_digests(words, at, WINDOW)
            rows.append((np.full(len(at), doc), np.full(len(at), nth), c[:, 0], c[:, 1], at))
        yield _batch(["doc_id", "ord", "c0", "c1", "start"], rows)


def parse(matches: list[tuple[int, ...]]) -> list[tuple[int, int, int, int, int]]:
    """Greedy factors (start, words, source doc, source ord, source start) from matches (start, windows, source doc, source ord, source start).

    Matches that continue each other in one source are one match. Of those that
    cover the next place the one that reaches furthest is the factor; of equal
    ones the earliest source.
    """
    joined: list[list] = []
    for diagonal, start, n in sorted(((doc, nth, src - start), start, n) for start, n, doc, nth, src in matches):
        if joined and joined[-1][0] == diagonal and start <= joined[-1][2]:
            joined[-1][2] = max(joined[-1][2], start + n)
        else:
            joined.append([diagonal, start, start + n])
    joined.sort(key=lambda m: (m[1], m[0]))
    out, at, i, best = [], 0, 0, None
    while i < len(joined) or (best and best[2] > at):
        while i < len(joined) and joined[i][1] <= at:
            best = joined[i] if best is None or joined[i][2] > best[2] else best
            i += 1
        if best is None or best[2] <= at:
            if i < len(joined):
                at = joined[i][1]
            continue
        (doc, nth, shift), end = best[0], best[2]
        out.append((at, end - at + WINDOW - 1, doc, nth, at + shift))
        at = end
    return out


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [parse(list(zip(*[iter(m)] * 5, strict=True))) for m in batch.column("matches").to_pylist()]
        flat = [tuple(zip(*f, strict=True)) or ((),) * 5 for f in found]
        names = ("start", "words", "source_id", "source_ord", "source_start")
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ord"), *(pa.array([f[k] for f in flat], pa.list_(pa.int64())) for k in range(5))], names=["doc_id", "ord", *names])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the words of the factors: counts and the text that is left."""
    for batch in batches:
        n, gone, left = [], [], []
        for body, starts, sizes in zip(batch.column("body"), batch.column("start").to_pylist(), batch.column("words").to_pylist(), strict=True):
            words = (body.as_py() or b"").split()
            n.append(len(words))
            kept, at = [], 0
            for start, size in zip(starts or [], sizes or [], strict=True):
                kept += words[at : max(at, start)]
                at = max(at, start + size)
            kept += words[at:]
            gone.append(n[-1] - len(kept))
            left.append(b" ".join(kept).decode())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(left, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def _bodies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return numbered(docs, id_col, text_col).select("doc_id", "ord", F.col("text").cast("binary").alias("body"))


_FACTORS = "doc_id long, ord long, start array<long>, words array<long>, source_id array<long>, source_ord array<long>, source_start array<long>"


def _factors(body: DataFrame) -> DataFrame:
    docs = body.filter("doc_id IS NOT NULL")
    if not docs.filter("ord <> 0").select("ord").isEmpty():
        docs = docs.dropDuplicates(["doc_id", "ord"])
    place, source = F.struct(*PLACE), lambda *more: F.array(*(F.col(c).cast("long") for c in ("start", "windows", "at.doc_id", "at.ord", *more)))
    # A document that an earlier one equals word for word is one factor, and its blocks are no references.
    outline = durable(docs.mapInArrow(_outline, "doc_id long, ord long, c0 long, c1 long, n_words long, anchors array<long>"))
    same = durable(outline.groupBy("c0", "c1", "n_words").agg(F.min(F.struct("doc_id", "ord")).alias("at"), F.count(F.lit(1)).alias("times")).filter("times > 1"))
    copies = durable(meet(outline.drop("anchors"), same, ["c0", "c1", "n_words"]).filter("struct(doc_id, ord) <> at").select("doc_id", "ord", F.lit(0).alias("start"), (F.col("n_words") - WINDOW + 1).alias("windows"), "at"))
    gone = copies.select("doc_id", "ord")
    anchors = outline.join(gone, ["doc_id", "ord"], "left_anti").select(F.explode("anchors").alias("anchor"))
    repeated = durable(anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).filter("times > 1"))
    docs = docs.join(gone, ["doc_id", "ord"], "left_anti")
    indexed = docs.mapInArrow(_index, "doc_id long, ord long, anchor long, c0 long, c1 long, start int, windows int")
    found = durable(meet(indexed, repeated, ["anchor"]).drop("times"))
    contents = durable(found.groupBy("anchor", "c0", "c1").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("times")))
    later = meet(found, contents.filter("times > 1"), ["anchor", "c0", "c1"]).filter(place != F.col("at"))
    # Factor boundaries: contents that differ around one anchor, each at its first place.
    mixed = durable(contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"))
    edges = meet(contents.select("anchor", "at"), mixed, ["anchor"], "kinds").groupBy("at.doc_id", "at.ord").agg(F.collect_list("at.start").alias("starts"))
    single = durable(docs.join(edges, ["doc_id", "ord"]).select("doc_id", "ord", "body", "starts").mapInArrow(_windows, "doc_id long, ord long, c0 long, c1 long, start int"))
    seen = durable(single.groupBy("c0", "c1").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("times")).filter("times > 1"))
    again = meet(single, seen, ["c0", "c1"]).filter(place != F.col("at")).withColumn("windows", F.lit(1))
    matches = copies.select("doc_id", "ord", F.concat(source(), F.array(F.lit(0).cast("long"))).alias("match"))
    for part in (later, again):
        matches = matches.unionByName(part.select("doc_id", "ord", source("at.start").alias("match")))
    return matches.groupBy("doc_id", "ord").agg(F.flatten(F.collect_list("match")).alias("matches")).mapInArrow(_parsed, _FACTORS)


def factors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The parse: (doc_id, start, words, source_id, source_start), one row per factor of WINDOW words or more; words count from 0."""
    found = _factors(_bodies(docs, id_col, text_col)).select("doc_id", F.explode(F.arrays_zip("start", "words", "source_id", "source_start")).alias("f"))
    return found.select("doc_id", "f.*")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept (the words left, joined by one space).

    A word goes when a window of 20 consecutive words that covers it also starts
    earlier: in a smaller doc_id, or in the same document before. Null texts have
    no words; texts of fewer than 20 words lose none. Rows without a doc_id are
    returned whole and are no reference. Rows that repeat a doc_id with another
    text are documents of their own, in the order of a digest of their text;
    rows equal in both are one document and fare alike. An empty table gives no
    rows; other columns play no part.
    """
    body = _bodies(docs, id_col, text_col)
    return body.join(_factors(body).select("doc_id", "ord", "start", "words"), ["doc_id", "ord"], "left").select("doc_id", "body", "start", "words").mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept string")
