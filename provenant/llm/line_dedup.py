"""Line dedup over content-defined chunks of lines.

A hash rolls over the hashes of neighbouring lines; where its low bits are zero a
chunk ends. What stands elsewhere in a text moves no boundary, so a passage that
is shifted is cut as before, but for its edges. Chunks of several lines that
occur more than once in the corpus are compared byte by byte, and every
occurrence but the first goes whole.

Then the matches are carried over the edges of the chunks: each pair of lines that
stands on both sides of a boundary is looked up, and each pair inside the first
occurrence of a chunk. Copies of chunks are not looked into again, so what is
repeated most costs least. Together they remove exactly the lines that stand in
a repeated run of two lines or more, wherever the boundaries fall.

Only digests are shuffled for all chunks; contents are read for the repeated ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.textops import durable, hashed, meet, mix, numbered

#: Lines that the rolling hash spans; one in 2**BITS of its values ends a chunk, and a chunk of MOST lines ends in any case.
WINDOW, BITS, MOST = 2, 2, 64


def chunks(lines: list[bytes]) -> list[tuple[int, int]]:
    """(first line, number of lines) of each chunk."""
    h, rolled = hashed(lines), np.zeros(len(lines), dtype=np.uint64)
    for back in range(min(WINDOW, len(lines))):
        rolled[back:] += h[: len(h) - back] << np.uint64(back)
    ends = np.flatnonzero((mix(rolled) & np.uint64((1 << BITS) - 1)) == 0) + 1
    out, start = [], 0
    for end in [*ends.tolist(), len(lines)]:
        while end > start:
            n = min(MOST, end - start)
            out.append((start, n))
            start += n
    return out


def _digest(lines: list[bytes]) -> bytes:
    return hashlib.blake2b(b"\n".join(lines), digest_size=16).digest()


_CUT = pa.schema([("doc_id", pa.int64()), ("ord", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("digest", pa.binary()), ("pairs", pa.list_(pa.binary())), ("edge", pa.binary())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with their digest, those of the pairs of lines inside, and that of the pair across their end."""
    for batch in batches:
        rows = []
        for doc, nth, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ord", "text")), strict=True):
            lines = text.encode().split(b"\n")
            pairs = [_digest(lines[i : i + 2]) for i in range(len(lines) - 1)]
            for start, n in chunks(lines):
                end = start + n
                rows.append((doc, nth, start, n, _digest(lines[start:end]), pairs[start : end - 1], pairs[end - 1] if end < len(lines) else None))
        columns = list(zip(*rows, strict=True)) or [[]] * len(_CUT)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CUT, strict=True)], schema=_CUT)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            lines = text.split("\n")
            rows += [(s["digest"], "\n".join(lines[s["start"] : s["start"] + s["n"]])) for s in spans]
        columns = list(zip(*rows, strict=True)) or [[]] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.string()), strict=True)], names=["digest", "body"])


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, gone, kept = [], [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            lines = text.split("\n") if text else []
            out = {i for s in spans or [] for i in range(s["start"], s["start"] + s["n"])}
            n.append(len(lines))
            gone.append(len(out))
            kept.append("\n".join(line for i, line in enumerate(lines) if i not in out))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_removed", "kept"])


def _hits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The occurrences (doc_id, ord, start, n, digest) of what is repeated, and whether each is another than the first."""
    return meet(rows, found, ["digest"]).select("doc_id", "ord", "start", "n", "digest", (F.struct("doc_id", "ord", "start") != F.col("at")).alias("again"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, kept (the text left).

    A line goes when it and a neighbour were seen before in this order, by
    doc_id and then line; the first occurrence of every line stays. A line
    repeated in a row stays once. A text of one line has no chunk. Null and
    empty texts have no lines. Rows without doc_id are returned whole. Rows that
    repeat a doc_id with another text are documents of their own, in the order
    of a digest of their text; rows equal in both are one document and fare
    alike. An empty table gives no rows; other columns play no part. Contents
    that share a digest without being equal byte by byte all stay.
    """
    rows = numbered(docs, id_col, text_col)
    several = rows.filter("doc_id IS NOT NULL AND instr(text, '\n') > 0")
    cut = several.mapInArrow(_cut, "doc_id long, ord long, start int, n int, digest binary, pairs array<binary>, edge binary")
    place = F.struct("doc_id", "ord", "start")
    first = durable(cut.groupBy("digest").agg(F.count(F.lit(1)).alias("times"), F.max("n").alias("n"), F.min(F.struct("doc_id", "ord", "start", "pairs")).alias("first")))
    copied = first.filter("times > 1 AND n > 1").select("digest", "times", F.struct("first.doc_id", "first.ord", "first.start").alias("at"))
    whole = _hits(cut.filter("n > 1").select("doc_id", "ord", "start", "n", "digest"), copied)
    inner = first.select("first.doc_id", "first.ord", "first.start", F.posexplode("first.pairs").alias("k", "digest")).select("doc_id", "ord", (F.col("start") + F.col("k")).alias("start"), "digest")
    edges = cut.filter("edge IS NOT NULL").select("doc_id", "ord", (F.col("start") + F.col("n") - 1).alias("start"), F.col("edge").alias("digest"))
    pairs = inner.unionByName(edges).withColumn("n", F.lit(2))
    twice = durable(pairs.groupBy("digest").agg(F.count(F.lit(1)).alias("times"), F.min(place).alias("at")).filter("times > 1"))
    hits = durable(whole.unionByName(_hits(pairs, twice)))
    spans = hits.groupBy("doc_id", "ord").agg(F.collect_set(F.struct("start", "n", "digest")).alias("spans"))
    contents = several.join(spans, ["doc_id", "ord"]).select("text", "spans").mapInArrow(_contents, "digest binary, body string")
    mixed = durable(contents.groupBy("digest").agg(F.min("body").alias("low"), F.max("body").alias("high")).filter("low <> high").select("digest"))
    gone = hits.filter("again").join(mixed, "digest", "left_anti").groupBy("doc_id", "ord").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    return rows.join(gone, ["doc_id", "ord"], "left").select("doc_id", "text", "spans").mapInArrow(_drop, "doc_id long, n_lines long, n_removed long, kept string")
