"""Words, hashes and shingle sets shared by the text operators.

A word is a maximal run of bytes other than space and 0x09-0x0D, which on UTF-8
is the same as ``[^\\x20\\x09-\\x0D]+`` on characters. Hashes are 64 bit and
depend on content only, so that every executor and every rerun agrees. They
find candidates; equality is decided on words or on 128-bit BLAKE2b digests.
"""

from __future__ import annotations

import os
from hashlib import blake2b

import numpy as np
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

WORD = r"[^\x20\x09-\x0D]+"
_STEP = 0xC2B2AE3D27D4EB4F
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; the table grows by doubling."""
    table = _powers.get(base)
    if table is None or len(table) <= n:
        size = max(1024, 1 << (n + 1).bit_length())
        table = np.full(size, base, dtype=np.uint64)
        table[0] = 1
        table = np.multiply.accumulate(table)
        _powers[base] = table
    return table[: n + 1]


_BACK = pow(_STEP, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed(words: list[bytes]) -> np.ndarray:
    """One 64-bit hash per word: it finds candidates and places, and never alone decides that words are equal."""
    return np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def word_hashes(data: bytes) -> np.ndarray:
    """One 64-bit hash per word of UTF-8 text."""
    return hashed(data.split())


class Rolling:
    """Hashes of any run of consecutive words of one document, to find candidates with."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        self.total = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(words * powers(_STEP, self.n)[:-1], out=self.total[1:])
        self.back = powers(_BACK, self.n)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        start, end = np.asarray(start), np.asarray(end)
        return mix((self.total[end] - self.total[start]) * self.back[start] + (end - start).astype(np.uint64))

    def windows(self, size: int) -> np.ndarray:
        start = np.arange(max(0, self.n - size + 1))
        return self.spans(start, start + size)


def shingle_set(data: bytes | None, size: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes, letters A-Z lower-cased first.

    A shorter text has its whole word sequence as its only shingle; a text
    without words, or null, has none.
    """
    words = word_hashes((data or b"").lower())
    if not len(words):
        return words
    roll = Rolling(words)
    if len(words) < size:
        return roll.spans(np.array([0]), np.array([len(words)]))
    every = np.sort(roll.windows(size))
    return every[np.concatenate(([True], every[1:] != every[:-1]))]


def shingles(data: bytes | None, size: int = 5) -> set[tuple[bytes, ...]]:
    """The same set as true words: what similarity is decided on."""
    words = (data or b"").lower().split()
    return set(zip(*(words[k:] for k in range(size)), strict=False)) if len(words) >= size else {tuple(words)} - {()}


def digest128(data: bytes) -> bytes:
    """A collision-resistant digest of contents."""
    return blake2b(data, digest_size=16).digest()


def stretch_digests(words: list[bytes], start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Two longs for each stretch of size words from start: a digest of its words, joined by one space."""
    at = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1, out=at[1:])
    body, ends = b" ".join(words), at[start + size] - 1
    return np.frombuffer(b"".join([blake2b(body[a:b], digest_size=16).digest() for a, b in zip(at[start].tolist(), ends.tolist(), strict=True)]), dtype=np.int64).reshape(-1, 2)


def numbered(docs, id_col: str, text_col: str):
    """(doc_id, ord, text): ord tells rows of one doc_id apart by their text. It is 0 throughout where no doc_id repeats."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    again = rows.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL")
    told = F.lit(0) if again.isEmpty() else F.conv(F.substring(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), 1, 15), 16, 10)
    return rows.select("doc_id", told.cast("long").alias("ord"), "text")


#: A key with more than 1/HEAVY of the rows, and more than LEAST_HEAVY, is dealt over SPREAD tasks; so fewer than HEAVY keys are.
HEAVY, SPREAD, LEAST_HEAVY = 4096, 256, 2048


def meet(rows, once, keys: list[str], times: str = "times", counts=None, how: str = "inner"):
    """rows joined with once on keys, inner or left; once (or counts, by keys) has a column times that says how many rows a key has.

    No key's rows meet in one task, however frequent the key is: the heavy keys,
    fewer than HEAVY, are broadcast and their rows dealt over SPREAD tasks each.
    """
    told = once if counts is None else counts
    total, most = told.agg(F.sum(times), F.max(times)).first()
    least = max(LEAST_HEAVY, (total or 0) // HEAVY)
    if (most or 0) <= least:
        return rows.join(once, keys, how)
    hot = F.broadcast(told.filter(F.col(times) > least).select(*keys, F.lit(True).alias("__hot")))
    dealt = rows.join(hot, keys, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*[c for c in rows.columns if c not in keys]), F.lit(SPREAD)).cast("int")).otherwise(0)).drop("__hot")
    copied = once.join(hot, keys, "left").withColumn("__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0))))).drop("__hot")
    return dealt.join(copied, [*keys, "__salt"], how).drop("__salt")


def row_hash(df):
    """A number by which rows that are alike in other respects can be told apart the same way on every run."""
    return F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind])


def checkpoint_dir(spark) -> str:
    """The shared folder that the cluster names; a local default only in a local session that names none, as in tests."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or os.path.join(os.getcwd(), "spark-warehouse", "checkpoints"))
    return context.getCheckpointDir()


def durable(df):
    """Cut the lineage through reliable storage that outlives any executor, and let go of the shuffle files behind it."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    checkpoint_dir(spark)
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(key, before)


def first_by_hash(df, column: str, most: int):
    """(h, n, column): at most ``most`` distinct texts, the first by a hash, null left out.

    Keys of 16 bytes are chosen first and joined back (the broadcast side has
    at most ``most`` rows), so that no text but the chosen ones is moved.
    """
    keyed = df.select(F.xxhash64(column).alias("h"), F.length(column).alias("n"), F.col(column)).filter(F.col(column).isNotNull())
    chosen = keyed.select("h", "n").distinct().orderBy("h", "n").limit(most)
    return keyed.join(F.broadcast(chosen), ["h", "n"]).dropDuplicates(["h", "n"])
