"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same expected number of copies, its
source's target over its source's size. The integral part is certain. The
fractional parts meet in pairs: mass, in words, moves at random from one
document of a pair to the other until one of them is integral, so the expected
copies of each and the words of both together are kept. What is still fractional
in a leaf goes up a reduction tree and meets the rest of other leaves, until one
document of each source is left, which is rounded to the nearer whole.

Leaves hold about LEAF documents chosen by hash; a source of any size is spread
over as many leaves as it needs, and no leaf or node holds more than a few
thousand rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenant.llm.textops import WORD, durable, row_hash

WEIGHTS, SHARE, CAP, LEAF = (5, 2, 1), 1.5, 2.0, 1024
_SALTS = 16


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, n_docs) with source_no and target: the capped shares of a water-filling.

    With the sources in order of ``cap * size / weight``, the level that spends
    the whole share is the greatest of the levels that leave off each prefix.
    The table has one row for each source, whatever the number of documents.
    """
    order, everything = Window.orderBy("full_at", "source_no"), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbered = sizes.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    weighed = numbered.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("source_no") - 1) % len(weights) + 1).cast("int")).cast("double"))
    weighed = weighed.withColumn("full_at", cap * F.col("source_size") / F.col("weight"))
    before = F.coalesce(F.sum(cap * F.col("source_size")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (share * F.sum("source_size").over(everything) - before) / left
    levelled = weighed.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return levelled.select("source", "source_no", "source_size", "n_docs", F.least(cap * F.col("source_size"), F.col("level") * F.col("weight")).alias("target"))


def pivot(fraction: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Settle fractions in the given order until at most one is not 0 or 1; the sum of fraction * size stays."""
    fraction, held = fraction.copy(), -1
    draws = rng.random(len(fraction))
    for i in range(len(fraction)):
        if not 0.0 < fraction[i] < 1.0:
            continue
        if held < 0:
            held = i
            continue
        a, b, wa, wb = fraction[held], fraction[i], float(size[held]), float(size[i])
        to_a, a_fills = min((1 - a) * wa, b * wb), (1 - a) * wa <= b * wb
        to_b, b_fills = min(a * wa, (1 - b) * wb), (1 - b) * wb <= a * wa
        if draws[i] * (to_a + to_b) < to_b:
            a, b = (1.0 if a_fills else a + to_a / wa), (b - to_a / wb if a_fills else 0.0)
        else:
            a, b = (a - to_b / wa if b_fills else 0.0), (1.0 if b_fills else b + to_b / wb)
        # A remainder within rounding error of a whole is that whole.
        a, b = (round(x) if min(x, 1 - x) < 1e-12 else x for x in (a, b))
        fraction[held], fraction[i] = a, b
        held = held if 0.0 < a < 1.0 else i if 0.0 < b < 1.0 else -1
    return fraction


def _settle(level: int, last: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id", "copies"], ascending=[False, True, True], kind="stable")
        seed = int.from_bytes(hashlib.blake2b(repr((level, *map(int, key))).encode(), digest_size=8).digest(), "big")
        part = pivot(rows["part"].to_numpy(), rows["size"].to_numpy(), np.random.default_rng(seed))
        return rows.assign(part=np.rint(part) if last else part)

    return run


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken.

    size counts words (null: 0); documents without words take no copies. Sources
    are weighed in code-point order, null last. Rows with equal id, source and
    size are interchangeable, a null id among them. Reruns agree.
    """
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    sized = durable(sized)
    by_source = durable(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), weights, share, cap))
    most = by_source.agg(F.max("n_docs")).first()[0] or 0
    salted = by_source.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))).withColumnRenamed("source", "its_source")
    spread = sized.withColumn("salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(_SALTS)).cast("int"))
    given = spread.join(salted, spread["salt"].eqNullSafe(salted["salt"]) & spread["source"].eqNullSafe(salted["its_source"])).drop(salted["salt"])
    rate = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    leaf = F.pmod(F.xxhash64(F.lit(1), "doc_id", "size"), F.ceil(F.col("n_docs") / LEAF))
    given = given.select("doc_id", "source", "size", "source_size", "target", "source_no", leaf.cast("long").alias("leaf"), F.floor(rate).cast("long").alias("copies"), (rate - F.floor(rate)).alias("part"))
    schema, level, leaves, done = given.schema, 0, -(-most // LEAF), None
    while True:
        last = leaves <= 1
        settled = durable(given.groupBy("source_no", "leaf").applyInPandas(_settle(level, last), schema))
        whole = settled.filter("part = 0 OR part = 1")
        done = whole if done is None else done.unionByName(whole)
        if last:
            break
        given = settled.filter("part > 0 AND part < 1").withColumn("leaf", F.floor(F.col("leaf") / LEAF))
        level, leaves = level + 1, -(-leaves // LEAF)
    copies = (F.col("copies") + F.col("part")).cast("long")
    return done.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each document as often as it is taken, all its columns and copy_no from 1 (copy_no_ where that name is taken)."""
    nth = lambda df, by: df.withColumn("nth", F.row_number().over(Window.partitionBy("__id", "__source", "__size").orderBy(by)))
    rows = nth(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(id_col).cast("long").alias("__id"), F.col(source_col).cast("string").alias("__source"), word_count(F.col(text_col)).alias("__size"), row_hash(docs).alias("__hash")), "__hash")
    taken = nth(mix(docs, id_col, text_col, source_col).select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), "copies"), "copies")
    same = [rows[c].eqNullSafe(taken[c]) for c in ("__id", "__source", "__size", "nth")]
    name = "copy_no"
    while name in docs.columns:
        name += "_"
    return rows.join(taken, same).filter("copies > 0").select(rows["__row"], F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(name)).select("__row.*", name)
