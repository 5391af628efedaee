"""Hard negatives by Kronecker-packed products.

Vectors are held as whole numbers. A bias makes every component of a block of
candidates at least 0, and the components of several candidates are laid side by
side as fields of one wide integer. One multiplication by a component of an
anchor, biased too, multiplies all the fields; a field is wide enough for the
sum over all components, so that nothing carries into the next one. The summed
integer is cut into its fields again, the biases are taken off, and what is left
are exact inner products.

The wide integer is a double of 53 exact bits, multiplied by BLAS, where two
fields or more fit in (true of vectors of length about 1); else it is a Python
integer of WIDE fields. Every score is exact either way.

Rows are dealt by hash into blocks of candidates and blocks of anchors, and each
pair of blocks meets in one task of bounded size, whatever the labels are. Only
the best few of a block leave it. Positives are found first; the negatives are
then searched within the scores that each positive allows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenant.llm.textops import durable

#: Exact bits of a double; fields of a Python integer; anchors that are scored at once.
EXACT, WIDE, AT_ONCE = 53, 16, 64
#: A block holds 1/SHARE of the rows, within these bounds: small enough for one task, large enough that few copies of the rows are sent.
SHARE, LEAST, MOST = 256, 1024, 65536


def whole(vectors: np.ndarray, scale: float, most: int) -> np.ndarray:
    """floor(scale * x), as int64 where that can hold it, else as Python integers."""
    found = np.floor(scale * vectors.astype(np.float64))
    return found.astype(np.int64) if most < 1 << EXACT else np.array([[int(x) for x in row] for row in found], dtype=object).reshape(found.shape)


class Packed:
    """A block of candidates, several to an integer."""

    def __init__(self, candidates: np.ndarray, most: int):
        """most: no component of a candidate or an anchor is further from 0."""
        self.n, size = candidates.shape
        self.bias, self.width = most, max(1, (size * (2 * most) ** 2).bit_length())
        self.fields, kind = (EXACT // self.width, np.float64) if 2 * self.width <= EXACT else (WIDE, object)
        self.number = object if kind is object else np.int64
        candidates = candidates.astype(self.number)
        self.sums, self.size = candidates.sum(axis=1), size
        lanes = np.zeros((-(-self.n // self.fields) * self.fields, size), dtype=self.number)
        lanes[: self.n] = candidates + most
        lanes = lanes.reshape(len(lanes) // self.fields, self.fields, size)
        places = np.array([1 << self.width * k for k in range(self.fields)], dtype=lanes.dtype)
        self.packs = (lanes * places[None, :, None]).sum(axis=1).astype(kind)

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Inner products, candidates by anchors."""
        anchors = anchors.astype(self.number)
        made = self.packs @ (anchors + self.bias).T.astype(self.packs.dtype)
        made = made if made.dtype == object else made.astype(np.int64)
        out = np.empty((len(made), self.fields, made.shape[1]), dtype=made.dtype)
        for k in range(self.fields):
            out[:, k] = (made >> self.width * k) & ((1 << self.width) - 1)
        out = out.reshape(len(made) * self.fields, made.shape[1])[: self.n]
        return out - self.bias * (self.sums[:, None] + anchors.sum(axis=1)[None, :]) - self.size * self.bias**2


def _scored(cand: pd.DataFrame, anch: pd.DataFrame, scale: float, most: int, same: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of anch, ids, scores) with all candidates of the anchor's label, or of every other label; ids rise."""
    cand = cand.sort_values("id")
    ids, labels = cand["id"].to_numpy(), cand["label"].to_numpy()
    c, a = (whole(np.stack(x["v"].to_numpy()), scale, most) for x in (cand, anch))
    for label, rows in anch.reset_index(drop=True).groupby("label").indices.items():
        chosen = (labels == label) == same
        if not chosen.any():
            continue
        block, names = Packed(c[chosen], most), ids[chosen]
        for k in range(0, len(rows), AT_ONCE):
            part = rows[k : k + AT_ONCE]
            found = block.scores(a[part])
            for j, row in enumerate(part):
                yield row, names, found[:, j]


def _fits(names: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As long; a score beyond that is left out."""
    if scores.dtype == object:
        ok = np.array([abs(x) < 1 << 63 for x in scores], dtype=bool)
        names, scores = names[ok], scores[ok]
    return names, scores.astype(np.int64)


def _best(names: np.ndarray, scores: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The n best of rising ids, highest score first, ties by smaller id."""
    if len(scores) > n:
        least = np.partition(scores, len(scores) - n)[len(scores) - n]
        kept = np.flatnonzero(scores >= least)
        names, scores = names[kept], scores[kept]
    order = np.argsort(-scores, kind="stable")[:n]
    return list(zip(names[order].tolist(), scores[order].tolist(), strict=True))


def _positives(n: int, scale: float, most: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(cand: pd.DataFrame, anch: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(cand) and len(anch):
            own = anch["id"].to_numpy()
            for row, names, scores in _scored(cand, anch, scale, most, same=True):
                others = names != own[row]
                out += [(own[row], *x) for x in _best(*_fits(names[others], scores[others]), n)]
        return pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score"])

    return run


def _negatives(n: int, low: int, high: int, scale: float, most: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(cand: pd.DataFrame, anch: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(cand) and len(anch):
            own, wanted = anch["id"].to_numpy(), anch["positives"].to_numpy()
            for row, names, scores in _scored(cand, anch, scale, most, same=False):
                names, scores = _fits(names, scores)
                for want in wanted[row]:
                    p = int(want["positive_score"])
                    inside = np.flatnonzero((scores >= -(-low * p // 100)) & (scores <= high * p // 100))
                    out += [(own[row], want["positive_id"], p, *x) for x in _best(names[inside], scores[inside], n)]
        return pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return run


def _blocks(n: int) -> int:
    return max(1, -(-n // min(MOST, max(LEAST, n // SHARE))))


def _first(rows: DataFrame, by: list[str], score: str, name: str, n: int) -> DataFrame:
    """The n best rows of each key; Spark keeps no more than n of a key in each task before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), name)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def mine(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    is_anchor is a condition on ``id`` and ``label``. An anchor's positives are
    the ``positives`` best other rows of its label, by score and then smaller
    id. For each, the ``negatives`` best rows of other labels are returned whose
    score lies between low and high percent of the positive's, ends included;
    rank counts from 1. All rows are searched, each pair exactly.

    Rows with a null id, label or vector, or with a null or non-finite (once scaled)
    component, take no part. Of rows that share an id, the least by label and
    vector does. Vectors meet those of the same length only. A score that no
    long can hold is left out. Other columns are not read; an empty table gives
    an empty result, and so do anchors without positives.
    """
    v = F.col(f"`{vector_col}`")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf")))
    valid = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False)))
    once = durable(valid.groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v", F.size("x.v").alias("size")).withColumn("anchor", F.coalesce(is_anchor, F.lit(False))))
    n, n_anchors, reach = once.agg(F.count(F.lit(1)), F.count_if("anchor"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double") * scale))))).first()
    most, blocks, anchor_blocks = int(reach or 0) + 1, _blocks(n), max(1, -(-n_anchors // MOST))
    near = lambda seed, k: F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    keys = ["size", "block", "anchor_block"]
    candidates = once.select("id", "label", "v", "size", near(0, blocks).alias("block"), each(anchor_blocks).alias("anchor_block")).groupBy(*keys)
    anchors = once.filter("anchor").select("id", "label", "v", "size", near(1, anchor_blocks).alias("anchor_block"))
    dealt = lambda df: df.withColumn("block", each(blocks)).select(*(F.col(c).alias(c) for c in [*df.columns, "block"])).groupBy(*keys)
    found = candidates.cogroup(dealt(anchors)).applyInPandas(_positives(positives, scale, most), "anchor_id long, positive_id long, positive_score long")
    chosen = durable(_first(found, ["anchor_id"], "positive_score", "positive_id", positives).drop("rank"))
    wanted = chosen.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    made = candidates.cogroup(dealt(anchors.join(wanted, "id"))).applyInPandas(_negatives(negatives, low, high, scale, most), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    return _first(made, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
