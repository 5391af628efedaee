"""How much of what was cited was captured, how two extractors differ, and whether two reads agree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.functions import align

AGREE = 0.90


def coverage(cited: DataFrame, last: DataFrame, index: DataFrame) -> DataFrame:
    """One row: eligible URLs (cited by the last assistant message of a turn), how many the index has, and URLs of earlier messages only.

    cited (session, turn_seq, role, url), last (session, turn_seq), index (url). percent is null where nothing is eligible.
    """
    final = last.select("session", "turn_seq", F.lit(1).alias("final")).distinct()
    per_url = cited.filter("role = 'assistant'").join(final, ["session", "turn_seq"], "left").groupBy("url").agg(F.max(F.coalesce("final", F.lit(0))).alias("final"))
    marked = per_url.join(index.select("url", F.lit(True).alias("known")).distinct(), "url", "left")
    eligible, known = F.col("final") == 1, F.col("known").isNotNull()
    counts = marked.agg(F.count_if(eligible).alias("eligible"), F.count_if(eligible & known).alias("present"), F.count_if(~eligible).alias("mid_only"))
    return counts.withColumn("percent", F.try_divide(F.col("present") * 100.0, F.col("eligible")))


def extraction_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row over messages (msg_id, urls): how many differ, and URLs lost, gained, and lost to a shorter form of themselves."""
    side = lambda df, name: df.select("msg_id", F.col("urls").alias(name))
    both = side(old, "a").join(side(new, "b"), "msg_id", "full").select(*(F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in "ab"))
    diff = both.select(F.array_except("a", "b").alias("old_only"), F.array_except("b", "a").alias("new_only"))
    shorter = F.size(F.filter("old_only", lambda x: F.exists("new_only", lambda y: x.startswith(y))))
    total = lambda c: F.coalesce(F.sum(c).cast("long"), F.lit(0).cast("long"))
    return diff.agg(F.count(F.lit(1)).alias("messages"), F.count_if((F.size("old_only") > 0) | (F.size("new_only") > 0)).alias("changed"), total(F.size("old_only")).alias("lost"), total(F.size("new_only")).alias("gained"), total(shorter).alias("shortened"))


def _aligned(digests: bool):
    """Bytes of each page's first read and of its units that the second has in the same order, and with digests these units', each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = batch.column("one"), batch.column("two")
            held, sizes = one.flatten(), batch.column("sizes").flatten().to_numpy(zero_copy_only=False)
            codes = pa.concat_arrays([held, two.flatten()]).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            ends = [np.cumsum(pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False), dtype=np.int64) for c in (one, two)]
            kept, total, units = [], [], []
            for k in range(batch.num_rows):
                (a, b), (c, d) = (((int(e[k - 1]) if k else 0), int(e[k])) for e in ends)
                met = a + align.places(codes[a:b], codes[len(held) + c : len(held) + d])
                kept.append(int(sizes[met].sum()))
                total.append(int(sizes[a:b].sum()))
                units.append(met[np.unique(codes[met], return_index=True)[1]] if digests else met[:0])
            columns = [batch.column("url"), pa.array(kept, pa.int64()), pa.array(total, pa.int64())]
            if digests:
                offsets = np.concatenate([[0], np.cumsum([len(u) for u in units])])
                columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), held.take(pa.array(np.concatenate([np.arange(0), *units]), pa.int64()))))
            yield pa.RecordBatch.from_arrays(columns, names=["url", "kept", "total", "digests"][: len(columns)])

    return run


def _packed(units: DataFrame) -> DataFrame:
    """units (url, read_no, ord, digest, nbytes) as reads (url, read_no, digests, sizes), one row a read; reads as they are."""
    if "digests" in units.columns:
        return units
    read = units.groupBy("url", "read_no").agg(F.sort_array(F.collect_list(F.struct("ord", "digest", F.col("nbytes").cast("long").alias("nbytes")))).alias("u"))
    return read.select("url", "read_no", F.col("u.digest").alias("digests"), F.col("u.nbytes").alias("sizes"))


def _met(units: DataFrame, digests: bool = False) -> DataFrame:
    """(url, kept, total, and digests if asked) of two reads, aligned as sequences: a unit that moved before or behind others is not joined.

    The alignment is a longest common subsequence of the two reads of one page,
    which come to one row; units are small beside the page that they are cut from.
    """
    one, two = (F.any_value(F.when(F.col("read_no") == k, F.struct("digests", "sizes")), True) for k in (1, 2))
    pairs = _packed(units).groupBy("url").agg(one.alias("a"), two.alias("b"))
    kind = "url string, kept long, total long" + (", digests array<string>" if digests else "")
    return pairs.select("url", F.col("a.digests").alias("one"), F.col("a.sizes").cast("array<long>").alias("sizes"), F.col("b.digests").alias("two")).mapInArrow(_aligned(digests), kind)


def agreed_reads(units: DataFrame, least: float = AGREE) -> DataFrame:
    """(url, digests), each once, of the units that both reads have in the same order, where these hold at least least of the first read's bytes.

    units (url, read_no, ord, digest, nbytes), or whole reads of them, one row
    a read: (url, read_no, digests, sizes), both in the order of the page.
    """
    return _met(units, True).filter((F.col("total") > 0) & (F.col("kept") >= F.col("total") * least)).select("url", F.array_compact("digests").alias("digests"))


def agreed_units(units: DataFrame, least: float = AGREE) -> DataFrame:
    """(url, digest) of agreed_reads, one row a unit."""
    return agreed_reads(units, least).select("url", F.explode("digests").alias("digest"))


def agreed(units: DataFrame, least: float = AGREE) -> DataFrame:
    """(url, kept, total, agreed) of two reads, given as to agreed_reads: the bytes of the first read, and of its units that the second has in the same order.

    agreed is null below least and for an empty first read, for then there is
    no agreed set to compare.
    """
    return _met(units).select("url", "kept", "total", F.when((F.col("total") > 0) & (F.col("kept") >= F.col("total") * least), True).alias("agreed"))
