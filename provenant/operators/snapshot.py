"""The snapshot pass: first fingerprints of rows that have none.

A read that failed for a reason of the source is an outcome of its row. One that
failed for a reason of ours says nothing of the source: it is counted as
internal_error and changes no row, so that the next pass tries it again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.operators import content, upkeep
from provenant.streaming.buckets import Buckets

# Errors of a fetch that are facts about its source; a status is one in any case.
FETCH_FAULTS = ("invalid_url", "timeout", "connection", "protocol", "redirects", "decoding")
INTERNAL = "internal_error"


def outcome(status: Column, error: Column) -> Column:
    return F.when(error.isNotNull() & ~error.isin(*FETCH_FAULTS), INTERNAL).when(error.isNull() & status.isNull(), INTERNAL).otherwise(content.outcome(status, error))


def take(index: DataFrame, reads: DataFrame, limit: int) -> DataFrame:
    """(url, outcome, content_hash, hash_bytes, hash_truncated, final_url, content_sketch) of at most limit rows that need a fingerprint and were read.

    index (url, item_key, content_hash, last_outcome, first_seen), reads (url,
    status, error, final_url, body, complete), one row a url. A missing page
    counts as gone only where its address is whole and its parent was seen; the
    parents may be among reads. Rows that nobody has read are left for the next pass.
    """
    due = upkeep.needs_hash(index, limit).select("url")
    judged = reads.withColumn("outcome", outcome(F.col("status"), F.col("error")))
    refined = content.corroborated(judged.select("url", "outcome")).select("url", "refined")
    met = due.join(judged, "url").join(refined, "url")
    body = F.when(F.col("refined") == "ok", F.col("body").cast("binary"))
    rows = met.select("url", F.col("refined").alias("outcome"), body.alias("body"), "final_url", "complete")
    units = content.body_sketches(rows.filter("body IS NOT NULL").select("url", "body")).withColumnRenamed("sketch", "content_sketch")
    found = rows.select("url", "outcome", content.content_hash(F.col("body")).alias("content_hash"), F.octet_length("body").cast("long").alias("hash_bytes"), F.when(F.col("body").isNotNull(), ~F.coalesce("complete", F.lit(True))).alias("hash_truncated"), F.when(F.col("body").isNotNull(), F.col("final_url")).alias("final_url"))
    return found.join(units, "url", "left")


def merged(old: DataFrame, found: DataFrame, at: Column) -> DataFrame:
    """The index after a pass: outcomes of the source are stored, fingerprints only where none is stored."""
    new = found.filter(F.col("outcome") != INTERNAL).select("url", *(F.col(c).alias(f"__{c}") for c in found.columns if c != "url"))
    met = old.join(new, "url", "left")
    came, free = F.col("__outcome").isNotNull(), F.col("content_hash").isNull() & F.col("__content_hash").isNotNull()
    set_ = {c: F.when(free, F.col(f"__{c}")).otherwise(F.col(c)) for c in ("content_hash", "hash_bytes", "hash_truncated", "final_url", "content_sketch")}
    set_ |= {"hashed_at": F.when(free, at).otherwise(F.col("hashed_at")), "content_sketch_algo": F.when(free, content.CONTENT_ALGO).otherwise(F.col("content_sketch_algo"))}
    set_ |= {"last_outcome": F.coalesce("__outcome", "last_outcome"), "last_attempt_at": F.when(came, at).otherwise(F.col("last_attempt_at"))}
    return met.select(*(set_.get(c, F.col(c)).alias(c) for c in old.columns))


def run(index: Buckets, reads: DataFrame, at: Column, limit: int) -> dict[str, int]:
    """One pass over a kept index; returns how many rows have had which outcome.

    All that a pass has found is in the table, or, where it is killed, none of
    it; either way the next pass goes on with the rows that still need one. A
    pass that finds nothing to store writes nothing.
    """
    rows = index.read()
    if rows is None:
        return {}
    found = take(rows, reads, limit).persist()
    try:
        counts = {r["outcome"]: r["count"] for r in found.groupBy("outcome").count().collect()}
        if set(counts) - {INTERNAL}:
            index.merge(index.last_epoch() + 1, found, lambda old, new: merged(old, new, at))
    finally:
        found.unpersist()
    return counts
