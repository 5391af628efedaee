"""Work lists, plans, reconciliation, health and unfinished operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.functions import urls

ABANDON_AT = 5


def _checked(limit: int) -> int:
    """A limit of 0 is one; below that it is a mistake."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    return limit


def needs_hash(index: DataFrame, limit: int, failed: bool = False, only_outcome: str | None = None) -> DataFrame:
    """Rows with an item and no digest, oldest first; a top-k, so no full sort.

    Those whose last attempt failed are left out, unless failed says otherwise;
    with only_outcome, the rows whose last attempt ended so.
    """
    told = F.lit(True) if failed else F.col("last_outcome").isNull() | (F.col("last_outcome") == "ok")
    told = told if only_outcome is None else F.col("last_outcome") == only_outcome
    return index.filter("content_hash IS NULL AND item_key IS NOT NULL").filter(told).orderBy("first_seen", "url").limit(_checked(limit))


def needs_verify(index: DataFrame, limit: int) -> DataFrame:
    return index.filter("content_hash IS NOT NULL").orderBy(F.asc_nulls_first("verified_at"), "url").limit(_checked(limit))


def never_verified(index: DataFrame) -> DataFrame:
    """One row: how many rows with a digest were never held against their page."""
    return index.agg(F.count_if(F.col("content_hash").isNotNull() & F.col("verified_at").isNull()).alias("never_verified"))


def unresolved(items: DataFrame, hosts: tuple[str, ...] = ()) -> DataFrame:
    """(key, url) of the items (key, url, tags) whose title is unresolved; with hosts, of these hosts only."""
    found = items.filter(F.array_contains("tags", "title:unresolved"))
    return (found.filter(urls.host(F.col("url")).isin(*hosts)) if hosts else found).select("key", "url")


def corrected(url: Column) -> Column:
    """The address without terminal codes, closing emphasis, characters no address ends in, and closing brackets that it never opened.

    Brackets that it opened stay, and so do templates. What nothing was cut
    from comes back as it was, canonical or not.
    """
    bare = F.regexp_replace(urls.strip_ansi(url), r"\*\*+$", "")
    tail = F.when(bare.rlike("[{}]"), bare).otherwise(F.regexp_replace(bare, r"[^A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%\u0080-\x{10FFFF}-]+$", ""))
    excess = F.length(F.replace(tail, F.lit("("), F.lit(""))) - F.length(F.replace(tail, F.lit(")"), F.lit("")))
    out = F.when(excess > 0, F.regexp_replace(tail, F.concat(F.lit(r"(?:\)[.,;:]*){1,"), excess, F.lit("}$")), F.lit(""))).otherwise(tail)
    return F.when(out == url, url).otherwise(urls.canonical(out))


def repair_plan(index: DataFrame) -> DataFrame:
    """(url, corrected, action): a damaged address is rewritten, merged into a known row, or left with a reason."""
    plan = index.select("url", corrected(F.col("url")).alias("corrected"))
    known = index.select(F.col("url").alias("corrected"), F.lit(True).alias("known")).distinct()
    action = F.when(F.col("corrected") == F.col("url"), "keep").when(F.col("url").rlike(r"[{}*]") & F.col("corrected").rlike(r"[{}*]"), "skip_template").when(F.col("known"), "merge").otherwise("rewrite")
    return plan.join(known, "corrected", "left").select("url", "corrected", action.alias("action"))


def repair_steps(index: DataFrame, items: DataFrame) -> DataFrame:
    """repair_plan against the library: a merge whose surviving row has no live item (key, deleted) is refused and changes nothing."""
    plan = repair_plan(index)
    live = items.filter("NOT coalesce(deleted, false)").select(F.col("key").alias("item_key"))
    kept = index.join(live, "item_key", "left_semi").select(F.col("url").alias("corrected"), F.lit(True).alias("live")).distinct()
    action = F.when((F.col("action") == "merge") & F.col("live").isNull(), "refused_no_survivor").otherwise(F.col("action"))
    return plan.join(kept, "corrected", "left").select("url", "corrected", action.alias("action"))


def merge_rows(index: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows under their corrected address: earliest first, latest last, and how many were merged. Their tags are reports.merged_tags' to unite."""
    moved = index.join(plan, "url").withColumn("url", F.when(F.col("action").isin("rewrite", "merge"), F.col("corrected")).otherwise(F.col("url")))
    return moved.groupBy("url").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.count(F.lit(1)).alias("merged"))


def reconcile(index: DataFrame, items: DataFrame) -> DataFrame:
    """(bucket, n) over index rows and live items, both directions; every row and item is in exactly one bucket.

    index (url, item_key, pending_key), items (key, url). An item that no row
    names is a duplicate where its URL is indexed, pending where a claim names
    it, and else stranded.
    """
    left = index.filter("item_key IS NOT NULL").select(F.col("item_key").alias("key"), F.col("url").alias("row_url"))
    both = left.join(items.select("key", F.col("url").alias("item_url")), "key", "full")
    indexed = index.select(F.col("url").alias("item_url"), F.lit(True).alias("indexed")).distinct()
    claimed = index.filter("pending_key IS NOT NULL").select(F.col("pending_key").alias("key"), F.lit(True).alias("claimed")).distinct()
    marked = both.join(indexed, "item_url", "left").join(claimed, "key", "left")
    bucket = F.when(F.col("item_url").isNull(), "row_item_missing").when(F.col("row_url") == F.col("item_url"), "ok").when(F.col("row_url").isNotNull(), "url_disagreement").when(F.col("claimed"), "orphan_pending_claim").when(F.col("indexed"), "orphan_duplicate").otherwise("orphan_stranded")
    return marked.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def drain(queue: DataFrame) -> DataFrame:
    """(url, attempts, action): abandon at five failures, else replay."""
    return queue.groupBy("url").agg(F.count(F.lit(1)).alias("attempts"), F.min("failed").alias("first_failed")).withColumn("action", F.when(F.col("attempts") >= ABANDON_AT, "abandon").otherwise("replay"))


def health(log: DataFrame) -> DataFrame:
    """log (src, seq, value) of JSON lines to counts per source: one bad line blinds nothing.

    tail counts unparseable lines after the last good one.
    """
    got = log.select("src", "seq", F.from_json("value", "ts long, urls_new int, refused_kind string").alias("r"))
    good = F.col("r.ts").isNotNull()
    base = got.groupBy("src").agg(F.count(F.lit(1)).alias("lines"), F.count_if(good).alias("records"), F.count_if(good & F.col("r.refused_kind").isNotNull()).alias("refused"), F.max(F.when(F.col("r.refused_kind").isNotNull(), F.col("r.ts"))).alias("last_refused"), F.array_join(F.array_sort(F.collect_set("r.refused_kind")), ",").alias("kinds"), F.max(F.when(good, F.col("seq"))).alias("last_good"), F.max("seq").alias("last_seq"))
    return base.select("src", "lines", "records", (F.col("lines") - F.col("records")).alias("unparseable"), "refused", "last_refused", "kinds", (F.col("last_seq") - F.col("last_good")).alias("tail"))


def unfinished(starts: DataFrame, steps: DataFrame, ends: DataFrame) -> DataFrame:
    """Operations without an end: their number of steps and the last target, of ties the largest."""
    done = steps.groupBy("op_id").agg(F.count(F.lit(1)).alias("steps"), F.max(F.struct("seq", "target"))["target"].alias("last_target"))
    return starts.select("op_id").join(ends.select("op_id"), "op_id", "left_anti").join(done, "op_id", "left").select("op_id", F.coalesce("steps", F.lit(0)).alias("steps"), "last_target")


def newest_unfinished(starts: DataFrame, steps: DataFrame, ends: DataFrame, limit: int) -> DataFrame:
    """(op_id, started, steps, last_target) of the operations without an end, those last begun first. starts (op_id, started)."""
    begun = starts.groupBy("op_id").agg(F.min("started").alias("started"))
    return unfinished(begun, steps, ends).join(begun, "op_id").select("op_id", "started", "steps", "last_target").orderBy(F.desc("started"), "op_id").limit(_checked(limit))
