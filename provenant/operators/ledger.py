"""The retry queue with bounded room, titles of unresolved items, repairs carried out on tables, and which incidents to import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUEUE, UNRESOLVED = 500, "title:unresolved"


def enqueue(queue: DataFrame, failures: DataFrame, room: int = QUEUE) -> tuple[DataFrame, DataFrame]:
    """(queue, refused) after failures (url, failed) are added to queue (url, attempts, first_failed, last_failed).

    An entry that is queued counts on, however full the queue is. New entries
    fill what room is left, oldest failure first and by url where these are
    equal; those beyond it are refused and returned with their counts. Rows
    with a null url are neither. Of a queue that is over its room nothing is dropped.
    """
    new = failures.filter("url IS NOT NULL").groupBy("url").agg(F.count(F.lit(1)).alias("attempts"), F.min("failed").alias("first_failed"), F.max("failed").alias("last_failed"))
    was = queue.select("url", F.col("attempts").cast("long").alias("attempts"), "first_failed", "last_failed", F.lit(True).alias("was"))
    both = was.unionByName(new.withColumn("was", F.lit(False)))
    merged = both.groupBy("url").agg(F.sum("attempts").alias("attempts"), F.min("first_failed").alias("first_failed"), F.max("last_failed").alias("last_failed"), F.max("was").alias("was"))
    held, fresh = merged.filter("was").drop("was"), merged.filter("NOT was").drop("was")
    # At most room rows are numbered, and met with one number.
    first = fresh.orderBy("first_failed", "url").limit(room).select("url", F.row_number().over(Window.orderBy("first_failed", "url")).alias("nth"))
    free = held.agg(F.greatest(F.lit(room) - F.count(F.lit(1)), F.lit(0)).alias("free"))
    fits = first.join(F.broadcast(free), F.col("nth") <= F.col("free")).select("url")
    return held.unionByName(fresh.join(fits, "url", "left_semi")), fresh.join(fits, "url", "left_anti")


def real_title(title: Column, url: Column) -> Column:
    """Whether a title says more than the address: not blank, and not the address with or without its scheme or closing slash."""
    plain = lambda c: F.lower(F.regexp_replace(F.regexp_replace(F.trim(c), "^[A-Za-z]+://", ""), "/+$", ""))
    return F.coalesce((F.trim(title) != "") & (plain(title) != plain(url)), F.lit(False))


def backfill(items: DataFrame, titles: DataFrame) -> DataFrame:
    """(key, title, tags, action) of the items (key, url, title, tags) that wait for a title; titles (url, title) were fetched since.

    cleared: the stored title is real already, so only the tag goes; resolved:
    a fetched title is real and takes its place, and the tag goes; waiting:
    neither. The tag is a claim, the title the evidence.
    """
    fetched = titles.groupBy("url").agg(F.max(F.when(real_title(F.col("title"), F.col("url")), F.col("title"))).alias("fetched"))
    open_ = items.filter(F.array_contains("tags", UNRESOLVED)).join(fetched, "url", "left")
    action = F.when(real_title(F.col("title"), F.col("url")), "cleared").when(F.col("fetched").isNotNull(), "resolved").otherwise("waiting")
    marked = open_.withColumn("action", action)
    title = F.when(F.col("action") == "resolved", F.col("fetched")).otherwise(F.col("title"))
    tags = F.when(F.col("action") == "waiting", F.col("tags")).otherwise(F.array_remove("tags", UNRESOLVED))
    return marked.select("key", title.alias("title"), tags.alias("tags"), "action")


def _under(rows: DataFrame, plan: DataFrame) -> DataFrame:
    steps = plan.filter("action IN ('rewrite', 'merge')").select("url", "corrected").dropDuplicates(["url"])
    return rows.join(steps, "url", "left").withColumn("url", F.coalesce("corrected", "url")).drop("corrected")


def moved_tags(tags: DataFrame, plan: DataFrame) -> DataFrame:
    """Tags (url, tag) after a repair by plan (url, corrected, action): under the corrected address, each tag once."""
    return _under(tags.select("url", "tag"), plan).distinct()


def moved_claims(links: DataFrame, plan: DataFrame) -> DataFrame:
    """Claim links (url, claim, first_seen, last_seen, times_seen) after a repair: links that meet under one address are added up."""
    return _under(links, plan).groupBy("url", "claim").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("times_seen").alias("times_seen"))


def open_roots(found: DataFrame, ledger: DataFrame) -> DataFrame:
    """Incidents (incident_id, root, kind) of roots that have no row in the ledger (root); one without a root is a legacy incident and always passes."""
    known = ledger.filter("root IS NOT NULL").select("root").distinct()
    return found.join(known, "root", "left_anti").select("incident_id", "root", "kind")
