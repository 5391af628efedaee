"""Source history by run: new, persisting, recurring and dropped sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def buckets(sightings: DataFrame, triaged: DataFrame, run: str) -> DataFrame:
    """(url, prior, today, triaged, bucket). sightings: (url, seen date); triaged: distinct (url). Buckets exclude each other."""
    day = F.lit(run).cast("date")
    seen = sightings.groupBy("url").agg(F.count_distinct(F.when(F.col("seen") < day, F.col("seen"))).alias("prior"), F.max(F.when(F.col("seen") == day, 1).otherwise(0)).alias("today"))
    marked = seen.join(triaged.select("url", F.lit(1).alias("t")), "url", "left").withColumn("triaged", F.coalesce("t", F.lit(0))).drop("t")
    today = F.col("today") == 1
    bucket = F.when(today & (F.col("prior") >= 2), F.when(F.col("triaged") == 1, "recurring_triaged").otherwise("recurring_untriaged")).when(today & (F.col("prior") == 1), "persisting").when(today, "new").when(F.col("prior") >= 1, "dropped")
    return marked.withColumn("bucket", bucket)


def spans(sightings: DataFrame, run: str, since: int | None = None) -> DataFrame:
    """(url, prior, first, last, span_days) of the history before a run, of the URLs seen in the since days before it or on it; all of them without since."""
    day = F.lit(run).cast("date")
    before = F.when(F.col("seen") < day, F.col("seen"))
    rolled = sightings.groupBy("url").agg(F.count_distinct(before).alias("prior"), F.min(before).alias("first"), F.max(before).alias("last"), F.max("seen").alias("newest"))
    recent = rolled if since is None else rolled.filter(F.col("newest") >= F.date_sub(day, since))
    return recent.select("url", "prior", "first", "last", F.datediff("last", "first").alias("span_days"))


def earliest(sightings: DataFrame) -> DataFrame:
    """One row: the day of the first sighting, from which a window goes that names no other; null without sightings."""
    return sightings.agg(F.min("seen").alias("earliest"))


def summary(bucketed: DataFrame) -> DataFrame:
    return bucketed.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def triage(known: DataFrame, wanted: DataFrame) -> DataFrame:
    """(url, status): triaged where the URL is known, else unknown_url."""
    return wanted.select("url").distinct().join(known.select("url", F.lit(True).alias("k")).distinct(), "url", "left").select("url", F.when(F.col("k"), "triaged").otherwise("unknown_url").alias("status"))
