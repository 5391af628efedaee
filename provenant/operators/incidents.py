"""Incidents from capture records: judged one record at a time, opened once, closed only by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kind(root: Column, pinned: Column, observation: Column, incident_id: Column, wrote: Column) -> Column:
    """stale or unverified, by the record alone; null for one that wrote nothing, has no identifier or no evidence."""
    named = lambda c: F.coalesce(c != "", F.lit(False))
    can = named(root) & named(incident_id) & F.coalesce(wrote, F.lit(False))
    return F.when(~can, None).when(observation == "unknown", "unverified").when(named(pinned) & (root != pinned), "stale")


def open_incidents(ledger: DataFrame, found: DataFrame) -> DataFrame:
    """ledger (incident_id, kind, status) with the incidents of found (incident_id, kind) that it never had, in any status: replays reopen nothing."""
    new = found.filter("incident_id IS NOT NULL AND kind IS NOT NULL").groupBy("incident_id").agg(F.min("kind").alias("kind"))
    return ledger.unionByName(new.join(ledger.select("incident_id"), "incident_id", "left_anti").withColumn("status", F.lit("open")))


def acknowledge(ledger: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ledger with the open incidents among ids acknowledged, and the ids that name no open incident."""
    asked = ids.select("incident_id").distinct()
    marked = ledger.join(asked.withColumn("asked", F.lit(True)), "incident_id", "left")
    status = F.when(F.col("asked") & (F.col("status") == "open"), "acknowledged").otherwise(F.col("status"))
    return marked.withColumn("status", status).drop("asked"), asked.join(ledger.filter("status = 'open'"), "incident_id", "left_anti")
