"""Scans that prove themselves, and counters that come with a write: metrics that Spark observes while it runs.

The rows are counted in the pass that writes them, so a count costs no second
scan and can't differ from what was written.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, Row
from pyspark.sql import functions as F

# The outcomes that each job counts, in the order of its report.
JOBS = {
    "snapshot": ("hashed", "gone", "malformed", "not_visible", "blocked", "rate_limited", "server_error", "no_content", "timeout", "unreachable", "internal_error"),
    "verify": ("unchanged", "changed", "unstable", "stable_unchanged", "stable_changed", "stable_baseline", "stable_rebaselined", "prefix_agreed", "incomparable", "gone", "malformed", "blocked", "rate_limited", "server_error", "no_content", "timeout", "unreachable"),
    "prune": ("selected", "trashed", "refused", "error"),
    "backfill": ("resolved", "unresolved", "refused", "error"),
    "drain": ("recovered", "deferred", "failed", "abandoned"),
    "gate": ("checked", "retracted", "unresolved"),
}


class ShortScan(ValueError):
    """A scan that gave another number of rows than its source declared."""


def land(rows: DataFrame, declared: int, top: str) -> DataFrame:
    """Write a scan under top and read it back; ShortScan where it hasn't the declared number of rows, and then nothing may be concluded from it."""
    seen = Observation()
    where = f"{top}/scan-{uuid.uuid4().hex}"
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(where)
    if seen.get["n"] != declared:
        raise ShortScan(f"the scan gave {seen.get['n']} rows, {declared} were declared")
    return rows.sparkSession.read.schema(rows.schema).parquet(where)


def write_counted(rows: DataFrame, where: str, outcome: str, outcomes: Sequence[str], amounts: Sequence[str] = ()) -> Row:
    """Append rows to a table and return what was written: rows, a count for each outcome and for any other, and sums of amounts."""
    seen = Observation()
    named = F.col(outcome).isin(*outcomes)
    metrics = [F.count(F.lit(1)).alias("rows"), *(F.count_if(F.col(outcome) == o).alias(o) for o in outcomes), F.count_if(~F.coalesce(named, F.lit(False))).alias("other"), *(F.coalesce(F.sum(a), F.lit(0)).alias(f"sum_{a}") for a in amounts)]
    rows.observe(seen, *metrics).write.mode("append").parquet(where)
    return Row(**seen.get)


def report(rows: DataFrame, where: str, job: str, outcome: str = "outcome") -> DataFrame:
    """Write a job's rows and return its report (job, ord, line, n): its counters in their order, those of 0 as well, then other and rows."""
    counts = write_counted(rows, where, outcome, JOBS[job])
    lines = [(job, k, name, int(counts[name])) for k, name in enumerate((*JOBS[job], "other", "rows"))]
    return rows.sparkSession.createDataFrame(lines, "job string, ord int, line string, n long")
