"""What a capture log says about the writer's health: records, faults within a window, and lines that are no records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.functions import stamps

#: Events that are refusals, kinds of refusals that are kept and shown, and how far a stamp may lie ahead.
REFUSALS, KINDS, SHOWN, SKEW = ("stale_install", "identity_refused"), 16, 3, "INTERVAL 1 HOUR"
_RECORD = "ts string, event string, refused string, refused_kind string, urls_seen long, version string, errors array<struct<code:string,message:string,url:string>>"


def records(log: DataFrame) -> DataFrame:
    """log (src, seq, value, terminated) with json, ts and the fields of a record.

    json says whether a line is a JSON object at all; ts is null where a stamp
    is missing, malformed or names no offset, and then the line is no record.
    """
    parsed = log.withColumn("json", F.coalesce(F.trim("value").rlike(r"(?s)^\{.*\}$") & F.try_parse_json("value").isNotNull(), F.lit(False)))
    rows = parsed.withColumn("r", F.when(F.col("json"), F.from_json("value", _RECORD)))
    return rows.select("src", "seq", "value", "terminated", "json", stamps.offset_time(F.col("r.ts")).alias("ts"), F.col("r.ts").alias("stamp"), *(f"r.{c}" for c in ("event", "refused", "refused_kind", "urls_seen", "version", "errors")))


def evaluate(log: DataFrame, now: Column, window: str = "24 HOURS") -> DataFrame:
    """One row for each src of log (src, seq, value, terminated); blank lines don't count.

    lines, records; naive (objects whose stamp names no offset), future (stamps
    more than an hour ahead of now, which count in no window), torn (a last line
    that is no record and not terminated), tail (lines after the last record,
    without a torn one); refusals, newest_refusal and kinds within the window;
    errors, and newest_error as code, message and url, of what was captured in
    the window. An src without any record has a null newest record, and its
    lines are all tail.
    """
    rows = records(log.filter(F.trim("value") != ""))
    good = F.col("ts").isNotNull()
    ahead = F.col("ts") > now + F.expr(SKEW)
    recent = good & ~ahead & (F.col("ts") >= now - F.expr(f"INTERVAL {window}"))
    refusal = F.coalesce(F.col("event").isin(*REFUSALS), F.lit(False)) | (F.coalesce("refused", F.lit("")) != "")
    capture = ~refusal & F.col("event").isNull() & (F.col("urls_seen").isNotNull() | F.col("version").isNotNull())
    failed = recent & capture & (F.coalesce(F.size("errors"), F.lit(0)) > 0)
    kind = F.coalesce("event", "refused_kind", F.lit("unlabelled"))
    newest = F.max_by(F.get("errors", F.lit(0)), F.when(failed, F.struct("ts", -F.col("seq"))))
    sums = rows.groupBy("src").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(good).alias("records"), F.count_if(F.col("json") & ~good & F.coalesce(F.col("stamp").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:.]+$"), F.lit(False))).alias("naive"), F.count_if(good & ahead).alias("future"),
        F.count_if(recent & refusal).alias("refusals"), F.max(F.when(recent & refusal, F.col("ts"))).alias("newest_refusal"), F.slice(F.array_sort(F.collect_set(F.when(recent & refusal, kind))), 1, KINDS).alias("kinds"),
        F.coalesce(F.sum(F.when(failed, F.size("errors"))), F.lit(0)).cast("long").alias("errors"), newest.alias("newest_error"),
        F.max(F.when(good, F.col("seq"))).alias("last_record"), (F.max_by(F.struct("terminated", "json"), "seq")).alias("last_line"),
    )
    # A line is in the tail by where it stands, which is known once the last record is.
    behind = rows.join(sums.select("src", "last_record"), "src").filter(F.col("last_record").isNull() | (F.col("seq") > F.col("last_record"))).groupBy("src").agg(F.count(F.lit(1)).alias("behind"))
    torn = (~F.col("last_line.terminated") & ~F.col("last_line.json")).cast("long")
    joined = sums.join(behind, "src", "left").withColumn("torn", torn).withColumn("tail", F.coalesce("behind", F.lit(0).cast("long")) - F.col("torn"))
    return joined.select("src", "lines", "records", "naive", "future", "torn", "tail", "refusals", "newest_refusal", "kinds", "errors", "newest_error", F.col("newest_error.code").alias("error_code"))


def warnings(health: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """(src, ord, warning) of evaluate's rows, and of the open incidents of ledger (incident_id, kind, status, opened_at) with a null src; nothing where there is nothing to say."""
    blind = F.when((F.col("lines") > 0) & (F.col("records") == 0), F.format_string("the log has %d line(s) but no readable records", "lines"))
    tail = F.when((F.col("records") > 0) & (F.col("tail") >= 1), F.format_string("the last %d line(s) of the log are unreadable", "tail"))
    future = F.when(F.col("future") > 0, F.format_string("%d record(s) are dated in the future", "future"))
    refused = F.when(F.col("refusals") > 0, F.format_string("%d refusal(s), newest %s: %s", "refusals", F.date_format("newest_refusal", "yyyy-MM-dd'T'HH:mm:ss"), F.array_join(F.slice("kinds", 1, SHOWN), ", ")))
    failed = F.when(F.col("errors") > 0, F.format_string("%d capture error(s): %s (%s) for %s", "errors", F.col("newest_error.code"), F.col("newest_error.message"), F.col("newest_error.url")))
    said = health.select("src", F.posexplode(F.array(blind, tail, future, refused, failed)).alias("ord", "warning")).filter("warning IS NOT NULL")
    if ledger is None:
        return said
    open_ = ledger.filter("status = 'open'")
    counted = open_.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set("kind")), 1, KINDS), ", ").alias("kinds"))
    line = counted.filter("n > 0").select(F.lit(None).cast("string").alias("src"), F.lit(-1).alias("ord"), F.format_string("%d open integrity incident(s) [%s]", "n", "kinds").alias("warning"))
    return said.unionByName(line)
