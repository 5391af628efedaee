"""Capture as one job: from messages to index rows, items to create, tags, claims, counters and log records; and the replay of what failed."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.functions import urls
from provenant.operators import capture, reports

ABANDON_AT = 5


class Captured(NamedTuple):
    """What a job hands on. marked: a row for every cited URL of a message with its state; the rest as their makers below say."""

    marked: DataFrame
    index_rows: DataFrame
    outbox: DataFrame
    tags: DataFrame
    claims: DataFrame
    counters: DataFrame
    log: DataFrame


def live_turns(messages: DataFrame) -> DataFrame:
    """The last assistant message that has text of each turn, where it names an address: what a turn that has just ended cites.

    messages (session, turn_seq, role, text). A turn is the run after a user's
    message; a message without text ends nothing and cites nothing.
    """
    said = messages.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    segments = capture.turn_segments(said)
    last = capture.last_of_segment(segments).select("session", "turn_seq")
    return said.join(last, ["session", "turn_seq"], "left_semi").filter((F.col("role") == "assistant") & F.lower("text").rlike("https?://"))


def _marked(cited: DataFrame, index: DataFrame) -> DataFrame:
    """cited with state: excluded, recurring, deferred (claimed by a writer that has no item yet), or new for the first message that cites an unknown URL and recurring for the others."""
    known = index.groupBy("url").agg(F.max(F.col("item_key").isNotNull()).alias("has_item"))
    first = cited.filter("excluded_reason IS NULL").groupBy("url").agg(F.min(F.struct("seen", "msg_id")).alias("first"))
    met = cited.join(known, "url", "left").join(first, "url", "left")
    opens = F.struct("seen", "msg_id") == F.col("first")
    state = F.when(F.col("excluded_reason").isNotNull(), "excluded").when(F.col("has_item"), "recurring").when(F.col("has_item").isNotNull(), "deferred").when(opens, "new").otherwise("recurring")
    return met.withColumn("state", state).drop("has_item", "first")


def claim_rows(marked: DataFrame) -> DataFrame:
    """(url, claim, first_seen, last_seen, times_seen, project, context, origin): the last three of the first message that made the claim."""
    said = marked.filter("state <> 'excluded'").withColumn("claim", capture.claim(F.col("text"), F.col("raw"))).filter("claim IS NOT NULL")
    first = F.min_by(F.struct("project", "context", "origin"), F.struct("seen", "msg_id")).alias("f")
    rolled = said.groupBy("url", "claim").agg(F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"), F.count(F.lit(1)).alias("times_seen"), first)
    return rolled.select("url", "claim", "first_seen", "last_seen", "times_seen", "f.project", "f.context", "f.origin")


def message_counters(messages: DataFrame, marked: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """(msg_id, seen, new, recurring, excluded, deferred, claims, errors) of every message; failures (msg_id, url) are writes that failed."""
    said = capture.claim(F.col("text"), F.col("raw"))
    state = lambda name: F.count_if(F.col("state") == name).alias(name)
    counts = marked.groupBy("msg_id").agg(F.count(F.lit(1)).alias("seen"), state("new"), state("recurring"), state("excluded"), state("deferred"), F.count_if((F.col("state") != "excluded") & said.isNotNull()).alias("claims"))
    out = messages.select("msg_id").join(counts, "msg_id", "left")
    errors = messages.sparkSession.createDataFrame([], "msg_id string, errors long") if failures is None else failures.groupBy("msg_id").agg(F.count_distinct("url").alias("errors"))
    return out.join(errors, "msg_id", "left").na.fill(0)


def run(messages: DataFrame, index: DataFrame, rules: urls.Rules = urls.DEFAULT, failures: DataFrame | None = None) -> Captured:
    """One pass of the capture job over messages (msg_id, session, turn_seq, role, text, seen, project) and an index (url, item_key).

    index_rows (url, first_seen, last_seen, times_seen) are to be merged into
    the index, outbox (url, document) to be created, tags (url, tag) to be
    added, claims to be merged, log (msg_id, value) to be appended. A message
    that is run again gives the same rows; merges take minima and maxima. What
    is deferred is left to the writer that holds the claim.
    """
    told = reports.contexts(messages)
    marked = _marked(capture.citations(told, rules), index)
    mine = marked.filter("state IN ('new', 'recurring')")
    index_rows = capture.url_index(mine)
    labels = F.array(F.concat(F.lit("seen:"), F.date_format("seen", "yyyy-MM-dd")), F.concat(F.lit("context:"), F.col("context")), F.concat(F.lit("project:"), F.coalesce("project", F.lit("home"))))
    tags = mine.select("url", F.explode(labels).alias("tag")).distinct()
    fresh = marked.filter("state = 'new'").select("url", "seen").join(capture.tag_sets(tags), "url")
    outbox = fresh.select("url", reports.item_document(F.col("url"), F.lit(None).cast("string"), F.col("seen"), F.col("tags")).alias("document"))
    counters = message_counters(messages, marked, failures)
    log = counters.select("msg_id", F.to_json(F.struct(F.col("msg_id").alias("message"), *(F.col(c).alias(f"urls_{c}") for c in ("seen", "new", "recurring", "excluded", "deferred")), "claims", "errors")).alias("value"))
    return Captured(marked, index_rows, outbox, tags, claim_rows(marked), counters, log)


def replay(queue: DataFrame, index: DataFrame, written: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(queue, outcomes) after a replay of queue (url, project, context, seen_date, first_failed, last_failed, attempts, last_error).

    What has failed ABANDON_AT times is abandoned and leaves the queue. An entry
    whose row has an item, or that written (url, ok) says was stored, has
    recovered and leaves it; one whose row is claimed by another writer is
    deferred and stays as it was; one that failed again, or that nobody tried
    although it could be, stays with one more attempt or as it was. outcomes
    (url, seen_date, project, context, outcome): recovered entries keep the date
    of their message, never that of the replay.
    """
    known = index.groupBy("url").agg(F.max(F.col("item_key").isNotNull()).alias("has_item"))
    tried = written.groupBy("url").agg(F.max("ok").alias("ok"))
    met = queue.join(known, "url", "left").join(tried, "url", "left")
    outcome = F.when(F.col("attempts") >= ABANDON_AT, "abandoned").when(F.coalesce("has_item", F.lit(False)) | F.coalesce("ok", F.lit(False)), "recovered").when(F.col("has_item").isNotNull(), "deferred").when(F.col("ok").isNotNull(), "failed").otherwise("waiting")
    judged = met.withColumn("outcome", outcome)
    again = F.col("outcome") == "failed"
    left = judged.filter(~F.col("outcome").isin("abandoned", "recovered"))
    moved = {"attempts": F.col("attempts") + again.cast("int"), "last_failed": F.when(again, at).otherwise(F.col("last_failed"))}
    return left.select(*(moved.get(c, F.col(c)).alias(c) for c in queue.columns)), judged.select("url", "seen_date", "project", "context", "outcome")
