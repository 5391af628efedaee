"""Messages to citations, and citations to the URL index, claims and tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenant.functions import extract, urls

CLAIM_CHARS, CLAIMS_PER_URL = 400, 50


#: Opens a report that this library wrote itself: its addresses are shown, not cited.
REPORT = "<!-- provenance: generated report, not citations -->"


def generated_report(role: Column, text: Column) -> Column:
    return F.coalesce((role == "assistant") & F.ltrim(text).startswith(REPORT), F.lit(False))


def citations(messages: DataFrame, rules: urls.Rules = urls.DEFAULT) -> DataFrame:
    """messages (msg_id, session, turn_seq, role, text, seen) to one row per cited URL of a message, first spelling first.

    Columns: all of messages, and pos, raw, kind (link, html or bare), url,
    excluded_reason. The cheap test for an address runs first, so most messages
    never meet the extractor. A message that is a generated report cites nothing.
    """
    likely = messages.filter(F.lower("text").rlike("https?://") & ~generated_report(F.col("role"), F.col("text")))
    found = likely.select(*[c for c in messages.columns], F.posexplode(extract.citations(F.col("text"))).alias("pos", "c"))
    found = found.select(*messages.columns, "pos", "c.raw", "c.kind", "c.resolvable").withColumn("url", urls.canonical(F.col("raw"), rules))
    first = found.withColumn("nth", F.row_number().over(Window.partitionBy("msg_id", "url").orderBy("pos"))).filter("nth = 1").drop("nth")
    reason = F.coalesce(urls.excluded_reason(F.col("url"), rules), F.when(~F.col("resolvable"), "no_name"))
    return first.withColumn("excluded_reason", reason).drop("resolvable")


def url_index(cited: DataFrame) -> DataFrame:
    return cited.groupBy("url").agg(F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"), F.count(F.lit(1)).alias("times_seen"))


def merge_index(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keyed upsert: the earliest first_seen, the latest last_seen, counts added. A replay never moves a date back."""
    return old.unionByName(new).groupBy("url").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("times_seen").alias("times_seen"))


def message_counters(messages: DataFrame, cited: DataFrame, known: DataFrame) -> DataFrame:
    """Per message: URLs seen, excluded, recurring (in known) and new. Messages without citations count 0."""
    marked = cited.join(known.select("url", F.lit(True).alias("known")), "url", "left")
    counts = marked.groupBy("msg_id").agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("excluded_reason").isNotNull()).alias("excluded"), F.count_if(F.col("excluded_reason").isNull() & F.col("known")).alias("recurring"), F.count_if(F.col("excluded_reason").isNull() & F.col("known").isNull()).alias("new"))
    return messages.select("msg_id").join(counts, "msg_id", "left").na.fill(0)


def claim(text: Column, raw: Column) -> Column:
    """The sentence around an address, never cut inside it; null where no word stands outside it."""
    at = F.instr(text, raw)
    before = F.regexp_extract(F.substring(text, F.lit(1), at - 1), r"(?s)^(?:.*(?:[.!?][ \n]|\n))?(.*)$", 1)
    rest = F.substring(text, at + F.length(raw), F.length(text))
    after = F.regexp_extract(rest, r"(?s)^(.*?[.!?])(?:[ \n]|$)", 1)
    after = F.when(after == "", F.regexp_extract(rest, r"^([^\n]*)", 1)).otherwise(F.substring_index(after, "\n", 1))
    whole = F.trim(F.regexp_replace(F.concat(before, raw, after), "[ \t\r\n]+", " "))
    cut = F.when(F.length(whole) > CLAIM_CHARS, F.concat(F.regexp_replace(F.substring(whole, 1, CLAIM_CHARS), " [^ ]*$", ""), F.lit(" […]"))).otherwise(whole)
    return F.when(F.regexp_replace(F.concat(before, after), r"[ \t\r\n\[\]().,;:!?`]", "") != "", cut)


def claim_rows(said: DataFrame) -> DataFrame:
    """Citations with their text to (url, claim, first_seen, last_seen, times_seen)."""
    links = said.select("url", "seen", claim(F.col("text"), F.col("raw")).alias("claim")).filter("claim IS NOT NULL")
    return links.groupBy("url", "claim").agg(F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"), F.count(F.lit(1)).alias("times_seen"))


def claim_links(cited: DataFrame, texts: DataFrame) -> DataFrame:
    """One row per (url, claim) with first and last date and count; the first CLAIMS_PER_URL claims of a URL are kept."""
    said = cited.join(texts.select("msg_id", "text"), "msg_id") if "text" not in cited.columns else cited
    return claim_rows(said).withColumn("nth", F.row_number().over(Window.partitionBy("url").orderBy("first_seen", "claim"))).filter(F.col("nth") <= CLAIMS_PER_URL).drop("nth")


def search_claims(links: DataFrame, term: str) -> DataFrame:
    """Links whose claim or URL holds the term, in any case."""
    return links.filter(F.lower("claim").contains(term.lower()) | F.lower("url").contains(term.lower()))


def tag_sets(tags: DataFrame) -> DataFrame:
    return tags.groupBy("url").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def turn_segments(messages: DataFrame) -> DataFrame:
    """(session, turn_seq, segment): a segment starts at each user message; assistant messages follow in theirs."""
    w = Window.partitionBy("session").orderBy("turn_seq").rowsBetween(Window.unboundedPreceding, 0)
    return messages.select("session", "turn_seq", "role", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w).alias("segment"))


def last_of_segment(segments: DataFrame) -> DataFrame:
    return segments.filter("role = 'assistant'").groupBy("session", "segment").agg(F.max("turn_seq").alias("turn_seq"))
