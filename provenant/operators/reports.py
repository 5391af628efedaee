"""Message contexts, titles, pending tags, notes and tallies: the small joins and columns that reports are made of.

A null in an input column gives the null or default that each function names;
empty tables give no rows, or one row of zeros where the result is one row.
"""

from __future__ import annotations

import html
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenant.functions import urls
from provenant.operators import content

GENERAL, SHARED, UNRESOLVED = "general", "user-shared", "title:unresolved"
BASE_BYTES, REFRESHES = 65_536, 3


def contexts(messages: DataFrame) -> DataFrame:
    """messages with context and origin: what a user shares, else what the last context marker of an assistant's text names."""
    marks = F.regexp_extract_all("text", F.lit(r"\[(?:SOURCE|AUDIT)-CONTEXT: *([^\]\n]+?) *\]"), F.lit(1))
    user = F.coalesce(F.col("role") == "user", F.lit(False))
    named = F.when(F.size(marks) > 0, F.element_at(marks, -1))
    return messages.withColumns({"context": F.when(user, SHARED).otherwise(F.coalesce(named, F.lit(GENERAL))), "origin": F.when(user, "user").otherwise("assistant")})


def spoken(records: DataFrame) -> DataFrame:
    """Records (role, kinds) of messages that a person wrote: a user's, and not only tool results."""
    return records.filter((F.col("role") == "user") & ~F.coalesce(F.size("kinds") > 0, F.lit(False)) | (F.col("role") == "user") & F.exists("kinds", lambda k: k != "tool_result"))


def corpus(texts: DataFrame) -> DataFrame:
    """The distinct assistant texts that name an address; nulls name none."""
    return texts.filter("role = 'assistant'").select("text").filter(F.lower("text").rlike("https?://")).distinct()


@F.pandas_udf(T.StringType())
def _unescaped(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def clean_title(title: Column) -> Column:
    """Without inline markup, character references decoded, white space collapsed; null where nothing is left."""
    bare = F.regexp_replace(title, r"(?i)</?(?:i|b|em|strong|sub|sup|span|sc|tt|u)(?:\s[^>]*)?>", "")
    return F.nullif(F.trim(F.regexp_replace(_unescaped(bare), r"\s+", " ")), F.lit(""))


def declared_base(body: Column) -> Column:
    """The address in the first base element of the head; null where none is declared."""
    return F.nullif(F.regexp_extract(F.substring(body, 1, BASE_BYTES), r"""(?is)<base\b[^>]*?\bhref\s*=\s*["']([^"']+)["']""", 1), F.lit(""))


def disowned(body: Column, answered_by: Column) -> Column:
    """Whether a document says that it belongs to another site than the one that answered; false where it says nothing."""
    return F.coalesce(urls.site(declared_base(body)) != urls.site(answered_by), F.lit(False))


def page_title(reads: DataFrame) -> DataFrame:
    """(url, title) of reads (url, final_url, status, content_type, body): the page's own title, else its address.

    A title counts only of HTML that was answered without error, doesn't disown
    itself and isn't an access gate.
    """
    own = F.col("content_type").rlike("(?i)^(text/html|application/xhtml)") & (F.col("status") < 400) & ~disowned(F.col("body"), F.coalesce("final_url", "url")) & (content.visible_chars(F.col("body")) >= content.GATE_CHARS)
    return reads.select("url", F.coalesce(F.when(own, clean_title(content.title(F.col("body")))), F.col("url")).alias("title"))


def identified_titles(pages: DataFrame, metadata: DataFrame) -> DataFrame:
    """(url, title, source): what metadata (scheme, id, title) says of the address's identifier, else the page's own title."""
    named = pages.select("url", F.col("title").alias("scraped"), urls.identifier(F.col("url")).alias("i"))
    told = metadata.groupBy("scheme", "id").agg(F.min(clean_title(F.col("title"))).alias("told")).filter("told IS NOT NULL")
    joined = named.select("url", "scraped", "i.scheme", "i.id").join(told, ["scheme", "id"], "left")
    return joined.select("url", F.coalesce("told", "scraped").alias("title"), F.when(F.col("told").isNotNull(), F.col("scheme")).when(F.col("scraped").isNotNull(), "page").alias("source"))


def flush_pending(pending: DataFrame, index: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items with the tags of their addresses united, pending tags that stay) of pending (url, tag), index (url, item_key), items (key, tags).

    Only tags whose address has an item that exists are flushed, and only these are cleared.
    """
    done = pending.join(index.filter("item_key IS NOT NULL").select("url", F.col("item_key").alias("key")), "url").join(items.select("key"), "key").select("key", "url", "tag").distinct()
    added = done.groupBy("key").agg(F.array_sort(F.collect_set("tag")).alias("new"))
    united = items.join(added, "key", "left").withColumn("tags", F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.coalesce("new", F.array().cast("array<string>")))).drop("new")
    return united, pending.join(done.select("url", "tag"), ["url", "tag"], "left_anti")


def missing_tags(wanted: Column, held: Column) -> Column:
    return F.array_except(wanted, F.coalesce(held, F.array().cast("array<string>")))


def survivors(plan: DataFrame, index: DataFrame, items: DataFrame) -> DataFrame:
    """merge steps (url, corrected) with ok: whether the row to merge into has an item that is live. items (key, deleted)."""
    live = index.join(items.filter("NOT coalesce(deleted, false)").select(F.col("key").alias("item_key")), "item_key", "left_semi").select(F.col("url").alias("corrected"), F.lit(True).alias("ok")).distinct()
    return plan.join(live, "corrected", "left").select("url", "corrected", F.coalesce("ok", F.lit(False)).alias("ok"))


def merged_tags(tags: DataFrame, plan: DataFrame) -> DataFrame:
    """(url, tags) under the corrected address: all tags united, but the mark of an unresolved title, which a merge may have settled."""
    target = F.when(F.col("action").isin("rewrite", "merge"), F.col("corrected")).otherwise(F.col("url"))
    moved = tags.join(plan, "url", "left").select(F.coalesce(target, "url").alias("url"), "tag", F.coalesce(F.col("action") == "merge", F.lit(False)).alias("merged"))
    whole = moved.groupBy("url").agg(F.array_sort(F.collect_set("tag")).alias("tags"), F.max("merged").alias("merged"))
    return whole.select("url", F.when(F.col("merged"), F.array_remove("tags", UNRESOLVED)).otherwise(F.col("tags")).alias("tags"))


def claim_coverage(links: DataFrame) -> DataFrame:
    return links.agg(F.count(F.lit(1)).alias("links"), F.count_distinct("url").alias("urls"))


def latest(rows: DataFrame, stamp: str, limit: int, *ties: str) -> DataFrame:
    """The newest rows, ties in order; a limit below 0 is an error, 0 gives none."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    return rows.orderBy(F.desc(stamp), *ties).limit(limit)


def open_report(ledger: DataFrame, first: int = 5) -> DataFrame:
    """One row: the number of open incidents, their kinds, and the oldest ids."""
    open_ = ledger.filter("status = 'open'")
    oldest = open_.orderBy("opened_at", "incident_id").limit(first).agg(F.transform(F.array_sort(F.collect_list(F.struct("opened_at", "incident_id"))), lambda s: s["incident_id"]).alias("oldest"))
    return open_.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds")).crossJoin(oldest.select(F.array_join("oldest", ",").alias("oldest")))


def legacy_id(record: Column) -> Column:
    """An identifier of a record that has none, from all of it: the order of logs doesn't matter."""
    return F.concat(F.lit("legacy:"), F.substring(F.sha2(record.cast("binary"), 256), 1, 16))


def tallies(rows: DataFrame, by: str, example: str, examples: int = 3) -> DataFrame:
    """(by, n, examples): the most frequent first; examples are the first by order, kept as a bounded top, not as a list of all."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(example))
    few = rows.select(by, example).withColumn("nth", nth).filter(F.col("nth") <= examples).groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(example)), ",").alias("examples"))
    counted = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return counted.join(few, counted[by].eqNullSafe(few[by]), "left").select(counted[by], "n", "examples").orderBy(F.desc("n"), by)


def age_note(seconds: Column) -> Column:
    """How old a claim is: in flight below three minutes, else cut off, with its span in minutes, hours or days."""
    span = F.when(seconds < 3600, F.concat(F.floor(seconds / 60), F.lit("m"))).when(seconds < 86400, F.concat(F.floor(seconds / 3600), F.lit("h"))).otherwise(F.concat(F.floor(seconds / 86400), F.lit("d")))
    return F.when(seconds.isNull(), "age unknown").when(seconds < 180, F.concat(F.lit("in flight, "), span)).otherwise(F.concat(F.lit("cut off, "), span))


def overlap_note(similarity: Column) -> Column:
    """The size of a change; no figure is not none, and a full overlap says that the sketch cannot resolve it."""
    return F.when(similarity.isNull(), "size unknown").when(similarity >= 1.0, "no resolvable difference").otherwise(F.concat(F.round(similarity * 100).cast("int"), F.lit("% shared")))


def with_line(extra: Column, name: str, value: Column) -> Column:
    """Free text with its line "name: value" replaced or added at the end; all other lines stay."""
    lines = F.filter(F.split(F.coalesce(extra, F.lit("")), "\n"), lambda line: ~line.startswith(name + ":"))
    kept = F.filter(lines, lambda line: (line != "") | (F.size(lines) > 1))
    return F.array_join(F.concat(kept, F.array(F.concat(F.lit(name + ": "), value))), "\n")


def item_document(url: Column, title: Column, day: Column, tags: Column) -> Column:
    """The document of a new item, as JSON."""
    marks = F.transform(tags, lambda t: F.struct(t.alias("tag")))
    return F.to_json(F.struct(F.lit("webpage").alias("itemType"), url.alias("url"), F.coalesce(title, url).alias("title"), day.cast("string").alias("accessDate"), urls.site(url).alias("websiteTitle"), marks.alias("tags")))


def surface(bridge: Column, remote: Column) -> Column:
    return F.when(F.coalesce(bridge != "", F.lit(False)), "bridged").when(F.coalesce(remote != "", F.lit(False)), "remote").otherwise("local")


def within_budget(files: DataFrame, budget: int) -> DataFrame:
    """files (source, name, stamp, nbytes) with kept: the newest that fit, one that doesn't is skipped and smaller ones go on.

    Files stream through a task in the order of their source, which keeps no
    more than the bytes used so far; a source is never gathered.
    """
    ordered = files.repartition("source").sortWithinPartitions("source", F.desc("stamp"), "name")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, used = object(), 0
        for batch in batches:
            kept = []
            for name, nbytes in zip(batch.column("source").to_pylist(), batch.column("nbytes").to_pylist(), strict=True):
                if name != source:
                    source, used = name, 0
                kept.append(nbytes is not None and used + nbytes <= budget)
                used += nbytes if kept[-1] else 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept, pa.bool_())], names=[*batch.schema.names, "kept"])

    return ordered.mapInArrow(fit, T.StructType([*files.schema.fields, T.StructField("kept", T.BooleanType())]))


def refreshes(rows: DataFrame, most: int = REFRESHES) -> DataFrame:
    """rows (run, url, first_seen) that a run may refresh: its oldest."""
    nth = F.row_number().over(Window.partitionBy("run").orderBy("first_seen", "url"))
    return rows.withColumn("nth", nth).filter(F.col("nth") <= most).drop("nth")


def hourly(records: DataFrame, stamp: str, now: Column) -> DataFrame:
    """(hour, records, refused) of stamps up to an hour ahead of now, and one row with a null hour for those beyond."""
    hour = F.when(F.col(stamp) <= now + F.expr("INTERVAL 1 HOUR"), F.date_trunc("hour", stamp))
    return records.filter(F.col(stamp).isNotNull()).groupBy(hour.alias("hour")).agg(F.count(F.lit(1)).alias("records"), F.count("refused_kind").alias("refused"))
