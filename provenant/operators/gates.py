"""Which rows and items should go, which sources are retracted or hidden, and which claims are stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.functions import urls
from provenant.operators.upkeep import corrected

#: Reserved endings that resolve for whoever is on the right network.
IN_CONTEXT = ("localhost", "local", "onion", "internal", "arpa")
CLAIM_SECONDS = 180


def _tier(url: Column, rules: urls.Rules) -> Column:
    name = urls.host(url)
    number = urls.ipv4(name)
    why = urls.excluded_reason(url, rules)
    pair = lambda tier, reason: F.struct(F.lit(tier).alias("tier"), F.lit(reason).alias("reason"))
    fixed = corrected(url)
    return (
        F.when((fixed != url) & ~fixed.rlike(r"[{}*]") & urls.host(fixed).isNotNull(), None)
        .when(url.rlike("[{}]"), pair("hard", "placeholder")).when(url.rlike(r"[\x00-\x1f\x7f-\u009f]"), pair("hard", "control_character"))
        .when(name.isNull(), pair("hard", "no_host")).when(F.substring_index(name, ".", -1).isin(*IN_CONTEXT), pair("policy", "only_in_context"))
        .when(why == "reserved_name", pair("hard", "reserved_name")).when(number.isNull() & ~name.startswith("[") & ~urls.lookup_name(name), pair("hard", "no_name"))
        .when(why.isNotNull(), F.struct(F.lit("policy").alias("tier"), why.alias("reason")))
    )


def retire_plan(index: DataFrame, policy: bool = False, rules: urls.Rules = urls.DEFAULT) -> DataFrame:
    """(url, item_key, tier, reason) of the rows to retire; hard rows only, unless policy.

    A row that repair can save stays, and so does one whose item is still being
    made (no item_key, but a pending_key). Rows with a null url stay.
    """
    rows = index.filter("url IS NOT NULL AND NOT (item_key IS NULL AND pending_key IS NOT NULL)").select("url", "item_key", _tier(F.col("url"), rules).alias("t"))
    found = rows.filter("t IS NOT NULL").select("url", "item_key", "t.tier", "t.reason")
    return found if policy else found.filter("tier = 'hard'")


def retire(index: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(archive, kept, refused): full rows to archive before they go, the rows that stay, and steps whose row is no longer as planned."""
    same = [F.col("r.url") == F.col("p.url"), F.col("r.item_key").eqNullSafe(F.col("p.item_key"))]
    steps = plan.select("url", "item_key").alias("p")
    return index.alias("r").join(steps, same, "left_semi"), index.alias("r").join(steps, same, "left_anti"), steps.join(index.alias("r"), same, "left_anti")


def prune_plan(items: DataFrame, rules: urls.Rules = urls.DEFAULT) -> DataFrame:
    """(key, url, reason) of the live items that the exclusion rules reject."""
    return items.select("key", "url", urls.excluded_reason(F.col("url"), rules).alias("reason")).filter("reason IS NOT NULL")


def doi_gate(sources: DataFrame, notices: DataFrame, order: str | None = None) -> DataFrame:
    """(doi, url, checked, finding): each DOI once, by its first address in order (without one, the least); one that notices (doi, finding) lacks is unchecked, not clean."""
    told = sources.select(urls.doi_of(F.col("url")).alias("doi"), "url", (F.lit(0) if order is None else F.col(order)).alias("nth")).filter("doi IS NOT NULL")
    first = told.groupBy("doi").agg(F.min_by("url", F.struct("nth", "url")).alias("url"))
    known = notices.groupBy("doi").agg(F.max("finding").alias("finding"), F.lit(True).alias("known"))
    return first.join(known, "doi", "left").select("doi", "url", F.col("known").isNotNull().alias("checked"), "finding")


def repo_downgrade(outcomes: DataFrame, visible: DataFrame) -> DataFrame:
    """outcomes (url, outcome) and refined: gone becomes not_visible where the repository is in visible (slug). Nothing is ever upgraded."""
    seen = visible.select("slug", F.lit(True).alias("seen")).distinct()
    slug = F.when(F.col("outcome") == "gone", urls.repo_slug(F.col("url")))
    marked = outcomes.withColumn("slug", slug).join(seen, "slug", "left").drop("slug")
    return marked.withColumn("refined", F.when(F.col("seen"), "not_visible").otherwise(F.col("outcome"))).drop("seen")


def stale_claims(index: DataFrame, items: DataFrame, now: Column) -> DataFrame:
    """(url, pending_key, action) of rows without an item: complete where the claimed item exists, release an old claim, else leave it in flight.

    index (url, item_key, pending_key, claimed_at), items (key); claimed_at and now in seconds. A claim without a time is left alone, for its age can't be told.
    """
    open_ = index.filter("item_key IS NULL AND pending_key IS NOT NULL").select("url", "pending_key", "claimed_at")
    made = items.select(F.col("key").alias("pending_key"), F.lit(True).alias("made")).distinct()
    action = F.when(F.coalesce(now - F.col("claimed_at") < CLAIM_SECONDS, F.lit(True)), "in_flight").when(F.col("made"), "complete").otherwise("release")
    return open_.join(made, "pending_key", "left").select("url", "pending_key", action.alias("action"))
