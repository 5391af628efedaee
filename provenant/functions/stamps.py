"""Time stamps, versions, write identifiers and project names as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the name space of write identifiers. Another one would reopen what has been acknowledged.
WRITES = "8b1f2c6a4d3e5f709a216c0d7e4b8f13"
HOME = "home"


def offset_time(raw: Column) -> Column:
    """An ISO time stamp that names its offset, with or without a colon; null for one that names none, and for anything else."""
    colon = F.regexp_replace(raw, r"([+-][0-9]{2})([0-9]{2})$", "$1:$2")
    return F.when(raw.rlike(r"T.*(Z|[+-][0-9]{2}:?[0-9]{2})$"), F.try_to_timestamp(colon))


def version_state(running: Column, installed: Column) -> Column:
    """current, mismatch (older or newer), or unknown where either isn't a plain version, null included."""
    plain = lambda v: F.coalesce(F.trim(v).rlike(r"^[0-9]+(\.[0-9]+)*$"), F.lit(False))
    parts = lambda v: F.regexp_replace(F.trim(v), r"(^|\.)0+(?=[0-9])", "$1")
    return F.when(~(plain(running) & plain(installed)), "unknown").when(parts(running) == parts(installed), "current").otherwise("mismatch")


def write_id(capture: Column, url: Column) -> Column:
    """The name-based (version 5) UUID of one write of one URL, as hex: a replayed write keeps its identifier."""
    h = F.sha1(F.concat(F.unhex(F.lit(WRITES)), F.encode(F.concat(capture, F.lit("\n"), F.coalesce(url, F.lit(""))), "UTF-8")))
    return F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab"), F.substring(h, 18, 15))


def projects(places: DataFrame, roots: DataFrame, homes: tuple[str, ...]) -> DataFrame:
    """places (cwd, override) to distinct (cwd, override, project).

    The override; else the last name of the longest root (path) that holds
    cwd; else the first name beneath a home; else cwd's last name; else home.
    Each folder meets the roots by equality on its ancestors, so no pair of
    folder and root is tried that cannot match.
    """
    given = places.select("cwd", "override").distinct()
    steps = F.filter(F.split("cwd", "/"), lambda s: s != "")
    above = F.transform(F.sequence(F.lit(1), F.size("steps")), lambda k: F.concat(F.lit("/"), F.array_join(F.slice("steps", F.lit(1), k), "/")))
    named = given.withColumn("steps", steps).filter(F.size("steps") > 0).select("cwd", F.explode(above).alias("path")).distinct()
    nearest = named.join(roots.select("path").distinct(), "path").groupBy("cwd").agg(F.max_by("path", F.length("path")).alias("root"))
    last = lambda p: F.nullif(F.element_at(F.split(F.regexp_replace(p, "/+$", ""), "/"), -1), F.lit(""))
    under = F.lit(None).cast("string")
    for top in reversed(homes):
        under = F.when(F.regexp_replace("cwd", "/+$", "") == top, HOME).when(F.col("cwd").startswith(top + "/"), F.element_at(F.split(F.substring("cwd", len(top) + 2, 1 << 20), "/"), 1)).otherwise(under)
    found = F.coalesce(F.nullif(F.col("override"), F.lit("")), last(F.col("root")), F.nullif(under, F.lit("")), last(F.col("cwd")), F.lit(HOME))
    return given.join(nearest, "cwd", "left").select("cwd", "override", found.alias("project"))
