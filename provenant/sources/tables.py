"""Keyed tables on Parquet: scans, and sinks that read, merge and write a new version beside the old."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.functions import urls
from provenant.sources.logs import read_log


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines under a folder, at any depth: (session, turn_seq, msg_id, role, text, stamp) of what people and assistants said.

    turn_seq is the place of a line in its file, so that records come in the
    order in which they were written. Text is the content where this is a
    string, else its text blocks joined by newlines. A user's record is kept if
    a person spoke: it is no tool result and has text. Assistants' records
    without text, side chains and malformed lines are left out; messages that
    name no address stay, for they end turns.
    """
    lines = read_log(spark, folder).filter(F.col("value").contains('"type"'))
    v = F.try_parse_json("value")
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    parsed = lines.select("src", "seq", v.alias("v")).filter("v IS NOT NULL")
    blocks = get("$.message.content", "array<variant>")
    texts = F.transform(F.filter(blocks, lambda b: F.try_variant_get(b, "$.type", "string") == "text"), lambda b: F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit("")))
    body = F.when(blocks.isNotNull(), F.array_join(texts, "\n")).otherwise(get("$.message.content", "string"))
    rows = parsed.select(
        F.coalesce(get("$.sessionId", "string"), "src").alias("session"), F.col("seq").alias("turn_seq"), get("$.uuid", "string").alias("msg_id"), get("$.type", "string").alias("role"), F.trim(body).alias("text"), get("$.timestamp", "string").alias("stamp"),
        F.coalesce(get("$.isSidechain", "boolean"), F.lit(False)).alias("aside"), F.coalesce(get("$.toolUseResult", "variant").isNotNull() & ~F.is_variant_null(get("$.toolUseResult", "variant")), F.lit(False)).alias("tool"), F.coalesce(F.size(texts) > 0, F.lit(False)).alias("blocks"),
    )
    has_text = F.coalesce(F.col("text") != "", F.lit(False))
    spoke = (F.col("role") == "assistant") & ~F.col("aside") & has_text | (F.col("role") == "user") & ~F.col("tool") & (has_text | F.col("blocks"))
    return rows.filter(spoke).select("session", "turn_seq", "msg_id", "role", "text", "stamp")


def by_tag(items: DataFrame, tag: str) -> DataFrame:
    return items.filter(F.array_contains("tags", tag))


def of_host(index: DataFrame, host: str) -> DataFrame:
    """Rows of a host and its subdomains, on label boundaries."""
    name = urls.host(F.col("url"))
    return index.filter((name == host) | name.endswith("." + host))


def _row(columns: list[str], key: str) -> Column:
    return F.struct(*[F.col(c) for c in columns if c != key])


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old and the rows of new whose key it lacks; of several rows for a key the least by its columns from left to right."""
    one = new.groupBy(key).agg(F.min(_row(old.columns, key)).alias("row")).select(key, "row.*")
    return old.unionByName(one.join(old.select(key), key, "left_anti").select(old.columns))


def update_by_key(old: DataFrame, changes: DataFrame, key: str, once: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """Set the columns of changes where they are not null; columns named in once only where nothing is stored.

    Of several changes of one key the last by order sets each column that it
    names (order itself is not stored unless old has it); without an order, the
    largest value does. old keeps its rows: no key is added or multiplied.
    """
    cols = [c for c in changes.columns if c != key and (c != order or c in old.columns)]
    value = lambda c: F.max(c) if order is None else F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(order, c)))
    renamed = changes.groupBy(key).agg(*[value(c).alias(f"__{c}") for c in cols])
    merged = old.join(renamed, key, "left")
    return merged.select(*[(F.coalesce(c, f"__{c}") if c in once else F.coalesce(f"__{c}", c)).alias(c) if c in cols else F.col(c) for c in old.columns])


def write_once(old: DataFrame, changes: DataFrame, key: str, column: str, algo: str, current: str) -> DataFrame:
    """Set column, and algo to current, where nothing is stored or what is stored was made by another algorithm."""
    new = changes.groupBy(key).agg(F.max(column).alias("__new"))
    joined = old.join(new, key, "left")
    free = F.col("__new").isNotNull() & (F.col(column).isNull() | ~F.col(algo).eqNullSafe(F.lit(current)))
    return joined.select(*[F.when(free, F.col("__new") if c == column else F.lit(current)).otherwise(F.col(c)).alias(c) if c in (column, algo) else F.col(c) for c in old.columns])


def append_json(df: DataFrame, path: str) -> None:
    """Append rows to a log, one JSON object a line; a line that is not whole is the reader's to skip."""
    df.write.mode("append").json(path)


def journal(spark: SparkSession, path: str) -> DataFrame:
    """Events (op_id, seq, event, target, ts) of an operation journal; torn lines and lines without an operation are skipped."""
    rows = spark.read.text(path).select(F.from_json("value", "op_id string, seq long, event string, target string, ts string").alias("r"))
    return rows.select("r.*").filter("op_id IS NOT NULL")


def require_identity(target: DataFrame, held: DataFrame, wanted: tuple[str, str, str, str], adopt: bool = False) -> DataFrame:
    """The one-row identity (api_origin, library_type, library_id, collection_key) to write to target under; ValueError where it is another's.

    An empty target, or one that is bound to nothing, may be adopted; without
    adopt only the identity that is held already passes.
    """
    names = ["api_origin", "library_type", "library_id", "collection_key"]
    rows = [tuple(r) for r in held.select(names).limit(2).collect()]
    if rows == [wanted]:
        return held.select(names)
    if adopt and (not rows or target.isEmpty()):
        return held.sparkSession.createDataFrame([wanted], ", ".join(f"{n} string" for n in names))
    raise ValueError(f"the target is bound to {rows or 'nothing'}, not to {wanted}")


def delete_keys(old: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return old.join(gone.select(key), key, "left_anti")


def delete_with(old: DataFrame, dependents: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the keys that go: no dependent row outlives its row."""
    return delete_keys(old, gone, key), delete_keys(dependents, gone, key)


def with_schema(df: DataFrame, current: DataFrame, defaults: dict | None = None) -> DataFrame:
    """An older table under the current schema: missing columns come with their default, else null."""
    missing = {c: F.lit(v) for c, v in (defaults or {}).items() if c not in df.columns}
    return current.limit(0).unionByName(df.withColumns(missing), allowMissingColumns=True).select(current.columns)


def write_version(df: DataFrame, top: str) -> DataFrame:
    """Write a new version under top and read it back; the version being read is never overwritten."""
    where = f"{top}/v-{uuid.uuid4().hex}"
    df.write.parquet(where)
    return df.sparkSession.read.parquet(where)
