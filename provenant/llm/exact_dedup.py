"""Exact dedup by deterministic block naming, with DataFrame functions only.

Each normalised text is cut into fixed-size byte blocks. The blocks are sorted
into names; adjacent names are then paired and the pairs named in turn, until
one name is left for each document. Equal names of documents of the same number
of blocks mean equal texts, since every name stands for exactly one content.

Block contents cross the network once, combined before the shuffle: they are
grouped under a 64-bit key and the smallest and largest content of each key
compared. Where both agree, the key stands for one content and may represent it;
where they differ, the contents under that key are sorted and numbered apart.
So equality is decided by content, never by hash alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenant.llm.textops import durable, row_hash

BLOCK_BYTES = 16384
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z only; null becomes empty. Pure ASCII takes the fast path."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _keyed(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(document keys with their number of blocks, blocks). A generator keeps the folded text from being computed twice."""
    folded = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array(fold_ascii(F.col(text_col)))).alias("norm"))
    keyed = folded.select(
        "doc_id",
        F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
        F.greatest(F.lit(1), F.ceil(F.octet_length("norm") / block_bytes)).cast("int").alias("n_blocks"),
        F.col("norm").cast("binary").alias("body"),
    )
    blocks = keyed.select(
        "doc_id",
        "text_sha256",
        "n_blocks",
        F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda i: F.substring(F.col("body"), i * block_bytes + 1, F.lit(block_bytes)))).alias("pos", "block"),
    )
    return keyed.drop("body"), blocks.withColumn("key", F.xxhash64("block", F.octet_length("block")))


def _sorted_names(keys: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct keys sorted over the cluster; each gets an integer, the same one however a task is rerun."""
    return keys.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("name", F.monotonically_increasing_id())


def _name_blocks(blocks: DataFrame) -> DataFrame:
    """(doc_id, text_sha256, n_blocks, pos, name) with one name for each distinct block."""
    by_key = blocks.groupBy("key").agg(F.min("block").alias("low"), F.max("block").alias("high"))
    by_key = durable(by_key.select("key", (F.col("low") == F.col("high")).alias("single")))
    slots = blocks.select("doc_id", "text_sha256", "n_blocks", "pos", "key")
    mixed = by_key.filter(~F.col("single")).select("key")
    if mixed.isEmpty():
        names = _sorted_names(by_key.select("key"), ["key"])
        return slots.join(names, "key").drop("key")
    # Keys shared by several contents: number the contents of each such key in sorted order.
    contents = blocks.join(mixed, "key", "left_semi").select("key", "block").distinct()
    ranked = contents.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("block")))
    several = blocks.join(ranked, ["key", "block"]).select("doc_id", "text_sha256", "n_blocks", "pos", "key", "rank")
    one = slots.join(mixed, "key", "left_anti").withColumn("rank", F.lit(0))
    every = by_key.filter("single").select("key", F.lit(0).alias("rank")).unionByName(ranked.select("key", "rank"))
    return one.unionByName(several).join(_sorted_names(every, ["key", "rank"]), ["key", "rank"]).drop("key", "rank")


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(keys, names): one row per input row with (doc_id, text_sha256, n_blocks), and (doc_id, text_sha256, n_blocks, name)."""
    keys, blocks = _keyed(docs, id_col, text_col, block_bytes)
    todo = durable(_name_blocks(blocks))
    whole = [todo.filter("n_blocks = 1").drop("pos")]
    rest, width = todo.filter("n_blocks > 1"), todo.agg(F.max("n_blocks")).first()[0] or 1
    while width > 1:
        width = (width + 1) // 2
        # Repeated rows have equal names in each place, so min() keeps one of equals.
        side = lambda bit: F.min(F.when(F.col("pos") % 2 == bit, F.col("name")))
        pairs = rest.groupBy("doc_id", "text_sha256", "n_blocks", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(side(0).alias("a"), F.coalesce(side(1), F.lit(-1)).alias("b"))
        names = _sorted_names(pairs.select("a", "b").distinct(), ["a", "b"])
        rest = durable(pairs.join(names, ["a", "b"]).drop("a", "b"))
        # A document of n blocks is done at the level at which ceil(n / 2**level) is 1; pairing a lone name again keeps it unique.
    whole.append(rest.drop("pos"))
    return keys, whole[0].unionByName(whole[1]).distinct()


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    The row with the largest doc_id of a group stays; null is the smallest, and
    a group of nulls only has a null keep_id. Of rows repeated with the same
    doc_id and text, exactly one is kept. An empty table gives an empty result.
    """
    keys, names = identities(docs, id_col, text_col, block_bytes)
    rows = keys.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("times"))
    named = rows.alias("r").join(names.alias("n"), F.col("r.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("r.text_sha256") == F.col("n.text_sha256"))).select("r.doc_id", "r.text_sha256", "r.times", "n.n_blocks", "n.name")
    named = durable(named)
    groups = named.groupBy("n_blocks", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("times").alias("group_size"))
    out = named.join(groups, ["n_blocks", "name"])
    copies = F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "text_sha256", copies.alias("nth")).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), "text_sha256"
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns whatever their names."""
    keep = decide(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias("__keep_id"), F.col("text_sha256").alias("__keep_sha"))
    sha = F.sha2(fold_ascii(F.col(text_col)).cast("binary"), 256)
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(id_col).alias("__id"), sha.alias("__sha"), row_hash(docs).alias("__hash"))
    hit = tagged.join(keep, F.col("__id").eqNullSafe(F.col("__keep_id")) & (F.col("__sha") == F.col("__keep_sha")), "left_semi")
    # Only rows repeated with the same id and text share a partition here; of those, the same one is kept on every run.
    first = hit.withColumn("__nth", F.row_number().over(Window.partitionBy("__id", "__sha").orderBy("__hash")))
    return first.filter("__nth = 1").select("__row.*")
