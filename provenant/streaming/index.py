"""Tables kept by a stream: the URL index, claims, incidents and operations, equal to their batch results.

Each micro-batch is reduced to rows of its table and folded into the buckets that
their keys fall in (see buckets). A batch that is run again after a failure
reads the table before it, so that nothing counts twice; a query that is started
again on the same folder goes on where it stopped. Folds take minima, maxima and
sums, so late rows keep their own dates.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provenant.operators import capture, incidents
from provenant.streaming.buckets import Buckets


@dataclass(frozen=True)
class Fold:
    """What a stream keeps: rows(batch) of a table with this key, and merge(old rows or None, new rows), which works key by key."""

    key: str
    rows: Callable[[DataFrame], DataFrame]
    merge: Callable[[DataFrame | None, DataFrame], DataFrame]

    def __call__(self, old: DataFrame | None, batch: DataFrame) -> DataFrame:
        return self.merge(old, self.rows(batch))


def shared_folder(spark: SparkSession) -> str:
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{top or os.path.join(os.getcwd(), 'spark-warehouse', 'streams')}/stream-{uuid.uuid4().hex}"


def keep(stream: DataFrame, top: str, fold: Fold, buckets: int = 16) -> DataFrame:
    """Drain a stream into the bucketed table under top. An empty stream gives what fold makes of no rows."""
    spark = stream.sparkSession
    kept = Buckets(spark, f"{top}/table", fold.key, buckets)
    query = stream.writeStream.foreachBatch(lambda batch, epoch: kept.merge(epoch, fold.rows(batch), fold.merge) and None).option("checkpointLocation", f"{top}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    found = kept.read()
    return fold(None, spark.createDataFrame([], stream.schema)) if found is None else found


fold_index = Fold("url", lambda batch: capture.url_index(capture.citations(batch)), lambda old, new: new if old is None else capture.merge_index(old, new))


def claims(most: int = capture.CLAIMS_PER_URL) -> Fold:
    """(url, claim, first_seen, last_seen, times_seen): claims that a URL has count on; new ones fill what room it has left, the oldest first, and others are refused."""

    def merge(old: DataFrame | None, new: DataFrame) -> DataFrame:
        both = new.withColumn("held", F.lit(False)) if old is None else old.withColumn("held", F.lit(True)).unionByName(new.withColumn("held", F.lit(False)))
        merged = both.groupBy("url", "claim").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("times_seen").alias("times_seen"), F.max("held").alias("held"))
        nth = F.row_number().over(Window.partitionBy("url").orderBy(F.desc("held"), "first_seen", "claim"))
        return merged.withColumn("nth", nth).filter(F.col("held") | (F.col("nth") <= most)).drop("nth", "held")

    return Fold("url", lambda batch: capture.claim_rows(capture.citations(batch)), merge)


fold_claims = claims()


def _opened(old: DataFrame | None, new: DataFrame) -> DataFrame:
    return incidents.open_incidents(new.sparkSession.createDataFrame([], "incident_id string, kind string, status string") if old is None else old, new)


#: batch (incident_id, kind): an incident opens once and stays, whatever its status became.
fold_incidents = Fold("incident_id", lambda batch: batch, _opened)


def _operations(batch: DataFrame) -> DataFrame:
    return batch.select("op_id", F.when(F.col("event") == "start", F.col("ts")).alias("started"), F.col("ts").alias("last"), (F.col("event") == "end").alias("ended"))


def _lasting(old: DataFrame | None, new: DataFrame) -> DataFrame:
    both = new if old is None else old.unionByName(new)
    return both.groupBy("op_id").agg(F.min("started").alias("started"), F.max("last").alias("last"), F.max("ended").alias("ended"))


#: batch (op_id, event, ts) to (op_id, started, last, ended): what began and has no end is unfinished.
fold_operations = Fold("op_id", _operations, _lasting)


def keep_index(messages: DataFrame, top: str) -> DataFrame:
    return keep(messages, top, fold_index)
