"""Keyed tables that a stream keeps: rows in hash buckets, of which a batch rewrites only those that it touches.

Under a table's folder stand ``data/epoch=N/bucket=B``, the buckets that epoch N
rewrote, and ``manifest/epoch=N``, one small file that says for every bucket
which epoch's files hold it now. The manifest is written last: until it is
there, readers see the table of the epoch before. An epoch that is run again
reads the manifest before its own and writes its files anew, so that nothing
counts twice. Files that neither of the last two manifests names are removed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Merge = Callable[[DataFrame | None, DataFrame], DataFrame]


class Buckets:
    """A table keyed by one column. buckets is fixed when the table is made: a batch of few keys rewrites few of them."""

    def __init__(self, spark: SparkSession, top: str, key: str, buckets: int = 64, kept: int = 2):
        self.spark, self.top, self.key, self.n, self.kept = spark, top, key, buckets, kept

    def _manifests(self) -> dict[int, dict[int, int]]:
        """epoch -> bucket -> epoch of its files; at most kept + 1 manifests of n rows are ever there."""
        try:
            rows = self.spark.read.parquet(f"{self.top}/manifest").select("epoch", "bucket", "held").collect()
        except AnalysisException:
            return {}
        found: dict[int, dict[int, int]] = {}
        for r in rows:
            entry = found.setdefault(int(r["epoch"]), {})
            if r["bucket"] is not None:
                entry[r["bucket"]] = r["held"]
        return found

    def _files(self, held: dict[int, int], buckets: set[int] | None = None) -> DataFrame | None:
        where = [f"{self.top}/data/epoch={e}/bucket={b}" for b, e in sorted(held.items()) if buckets is None or b in buckets]
        return self.spark.read.parquet(*where) if where else None

    def read(self, before: int | None = None) -> DataFrame | None:
        """The table now, or before an epoch; None where it never had a row."""
        manifests = {e: held for e, held in self._manifests().items() if before is None or e < before}
        return self._files(manifests[max(manifests)]) if manifests else None

    def last_epoch(self) -> int:
        return max(self._manifests(), default=-1)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.n)).cast("int")

    def merge(self, epoch: int, rows: DataFrame, merge: Merge) -> int:
        """Fold rows into the table as this epoch; merge(old, rows) works key by key. Returns the number of buckets rewritten."""
        manifests = self._manifests()
        earlier = [e for e in manifests if e < epoch]
        held = dict(manifests[max(earlier)]) if earlier else {}
        rows = rows.persist()
        try:
            touched = {r[0] for r in rows.select(self.bucket()).distinct().collect()}  # no more than n numbers
            if touched:
                made = merge(self._files(held, touched), rows).withColumn("__bucket", self.bucket())
                target = f"{self.top}/data/epoch={epoch}"
                made.withColumnRenamed("__bucket", "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
                held = {b: e for b, e in held.items() if b not in touched} | dict.fromkeys(self._written(target), epoch)
        finally:
            rows.unpersist()
        self._commit(epoch, held)
        self._vacuum(manifests | {epoch: held})
        return len(touched)

    def _written(self, target: str) -> list[int]:
        try:
            return [r[0] for r in self.spark.read.parquet(target).select("bucket").distinct().collect()]
        except AnalysisException:  # every touched bucket came out empty
            return []

    def _commit(self, epoch: int, held: dict[int, int]) -> None:
        rows = sorted(held.items()) or [(None, None)]
        self.spark.createDataFrame(rows, "bucket int, held long").coalesce(1).write.mode("overwrite").parquet(f"{self.top}/manifest/epoch={epoch}")

    def _vacuum(self, manifests: dict[int, dict[int, int]]) -> None:
        newest = sorted(manifests)[-self.kept :]
        named = {(b, e) for k in newest for b, e in manifests[k].items()}
        for k in sorted(set(manifests) - set(newest)):
            for b, e in manifests[k].items():
                if (b, e) not in named:
                    self._remove(f"{self.top}/data/epoch={e}/bucket={b}")
            self._remove(f"{self.top}/manifest/epoch={k}")

    def _remove(self, where: str) -> None:
        """Through Hadoop, so that any store that Spark writes to will do."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def newest(key: str) -> Merge:
    """A merge that replaces the row of a key."""
    return lambda old, rows: rows if old is None else old.join(rows.select(key), key, "left_anti").unionByName(rows)
