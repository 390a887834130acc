"""Tables in buckets by key, of which a merge rewrites only those that it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from recordloom.functions.exprs import fold
from recordloom.sources.scratch import materialize

_BUCKET = "bucket"


class BucketTable:
    """A Parquet table with a folder per bucket, a bucket being a hash of the folded key.

    ``merge`` works on the buckets of the rows that come in and replaces their
    folders; all other files stay as they are. The new rows are complete in the
    shared folder before any old file goes, so a failed merge can be run again.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 256):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def _dealt(self, rows: DataFrame, key: str) -> DataFrame:
        return rows.withColumn(_BUCKET, F.pmod(F.xxhash64(fold(key)), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame) -> None:
        """Replaces the folders of the buckets that ``rows`` have."""
        rows.repartition(_BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_BUCKET).parquet(self.path)

    def create(self, rows: DataFrame) -> None:
        self._write(self._dealt(rows, self.key))

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop(_BUCKET)

    def merge(self, new: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame], key: str | None = None) -> list[int]:
        """Puts ``apply(old, new)`` in the place of the touched buckets and returns their numbers.

        ``apply`` sees the old rows of the touched buckets and all new rows. Its
        result has the table's columns and may hold keys of these buckets only.
        """
        dealt = materialize(self._dealt(new, key or self.key), "incoming")
        touched = sorted(r[0] for r in dealt.select(_BUCKET).distinct().collect())  # as many as there are buckets, at most
        if not touched:
            return []
        old = self.spark.read.parquet(self.path)
        merged = apply(old.filter(F.col(_BUCKET).isin(touched)).drop(_BUCKET), dealt.drop(_BUCKET)).select(*[c for c in old.columns if c != _BUCKET])
        self._write(materialize(self._dealt(merged, self.key), "merged"))
        self.spark.catalog.refreshByPath(self.path)
        return touched
