"""A store of 256-bit digests that answers which of a batch are new without reading all of them.

Digests lie in a folder per batch and prefix. Beside them every block of digests
(a longer prefix) has a Bloom filter, a bitmap of 32,768 bits, so a batch first
meets the filters, whose size does not grow with what is stored, and reads only
the prefixes in which a digest may have been seen. A filter errs on one side:
it never calls a stored digest new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recordloom.sources.scratch import materialize

#: Bits of a filter, and how many of them a digest sets; each comes from four hexadecimal digits of its own.
BITS, SET = 32_768, 4
_FILTERS, _DIGESTS = "prefix string, block string, bits binary", "digest string, batch long, prefix string"


class DigestStore:
    """Digests by batch; batches have consecutive numbers from 0 and may be replayed.

    ``prefix`` hexadecimal digits make a folder, ``block`` more of them a filter
    (with the defaults 4,096 filters, enough for some 13 million digests at one false
    hit in a hundred; with more digests, more prefixes are read, and results stay
    right). Every ``merge``-th batch writes all filters anew, so at most that many
    versions of one are read.
    """

    def __init__(self, spark: SparkSession, path: str, prefix: int = 2, block: int = 1, merge: int = 10):
        self.spark, self.path, self.prefix, self.block, self.merge = spark, path, prefix, block, merge

    def _keyed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({"prefix": F.substring("digest", 1, self.prefix), "block": F.substring("digest", self.prefix + 1, self.block)})

    def _places(self) -> list[Column]:
        """The bits of a digest: digits from the end, which neither prefix nor block take."""
        return [F.conv(F.substring("digest", 61 - 4 * k, 4), 16, 10).cast("long") % BITS for k in range(SET)]

    def _filters(self, batch: int) -> DataFrame | None:
        """Filters over all batches before this one."""
        merged = batch - batch % self.merge - 1  # the last batch that wrote all filters
        paths = [f"{self.path}/filters/batch={k}" for k in range(max(merged, 0), batch)]
        if not paths:
            return None
        return self.spark.read.schema(_FILTERS).parquet(*paths).groupBy("prefix", "block").agg(F.bitmap_or_agg("bits").alias("bits"))

    def unseen(self, batch: int, rows: DataFrame) -> tuple[DataFrame, dict]:
        """The rows (with ``digest``) whose digest no earlier batch stored, and what was read: prefixes and files."""
        filters = self._filters(batch)
        if filters is None:
            return rows, {"prefixes": [], "files": []}
        byte = lambda p: F.conv(F.hex(F.substring("bits", (p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        maybe = F.col("bits").isNotNull()
        for p in self._places():
            maybe = maybe & (F.call_function("shiftright", byte(p), (p % 8).cast("int")) % 2 == 1)
        asked = self._keyed(rows).join(filters, ["prefix", "block"], "left").withColumn("maybe", maybe).drop("bits", "block")
        asked = materialize(asked, "asked")
        prefixes = sorted(r["prefix"] for r in asked.filter("maybe").select("prefix").distinct().collect())  # as many as there are prefixes, at most
        if not prefixes:
            return asked.select(*rows.columns), {"prefixes": [], "files": []}
        paths = [f"{self.path}/digests/batch=*/prefix={p}" for p in prefixes]
        stored = self.spark.read.schema(_DIGESTS).option("basePath", f"{self.path}/digests").parquet(*paths)
        new = asked.join(stored.filter(F.col("batch") < batch).select("digest"), "digest", "left_anti")
        return new.select(*rows.columns), {"prefixes": prefixes, "files": stored.inputFiles()}

    def add(self, batch: int, digests: DataFrame) -> None:
        """Stores a batch's digests and filters in folders of its own; a replay overwrites them."""
        keyed = self._keyed(digests.select("digest"))
        keyed.select("digest", "prefix").repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(f"{self.path}/digests/batch={batch}")
        # from what is stored, so that both always agree
        stored = self._keyed(self.spark.read.schema("digest string").parquet(f"{self.path}/digests/batch={batch}"))
        bits = stored.select("prefix", "block", F.explode(F.array(*self._places())).alias("place")).groupBy("prefix", "block").agg(F.bitmap_construct_agg("place").alias("bits"))
        if batch % self.merge == self.merge - 1 and (old := self._filters(batch)) is not None:
            bits = old.unionByName(bits).groupBy("prefix", "block").agg(F.bitmap_or_agg("bits").alias("bits"))
        bits.write.mode("overwrite").parquet(f"{self.path}/filters/batch={batch}")
