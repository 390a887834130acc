"""C14: intake that may run again at any time, over files as they arrive.

Each micro-batch is deduplicated within itself and against the digests of what
is stored, and overwrites folders of its own, so a replayed batch gives the same
rows. Of the stored digests it reads the prefixes that their filters cannot rule out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery

from recordloom.operators.intake import capture_digest, captures_of, first_of_digest
from recordloom.sources.digests import DigestStore


def stream_intake(
    spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, keys: list[str], order: list, fmt: str = "parquet", files: int | None = None, prefix: int = 2
) -> StreamingQuery:
    """Starts a query that takes all files present now and ends; a batch has at most ``files`` of them.

    ``target`` has one ``batch=`` folder per batch, ``target-digests`` the digest store,
    and ``target-log`` one row per batch: new rows, and the prefixes and number of files that were read.
    """

    def take(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        store = DigestStore(session, f"{target}-digests", prefix)
        digested = batch.withColumn("digest", capture_digest(keys))
        new, read = store.unseen(number, first_of_digest(digested, order))
        captures_of(digested, new, order).select(*batch.columns).write.mode("overwrite").parquet(f"{target}/batch={number}")
        # from what is stored, so that both always agree
        stored = session.read.schema(batch.schema).parquet(f"{target}/batch={number}")
        store.add(number, stored.select(capture_digest(keys).alias("digest")))
        log = session.createDataFrame([(stored.count(), read["prefixes"], len(read["files"]))], "new long, prefixes array<string>, files long")
        log.write.mode("overwrite").parquet(f"{target}-log/batch={number}")

    stream = spark.readStream.schema(schema).format(fmt)
    stream = (stream.option("maxFilesPerTrigger", files) if files else stream).load(source)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
