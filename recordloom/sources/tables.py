"""Sources and sinks: capture archives, headed CSV, name lists (A1 to A5)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from recordloom.functions.exprs import clean
from recordloom.sources.members import archive_members

_PARSED = T.StructType([T.StructField(n, T.StringType()) for n in "header display_name character_name query_name epithet_or_title role descriptor race class level status last_login_text last_login_estimated_date captured_date body_text".split()])
CAPTURE = T.StructType(
    [T.StructField(n, T.StringType()) for n in "query_name raw_text raw_html raw_decho raw_colour_format capture_quality capture_id captured_at captured_datetime captured_date captured_epoch".split()]
    + [T.StructField("source_queue", T.StructType([T.StructField("sent_at", T.StringType())])), T.StructField("parsed", _PARSED)]
)
ARCHIVE = T.StructType(
    [
        T.StructField("version", T.StringType()),
        T.StructField("captures", T.ArrayType(T.StringType())),  # as JSON text: members need not be objects
        T.StructField("records", T.MapType(T.StringType(), T.StructType([T.StructField("latest", _PARSED)]))),
    ]
)


def read_archive(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A1: archive objects with ``captures`` and ``records``, one per file or, with ``lines``, one per line, so that files split; one without either stops the job."""
    df = spark.read.schema(ARCHIVE).option("multiLine", not lines).json(path)
    whole = F.col("captures").isNotNull() & F.col("records").isNotNull()
    bad = F.raise_error(F.lit("archive needs the members captures and records"))
    return df.withColumn("captures", F.when(whole, F.col("captures")).otherwise(bad))


def archive_captures(archive: DataFrame) -> DataFrame:
    """A1: captures in order (``ord``); members that are no objects are skipped."""
    return _captures(archive.select(F.posexplode("captures").alias("ord", "c")))


def _captures(members: DataFrame) -> DataFrame:
    rows = members.select("ord", F.from_json("c", CAPTURE).alias("c")).filter("c is not null")
    some = F.coalesce(*[F.col(f"c.{n}").cast("string") for n in CAPTURE.fieldNames() if n not in ("parsed", "source_queue")], F.col("c.parsed").cast("string"))
    return rows.filter(some.isNotNull()).select("ord", "c.*")


def archive_snapshots(archive: DataFrame) -> DataFrame:
    """A1: the latest snapshot of every record key."""
    return archive.select(F.explode("records").alias("key", "r")).filter("r.latest is not null").select("key", "r.latest.*")


def split_archives(spark: SparkSession, path: str, chunk: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """A1 for large objects: captures and snapshots, as above, of one object per file; a file is read by as many tasks as it has blocks (``members.archive_members``)."""
    members = archive_members(spark, path, {"captures": "[", "records": "{"}, chunk)
    captures = _captures(members.filter("section = 'captures'").select("ord", F.col("text").alias("c")))
    entry = F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), ARCHIVE["records"].dataType)
    return captures, archive_snapshots(members.filter("section = 'records'").select(entry.alias("records")))


def read_capture_lines(spark: SparkSession, path: str) -> DataFrame:
    """A1 at scale: one capture per line, so that files split."""
    return spark.read.schema(CAPTURE).json(path)


def read_csv(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """A2: a headed CSV as cleaned strings of the given fields; absent columns are blank, a missing file is empty."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(conf).exists(place):
        return spark.createDataFrame([], T.StructType([T.StructField(f, T.StringType()) for f in fields]))
    df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    have = {c.lstrip("﻿"): c for c in df.columns}
    return df.select(*[(clean(F.col(f"`{have[f]}`")) if f in have else F.lit("")).alias(f) for f in fields])


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """A3: one name per line, blanks dropped."""
    return spark.read.text(path).select(clean("value").alias("name")).filter("name <> ''")


def write_table(df: DataFrame, path: str, columns: list[str], fmt: str = "parquet") -> None:
    """A4: the given columns in order, replacing what is there."""
    out = df.select(*[f"`{c}`" for c in columns]).write.mode("overwrite")
    (out.option("header", True).option("quote", '"').option("escape", '"').csv(path) if fmt == "csv" else out.format(fmt).save(path))


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """A4 with buckets: a table of the session's catalog, dealt and sorted by a key once; joins and groups by it need no shuffle later."""
    name = "bucketed_" + uuid.uuid4().hex
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def write_names(df: DataFrame, path: str, column: str = "name") -> None:
    """A5: one name per line."""
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)
