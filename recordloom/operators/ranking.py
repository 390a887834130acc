"""Picking rows by order: best, first, last, numbered and capped per key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from recordloom.sources.scratch import materialize


def rank_in(keys, order, name: str = "__rank") -> tuple[str, Column]:
    return name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def best_per_key(df: DataFrame, keys: list, order: list, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key; ties must be settled by the order itself."""
    name, rank = rank_in(keys, order)
    return df.withColumn(name, rank).filter(F.col(name) <= n).drop(name)


def numbered(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """Place of each row in its group, from 1, for groups of any size.

    Rows are dealt by ranges of key and order, so a hot group spreads over many
    tasks; only the groups' counts per range meet. The ranges are stored, as the
    counts must be those of the rows they are joined with.
    """
    part, local, before = "__range", "__local", "__before"
    ranged = df.repartitionByRange(*keys, *order).withColumn(part, F.spark_partition_id())
    ranged = materialize(ranged.withColumn(local, F.row_number().over(Window.partitionBy(part, *keys).orderBy(*order))), "numbered")
    counts = ranged.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("__n"))
    earlier = F.sum("__n").over(Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*[F.col(k).alias(f"__{k}_of") for k in keys], F.col(part).alias("__of"), F.coalesce(earlier, F.lit(0)).alias(before))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}_of")) for k in keys], F.col(part) == F.col("__of"))
    return ranged.join(offsets, same).withColumn(name, F.col(before) + F.col(local)).select(*df.columns, name)


def islands(df: DataFrame, keys: list[str], pos: str, gap: int, name: str = "island") -> DataFrame:
    """Number of each row's run in its group, from 1: rows of a run are at most ``gap`` apart; for groups of any size.

    A segmented scan: rows are dealt by ranges of key and position and stored; each
    range counts the runs that begin in it, and only its ends and counts per group
    meet, to tell whether its first run goes on from the range before.
    """
    part, begins = "__range", "__begins"
    by = Window.partitionBy(part, *keys).orderBy(pos)
    ranged = materialize(df.repartitionByRange(*keys, pos).withColumn(part, F.spark_partition_id()), "islands")
    ranged = ranged.withColumn(begins, F.when(F.col(pos) - F.lag(pos).over(by) <= gap, 0).otherwise(1)).withColumn("__local", F.sum(begins).over(by))
    ends = ranged.groupBy(*keys, part).agg(F.min(pos).alias("__first"), F.max(pos).alias("__last"), F.sum(begins).alias("__n"))
    ordered = Window.partitionBy(*keys).orderBy(part)
    ends = ends.withColumn("__on", F.when(F.col("__first") - F.lag("__last").over(ordered) <= gap, 1).otherwise(0))
    before = F.coalesce(F.sum(F.col("__n") - F.col("__on")).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("__on")
    ends = ends.select(*[F.col(k).alias(f"__{k}_of") for k in keys], F.col(part).alias("__of"), before.alias("__before"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}_of")) for k in keys], F.col(part) == F.col("__of"))
    return ranged.join(ends, same).withColumn(name, F.col("__before") + F.col("__local")).select(*df.columns, name)


def _with_numbers(df: DataFrame, numbers: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` with the column that ``numbers`` has for its keys (null-safe); wide rows travel once, here."""
    n = numbers.select(*[F.col(k).alias(f"__of_{k}") for k in keys], name)
    return df.join(n, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys])).select(*df.columns, name)


def numbered_slugs(df: DataFrame, slug: str, order: list[str], name: str = "page_slug") -> DataFrame:
    """The first of equal slugs stays bare, the next get -2, -3 and so on.

    ``order`` (column names) settles ties; only it and the slugs are numbered.
    """
    numbers = numbered(df.select(slug, *order), [slug], order, "__k")
    k = F.col("__k")
    numbers = numbers.withColumn(name, F.when(k == 1, F.col(slug)).otherwise(F.concat(slug, F.lit("-"), k.cast("string"))))
    return _with_numbers(df, numbers, [slug, *order], name)


def mint_ids(new: DataFrame, base: str, order: list[str], taken: DataFrame, name: str = "minted_id", separator: str = "_") -> DataFrame:
    """Ids from a base: the bare base, then suffixes from 2, skipping ids in ``taken`` (column ``id``).

    The k-th new row of a base gets its k-th free suffix. A taken number t, the
    j-th of its base, has t - j free ones below it, so it stands just before the
    (t - j + 1)-th new row; with both kinds of rows in this order, a new row's
    number is its place. Only the taken numbers of bases that are minted travel;
    a base may have any number of either. ``order`` (column names) settles ties;
    only it and the bases are numbered.
    """
    bases = new.select(F.col(base).alias("__b")).distinct()
    whole = taken.select(F.col("id").alias("__b"), F.lit(1).alias("__n"))
    tail = F.regexp_extract("id", rf"{separator}(\d+)$", 1)
    parts = taken.filter(tail != "").select(F.regexp_replace("id", rf"{separator}\d+$", "").alias("__b"), tail.try_cast("int").alias("__n"), "id")
    parts = parts.filter((F.col("__n") >= 2) & (F.col("id") == F.concat("__b", F.lit(separator), F.col("__n").cast("string")))).drop("id")
    used = whole.unionByName(parts).distinct().join(bases, "__b", "left_semi").withColumn("__new", F.lit(0))
    rows = new.select(F.col(base).alias("__b"), *order).withColumns({"__n": F.lit(None).cast("int"), "__new": F.lit(1)})
    both = numbered(rows.unionByName(used, allowMissingColumns=True), ["__b", "__new"], ["__n", *order], "__k")
    both = both.withColumn("__at", F.when(F.col("__new") == 1, F.col("__k")).otherwise(F.col("__n") - F.col("__k") + 1))
    out = numbered(both, ["__b"], ["__at", "__new"], "__place").filter("__new = 1")
    place = F.col("__place")
    out = out.withColumn(name, F.when(place == 1, F.col("__b")).otherwise(F.concat("__b", F.lit(separator), place.cast("string")))).withColumnRenamed("__b", base)
    return _with_numbers(new, out.select(base, *order, name), [base, *order], name)
