"""Review sets and work queues."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from recordloom.functions.exprs import clean, fold, is_checked
from recordloom.operators.ranking import best_per_key, numbered


def work_queue(queue: DataFrame, name: str, checked: str | None, order: str, priority: tuple[str, str] | None = None, limit: int | None = None) -> DataFrame:
    """Names to look at: blank and checked rows go, one exact priority if asked, the first per folded name, in order.

    A limit of 0 gives no rows. The limit is the feature; without one all names come.
    """
    rows = queue.filter(clean(name) != "")
    rows = rows.filter(~is_checked(checked)) if checked else rows
    rows = rows.filter(clean(priority[0]) == priority[1]) if priority else rows
    rows = best_per_key(rows.withColumn("__key", fold(name)), ["__key"], [order]).drop("__key")
    return rows if limit is None else rows.orderBy(order).limit(limit)


def bucket_samples(rows: DataFrame, buckets: dict[str, tuple[Column, int | None]], order: list) -> DataFrame:
    """The first rows of each bucket up to its cap (None: all); a row may fall into several.

    Capped buckets are cut to the greatest cap in each task before they travel. The
    rows of a bucket without a cap are numbered by ranges, so it may have any size.
    """
    def sample(some: dict[str, tuple[Column, int | None]]) -> DataFrame:
        hit = F.explode(F.array_compact(F.array(*[F.when(c, F.struct(F.lit(b).alias("bucket"), F.lit(n).cast("int").alias("cap"))) for b, (c, n) in some.items()])))
        each = rows.withColumn("__b", hit).withColumns({"bucket": F.col("__b.bucket"), "__cap": F.col("__b.cap")}).drop("__b")
        most = [n for _, n in some.values() if n is not None]
        if not most:
            return numbered(each, ["bucket"], order, "place").drop("__cap")
        each = each.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy(*order)))
        return each.filter(F.col("place") <= max(most)).filter(F.col("place") <= F.col("__cap")).drop("__cap")

    parts = [{b: v for b, v in buckets.items() if (v[1] is None) == free} for free in (False, True)]
    return reduce(DataFrame.unionByName, [sample(p) for p in parts if p])


def kind_samples(rows: DataFrame, kind: str, caps: dict[str, int], order: list) -> DataFrame:
    """The first rows of each listed kind, as many as its cap."""
    cap = reduce(lambda e, r: e.when(F.col(kind) == r[0], r[1]), caps.items(), F.when(F.lit(False), 0))
    place = F.row_number().over(Window.partitionBy(kind).orderBy(*order))
    # the literal limit lets each task keep its first rows only
    return rows.filter(F.col(kind).isin(*caps)).withColumn("place", place).filter(F.col("place") <= max(caps.values())).filter(F.col("place") <= cap)


def kind_counts(rows: DataFrame, kind: str) -> DataFrame:
    """Rows of every kind."""
    return rows.groupBy(kind).agg(F.count("*").alias("n"))


def top_by_score(rows: DataFrame, score: str, order: list, n: int = 25) -> DataFrame:
    """The ``n`` highest scores; what is no number counts 0."""
    return rows.withColumn("score", F.coalesce(F.col(score).try_cast("double"), F.lit(0.0))).orderBy(F.col("score").desc(), *order).limit(n)


def cover_sample(rows: DataFrame, name: str, order: str, preferred: list[str], predicates: dict[str, Column], most: int = 25) -> DataFrame:
    """Preferred names first (the last row of a name counts), then for each predicate the first row not chosen yet.

    Only the first (preferred + predicates) rows of each predicate are gathered,
    as no more can be taken before it; the greedy choice folds over that bounded
    array.
    """
    k = len(predicates) + len(preferred)
    wanted = rows.withColumn("__n", fold(name)).filter(F.col("__n").isin(*[p.lower() for p in preferred]))
    wanted = best_per_key(wanted, ["__n"], [F.col(order).desc()])
    place = reduce(lambda e, p: e.when(F.col("__n") == p[1].lower(), p[0]), enumerate(preferred), F.when(F.lit(False), 0))
    parts = [wanted.select(F.lit(0).alias("step"), place.cast("long").alias("place"), F.col(order).alias("row"))]
    for i, c in enumerate(predicates.values()):
        parts.append(rows.filter(c).select(F.lit(i + 1).alias("step"), F.col(order).cast("long").alias("place"), F.col(order).alias("row")).orderBy(order).limit(k))
    gathered = reduce(DataFrame.unionByName, parts).agg(F.sort_array(F.collect_list(F.struct("step", "place", "row"))).alias("all"))
    start = F.struct(F.array().cast("array<bigint>").alias("rows"), F.array().cast("array<int>").alias("steps"))
    fresh = lambda a, x: ~F.array_contains(a["rows"], x["row"]) & ((x["step"] == 0) | ~F.array_contains(a["steps"], x["step"])) & (F.size(a["rows"]) < most)
    # all steps whose row is taken are marked, so each predicate adds one row at most
    chosen = gathered.select(
        F.aggregate("all", start, lambda a, x: F.when(fresh(a, x), F.struct(F.array_append(a["rows"], x["row"].cast("long")).alias("rows"), F.array_append(a["steps"], x["step"]).alias("steps"))).otherwise(a)).alias("c")
    )
    picked = chosen.select(F.posexplode("c.rows").alias("pick", "__row"))
    return rows.join(picked, F.col(order) == F.col("__row")).drop("__row")


def mention_detail(mentions: DataFrame, key: str, order: str, pages: DataFrame, page_name: str, page: str, cap: int = 40, match: Callable[..., Column] = fold) -> DataFrame:
    """The first ``cap`` mentions per entity without repeats of (name, kind, heading), each with its page if there is one.

    Names are one name, and a page's, if ``match`` makes them equal.
    """
    capped = best_per_key(mentions, [key], [order], cap)
    once = best_per_key(capped.withColumn("__f", match("name")), [key, "__f", "kind", "heading"], [order])
    target = pages.select(match(page_name).alias("__p"), F.col(page).alias("page")).groupBy("__p").agg(F.min("page").alias("page"))
    return once.join(target, F.col("__f") == F.col("__p"), "left").drop("__f", "__p")


def detail_cap(rows: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """I8: the first ``n`` rows per entity."""
    return best_per_key(rows, [key], order, n)
