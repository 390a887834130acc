"""Comparison of repeated captures, supersession and best captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recordloom.functions.exprs import clean, first_line, fold, mask, normalise_text
from recordloom.operators.ranking import best_per_key


def first_alias(captures: DataFrame, aliases: list[Column], wanted: DataFrame, name: str = "alias") -> DataFrame:
    """The first of a capture's aliases that the watch list (column ``key``) holds; captures without one go."""
    tries = captures.select("ord", F.posexplode(F.array(*aliases)).alias("place", "key")).filter("key <> ''")
    hit = tries.join(wanted.select("key").distinct(), "key", "left_semi").groupBy("ord").agg(F.min_by("key", "place").alias(name))
    return captures.join(hit, "ord")


def all_aliases(captures: DataFrame, aliases: list[Column], wanted: DataFrame) -> DataFrame:
    """``ord, key`` for every distinct alias of a capture that is on the watch list."""
    keys = captures.select("ord", F.explode(F.array_distinct(F.array(*aliases))).alias("key")).filter("key <> ''")
    return keys.join(wanted.select("key").distinct(), "key", "left_semi").select("ord", "key")


def last_two(captures: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """D3: ``key, n_captures, previous_ord, latest_ord, previous, latest`` for every watched key."""
    top = best_per_key(captures.select(F.col(key).alias("key"), "ord"), ["key"], [F.col("ord").desc()], 2)
    pair = top.groupBy("key").agg(F.max("ord").alias("latest_ord"), F.when(F.count("*") > 1, F.min("ord")).alias("previous_ord"))
    counts = captures.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n_captures"))
    out = wanted.select("key").distinct().join(pair, "key", "left").join(counts, "key", "left")
    # only the chosen texts travel
    texts = captures.select(F.col("ord").alias("__o"), F.col(text).alias("__t"))
    for side in ("previous", "latest"):
        out = out.join(texts, F.col(f"{side}_ord") == F.col("__o"), "left").withColumnRenamed("__t", side).drop("__o")
    return out.withColumn("n_captures", F.coalesce("n_captures", F.lit(0).cast("long")))


#: Fixed values of D4: names of the kinds of change, in the order of their tests; an own list may replace them.
CHANGES = [
    "same_or_equivalent", "previous_not_found_with_extra_contamination", "previous_has_extra_after_clean_capture",
    "latest_is_subset_of_previous_review_previous_extra", "same_header_but_body_differs_review", "different_review",
]


def change_class(previous, latest, volatile: str, placeholder: str, not_found: str, names: list[str] = CHANGES) -> Column:
    """Kind of change between two captures, the first that applies."""
    same, contaminated, extra, subset, header, other = names
    stable = lambda c: mask(normalise_text(c), volatile, placeholder)
    a, b = stable(previous), stable(latest)
    return (
        F.when(a == b, same)
        .when(F.contains(a, F.lit(not_found)) & (clean(b) == not_found), contaminated)
        .when(F.startswith(a, b) & (F.length(a) > F.length(b)), extra)
        .when((b != "") & F.contains(a, b), subset)
        .when((first_line(a) != "") & (first_line(a) == first_line(b)), header)
        .otherwise(other)
    )


def compare_pairs(pairs: DataFrame, volatile: str, placeholder: str, not_found: str, phrases: list[str]) -> DataFrame:
    """Adds ``change`` and ``phrase_hits``; keys with fewer than two captures have a class of their own."""
    few = F.col("previous_ord").isNull()
    text = F.coalesce("latest", F.lit(""))
    hits = F.array_compact(F.array(*[F.when(F.contains(text, F.lit(p)), F.lit(p)) for p in phrases]))
    return pairs.withColumns({"change": F.when(few, "fewer_than_two_captures").otherwise(change_class("previous", "latest", volatile, placeholder, not_found)), "phrase_hits": hits})


def line_changes(pairs: DataFrame) -> DataFrame:
    """``key, line, change``: by how many times a line occurs more (or less) in the latest capture."""
    side = lambda c, sign: pairs.filter("previous_ord is not null").select("key", F.explode(F.split(normalise_text(c), "\n")).alias("line"), F.lit(sign).alias("n"))
    return side("previous", -1).unionByName(side("latest", 1)).groupBy("key", "line").agg(F.sum("n").alias("change")).filter("change <> 0")


def class_counts(compared: DataFrame) -> DataFrame:
    """D7."""
    return compared.groupBy("change").agg(F.count("*").alias("n"))


def latest_acceptable(captures: DataFrame, keys: DataFrame, good: Column) -> DataFrame:
    """``key, good_ord``: position of the last capture of acceptable quality; ``keys`` has ``ord, key``."""
    return keys.join(captures.filter(good).select("ord"), "ord").groupBy("key").agg(F.max("ord").alias("good_ord"))


def supersede(captures: DataFrame, keys: DataFrame, good: Column, quality: str = "quality", reason: str = "superseded") -> DataFrame:
    """Captures with downgraded quality where a later acceptable one stands in.

    A watched capture that is the latest acceptable one of none of its keys gets
    quality ``low``; the quality it had first is kept, so a second run changes
    nothing. ``superseded_by`` lists (key, position) of the captures that replace
    it, in key order; keys without an acceptable capture are left out.
    """
    latest = latest_acceptable(captures, keys, good)
    per = keys.join(latest, "key", "left").groupBy("ord").agg(
        F.bool_or(F.coalesce(F.col("ord") == F.col("good_ord"), F.lit(False))).alias("__stays"),
        F.sort_array(F.collect_list(F.when(F.col("good_ord").isNotNull(), F.struct("key", "good_ord")))).alias("__by"),
    )
    out = captures.join(per, "ord", "left")
    drop = F.coalesce(~F.col("__stays"), F.lit(False))
    first = F.coalesce(F.col("original_quality"), F.col(quality)) if "original_quality" in captures.columns else F.col(quality)
    return out.withColumns(
        {
            "original_quality": F.when(drop, first).otherwise(F.col("original_quality") if "original_quality" in captures.columns else F.lit(None).cast("string")),
            quality: F.when(drop, F.lit("low")).otherwise(F.col(quality)),
            "cleanup_reason": F.when(drop, F.lit(reason)),
            "superseded_by": F.when(drop, F.col("__by")),
        }
    ).drop("__stays", "__by")


def capture_time(capture_id) -> Column:
    """The timestamp inside a capture id: ten or more digits between colons, else blank."""
    return F.coalesce(F.regexp_extract(clean(capture_id), r":(\d{10,}):", 1), F.lit(""))


def best_display(captures: DataFrame, name, quality, needed: list, ranked: list, order: list) -> DataFrame:
    """The best usable capture per folded name (nameless ones are one group).

    Not-found and low captures go, and those where all of the ``needed`` columns
    are blank. Quality counts first, then which of the ``ranked`` columns are
    filled, in their order, then ``order``. The first row of each task's groups is
    picked before the shuffle, so a hot name does not travel.
    """
    q = clean(quality)
    rank = F.when(q == "high", 4).when(q == "medium", 3).when(q == "", 2).when(q == "low", 1).otherwise(0)
    filled = F.greatest(*[clean(c) != "" for c in needed]) if len(needed) > 1 else clean(needed[0]) != ""
    keyed = captures.filter(~q.isin("not_found", "low") & filled).withColumn("name_key", fold(name))
    return best_per_key(keyed, ["name_key"], [rank.desc(), *[(clean(c) != "").desc() for c in ranked], *order])


def index_of(captures: DataFrame, entities: DataFrame, name: str, flags: dict[str, object]) -> DataFrame:
    """Index rows with an entity id by folded name and has-field flags; ``entities`` has ``name_key, entity_id``."""
    keyed = captures.withColumn("__k", F.when(fold(name) != "", fold(name)))
    out = keyed.join(entities.select(F.col("name_key").alias("__n"), F.col("entity_id").alias("__e")), F.col("__k") == F.col("__n"), "left")
    return out.withColumns({"entity_id": F.coalesce(F.col("__e").cast("string"), F.lit("")), **{k: F.when(clean(c) != "", "yes").otherwise("no") for k, c in flags.items()}}).drop("__k", "__n", "__e")


def quality_shift(before: DataFrame, after: DataFrame, quality: str) -> DataFrame:
    """Captures per quality before and after the choice."""
    a = before.groupBy(clean(quality).alias("quality")).agg(F.count("*").alias("n_before"))
    b = after.groupBy(clean(quality).alias("quality")).agg(F.count("*").alias("n_after"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return a.join(b, "quality", "full_outer").select("quality", zero("n_before"), zero("n_after"))
