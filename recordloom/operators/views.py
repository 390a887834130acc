"""Derived views: one row per entity from many candidate rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from recordloom.functions.exprs import clean, fold
from recordloom.operators.ranking import best_per_key
from recordloom.sources.tables import write_bucketed


def points(rules: list[tuple[Column, object]]) -> Column:
    """Sum of the points whose condition holds; a null condition does not."""
    return reduce(lambda a, b: a + b, [F.when(c, p if isinstance(p, Column) else F.lit(p)).otherwise(F.lit(0)) for c, p in rules])


def best_by_score(rows: DataFrame, keys: list[str], rules: list[tuple[Column, object]], order: list, name: str = "score") -> DataFrame:
    """H1, H4, H9: the row with most points per key; ties go to the first in ``order``."""
    return best_per_key(rows.withColumn(name, points(rules)), keys, [F.col(name).desc(), *order])


def best_by_id_and_name(rows: DataFrame, id_col: str, name_col: str, rules: list[tuple[Column, object]], order: list, name: str = "score") -> tuple[DataFrame, DataFrame]:
    """H9: the row with most points per id and per folded name (columns ``key`` and those of ``rows``); blank ids and names are no keys."""
    pick = lambda key: best_by_score(rows.withColumn("key", key).filter("key <> ''"), ["key"], rules, order, name)
    return pick(clean(id_col)), pick(fold(name_col))


def classification_points(status: str, ranks: dict[str, int], fields: dict[str, int], attribute: str, confidence: Column, suspect: str, penalty: int = 20) -> list[tuple[Column, object]]:
    """H1: rules of a classification: 100 per status rank, points per filled field, the attribute's confidence, a penalty."""
    rules = [(clean(status) == s, r * 100) for s, r in ranks.items()] + [(clean(f) != "", p) for f, p in fields.items()]
    return [*rules, (clean(attribute) != "", F.lit(5) + confidence), (clean(status) == suspect, -penalty)]


def by_id_then_name(entities: DataFrame, rows: DataFrame, id_col: str, name_col: str, row_id: str, row_name: str, only_unnamed: bool = False) -> DataFrame:
    """H2: for every entity the rows with its id or, if there is none, those with its folded name.

    Blank ids and names never match and stay out of both joins. With
    ``only_unnamed`` rows are found by name only when they have no id. Returns
    the entity's id as ``entity``, how it was found as ``found_by``, and the row.
    """
    e = entities.select(F.col(id_col).cast("string").alias("entity"), fold(name_col).alias("__name"))
    r = rows.withColumns({"__rid": clean(row_id), "__rname": fold(row_name)})
    hit = e.join(r.filter("__rid <> ''"), F.col("entity") == F.col("__rid")).withColumn("found_by", F.lit("id"))
    rest = e.join(r.filter("__rid <> ''").select(F.col("__rid").alias("entity")).distinct(), "entity", "left_anti").filter("__name <> ''")
    named = r.filter("__rname <> ''")
    named = named.filter("__rid = ''") if only_unnamed else named
    by_name = rest.join(named, F.col("__name") == F.col("__rname")).withColumn("found_by", F.lit("name"))
    return hit.unionByName(by_name).drop("__name", "__rid", "__rname")


def usable_links(links: DataFrame, status: str = "status", accepted=("accepted",)) -> DataFrame:
    """H3: links whose status is blank or accepted."""
    return links.filter((clean(status) == "") | clean(status).isin(*accepted))


def one_per_entity(entities: DataFrame, entity: str, best: DataFrame, key: str, counts: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """H5, H6: every entity once, with its best row's columns or the defaults, and its candidate count ``n_candidates``."""
    b = best.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in defaults])
    n = counts.groupBy(F.col(key).alias("__n")).agg(F.count("*").alias("n_candidates"))
    out = entities.join(b, F.col(entity) == F.col("__k"), "left").join(n, F.col(entity) == F.col("__n"), "left")
    out = out.withColumns({c: F.coalesce(F.col(f"__{c}"), F.lit(v)) for c, v in defaults.items()}).withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0).cast("long")))
    return out.drop("__k", "__n", *[f"__{c}" for c in defaults])


def needs_review(status: str, statuses: list[str]) -> Column:
    """H7."""
    return F.coalesce(F.col(status).isin(*statuses), F.lit(False))


def profile(df: DataFrame, attributes: list[str], blank: str = "(blank)") -> DataFrame:
    """H8: ``attribute, value, n`` of several attributes in one pass."""
    pair = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.coalesce(F.nullif(F.col(a).cast("string"), F.lit("")), F.lit(blank)).alias("value")) for a in attributes]))
    return df.select(pair.alias("p")).groupBy("p.attribute", "p.value").agg(F.count("*").alias("n"))


def count_summary(rows: DataFrame, key: str, value: str, order: str, name: str) -> DataFrame:
    """``key``, and ``k:v`` counts of a value, most frequent first, ties by first occurrence."""
    per = rows.groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("f"))
    parts = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("a"), F.col("f").alias("b"), F.concat(F.col(value), F.lit(":"), F.col("n").cast("string")).alias("t"))))
    return per.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "; ").alias(name))


def mention_rollup(mentions: DataFrame, key: str, order: str, names: int = 12, match: Callable[..., Column] = fold) -> DataFrame:
    """Per key the mentions in all, of high confidence, matched, by kind, and the first distinct names (one if ``match`` makes them equal)."""
    totals = mentions.groupBy(key).agg(F.count("*").alias("n_mentions"), F.count_if(F.col("confidence") == "high").alias("n_high"), F.count_if(F.col("matched")).alias("n_matched"))
    kinds = count_summary(mentions, key, "kind", order, "kinds")
    first = mentions.groupBy(key, match("name").alias("__f")).agg(F.min(order).alias("o"), F.min_by("name", order).alias("name"))
    first = best_per_key(first, [key], ["o"], names)
    listed = first.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "name"))), lambda x: x["name"]), "; ").alias("names"))
    return totals.join(kinds, key).join(listed, key)


def art_rollup(art: DataFrame, key: str, score: str) -> DataFrame:
    """H11."""
    return art.groupBy(key).agg(F.lit("yes").alias("has_art"), F.count("*").alias("n_art"), F.max(score).alias("best_art"))


def group_rollup(groups: DataFrame, key: str, order: str) -> DataFrame:
    """H12."""
    return groups.groupBy(key).agg(F.count("*").alias("n_groups")).join(count_summary(groups, key, "confidence", order, "group_confidence"), key)


def manifest(base: DataFrame, key: str, *rollups: tuple[DataFrame, dict[str, object]]) -> DataFrame:
    """One row per entity of ``base``; each roll-up (one row per key) is joined with defaults for its absence."""
    out = base
    for k, (df, defaults) in enumerate(rollups):
        side = df.select(F.col(key).alias(f"__k{k}"), *[F.col(c).alias(f"__{c}") for c in defaults])
        out = out.join(side, F.col(key) == F.col(f"__k{k}"), "left")
        out = out.withColumns({c: F.coalesce(F.col(f"__{c}"), F.lit(v)) for c, v in defaults.items()}).drop(f"__k{k}", *[f"__{c}" for c in defaults])
    return out


def stored_rollups(path: str, key: str, buckets: int, **tables: DataFrame) -> dict[str, DataFrame]:
    """Base table and roll-ups stored in the same buckets of their key, so that ``one_per_entity`` and ``manifest`` join them without a shuffle, now and later."""
    return {name: write_bucketed(df, f"{path}/{name}", key, buckets) for name, df in tables.items()}


def page_review(flag: Column, groups: Column, mentions: Column) -> Column:
    """Flagged, or any group, or any mention."""
    return flag | (groups > 0) | (mentions > 0)


def core_counts(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Rows in all and per condition, in one aggregate."""
    return df.agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in conditions.items()])
