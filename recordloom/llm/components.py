"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from recordloom.sources.scratch import Scratch, materialize


def _key(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return r["n"], r["h"]


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``node, label`` for every node of ``edges`` (long columns ``u``, ``v``); the label is the smallest node.

    Neighbourhoods are never gathered: each step is an aggregate (combined before
    its shuffle), stored, and an equi-join of two stored tables, so that Spark can
    split a hub that a large part of all edges share. Self loops, repeated edges,
    null ends and an empty table are fine.
    """
    work = Scratch(edges.sparkSession, label)
    turned = lambda e: e.select(F.col("v").alias("u"), F.col("u").alias("v"))
    given = work.store(edges.select("u", "v").distinct(), "edges")
    now = work.store(given.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "now-0")
    seen, k = _key(now), 0
    while seen[0]:
        both = now.unionByName(turned(now))
        low = work.store(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), f"low-{k}")
        large = work.store(both.join(low, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"large-{k}")
        least = work.store(large.groupBy("u").agg(F.min("v").alias("m")), f"least-{k}")
        small = turned(large.join(least, "u").filter("v <> m").select(F.col("m").alias("u"), "v")).unionByName(least.select("u", F.col("m").alias("v")))
        k += 1
        now = work.store(small.distinct(), f"now-{k}")
        work.drop(*(f"{name}-{k - 1}" for name in ("low", "large", "least", "now")))
        key = _key(now)
        if key == seen:
            break
        seen = key
    # every node but the smallest of its component has one edge now, to that smallest
    alone = given.select(F.explode(F.array("u", "v")).alias("node")).filter("node is not null").distinct()
    out = alone.join(now.select(F.col("u").alias("node"), F.col("v").alias("label")), "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    out = materialize(out, label)
    work.close()
    return out
