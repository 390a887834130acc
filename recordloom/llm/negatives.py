"""Hard-negative mining over lists that the anchors of a cluster share.

Anchors are clustered by direction. For a cluster, every row has one upper bound
on its inner product with any unit anchor inside: its length times the cosine of
its angle to the centre less the cluster's widest angle. Rows are sorted by that
bound once per cluster; all members walk the sorted list together, segment by
segment, and each stops when the bound of what follows is below what it still
needs. The result is therefore exact. The list is walked once for the positives
and once for the negatives, whose window the positives' scores set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from recordloom.llm.names import quoted
from recordloom.llm.vectors import codebook, finite, floored, matrix, sample_matrix, unit, width
from recordloom.sources.scratch import Scratch, materialize

#: Clusters at most, wanted members of one, anchors that centres are fitted on at most (first by a hash of the vector).
CLUSTERS, MEMBERS, SAMPLE = 32, 256, 4096
#: Rows of a list's first segment (each later one is four times as long), list rows and asking rows of a task, list rows scored at a time.
SEGMENT, PART, BLOCK, STEP = 4096, 8192, 1024, 512
#: What rounding may add to a bound, relative to a row's length.
SLACK = 1e-6
_NO_ID = (1 << 63) - 1


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _first(query: np.ndarray, score: np.ndarray, row: np.ndarray, cls: np.ndarray, want: int) -> np.ndarray:
    """Indexes of the best ``want`` entries of each query: highest score, then smallest id."""
    order = np.lexsort((cls, row, -score, query))
    q = query[order]
    start = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return order[rank < want]


def walk(entries: pa.Table, queries: pa.Table, want: int, same: bool, dim: int) -> pa.Table:
    """Best rows of one part of a list for each query: ``q, score, id, cls``; the list is walked by falling bound."""
    entries = entries.take(np.argsort(-entries.column("bound").to_numpy(), kind="stable"))
    e, bound, label = matrix(entries.column("vec"), dim, np.int64), entries.column("bound").to_numpy(), entries.column("label").to_numpy()
    ids = entries.column("ids").combine_chunks()
    id_at, id_of, cls = np.concatenate([[0], np.cumsum(np.asarray(ids.value_lengths()))]), ids.flatten().to_numpy(zero_copy_only=False), entries.column("cls").to_numpy()
    m, norm, own = matrix(queries.column("vec"), dim, np.int64), queries.column("norm").to_numpy(), queries.column("label").to_numpy()
    low, high, need = queries.column("low").to_numpy(), queries.column("high").to_numpy(), queries.column("need").to_numpy().copy()
    best = [np.zeros(0, np.int64)] * 4  # query, score, id, class
    for a in range(0, len(e), STEP):
        live = np.flatnonzero(norm * bound[a] >= need)
        if not len(live):
            break
        b = min(a + STEP, len(e))
        s = _product(m[live], e[a:b])
        hit = (s >= np.maximum(low, need)[live, None]) & (s <= high[live, None]) & ((label[a:b][None, :] == own[live, None]) == same)
        r, c = np.nonzero(hit)
        n = id_at[a + c + 1] - id_at[a + c]
        place = np.repeat(id_at[a + c] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        found = [np.repeat(live[r], n), np.repeat(s[r, c], n), id_of[place], np.repeat(cls[a + c], n)]
        best = [np.concatenate(x) for x in zip(best, found)]
        keep = _first(*best, want)
        best = [x[keep] for x in best]
        count = np.bincount(best[0], minlength=len(m))
        worst = np.full(len(m), _NO_ID)
        np.minimum.at(worst, best[0], best[1])
        need = np.where(count >= want, np.maximum(need, worst), need)
    out = [pa.array(queries.column("q").to_numpy()[best[0]]), *(pa.array(x.astype(np.int64)) for x in best[1:])]
    return pa.Table.from_arrays(out, ["q", "score", "id", "cls"])


def _lists(classes: DataFrame, centres: np.ndarray, widest: np.ndarray, dim: int) -> DataFrame:
    """``cluster, cls, bound``: every row's bound in every cluster."""

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = matrix(batch.column(1), dim)
            size = np.linalg.norm(m, axis=1)
            angle = np.arccos(np.clip(unit(m) @ centres.T, -1, 1))
            bound = size[:, None] * (np.cos(np.maximum(0, angle - widest[None, :])) + SLACK)
            k = len(centres)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(np.arange(k, dtype=np.int32), len(m))), batch.column(0).take(pa.array(np.repeat(np.arange(len(m)), k))), pa.array(bound.ravel())], ["cluster", "cls", "bound"]
            )

    return classes.select("cls", "vec").mapInArrow(bounds, "cluster int, cls long, bound double")


def _clustered(members: DataFrame, centres: np.ndarray, dim: int) -> DataFrame:
    """``members`` with their cluster, length and angle to its centre; a zero vector has none of its own."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = matrix(batch.column(2), dim)
            near = unit(m) @ centres.T
            own = near.argmax(1) if len(m) else np.zeros(0, np.int64)
            size = np.linalg.norm(m, axis=1)
            angle = np.where(size > 0, np.arccos(np.clip(near[np.arange(len(m)), own], -1, 1)), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(size), pa.array(angle)], ["cls", "label", "vec", "cluster", "norm", "angle"])

    return members.mapInArrow(place, "cls long, label long, vec array<int>, cluster int, norm double, angle double")


def _by_cluster(values: dict[int, float], kind: str) -> Column:
    """The value of a row's cluster; one per cluster, so a bounded literal."""
    return F.element_at(F.create_map(*[F.lit(x) for k, v in values.items() for x in (int(k), v)]), F.col("cluster")).cast(kind)


class _Lists:
    """The clusters' sorted lists: one stored table in the order of segment, cluster and falling bound."""

    def __init__(self, classes: DataFrame, centres: np.ndarray, widest: np.ndarray, dim: int, work: Scratch):
        self.classes, self.dim, self.work = classes, dim, work
        n, ends = classes.count(), []
        while sum(ends) < n:
            ends.append(SEGMENT * 4 ** len(ends))
        self.segments = max(1, len(ends))
        all_bounds = work.store(_lists(classes, centres, widest, dim), "bounds")
        shares = [1 - x / n for x in np.cumsum(ends)[:-1].tolist()]
        cuts = all_bounds.groupBy("cluster").agg(F.percentile_approx("bound", F.array(*[F.lit(s) for s in shares]), F.lit(10_000)).alias("cuts")).collect() if shares else []
        self.cuts = {r["cluster"]: r["cuts"] for r in cuts}  # bounds below the k-th cut stand after segment k
        segment = F.lit(0)
        for k in range(self.segments - 1):
            segment = segment + (F.col("bound") < _by_cluster({c: v[k] for c, v in self.cuts.items()}, "double")).cast("int")
        placed = all_bounds.withColumn("segment", segment)
        self.table = work.store(placed.repartitionByRange("segment", "cluster", F.desc("bound")).sortWithinPartitions("segment", "cluster", F.desc("bound")), "lists")
        work.drop("bounds")
        self.sizes = {(r["segment"], r["cluster"]): r["count"] for r in self.table.groupBy("segment", "cluster").count().collect()}

    def search(self, queries: DataFrame, want: int, same: bool, label: str) -> DataFrame:
        """``q, score, id, cls, rank`` of the best ``want`` rows of each query (``q, cluster, label, vec, norm, low, high``)."""
        work, dim, best = self.work, self.dim, None
        live = queries.withColumn("need", F.col("low"))
        order = Window.partitionBy("q").orderBy(F.desc("score"), "id", "cls")
        for k in range(self.segments):
            asking = {r["cluster"]: r["count"] for r in live.groupBy("cluster").count().collect()}
            asking = {c: n for c, n in asking.items() if self.sizes.get((k, c))}
            if asking:
                blocks = _by_cluster({c: -(-n // BLOCK) for c, n in asking.items()}, "int")
                parts = _by_cluster({c: -(-self.sizes[k, c] // PART) for c in asking}, "int")
                rows = self.table.filter((F.col("segment") == k) & F.col("cluster").isin(list(asking))).join(self.classes, "cls")
                rows = rows.withColumn("part", F.pmod(F.xxhash64("cls"), parts).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
                ask = live.filter(F.col("cluster").isin(list(asking)))
                ask = ask.withColumn("block", F.pmod(F.xxhash64("q"), blocks).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
                met = rows.select("cluster", "part", "block", "cls", "label", "vec", "ids", "bound").groupBy("cluster", "part", "block").cogroup(ask.groupBy("cluster", "part", "block"))
                found = met.applyInArrow(lambda x, y: walk(x, y, want, same, dim), "q long, score long, id long, cls long")
                found = found if best is None else found.unionByName(best.drop("rank"))
                best = work.store(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= want), f"{label}-best-{k}")
            if k + 1 == self.segments:
                break
            ahead = _by_cluster({c: v[k] for c, v in self.cuts.items()}, "double")
            if best is not None:
                done = best.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("worst"))
                live = live.join(done, "q", "left").withColumn("need", F.when(F.col("n") >= want, F.greatest("need", "worst")).otherwise(F.col("need"))).drop("n", "worst")
            live = work.store(live.filter(F.col("norm") * ahead >= F.col("need")), f"{label}-live-{k}")
        empty = "q long, score long, id long, cls long, rank int"
        return best if best is not None else queries.sparkSession.createDataFrame([], empty)


def hard_negatives(
    rows: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scale: int = 256, clusters: int = CLUSTERS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows that ``anchors`` picks.

    A score is the inner product of the integer vectors ``floor(scale * x)``;
    higher ones come first, ties by smaller id. An anchor's positives are its
    first ``positives`` other rows of its label; for each, the first ``negatives``
    rows of another label are returned whose score lies between ``least`` and
    ``most`` per cent of the positive's.

    Rows with a null label or vector, or with null or non-finite components, take
    no part. Shorter vectors count as filled up with zeros, an empty one as zeros.
    Rows equal in id, label and integer vector are one row; other rows that share
    an id are rows of their own, and ties between them go by label and vector. Rows
    without an id come last in ties and are returned as null. An empty table,
    or one without partners, gives no rows. Ids lie below 2^63 - 1; a component
    of 2^26 or more after scaling stops the job.

    Rows equal in label and vector are one entry that keeps its first ids, as no
    result can hold more of them; so are anchors, which makes hot copies cheap.
    """
    work = Scratch(rows.sparkSession, "negatives")
    vec = F.col("vec")
    given = rows.select(quoted(id_col).alias("id"), quoted(label_col).cast("long").alias("label"), quoted(vector_col).alias("vec"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    given = given.filter(F.col("label").isNotNull() & finite(vec)).withColumn("vec", floored(vec, scale)).withColumn("id", F.coalesce(F.col("id").cast("long"), F.lit(_NO_ID)))
    given = work.store(given.groupBy("id", "label", "vec").agg(F.bool_or("anchor").alias("anchor")), "rows")
    dim = width(given, "vec")

    first = F.row_number().over(Window.partitionBy("label", "vec").orderBy("id"))
    classes = given.select("id", "label", "vec").withColumn("k", first).filter(F.col("k") <= positives + 1)
    classes = classes.groupBy("label", "vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = classes.repartitionByRange("label", "vec").sortWithinPartitions("label", "vec")  # numbers in the order of ties
    classes = work.store(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    asked = work.store(given.filter("anchor").join(classes.select("label", "vec", "cls"), ["label", "vec"]).select("cls", F.col("id").alias("anchor_id")), "asked")
    members = classes.join(asked.select("cls").distinct(), "cls", "left_semi").select("cls", "label", "vec")

    n = asked.select("cls").distinct().count()
    sample = unit(sample_matrix(members, "vec", SAMPLE, dim))
    centres = unit(codebook(sample, max(1, min(clusters, n // MEMBERS)))) if n else np.zeros((1, dim))
    members = work.store(_clustered(members, centres, dim), "members")
    angles = {r["cluster"]: r["angle"] for r in members.groupBy("cluster").agg(F.max("angle").alias("angle")).collect()}
    lists = _Lists(classes, centres, np.array([angles.get(k, 0.0) for k in range(len(centres))]), dim, work)

    everything = members.select(F.col("cls").alias("q"), "cluster", "label", "vec", "norm", F.lit(-(1 << 62)).alias("low"), F.lit(1 << 62).alias("high"))
    near = lists.search(everything, positives + 1, True, "positives").select(F.col("q").alias("member"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), "cls")
    own = asked.withColumnRenamed("cls", "member").join(near, "member").filter("cls <> member or positive_id <> anchor_id")
    place = F.row_number().over(Window.partitionBy("member", "anchor_id").orderBy(F.desc("positive_score"), "positive_id", "cls"))
    own = work.store(own.withColumn("place", place).filter(F.col("place") <= positives).drop("place", "cls"), "own")

    # least * positive <= 100 * negative <= most * positive, in whole numbers
    ceiling = f"-((-{least} * positive_score - pmod(-{least} * positive_score, 100)) div 100)"
    floor = f"(({most} * positive_score - pmod({most} * positive_score, 100)) div 100)"
    windows = own.select("member", "positive_score").distinct().withColumn("low", F.expr(ceiling)).withColumn("high", F.expr(floor))
    windows = windows.filter("low <= high").join(members.select(F.col("cls").alias("member"), "cluster", "label", "vec", "norm"), "member")
    windows = work.store(windows.withColumn("q", F.monotonically_increasing_id()), "windows")
    far = lists.search(windows.select("q", "cluster", "label", "vec", "norm", "low", "high"), negatives, False, "negatives")
    far = windows.select("q", "member", "positive_score").join(far, "q").select("member", "positive_score", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    shown = lambda c: F.when(F.col(c) == _NO_ID, None).otherwise(F.col(c)).alias(c)
    out = own.join(far, ["member", "positive_score"]).select(shown("anchor_id"), shown("positive_id"), "rank", shown("negative_id"), "positive_score", "negative_score")
    out = materialize(out, "hard-negatives")
    work.close()
    return out


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").filter("label is not null")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS MATERIALIZED (
  SELECT a.id AS anchor_id, b.id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.vec, b.vec) AS BIGINT) AS score
  FROM v a JOIN v b ON a.id <> b.id
  WHERE a.id % 50 = 0
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score
  FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
 AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) <= 3
"""
