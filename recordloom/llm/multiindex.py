"""Near duplicates of vectors by an inverted multi-index.

The two halves of a unit vector are quantised by codebooks of their own, whose
product is a grid of cells. A vector visits the cells nearest to it, in the order
of the multi-sequence algorithm, until the cells left hold a link with a chance
below 1 - recall; vectors that share a visited cell are verified in double
precision. Copies are one class from the start; blocks of a cell are compared in
separate tasks that hand back link counts and spanning edges, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from recordloom.llm.components import connected_components
from recordloom.llm.names import quoted
from recordloom.llm.vectors import codebook, finite, matrix, sample_matrix, squared_distances, unit, width
from recordloom.sources.scratch import Scratch, materialize

#: Least cosine of a link; wanted chance that a pair at that cosine is compared (1: certainty).
COSINE, RECALL = 0.98, 0.99999
#: Rows per cell of an even grid, entries of a codebook at most, vectors that codebooks are fitted on at most (first by a hash of the vector).
CELL, MOST_ENTRIES, SAMPLE = 1024, 64, 16_384
#: Rows of a block in verification, rows multiplied at a time.
BLOCK, STEP = 4096, 256
_TAIL = np.vectorize(lambda z: 0.5 * math.erfc(z / math.sqrt(2)), otypes=[float])


def margins(half: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Own entry of each row, and how far each entry's cell is away: the distance to the plane between it and the own entry."""
    d = squared_distances(half, centres)
    own = d.argmin(1) if len(d) else np.zeros(0, np.int64)
    apart = np.sqrt(squared_distances(centres, centres))[own]
    least = d[np.arange(len(d)), own][:, None]
    return own, np.where(apart > 0, (d - least) / np.where(apart > 0, 2 * apart, 1), 0.0)


def nearest_cells(first: np.ndarray, second: np.ndarray, reach: float, recall: float, spread: float) -> list[np.ndarray]:
    """For each row, the cells to visit (``i * k + j``), nearest first.

    ``first`` and ``second`` are the margins to the entries of both codebooks. A
    vector within ``reach`` can only lie in cells with first^2 + second^2 <= reach^2,
    so the traversal ends there at the latest. Before, it ends once the chance that
    a vector at that distance, in a direction of no preference (``spread`` is
    its standard deviation along one axis), lies in a cell not visited is at most
    1 - recall. All rows step through their sequences together.
    """
    n, k = second.shape
    a, b = np.argsort(first, 1, kind="stable"), np.argsort(second, 1, kind="stable")
    s, t = np.take_along_axis(first, a, 1), np.take_along_axis(second, b, 1)
    p, q = (np.where(x > 0, _TAIL(x / spread), 1.0) for x in (s, t))
    left = p.sum(1) * q.sum(1)
    # the next unvisited column in each row of the grid; the cheapest of these is the next cell
    at = np.zeros(s.shape, np.int64)
    cost = s**2 + t[:, :1] ** 2 if n else np.zeros(s.shape)
    rows = np.arange(n)
    found_row, found_cell = [], []
    while len(rows):
        i = cost[rows].argmin(1)
        low = cost[rows, i]
        go = low <= reach**2 * (1 + 1e-9)
        rows, i = rows[go], i[go]
        j = at[rows, i]
        found_row.append(rows)
        found_cell.append(a[rows, i] * k + b[rows, j])
        left[rows] -= p[rows, i] * q[rows, j]
        at[rows, i] += 1
        more = at[rows, i] < k
        cost[rows, i] = np.where(more, s[rows, i] ** 2 + t[rows, np.minimum(at[rows, i], k - 1)] ** 2, np.inf)
        rows = rows[(left[rows] > 1 - recall) | (recall >= 1)]
    row, cell = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_row, found_cell))
    order = np.argsort(row, kind="stable")
    return np.split(cell[order], np.cumsum(np.bincount(row, minlength=n))[:-1]) if n else []


def _placed(classes: DataFrame, books: tuple[np.ndarray, np.ndarray], dim: int, cosine: float, recall: float) -> DataFrame:
    """Classes with ``cell``, their own, and ``visits``, those of the visited cells that come after it."""
    reach = math.sqrt(max(0.0, 2 - 2 * cosine))
    spread = max(reach, 1e-12) / math.sqrt(max(dim, 1))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = unit(matrix(batch.column(2), dim))
            (i, first), (j, second) = (margins(h, c) for h, c in zip((u[:, : dim // 2], u[:, dim // 2 :]), books))
            k = len(books[1])
            own = i * k + j
            cells = [c[c > x] for c, x in zip(nearest_cells(first, second, reach, recall, spread), own)]
            at = np.concatenate([[0], np.cumsum([len(c) for c in cells])]).astype(np.int32)
            visits = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*cells, np.zeros(0, np.int64)]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), visits], ["node", "label", "vec", "copies", "cell", "visits"])

    kind = classes.schema["vec"].dataType.simpleString()
    label = classes.schema["label"].dataType.simpleString()
    return classes.select("node", "label", "vec", "copies").mapInArrow(place, f"node long, label {label}, vec {kind}, copies long, cell int, visits array<int>")


def _roots(hits: np.ndarray, width_: int, same: bool) -> np.ndarray:
    """Smallest index that each node reaches over links; ``hits`` are packed bits of rows against columns."""
    n = len(hits)
    root = np.arange(n if same else n + width_)
    base = 0 if same else n
    while True:
        new = root.copy()
        for x in range(0, n, STEP):
            bits = np.unpackbits(hits[x : x + STEP], axis=1, count=width_).astype(bool)
            r = np.arange(x, min(x + STEP, n))
            reached = np.where(bits, root[None, base : base + width_], len(root)).min(1, initial=len(root))
            new[r] = np.minimum(new[r], reached)
            back = np.where(bits, root[r][:, None], len(root)).min(0, initial=len(root))
            new[base : base + width_] = np.minimum(new[base : base + width_], back)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def compare(rows: pa.Table, dim: int, cosine: float) -> pa.Table:
    """Links and spanning edges of one pair of blocks (``side`` 0 against 1, or 0 alone within itself): ``node, links, root``."""
    side = rows.column("side").to_numpy()
    parts = [rows.filter(pa.array(side == x)) for x in (0, 1)]
    same = rows.column("i")[0].as_py() == rows.column("j")[0].as_py()
    a, b = parts[0], parts[0] if same else parts[1]
    u, v = (unit(matrix(x.column("vec"), dim)) for x in (a, b))
    packed, one, other = [], np.zeros(len(u), np.int64), np.zeros(len(v), np.int64)
    weight, own = b.column("copies").to_numpy(), a.column("copies").to_numpy()
    for x in range(0, len(u), STEP):
        hit = u[x : x + STEP] @ v.T >= cosine
        if same:
            r = np.arange(len(hit))
            hit[r, r + x] = False
        one[x : x + STEP] = hit @ weight
        other += own[x : x + STEP] @ hit
        packed.append(np.packbits(hit, axis=1))
    some, there = np.flatnonzero(one), np.flatnonzero(other)
    if not len(some):
        return pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
    node = np.concatenate([a.column("node").to_numpy(), *([] if same else [b.column("node").to_numpy()])])
    links = one if same else np.concatenate([one, other])
    root = _roots(np.concatenate(packed), len(v), same)
    full = some if same else np.concatenate([some, there + len(u)])
    return pa.table({"node": node[full], "links": links[full], "root": node[root[full]]})


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors of one label (not null) whose cosine in double precision is at least
    ``cosine`` are linked; no pair below it is. ``n_links`` counts the other rows
    linked directly, ``component_id`` is the smallest id that links reach, and the
    row with that id is kept. Vectors that are null, zero or hold null or
    non-finite components, and those without a label, link with nothing and are
    kept. Shorter vectors count as filled up with zeros. Repeated rows are links
    of each other. Rows without an id link but never name a component; they are
    kept if no row of theirs has an id.

    Copies (equal label and vector, by a 128-bit digest) are one class, so a hot
    vector is one row in the index. Codebooks are fitted on a sample; every row is
    indexed. Of two vectors, the one whose own cell comes first visits the other's,
    so each pair meets once. Cells of any size are split into blocks.
    """
    work = Scratch(rows.sparkSession, "multiindex")
    given = rows.select(quoted(id_col).alias("vec_id"), quoted(label_col).alias("label"), quoted(vector_col).alias("vec"))
    good = F.col("label").isNotNull() & finite(F.col("vec")) & F.coalesce(F.exists("vec", lambda x: x != 0), F.lit(False))
    halves = F.when(good, F.xxhash64("label", "vec")).alias("d1"), F.when(good, F.xxhash64(F.lit("again"), "vec", "label")).alias("d2")
    given = given.select("vec_id", "label", "vec", *halves)
    classes = given.filter("d1 is not null").groupBy("d1", "d2").agg(F.any_value("label").alias("label"), F.any_value("vec").alias("vec"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("rep"))
    classes = work.store(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    dim, n = width(classes, "vec"), classes.count()

    k = max(2, min(MOST_ENTRIES, math.ceil(math.sqrt(n / CELL))))
    sample = unit(sample_matrix(classes, "vec", SAMPLE, dim))
    books = tuple(codebook(h, k) if h.shape[1] and len(h) else np.zeros((1, h.shape[1])) for h in (sample[:, : dim // 2], sample[:, dim // 2 :]))
    placed = work.store(_placed(classes, books, dim, cosine, recall), "placed")

    # blocks of each cell: its own rows, and rows that visit it
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int").alias(c)
    own = placed.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("own"))
    come = placed.select("label", F.explode("visits").alias("cell")).groupBy("label", "cell").agg(F.count(F.lit(1)).alias("come"))
    cells = work.store(own.join(come, ["label", "cell"], "left").select("label", "cell", blocks("own"), F.coalesce(blocks("come"), F.lit(0)).alias("come")), "cells")
    narrow = placed.select("node", "label", "vec", "copies", "cell").join(cells, ["label", "cell"])
    block = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    side = lambda i, j, s: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(s).alias("side"))
    mine = narrow.withColumn("b", block("own"))
    # blocks of a cell's rows are 0, 1, ..., blocks of its visitors -1, -2, ...
    as_first = F.transform(F.sequence(F.col("b"), F.col("own") - 1), lambda x: side(F.col("b"), x, 0))
    as_second = F.transform(F.filter(F.sequence(F.lit(0), F.col("own") - 1), lambda x: x < F.col("b")), lambda x: side(x, F.col("b"), 1))
    met = F.transform(F.filter(F.sequence(F.lit(0), F.col("come")), lambda x: x > 0), lambda x: side(-x, F.col("b"), 1))
    mine = mine.withColumn("t", F.explode(F.concat(as_first, as_second, met)))
    guests = placed.select("node", "label", "vec", "copies", F.explode("visits").alias("cell")).join(cells, ["label", "cell"]).withColumn("b", -1 - block("come"))
    guests = guests.withColumn("t", F.explode(F.transform(F.sequence(F.lit(0), F.col("own") - 1), lambda x: side(F.col("b"), x, 0))))
    names = ["label", "cell", "t.i", "t.j", "t.side", "node", "copies", "vec"]
    each = mine.select(*names).unionByName(guests.select(*names))
    compared = each.groupBy("label", "cell", "i", "j").applyInArrow(lambda t: compare(t, dim, cosine), "node long, links long, root long")
    compared = work.store(compared, "compared")

    joined = connected_components(compared.select(F.col("node").alias("u"), F.col("root").alias("v")), "vector-components")
    named = work.store(joined.withColumnRenamed("label", "component").join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("least")), "named")
    counted = work.store(compared.groupBy("node").agg(F.sum("links").alias("links")), "counted")
    known = joined.withColumnRenamed("label", "component").join(named, "component").join(counted, "node").select("node", "least", "links")
    known = classes.select("node", "d1", "d2", "rep", "copies").join(work.store(known, "linked"), "node", "left")
    least = F.when(F.col("links").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id")
    known = work.store(known.select("d1", "d2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), least), "known")
    ids = given.select("vec_id", "d1", "d2")
    full = ids.filter("d1 is not null").join(known, ["d1", "d2"]).select("vec_id", "n_links", "component_id")
    none = ids.filter("d1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = full.unionByName(none).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    out = materialize(out, "near-vectors")
    work.close()
    return out


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.id AS u, b.id AS v FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id
  WHERE list_cosine_similarity(a.vec, b.vec) >= 0.98
), reach(id, low) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT l.v, r.low FROM reach r JOIN links l ON l.u = r.id WHERE r.low < l.v
), least AS (
  SELECT id, min(low) AS component_id FROM reach GROUP BY id
), degree AS (
  SELECT u AS id, count(*) AS n FROM links GROUP BY u
)
SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l ON l.id = e.vec_id LEFT JOIN degree d ON d.id = e.vec_id
"""
