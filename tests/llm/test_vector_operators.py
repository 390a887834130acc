"""Hard negatives, near duplicates of vectors and vector codes against plain versions in Python."""

import collections
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import multiindex, negatives, vectorcodes, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, kept string, cls string, entry string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], l, "x", "x", "x") for i, v, l in rows], SCHEMA)


def planted(n=900, dim=16, seed=5):
    """Groups of copies and near copies around few centres, ties, zero, null and broken vectors, repeated ids and rows."""
    r = np.random.default_rng(seed)
    base = r.normal(size=(12, dim))
    rows = []
    for i in range(n):
        v = base[r.integers(12)] + r.normal(size=dim) * r.choice([0.0, 0.02, 0.08, 0.5, 1.5])
        rows.append((i, list(v / np.linalg.norm(v)), int(r.integers(0, 3))))
    rows += [(n + 1, None, 1), (n + 2, [0.0] * dim, 1), (n + 3, [None] + [0.1] * (dim - 1), 1), (n + 4, [float("nan")] * dim, 1), (n + 5, [float("inf")] + [0.0] * (dim - 1), 2), (n + 6, rows[0][1], None)]
    rows += [rows[50], rows[50], (100, rows[3][1], rows[3][2]), (100, rows[4][1], 1), (None, rows[5][1], rows[5][2]), (None, rows[5][1], rows[5][2]), (n + 7, [], 1), (n + 8, rows[6][1][: dim // 2], 1)]
    return rows


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def padded(v, dim):
    return [*(float(np.float32(x)) for x in v), *([0.0] * (dim - len(v)))]


def plain_negatives(rows, anchor, positives=5, wanted=3):
    dim = max((len(v) for _, v, l in rows if good(v)), default=0)
    kept = {(math.inf if i is None else i, l, tuple(math.floor(256 * x) for x in padded(v, dim))) for i, v, l in rows if l is not None and good(v)}
    kept = sorted(kept)
    m = np.array([k[2] for k in kept], np.int64).reshape(len(kept), dim)
    shown = lambda i: None if i == math.inf else i
    out = []
    for k, (i, l, v) in enumerate(kept):
        if i == math.inf or not anchor(i):
            continue
        s = m @ m[k]
        order = sorted((x for x in range(len(kept)) if x != k), key=lambda x: (-s[x], *kept[x]))
        near = [x for x in order if kept[x][1] == l][:positives]
        for p in near:
            far = [x for x in order if kept[x][1] != l and 50 * s[p] <= 100 * s[x] <= 95 * s[p]][:wanted]
            out += [(i, shown(kept[p][0]), rank + 1, shown(kept[x][0]), int(s[p]), int(s[x])) for rank, x in enumerate(far)]
    return collections.Counter(out)


@pytest.mark.parametrize("segment, part, clusters, members", [(4096, 8192, 32, 256), (64, 50, 4, 5)])
def test_negatives_equal_brute_force(spark, monkeypatch, segment, part, clusters, members):
    """Both as one list and as many short segments, parts and clusters."""
    for name, value in (("SEGMENT", segment), ("PART", part), ("MEMBERS", members), ("BLOCK", 16), ("STEP", 32)):
        monkeypatch.setattr(negatives, name, value)
    rows = planted()
    got = negatives.hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0, clusters=clusters)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert collections.Counter(tuple(r) for r in got.collect()) == plain_negatives(rows, lambda i: i % 10 == 0)


def test_walk_ends_early():
    """Members stop once the bound of what follows is below what they need: the far end of a list is not scored."""
    import pyarrow as pa

    r = np.random.default_rng(1)
    centre = np.zeros(8)
    centre[0] = 1
    near = np.floor(256 * (centre + r.normal(size=(40, 8)) * 0.05)).astype(np.int64)
    far = np.floor(256 * -(centre + r.normal(size=(5000, 8)) * 0.05)).astype(np.int64)
    rows, scored = np.concatenate([near, far]), []
    bound = np.linalg.norm(rows, axis=1) * np.cos(np.maximum(0, np.arccos(rows[:, 0] / np.linalg.norm(rows, axis=1)) - 0.3)) + 1
    entries = pa.table({"cls": np.arange(len(rows)), "label": np.zeros(len(rows), np.int64), "vec": pa.array(rows.tolist(), pa.list_(pa.int32())), "ids": pa.array([[i] for i in range(len(rows))], pa.list_(pa.int64())), "bound": bound})
    queries = pa.table({"q": [0], "label": [0], "vec": pa.array([near[0].tolist()], pa.list_(pa.int32())), "norm": [float(np.linalg.norm(near[0]))], "low": [-(1 << 62)], "high": [1 << 62], "need": [-(1 << 62)]})
    product = negatives._product
    negatives._product = lambda a, b: scored.append(len(b)) or product(a, b)
    try:
        out = negatives.walk(entries, queries, 3, True, 8).to_pylist()
    finally:
        negatives._product = product
    s = rows @ near[0]
    assert [x["id"] for x in out] == sorted(range(len(rows)), key=lambda i: (-s[i], i))[:3] and sum(scored) <= negatives.STEP


def test_negatives_of_nothing(spark):
    none = table(spark, [])
    assert negatives.hard_negatives(none, F.col("vec_id") % 50 == 0).count() == 0
    assert negatives.hard_negatives(table(spark, planted(60)), F.lit(False)).count() == 0
    with pytest.raises(Exception, match="too large"):
        negatives.hard_negatives(table(spark, [(0, [1e6], 1)]), F.lit(True)).collect()


def plain_links(rows, cosine=0.98):
    dim = max((len(v) for _, v, _ in rows if good(v)), default=0)
    live = [k for k, (_, v, l) in enumerate(rows) if l is not None and good(v) and any(v)]
    m = vectors.unit(np.array([padded(rows[k][1], dim) for k in live]).reshape(len(live), dim))
    hit = (m @ m.T >= cosine) & (np.array([rows[k][2] for k in live])[:, None] == np.array([rows[k][2] for k in live])[None, :])
    np.fill_diagonal(hit, False)
    root = np.arange(len(live))
    while True:
        new = np.minimum(root, np.where(hit, root[None, :], len(live)).min(1, initial=len(live)))
        if (new == root).all():
            break
        root = new
    least = {}
    for x, k in zip(root, live):
        if rows[k][0] is not None:
            least[x] = min(least.get(x, math.inf), rows[k][0])
    at = dict(zip(live, range(len(live))))
    out = []
    for k, (i, _, _) in enumerate(rows):
        own = least.get(root[at[k]]) if k in at else i
        out.append((i, int(hit[at[k]].sum()) if k in at else 0, own, i == own))
    return collections.Counter(out)


@pytest.mark.parametrize("cell, block, recall", [(1024, 4096, multiindex.RECALL), (4, 7, multiindex.RECALL), (4, 4096, 1.0)])
def test_near_vectors_equal_brute_force(spark, monkeypatch, cell, block, recall):
    """With few large cells and with many small ones in blocks: every link is found and none below the threshold."""
    for name, value in (("CELL", cell), ("BLOCK", block), ("STEP", 5)):
        monkeypatch.setattr(multiindex, name, value)
    rows = planted()
    got = multiindex.near_vectors(table(spark, rows), recall=recall)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert collections.Counter(tuple(r) for r in got.collect()) == plain_links(rows)


def test_near_vectors_of_nothing(spark):
    assert multiindex.near_vectors(table(spark, [])).count() == 0
    rows = [(7, None, 1), (8, [0.0, 0.0], 1), (9, [1.0, 0.0], None), (3, [], 2)]
    assert sorted(tuple(r) for r in multiindex.near_vectors(table(spark, rows)).collect()) == [(i, 0, i, True) for i in (3, 7, 8, 9)]


def test_traversal_visits_nearest_cells_first():
    r = np.random.default_rng(3)
    first, second = (np.abs(r.normal(size=(50, 6))) * 0.2 for _ in range(2))
    for m in (first, second):
        m[np.arange(50), r.integers(0, 6, 50)] = 0
    reach = 0.2
    for x, y, cells in zip(first, second, multiindex.nearest_cells(first, second, reach, 1.0, 0.025)):
        cost = (x[:, None] ** 2 + y[None, :] ** 2).reshape(-1)
        assert set(cells) == set(np.flatnonzero(cost <= reach**2 * (1 + 1e-9)))
        assert (np.diff(cost[cells]) >= -1e-12).all()
    some = multiindex.nearest_cells(first, second, reach, 0.99, 0.025)
    assert all(len(a) <= len(b) for a, b in zip(some, multiindex.nearest_cells(first, second, reach, 1.0, 0.025))) and all(len(c) for c in some)


def test_recall_of_near_pairs():
    """Pairs at exactly the least cosine, in random directions: the wanted share lies in visited cells."""
    r = np.random.default_rng(9)
    dim, n = 64, 20_000
    x = vectors.unit(r.normal(size=(n, dim)))
    away = r.normal(size=(n, dim))
    away = vectors.unit(away - (away * x).sum(1)[:, None] * x)
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * away
    books = [vectors.codebook(vectors.unit(r.normal(size=(4000, dim)))[:, :32], 8) for _ in range(2)]
    margin = lambda m: [multiindex.margins(h, c) for h, c in zip((m[:, :32], m[:, 32:]), books)]
    (_, a), (_, b) = margin(x)
    (i, _), (j, _) = margin(y)
    hit = [cell in set(c) for c, cell in zip(multiindex.nearest_cells(a, b, 0.2, 0.999, 0.2 / 8), i * 8 + j)]
    assert np.mean(hit) >= 0.999


def plain_codes(rows, parts=8, entries=16, rounds=6):
    live = [r for r in rows if good(r[1])]
    dim = max((len(r[1]) for r in live), default=0)
    size = -(-dim // parts) or 1
    vec = [[math.floor(4096 * x) for x in padded(v, size * parts)] for _, v, _ in live]
    order = sorted(range(len(live)), key=lambda k: (math.inf if live[k][0] is None else live[k][0], [math.floor(4096 * float(np.float32(x))) for x in live[k][1]]))
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(vec[k], p) for k in order[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = collections.defaultdict(list)
            for v in vec:
                own[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k])] if k in own else e for k, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    best = [[near(cut(v, p), books[p]) for p in range(parts)] for v in vec]
    total = collections.Counter()
    for (_, _, l), b in zip(live, best):
        total[l] += sum(d for d, _ in b)
    return collections.Counter((i, "".join(f"{k:02x}" for _, k in b), sum(d for d, _ in b), total[l], digest) for (i, _, l), b in zip(live, best))


@pytest.mark.parametrize("rows", [planted(), planted(120, dim=13, seed=8), planted(60)[:3], []], ids=["some", "uneven", "few", "none"])
def test_codes_equal_brute_force(spark, rows):
    got = vectorcodes.vector_codes(table(spark, rows))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert collections.Counter(tuple(r) for r in got.collect()) == plain_codes(rows)


def test_only_changed_parts_travel(spark, monkeypatch):
    """What is dealt in a round are the parts that changed their entry, and all live where their entry does."""
    dealt, settled = [], vectorcodes._settled

    def watch(movers, tasks, work, name):
        out = settled(movers, tasks, work, name)
        dealt.append((movers.count(), out.count()))
        return out

    monkeypatch.setattr(vectorcodes, "_settled", watch)
    rows = planted(300)
    n = vectorcodes.vector_codes(table(spark, rows)).count()
    assert dealt[0][0] == 8 * n and all(a == b for a, b in dealt) and sum(a for a, _ in dealt[1:]) < 8 * n
