"""Hierarchical Pitman-Yor language model.

A token's context is the latest frequent word before it in its text (or the
text's beginning). Every context is a restaurant; all share one parent
restaurant over words, which rests on a uniform base. Seatings are sampled by
Gibbs sweeps: all customers of a dish leave their restaurant and are seated anew,
in one draw from their exact conditional distribution given everyone else,
however many they are.
Predictive probabilities are averaged over the samples. Totals of tables outside
a part are held at those of the last round; rounds are repeated until the totals
settle, and each sample's probabilities use the totals of that sample, so they
sum to one.

Tokens travel twice, to ranges of parts and from there to their parts: rare words are
dealt by hash, so each part holds whole words with the contexts and documents
they occur in; a part that one hot word swells is split, and only its counts meet.
Frequent words, at most 1 / SHARE of them, never travel; their counts are summed
per batch and their model is small enough to send to every task. Only per-context
totals, also bounded, come back to the driver.
"""

from __future__ import annotations

import logging
import math
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from recordloom.llm.names import quoted
from recordloom.llm.textbatch import mix, spans, utf8, word_bounds, word_hashes
from recordloom.sources.scratch import materialize

#: Least share of all tokens that makes a word frequent; hence at most 1 / SHARE of them.
SHARE = 1e-3
#: Tokens of a part, text bytes and rows of a batch, burn-in sweeps, sampled sweeps.
PART_TOKENS, BATCH_BYTES, BATCH_ROWS, BURN, SAMPLES = 600_000, 4 << 20, 1 << 15, 3, 3
#: Ranges of parts that tokens are dealt to first, at most; tokens of a lot that is dealt on.
FAN, LOT_TOKENS = 1024, 1_000_000
#: Share by which the totals of tables may still change between rounds once settled, and the most rounds.
SETTLED, MOST_ROUNDS = 0.002, 40
#: Strength of every restaurant; discounts come from the counts of counts.
STRENGTH = 1.0
#: Customers of a dish up to which numbers of seatings come from a table (beyond, from integrals), and customers drawn for at a time.
MOST_EXACT, DRAWN = 1024, 200_000
#: Points of such an integral on a side of its parabola and on a circle, points that an octave's polynomial is fitted to, and
#: the logarithm below the most likely number of tables at which others are too unlikely to count beside rounding.
SIDE, CIRCLE, NODES, UNLIKELY = 44, 64, 18, 80
#: Octaves up to this length are kept number by number.
WRITTEN_OUT = 512
#: Partial sums of (document, part) that a task gathers before it sends their sums on.
MOST_WAITING = 1_500_000
_HELD = 1 << 15
_LOG = logging.getLogger(__name__)


def _batches(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Row range, word hashes and word offsets of pieces of an Arrow batch (text in column 1)."""
    whole, bounds = utf8(batch.column(1))
    for low, high in spans(bounds, BATCH_BYTES):
        for a in range(low, high, BATCH_ROWS):  # places of rows are kept in 16 bits
            b = min(a + BATCH_ROWS, high)
            data, ends = whole[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
            start, stop, at = word_bounds(data, ends)
            yield a, b, word_hashes(data, start, stop), at


def _edges(parts: int) -> np.ndarray:
    """Hashes at which parts 1, 2, ... begin."""
    return np.array([(k << 64) // parts for k in range(1, parts)], dtype=np.uint64)


def survey(rows: DataFrame) -> tuple[np.ndarray, int, int, dict[int, int]]:
    """Sorted hashes of the frequent words, training tokens, parts, and pieces of the parts that need splitting.

    A first pass has each batch report words above a quarter of the share. A word of
    the whole share can lose a quarter of it at most that way, so sums of three
    quarters make the candidates, which a second pass counts exactly; how rows fall
    into batches makes no difference. That pass also sums up the tokens of each part.
    """

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            train = ~batch.column(2).to_numpy(zero_copy_only=False)
            for a, b, h, at in _batches(batch):
                word, n = np.unique(h, return_counts=True)
                total, of_train = len(h) + b - a, int(np.diff(at)[train[a:b]].sum() + train[a:b].sum())
                some = n >= total * SHARE / 4
                cols = [np.append(word[some].view(np.int64), 0), np.append(n[some], 0), np.append(np.zeros(some.sum(), np.int64), total), np.append(np.zeros(some.sum(), np.int64), of_train)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["word", "n", "total", "train"])

    reported = materialize(rows.mapInArrow(report, "word long, n long, total long, train long"), "frequent")
    total, train_tokens = (x or 0 for x in reported.agg(F.sum("total"), F.sum("train")).first())
    found = reported.filter("n > 0").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= 0.75 * total * SHARE).select("word").collect()
    candidates = np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64))
    parts = max(1, total // PART_TOKENS)
    edges = _edges(parts)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sizes = np.zeros(len(candidates), np.int64), np.zeros(parts, np.int64)
        for batch in batches:
            for _, _, h, _ in _batches(batch):
                place = np.minimum(np.searchsorted(candidates, h), max(len(candidates) - 1, 0))
                hit = candidates[place] == h if len(candidates) else np.zeros(len(h), bool)
                words += np.bincount(place[hit], minlength=len(words))
                sizes += np.bincount(np.searchsorted(edges, h[~hit], "right"), minlength=parts)
        some, full = np.flatnonzero(words), np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, full)), pa.array(np.append(words[some], sizes[full])), pa.array(np.append(np.ones(len(some), bool), np.zeros(len(full), bool)))], ["k", "n", "word"])

    tallied = materialize(rows.mapInArrow(tally, "k long, n long, word boolean").groupBy("word", "k").agg(F.sum("n").alias("n")), "tally")
    counts = np.zeros(len(candidates), np.int64)
    for r in tallied.filter("word").collect():
        counts[r["k"]] = r["n"]
    frequent = candidates[counts >= max(1, total * SHARE)]
    sizes = defaultdict(int)
    for r in tallied.filter(~F.col("word") & (F.col("n") > PART_TOKENS)).collect():  # parts with a hot word
        sizes[r["k"]] += r["n"]
    for word, n in zip(candidates, counts):
        if word not in frequent:
            sizes[int(np.searchsorted(edges, word, "right"))] += int(n)
    return frequent, train_tokens, parts, {k: -(-n // PART_TOKENS) for k, n in sizes.items() if n > 2 * PART_TOKENS}


def _pack(**arrays) -> bytes:
    """Named arrays one after another, behind a line that says their names, types and sizes."""
    body = [np.ascontiguousarray(v) for v in arrays.values()]
    return b"".join([";".join(f"{k}:{v.dtype.str}:{v.nbytes}" for k, v in zip(arrays, body)).encode() + b"\n", *(v.tobytes() for v in body)])


def _unpack(body) -> dict[str, np.ndarray]:
    body = memoryview(body)
    at = bytes(body[:512]).index(b"\n")
    out, place = {}, at + 1
    for said in bytes(body[:at]).decode().split(";"):
        name, kind, size = said.split(":")
        out[name] = np.frombuffer(body, np.dtype(kind), int(size) // np.dtype(kind).itemsize, place)
        place += int(size)
    return out


def _ids(column: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([column], ["doc_id"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


_DEALT = "part long, sub long, batch long, body binary, ids binary"


def _sub(number: np.ndarray, n: int) -> np.ndarray:
    """Piece of a split part that a batch's tokens go to; it depends on the batch alone, so a task run again deals alike."""
    return (mix(np.asarray(number, np.int64).view(np.uint64)) % np.uint64(n)).astype(np.int64)


class _Pieces:
    """Rows of dealt tokens."""

    def __init__(self):
        self.rows = []

    def add(self, part: int, sub: int, batch: int, body: bytes, ids: bytes | None = None) -> None:
        self.rows.append((part, sub, batch, body, ids))

    def take(self) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows) if self.rows else [[]] * 5, kinds)], ["part", "sub", "batch", "body", "ids"])
        self.rows = []
        return out


def deal(rows: DataFrame, frequent: np.ndarray, parts: int, subs: dict[int, int]) -> DataFrame:
    """``part, sub, batch, body, ids``: rare tokens by part; frequent tokens, ends and ids stay with their batch (part < 0).

    Tokens travel in two steps at every size: a batch makes at most FAN pieces, which
    go to ranges of parts, and lots of some LOT_TOKENS go on from there to their
    parts. A range is dealt to as many tasks as it has parts, by batch, so the first
    step has no fewer tasks than there are parts.
    """
    ranges = min(parts, FAN)
    bounds = np.array([k * parts // ranges for k in range(ranges + 1)])  # parts of each range
    fine = _edges(parts)
    coarse = fine[bounds[1:-1] - 1]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        pieces = _Pieces()
        for batch in batches:
            held = batch.column(2).to_numpy(zero_copy_only=False)
            for a, b, h, at in _batches(batch):
                n = np.diff(at)
                row = np.repeat(np.arange(b - a), n)
                place = np.searchsorted(frequent, h)
                known = np.zeros(len(h), bool)
                if len(frequent):
                    known = frequent[np.minimum(place, len(frequent) - 1)] == h
                fid = np.where(known, place + 1, 0).astype(np.uint16)
                # latest frequent word before each token, and before the text's end
                last = np.maximum.accumulate(np.append(-1, np.where(known, np.arange(len(h)), -1)))
                before = np.append(fid, np.uint16(0))
                ctx = np.where(last[:-1] >= at[:-1][row], before[last[:-1]], 0).astype(np.uint16)
                end_ctx = np.where(last[at[1:]] >= at[:-1], before[last[at[1:]]], 0).astype(np.uint16)
                rare = np.flatnonzero(~known)
                rare = rare[np.argsort(h[rare], kind="stable")]
                word, r, c = h[rare], row[rare].astype(np.uint16), ctx[rare] | (held[a:b][row[rare]] * np.uint16(_HELD))
                cut = np.concatenate([[0], np.searchsorted(word, coarse), [len(word)]])
                for k in np.flatnonzero(np.diff(cut)):
                    x, y = cut[k], cut[k + 1]
                    values, run = np.unique(word[x:y], return_counts=True)
                    pieces.add(int(k), -1, number, _pack(word=values, run=run.astype(np.uint32), row=r[x:y], ctx=c[x:y]))
                often = np.flatnonzero(known)
                # frequent tokens of each row, then its end
                order = np.argsort(np.concatenate([row[often], np.arange(b - a)]), kind="stable")
                body = _pack(
                    held=held[a:b], n=n, often=np.bincount(row[often], minlength=b - a),
                    word=np.concatenate([fid[often], np.full(b - a, len(frequent) + 1, np.uint16)])[order], ctx=np.concatenate([ctx[often], end_ctx])[order],
                )
                pieces.add(-1 - (number % 1_000_003), -1, number, body, _ids(batch.column(0).slice(a, b - a)))
                yield pieces.take()
                number += 1

    def deal_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, waiting, size = _Pieces(), defaultdict(list), defaultdict(int)

        def lot(q: int) -> None:
            got = waiting.pop(q)
            size.pop(q)
            numbers = np.array([number for number, _ in got], np.int64)
            word = np.concatenate([np.repeat(g["word"], g["run"]) for _, g in got])
            which = np.repeat(np.arange(len(got), dtype=np.uint32), [len(g["row"]) for _, g in got])
            row, ctx = (np.concatenate([g[c] for _, g in got]) for c in ("row", "ctx"))
            order = np.argsort(word, kind="stable")
            word, which, row, ctx = word[order], which[order], row[order], ctx[order]
            low, high = bounds[q], bounds[q + 1]
            cut = np.concatenate([[0], np.searchsorted(word, fine[low : high - 1]), [len(word)]])
            for k in np.flatnonzero(np.diff(cut)):
                at = np.arange(cut[k], cut[k + 1])
                part = int(low + k)
                subs_of = _sub(numbers[which[at]], subs[part]) if part in subs else np.full(len(at), -1)
                for sub in np.unique(subs_of):
                    some = at[subs_of == sub]
                    values, run = np.unique(word[some], return_counts=True)
                    batch, own = np.unique(which[some], return_inverse=True)
                    own = own.astype(np.uint16 if len(batch) <= 1 << 16 else np.uint32)
                    pieces.add(part, int(sub), -1, _pack(word=values, run=run.astype(np.uint32), row=row[some], ctx=ctx[some], which=own, batch=numbers[batch]))

        for batch in batches:
            part = batch.column(0).to_numpy()
            stays = np.flatnonzero(part < 0)  # frequent tokens, ends and ids
            if len(stays):
                yield batch.take(pa.array(stays))
            batch = batch.take(pa.array(np.flatnonzero(part >= 0)))
            for q, number, body in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                waiting[q].append((number, _unpack(body.as_buffer())))
                size[q] += len(waiting[q][-1][1]["row"])
                if sum(size.values()) > LOT_TOKENS:
                    lot(max(size, key=size.get))
                    yield pieces.take()
        for q in list(waiting):
            lot(q)
            yield pieces.take()

    dealt = rows.mapInArrow(split, _DEALT)
    return dealt.repartition("part", F.pmod(F.xxhash64("batch"), F.lit(-(-parts // ranges)))).mapInArrow(deal_on, _DEALT)


_STATE = "part long, sub long, batch long, pairs binary, body binary, ids binary"


def gather(dealt: DataFrame) -> DataFrame:
    """One row per part (or piece of a split part) with its words, (word, context) pairs and occurrences; batch rows pass through."""

    def build(table: pa.Table) -> pa.Table:
        names = ["part", "sub", "batch", "pairs", "body", "ids"]
        if table.column("part")[0].as_py() < 0:
            return table.append_column("pairs", pa.nulls(len(table), pa.binary())).select(names)
        got = [_unpack(x.as_buffer()) for x in table.column("body")]
        word = np.concatenate([np.repeat(g["word"], g["run"]) for g in got])
        number = np.concatenate([g["batch"][g["which"]] if "which" in g else np.full(len(g["row"]), own) for g, own in zip(got, table.column("batch").to_pylist())])
        batch, which = np.unique(number, return_inverse=True)
        row, ctx = np.concatenate([g["row"] for g in got]), np.concatenate([g["ctx"] for g in got])
        del got, number
        order = np.lexsort((ctx & (_HELD - 1), word))
        word, which, row, ctx = word[order], which[order].astype(np.uint32), row[order], ctx[order]
        train, ctx = ctx < _HELD, ctx & (_HELD - 1)
        new_word = np.append(True, word[1:] != word[:-1])
        new_pair = new_word | np.append(True, ctx[1:] != ctx[:-1])
        first = np.flatnonzero(new_pair)
        split = table.column("sub")[0].as_py() >= 0
        pairs = _pack(
            word=(np.cumsum(new_word) - 1)[first].astype(np.uint32), ctx=ctx[first],
            c=np.add.reduceat(train.astype(np.int64), first).astype(np.uint32), hash=word[new_word] if split else word[:0],
        )
        body = _pack(run=np.diff(np.append(first, len(word))).astype(np.uint32), which=which, row=row, batch=batch)
        one = [pa.array([table.column(c)[0].as_py()], pa.int64()) for c in ("part", "sub")]
        return pa.table([*one, pa.array([-1], pa.int64()), pa.array([pairs], pa.binary()), pa.array([body], pa.binary()), pa.nulls(1, pa.binary())], names=names)

    return dealt.groupBy("part", "sub").applyInArrow(build, _STATE)


def merged_pairs(state: DataFrame) -> DataFrame:
    """``part, pairs`` of the split parts: the counts of all their pieces together, with the words' hashes."""

    def merge(table: pa.Table) -> pa.Table:
        got = [_unpack(x.as_buffer()) for x in table.column("pairs")]
        word, ctx, c = np.concatenate([g["hash"][g["word"]] for g in got]), np.concatenate([g["ctx"] for g in got]), np.concatenate([g["c"] for g in got])
        order = np.lexsort((ctx, word))
        word, ctx, c = word[order], ctx[order], c[order]
        new_word = np.append(True, word[1:] != word[:-1])
        first = np.flatnonzero(new_word | np.append(True, ctx[1:] != ctx[:-1]))
        pairs = _pack(word=(np.cumsum(new_word) - 1)[first].astype(np.uint32), ctx=ctx[first], c=np.add.reduceat(c.astype(np.int64), first), hash=word[new_word])
        return pa.table({"part": table.column("part").slice(0, 1), "pairs": pa.array([pairs], pa.binary())})

    return state.filter("sub >= 0").select("part", "pairs").groupBy("part").applyInArrow(merge, "part long, pairs binary")


@lru_cache(4)
def partitions(discount: float, most: int = MOST_EXACT) -> np.ndarray:
    """Logarithms of generalised Stirling numbers: weight of all seatings of c customers (rows) at t tables (columns), up to ``most``."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0
    t = np.arange(most + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(most):
            stay = out[c] + np.log(np.maximum(c - discount * t, 0))
            out[c + 1] = np.logaddexp(stay, np.append(-np.inf, out[c, :-1]))
    return out.astype(np.float32)


@lru_cache(4)
def _tilts(discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of mean sizes, ascending, and the tilts exp(-tilt * size) at which single tables have them."""
    tilt = np.exp(np.linspace(np.log(30), np.log(1e-12), 4000))
    u = -np.expm1(-tilt)
    z = np.exp(-tilt)
    return np.log(np.maximum(discount * z * u ** (discount - 1) / -np.expm1(discount * np.log1p(-z)), 1)), tilt


def _log_sizes(tilt: np.ndarray, discount: float) -> np.ndarray:
    """Logarithm of (1 - (1 - z)^discount) / discount, the generating function of a table's size, at z = exp(-tilt)."""
    z = np.exp(-tilt)
    rest = np.log(-np.expm1(-tilt))
    far = tilt.real > 0.5  # where 1 - z would lose z's last digits
    if far.any():
        x = z[far]
        rest[far] = 0.5 * np.log1p(np.abs(x) ** 2 - 2 * x.real) + 1j * np.arctan2(-x.imag, 1 - x.real)
    return np.log(-np.expm1(discount * rest) / discount)


def log_seatings(c: int, t: np.ndarray, discount: float) -> np.ndarray:
    """Logarithms of generalised Stirling numbers of any size, c customers at t tables, less that of c!.

    The number times t! / c! is coefficient c of the t-th power of the generating
    function of a table's size. Cauchy's integral for it is summed along a parabola
    round the branch at z = 1, through the saddle point where there is one, or, if
    sizes hardly vary, round a circle. Such sums converge geometrically, so what is
    left is rounding.
    """
    t = np.asarray(t, np.float64)
    out = np.full(len(t), -math.lgamma(c + 1))  # as many tables as customers: one way
    tilt = np.maximum(np.interp(np.log(c / t), *_tilts(discount)), np.pi / c)
    z, u = np.exp(-tilt), -np.expm1(-tilt)
    mean = discount * z * u ** (discount - 1) / -np.expm1(discount * np.log(u))
    spread = np.sqrt(t * np.maximum(mean * (1 + (1 - discount) * z / u - mean), 1e-300))
    for circle in (False, True):
        some = np.flatnonzero((t < c) & ((spread < 3) == circle))
        if len(some):
            m, tables = tilt[some, None], t[some, None]
            if circle:
                step = np.full((len(some), 1), 2 * np.pi / CIRCLE)
                at, turn = m + 1j * step * np.arange(CIRCLE), np.ones(CIRCLE)
                scale = np.full(len(some), 1 / CIRCLE)
            else:
                step = np.minimum(0.2, 1 / (8 * m * spread[some, None]))
                at = 1 + 1j * step * np.arange(SIDE)
                at, turn = m * at**2, at * np.where(np.arange(SIDE) > 0, 2, 1)  # both sides are conjugate
                scale = (m * step / np.pi)[:, 0]
            start = _log_sizes(m + 0j, discount).real
            total = (turn * np.exp(tables * (_log_sizes(at, discount) - start) + c * (at - m))).real.sum(1)
            out[some] = (tables * start + c * m)[:, 0] + np.log(scale * total) - [math.lgamma(x + 1) for x in t[some]]
    return out


@lru_cache(1 << 13)
def _octave(c: int, low: int, high: int, discount: float) -> np.ndarray:
    """Logarithms of seatings of c customers at low to high tables: of each, or, if these are many, a Chebyshev polynomial's coefficients."""
    if high - low < 4 * NODES:
        return log_seatings(c, np.arange(low, high + 1), discount)
    x = np.cos(np.pi * (np.arange(NODES) + 0.5) / NODES)
    y = log_seatings(c, (low + high) / 2 + (high - low) / 2 * x, discount)
    out = 2 / NODES * (np.cos(np.pi * np.outer(np.arange(NODES), np.arange(NODES) + 0.5) / NODES) @ y)
    out[0] /= 2
    return out if high - low >= WRITTEN_OUT else np.polynomial.chebyshev.chebval(np.linspace(-1, 1, high - low + 1), out)


def log_range(c: int, low: int, high: int, discount: float) -> np.ndarray:
    """Logarithms of seatings of c customers, beyond MOST_EXACT, at low, low + 1, ..., high tables.

    They are smooth in octaves of the tables and, beyond half the customers, of the
    customers less the tables; short octaves are worked out number by number.
    """
    out, at = [], low
    while at <= high:
        if 2 * at <= c:
            a = 1 << at.bit_length() - 1
            a, b = (1, 4 * NODES - 1) if at < 4 * NODES else (max(a, 4 * NODES), min(2 * a - 1, c // 2))
        else:
            k = 1 << max((c - at).bit_length() - 1, 0)
            a, b = (c - 4 * NODES + 1, c) if c - at < 4 * NODES else (max(c - 2 * k + 1, c // 2 + 1), min(c - k, c - 4 * NODES))
        to = min(b, high)
        found = _octave(c, a, b, discount)
        if b - a < WRITTEN_OUT:
            out.append(found[at - a : to + 1 - a])
        else:
            out.append(np.polynomial.chebyshev.chebval((2 * np.arange(at, to + 1) - a - b) / (b - a), found))
        at = to + 1
    return np.concatenate(out)


@lru_cache(1 << 13)
def _steps(c: int, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of tables, each a tenth more than the last at most, and how seatings of c customers grow there, roughly."""
    grid = np.unique(np.append(np.floor(2 ** np.arange(0, np.log2(c), 0.125)), c)).astype(np.int64)
    tilt = np.interp(np.log(c / grid[:-1]), *_tilts(discount))
    return grid, _log_sizes(tilt + 0j, discount).real - np.log(grid[:-1] + 1)


def _reseat_any(c: int, weight, discount: float, draw: float) -> int:
    """Tables of one dish of any number of customers; ``draw`` is uniform in 0 to 1.

    Numbers of tables whose chance is below rounding are left out of the sum: the
    rough chances tell where, and the range grows until both its ends say so.
    """
    grid, slope = _steps(c, discount)
    slope = slope + weight(grid[:-1])
    ends = np.append(slope, slope[-1])
    rough = np.append(0, np.cumsum(np.diff(grid) * (ends[1:] + ends[:-1]) / 2))
    some = np.flatnonzero(rough >= rough.max() - UNLIKELY)
    a, b = some[0] - 2, some[-1] + 2
    while True:
        a, b = max(a, 0), min(b, len(grid) - 1)
        low, high = int(grid[a]), int(grid[b])
        w = log_range(c, low, high, discount) + np.append(0, np.cumsum(weight(np.arange(low, high))))
        w -= w.max()
        short, long = a > 0 and w[0] > -UNLIKELY / 2, b < len(grid) - 1 and w[-1] > -UNLIKELY / 2
        if not short and not long:
            break
        a, b = a - 4 * short, b + 4 * long
    w = np.cumsum(np.exp(w))
    return low + min(int(np.searchsorted(w, draw * w[-1], "right")), high - low)


def reseat(count: np.ndarray, weights, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of ``count`` customers (2 or more) of each dish, drawn given all others.

    ``weights(i, k)`` is the log weight of opening the (k + 1)-th table of dish
    ``i``. Up to MOST_EXACT customers the numbers of seatings come from a table;
    beyond, from their integral, for the same distribution.
    """
    out, d = np.empty(len(count)), round(discount, 6)
    many = np.flatnonzero(count > MOST_EXACT)
    for i, draw in zip(many.tolist(), rng.random(len(many)).tolist()):
        out[i] = _reseat_any(int(count[i]), lambda k: weights(i, k), d, draw)  # noqa: B023
    few = np.flatnonzero(count <= MOST_EXACT)
    if not len(few):
        return out
    table, at = partitions(d), 0
    ends = np.cumsum(count[few])
    while at < len(few):  # some at a time, so that memory stays small
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + DRAWN)))
        c = count[few[at:to]]
        stop = np.cumsum(c)
        start = stop - c
        item = np.repeat(np.arange(len(c)), c)
        k = np.arange(stop[-1]) - start[item]
        w = np.cumsum(weights(few[item + at], k))
        w = w - np.append(0, w)[start][item] + table[c[item], k + 1]
        w = np.exp(w - np.maximum.reduceat(w, start)[item])
        w = np.cumsum(w)
        before = np.append(0, w)[start]
        picked = np.searchsorted(w, before + rng.random(len(c)) * (w[stop - 1] - before), "right")
        out[few[at:to]] = np.clip(picked - start, 0, c - 1) + 1
        at = to
    return out


class Totals:
    """Per-context customers and tables, and the parent's customers, tables and vocabulary."""

    def __init__(self, n_ctx: int):
        self.c, self.t = np.zeros(n_ctx), np.zeros(n_ctx)
        self.words = self.parent_tables = 0.0
        self.once = np.zeros(4)  # pairs seen once and twice, words with one and two parent customers

    def add(self, other: Totals) -> None:
        self.c += other.c
        self.t += other.t
        self.words += other.words
        self.parent_tables += other.parent_tables
        self.once += other.once

    def discounts(self) -> tuple[float, float]:
        n = self.once
        pick = lambda a, b: min(0.95, max(0.05, a / (a + 2 * b))) if a else 0.5
        return pick(n[0], n[1]), pick(n[2], n[3])

    def array(self) -> np.ndarray:
        return np.concatenate([self.c, self.t, [self.words, self.parent_tables], self.once])

    @classmethod
    def of(cls, a: np.ndarray) -> Totals:
        out = cls((len(a) - 6) // 2)
        n = len(out.c)
        out.c, out.t, (out.words, out.parent_tables), out.once = a[:n].copy(), a[n : 2 * n].copy(), a[2 * n : 2 * n + 2], a[2 * n + 2 :].copy()
        return out


def totals_of(pairs: dict, tables: np.ndarray, parent: np.ndarray, n_ctx: int) -> Totals:
    out = Totals(n_ctx)
    out.c = np.bincount(pairs["ctx"], weights=pairs["c"], minlength=n_ctx)
    out.t = np.bincount(pairs["ctx"], weights=tables, minlength=n_ctx)
    customers = np.bincount(pairs["word"], weights=tables)
    out.words, out.parent_tables = float((customers > 0).sum()), float(parent.sum())
    out.once = np.array([(pairs["c"] == 1).sum(), (pairs["c"] == 2).sum(), (customers == 1).sum(), (customers == 2).sum()], float)
    return out


def first_seating(pairs: dict) -> tuple[np.ndarray, np.ndarray]:
    tables = (pairs["c"] > 0).astype(np.float64)
    return tables, (np.bincount(pairs["word"], weights=tables) > 0).astype(np.float64)


def sweeps(pairs: dict, totals: Totals, n: int, seed: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Gibbs sweeps: tables of every pair and of every word in the parent.

    In each, the customers of every pair are seated anew given all others, half of
    the pairs after the other half, and then those of every word in the parent.
    Whatever lies outside these words is held at ``totals``.
    """
    d, d0 = totals.discounts()
    rng = np.random.default_rng(seed)
    tables, parent = first_seating(pairs)
    word, ctx, c = pairs["word"], pairs["ctx"], pairs["c"]
    customers, base = np.bincount(word, weights=tables), 1 / (totals.words + 1)
    whole, fresh = STRENGTH + totals.t.sum(), (STRENGTH + d0 * totals.parent_tables) * base
    several = np.flatnonzero(c > 1)
    for _ in range(n):
        side = rng.random(len(several)) < 0.5
        for some in (several[side], several[~side]):
            w, others = word[some], customers[word[some]] - tables[some]
            room, full = STRENGTH + d * np.maximum(totals.t[ctx[some]] - tables[some], 0), d0 * parent[w]

            def weights(i, k, others=others, room=room, full=full):
                served = others[i] + k  # customers of the dish in the parent when the next table opens
                return np.log((room[i] + d * k) * (np.maximum(served - np.minimum(full[i], d0 * served), 0) + fresh) / whole)

            tables[some] = reseat(c[some], weights, d, rng)
            customers = np.bincount(word, weights=tables)
        parent = (customers > 0).astype(np.float64)
        some = np.flatnonzero(customers > 1)
        room = STRENGTH + d0 * max(totals.parent_tables, 0)
        parent[some] = reseat(customers[some].astype(np.int64), lambda i, k: np.log((room + d0 * k) * base), d0, rng)  # noqa: B023
        yield tables.copy(), parent


def settled(a: Totals, b: Totals) -> bool:
    """Whether tables per context and in the parent differ by SETTLED of all at most, chance of whole tables aside."""
    near = lambda x, y: np.abs(x - y).sum() <= SETTLED * np.sum(y) + 2 * np.sqrt(y).sum()
    return bool(near(a.t, b.t) and near(a.t.sum(), b.t.sum()) and near(np.float64(a.parent_tables), np.float64(b.parent_tables)))


def samples(pairs: dict, totals: Totals, seed: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tables of every pair and word in each sampled sweep; the same seatings for the same arguments."""
    for k, (tables, parent) in enumerate(sweeps(pairs, totals, BURN + SAMPLES, seed)):
        if k >= BURN:
            yield tables, parent


def predictive(pairs: dict, tables: np.ndarray, parent: np.ndarray, discounts: tuple[float, float], own: Totals) -> np.ndarray:
    """Probability of each pair's word in its context; ``own`` are the totals of the very seating given."""
    d, d0 = discounts
    customers = np.bincount(pairs["word"], weights=tables)
    p = (customers - d0 * parent + (STRENGTH + d0 * own.parent_tables) / (own.words + 1)) / (STRENGTH + own.t.sum())
    return (pairs["c"] - d * tables + (STRENGTH + d * own.t)[pairs["ctx"]] * p[pairs["word"]]) / (STRENGTH + own.c)[pairs["ctx"]]


def averaged(pairs: dict, totals: Totals, owns: list[Totals], seed: list[int]) -> np.ndarray:
    """Predictive probability of every pair, averaged over the samples, whose own totals are ``owns``."""
    total = np.zeros(len(pairs["c"]))
    for (tables, parent), own in zip(samples(pairs, totals, seed), owns, strict=True):
        total += predictive(pairs, tables, parent, totals.discounts(), own)
    return total / len(owns)


def _frequent_pairs(state: DataFrame) -> dict[str, np.ndarray]:
    """Training counts of (context, frequent word or end): at most 1 / SHARE squared pairs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0):
                g = _unpack(body.as_buffer())
                keep = np.repeat(~g["held"], g["often"] + 1)
                key, n = np.unique(g["word"].astype(np.int64) << 16 | g["ctx"], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.bincount(n, weights=keep, minlength=len(key)).astype(np.int64))], ["pair", "n"])

    found = state.filter("part < 0").select("body").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    key = found.column("pair").to_numpy()
    order = np.argsort(key)
    key, n = key[order], found.column("n").to_numpy()[order]
    word = key >> 16
    return {"key": key, "word": word, "ctx": key & 0xFFFF, "c": n}


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 10) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Tokens are the words, A-Z in lower case, and one end per text (null and
    empty texts have only the end). Documents whose crc32 of the id as text is
    divisible by ``fold`` are held out (a null id counts as empty text); all
    others train the model. ``base_score`` is the additive unigram model's log10
    probability of the text and ``score`` the Pitman-Yor model's. Words never seen
    share the parent's uniform base of all training words and one more. Repeated
    rows are scored alike. Without training text every token has the base's
    probability.
    """
    spark = docs.sparkSession
    held = F.crc32(F.coalesce(quoted(id_col).cast("string"), F.lit("")).cast("binary")) % fold == 0
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"), held.alias("held"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    frequent, train_tokens, parts, subs = survey(rows)
    n_ctx = len(frequent) + 1
    state = materialize(gather(deal(rows, frequent, parts, subs)), "restaurants")
    merged = materialize(merged_pairs(state), "split-parts")
    # counts of every part, whole
    whole_parts = state.filter("part >= 0 and sub < 0").select("part", "pairs").unionByName(merged)

    often = _frequent_pairs(state)

    def part_totals(pairs: dict, given: np.ndarray | None, seed: list[int], sampled: bool) -> list[Totals]:
        if given is None:
            seatings = [first_seating(pairs)]
        elif sampled:
            seatings = samples(pairs, Totals.of(given), seed)
        else:
            *_, last = sweeps(pairs, Totals.of(given), BURN, seed)
            seatings = [last]
        return [totals_of(pairs, *seating, n_ctx) for seating in seatings]

    def all_totals(given: np.ndarray | None, sampled: bool = False) -> list[Totals]:
        """Totals over all words: of the first seating, after a round at the given totals, or of each sample at them."""
        n, first = SAMPLES if sampled else 1, 2 if sampled else 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = [Totals(n_ctx) for _ in range(n)]
            for batch in batches:
                for part, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                    pairs = {k: v.astype(np.int64) for k, v in _unpack(body.as_buffer()).items() if k != "hash"}
                    for mine, more in zip(out, part_totals(pairs, given, [first, part], sampled), strict=True):
                        mine.add(more)
            value = np.concatenate([x.array() for x in out])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(value))), pa.array(value)], ["k", "v"])

        sums = whole_parts.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
        value = np.zeros(n * (2 * n_ctx + 6))
        value[sums.column("k").to_numpy()] = sums.column("v").to_numpy()
        out = [Totals.of(x) for x in value.reshape(n, -1)]
        if len(often["key"]):
            for mine, more in zip(out, part_totals(often, given, [first], sampled), strict=True):
                mine.add(more)
        return out

    (whole,) = all_totals(None)
    for k in range(1, MOST_ROUNDS + 1):
        (after,) = all_totals(whole.array())
        done, whole = settled(whole, after), after
        if done:
            break
    else:
        _LOG.warning("table totals still change after %d rounds", MOST_ROUNDS)
    _LOG.info("table totals after %d rounds: %d in contexts, %d in the parent", k, whole.t.sum(), whole.parent_tables)
    owns = all_totals(whole.array(), sampled=True)

    often_p = averaged(often, whole, owns, [2]) if len(often["key"]) else np.zeros(0)
    often_c = np.bincount(often["word"], weights=often["c"], minlength=len(frequent) + 2)
    given = spark.sparkContext.broadcast((whole.array(), [x.array() for x in owns], often["key"], often_p, often_c))  # bounded by 1 / SHARE squared
    divisor = math.log10(train_tokens + 0.1 * (whole.words + 1)) if train_tokens or whole.words else math.log10(0.1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, each, (keys, key_p, word_c) = Totals.of(given.value[0]), [Totals.of(x) for x in given.value[1]], given.value[2:]

        def record(out):
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary())], ["batch", "body", "ids"])

        def combined(waiting):
            """One row per batch: the sums of all parts that this task has seen since the last time."""
            out = []
            for number, sums in waiting.items():
                row, which = np.unique(np.concatenate([s[0] for s in sums]), return_inverse=True)
                add = lambda k: np.bincount(which, weights=np.concatenate([s[k] for s in sums]))  # noqa: E731, B023
                out.append((number, _pack(row=row, score=add(1).astype(np.float32), base=add(2), known=add(3).astype(np.uint32)), None))
            return record(out)

        waiting, n_waiting = {}, 0
        for batch in batches:
            for part, number, pairs, local, body, ids in zip(*(batch.column(k).to_pylist() for k in range(6))):
                g = _unpack(body)
                if part < 0:
                    n = g["often"] + 1
                    at = np.concatenate([[0], np.cumsum(n)])[:-1]
                    key = g["word"].astype(np.int64) << 16 | g["ctx"]
                    p = key_p[np.searchsorted(keys, key)]
                    c = word_c[g["word"]]
                    sums = [np.add.reduceat(np.log10(p), at), np.add.reduceat(np.log10(c + 0.1) - divisor, at), np.add.reduceat((c > 0).astype(np.int64), at)] if len(n) else [np.zeros(0)] * 2 + [np.zeros(0, np.int64)]
                    yield record([(number, _pack(row=np.arange(len(n), dtype=np.uint16), score=sums[0], base=sums[1], known=sums[2].astype(np.uint32), held=g["held"], n=g["n"]), ids)])
                    continue
                q = {k: v.astype(np.int64) for k, v in _unpack(pairs).items() if k != "hash"}
                c = np.bincount(q["word"], weights=q["c"])[q["word"]]
                p = averaged(q, totals, each, [2, part])  # words never seen have no customers and get the base's share
                if local is not None:  # a piece of a split part: its own pairs among those of the whole
                    own = _unpack(local)
                    hashes = _unpack(pairs)["hash"]
                    at = np.searchsorted(q["word"] << 16 | q["ctx"], np.searchsorted(hashes, own["hash"])[own["word"]].astype(np.int64) << 16 | own["ctx"])
                    c, p = c[at], p[at]
                pair = np.repeat(np.arange(len(p)), g["run"])
                place = g["which"].astype(np.int64) << 16 | g["row"]
                order = np.argsort(place, kind="stable")
                place, pair = place[order], pair[order]
                first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
                sums = [np.add.reduceat(v[pair], first) for v in (np.log10(p), np.log10(c + 0.1) - divisor, (c > 0).astype(np.int64))]
                place = place[first]
                cut = np.searchsorted(place >> 16, np.arange(len(g["batch"]) + 1))
                for k, (x, y) in enumerate(zip(cut[:-1], cut[1:])):
                    waiting.setdefault(int(g["batch"][k]), []).append(((place[x:y] & 0xFFFF).astype(np.uint16), *(v[x:y] for v in sums)))
                n_waiting += len(place)
                if n_waiting > MOST_WAITING:
                    yield combined(waiting)
                    waiting, n_waiting = {}, 0
        if waiting:
            yield combined(waiting)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def total(table: pa.Table) -> pa.Table:
        got = [_unpack(x.as_buffer()) for x in table.column("body")]
        ids = next(x for x in table.column("ids").to_pylist() if x is not None)
        ids = pa.ipc.open_stream(ids).read_all().column(0).combine_chunks()
        n = len(ids)
        row = np.concatenate([g["row"] for g in got])
        order = np.lexsort((np.concatenate([g["score"] for g in got]), row))  # sums must not depend on arrival
        row = row[order]
        add = lambda k: np.bincount(row, weights=np.concatenate([g[k] for g in got])[order], minlength=n)
        own = next(g for g in got if "held" in g)
        cols = [ids, pa.array(own["held"]), pa.array(own["n"] + 1, pa.int64()), pa.array(add("known").astype(np.int64)), pa.array(np.full(n, train_tokens, np.int64)), pa.array(add("base")), pa.array(add("score"))]
        return pa.table(cols, names=names)

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    whole_rows = state.filter("sub < 0").select("part", "batch", "pairs", F.lit(None).cast("binary").alias("local"), "body", "ids")
    pieces = state.filter("sub >= 0").withColumnRenamed("pairs", "local").join(merged, "part").select("part", "batch", "pairs", "local", "body", "ids")
    return whole_rows.unionByName(pieces).mapInArrow(score, "batch long, body binary, ids binary").groupBy("batch").applyInArrow(total, schema)


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity per token of both models, for held-out and training documents."""
    p = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens")).alias(f"{c}_perplexity")
    return scored.groupBy("held_out").agg(p("base_score"), p("score"))


def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
