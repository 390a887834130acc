"""Toxicity by class-conditional Kneser-Ney models.

Two models of word sequences, one learned from toxic and one from ordinary texts,
back off from pairs of words to single words, counted by the different words they
follow, and from there to the same counts of both classes together. What a class
has hardly seen it leaves to these shared counts, so rare expressions are smoothed
alike in both models; discounts come from the counts of counts. The models'
log-likelihoods are compared per word, over the whole text and over its strongest
passages of a few lengths; a logistic calibration of these length-normalised
ratios gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from recordloom.llm.names import quoted
from recordloom.llm.textbatch import mix, spans, utf8, word_bounds, word_hashes
from recordloom.sources.scratch import Scratch

#: Bound of the labelled sample: toxic and ordinary documents learned from, and text bytes of each, at most.
MOST_TOXIC, MOST_ORDINARY, MOST_BYTES = 3000, 9000, 48 << 20
#: One in so many documents of the sample calibrates, the others give counts.
CALIBRATE = 4
#: Count from which an expression adds to a class of its own; below, all of it is left to the backoff. Of 1 to 6, the one that
#: told most documents right in three folds of the rows to learn from (a hash of the id); held-out rows took no part.
LEAST_COUNT = 5
#: Words of the passages whose strongest ratio counts, ratio above which a word says no more, text bytes of a batch.
PASSAGES, MOST_RATIO, BATCH_BYTES = (2, 8, 32), 12.0, 2 << 20
CLASSES = ("toxic", "ordinary")
#: Ratios of single words, then of pairs of words: over the text and its strongest passage of each length.
FEATURES = [f"{kind}_{part}" for kind in ("words", "pairs") for part in ("text", *(f"best_{n}" for n in PASSAGES))]
_BEGIN = np.uint64(0x9D39247E33776D41)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_before(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the word before each word; before a text stands its beginning."""
    out = np.append(_BEGIN, h[:-1])[: len(h)]
    out[at[:-1][np.diff(at) > 0]] = _BEGIN
    return out


def pair_keys(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(h * _ODD + before)


def pair_counts(data: np.ndarray, ends: np.ndarray, toxic: np.ndarray) -> pa.RecordBatch:
    """``key, before, word, toxic, ordinary``: pairs of neighbouring words and their counts by class."""
    start, stop, at = word_bounds(data, ends)
    h = word_hashes(data, start, stop)
    flag, before = np.repeat(toxic, np.diff(at)), words_before(h, at)
    value, where, which = np.unique(pair_keys(before, h), return_index=True, return_inverse=True)
    count = [np.bincount(which, weights=w, minlength=len(value)).astype(np.int64) for w in (flag, ~flag)]
    cols = [value.view(np.int64), before[where].view(np.int64), h[where].view(np.int64), *count]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "before", "word", *CLASSES])


def discount(ones: float, twos: float, threes: float, fours: float) -> float:
    """Kneser-Ney discount of counts of three and more, from how many expressions have counts 1 to 4."""
    if not (ones and twos and threes):
        return 1.0
    return float(np.clip(3 - 4 * ones / (ones + 2 * twos) * fours / threes, 0.5, 2.9))


def taken(count: np.ndarray, d: float) -> np.ndarray:
    """What of each count is left to the backoff."""
    return np.where(count < LEAST_COUNT, count, np.minimum(count, d))


def at_keys(table: np.ndarray, values: np.ndarray, key: np.ndarray, other: float) -> np.ndarray:
    """Values (rows of one column per table entry) at the keys; ``other`` where the table lacks one."""
    out = np.full((len(values), len(key)), other)
    if len(table):
        k = np.minimum(np.searchsorted(table, key), len(table) - 1)
        hit = np.flatnonzero(table[k] == key)
        out[:, hit] = values[:, k[hit]]
    return out


class Models:
    """Both class models, as sorted arrays of what each word, pair and preceding word adds."""

    def __init__(self, words: dict[str, np.ndarray], pairs: dict[str, np.ndarray], befores: dict[str, np.ndarray], d: list[float]):
        """``words``: ``key`` and, per class and for ``both``, the different words before; ``pairs``: ``key, before`` and counts per
        class; ``befores``: ``key`` and per class ``_total`` and ``_left``; ``d``: discounts of the classes' pairs."""
        counts = [words[c] for c in (*CLASSES, "both")]
        left = [taken(c, discount(*(np.count_nonzero(c == k) for k in (1, 2, 3, 4)))) for c in counts]
        total = [max(c.sum(), 1) for c in counts]
        # the shared counts are smoothed as usual, by a discount of at most one and a uniform rest
        cut = np.minimum(counts[2], 0.75)
        shared = (counts[2] - cut) / total[2] + cut.sum() / total[2] / max(len(cut), 1)
        own = np.stack([(c - x) / n + x.sum() / n * shared for c, x, n in zip(counts[:2], left[:2], total[:2])])
        self.words = words["key"], own
        rest = lambda c: np.where(befores[f"{c}_total"] > 0, befores[f"{c}_left"] / np.maximum(befores[f"{c}_total"], 1), 1.0)
        self.befores = befores["key"], np.stack([rest(c) for c in CLASSES])
        whole = at_keys(befores["key"], np.stack([befores[f"{c}_total"].astype(float) for c in CLASSES]), pairs["before"], 0.0)
        self.pairs = pairs["key"], np.stack([(pairs[c] - taken(pairs[c], d[k])) / np.maximum(whole[k], 1) for k, c in enumerate(CLASSES)])
        # which leading bits some pair has: most pairs of a text are in no table
        self.seen = np.zeros(1 << 24, bool)
        self.seen[pairs["key"] >> np.uint64(40)] = True

    def ratios(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log-likelihood of each word in the toxic model less that in the ordinary one, by itself (first row) and after the
        word before it; words that neither class has say nothing."""
        word, which = np.unique(h, return_inverse=True)
        single, rest = at_keys(*self.words, word, 0.0), at_keys(*self.befores, word, 1.0)
        known = (single > 0).all(axis=0)[which]
        p = single[:, which]
        begins = at[:-1][np.diff(at) > 0]
        q = np.column_stack([np.ones(2), rest[:, which[:-1]]]) if len(h) else np.ones((2, 0))
        q[:, begins] = at_keys(*self.befores, _BEGIN[None], 1.0)
        q *= p
        key = pair_keys(words_before(h, at), h)
        maybe = np.flatnonzero(self.seen[key >> np.uint64(40)])
        q[:, maybe] += at_keys(*self.pairs, key[maybe], 0.0)
        out = [np.log(np.maximum(x[0], 1e-300)) - np.log(np.maximum(x[1], 1e-300)) for x in (p, q)]
        return np.where(known, np.clip(out, -MOST_RATIO, MOST_RATIO), 0.0)


def text_features(ratios: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ratios per word: over the text and over its strongest passage of each length (shorter texts are one passage)."""
    n = np.diff(at)
    out = np.zeros((len(n), len(FEATURES)))
    full = np.flatnonzero(n)
    if not len(full):
        return out
    begin = at[:-1][full]
    row = np.repeat(np.arange(len(full)), n[full])
    for i, ratio in enumerate(ratios):
        first_column = i * (len(PASSAGES) + 1)
        total = np.concatenate([[0], np.cumsum(ratio)])
        out[full, first_column] = np.add.reduceat(ratio, begin) / n[full]
        for k, size in enumerate(PASSAGES, 1):
            stop = np.minimum(np.arange(len(ratio)) + size, at[1:][full][row])
            first = np.maximum(stop - size, begin[row])  # passages at the end reach back
            out[full, first_column + k] = np.maximum.reduceat((total[stop] - total[first]) / (stop - first), begin)
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.01) -> np.ndarray:
    """Weights of standardised features and the intercept, by Newton steps: ``[mean, scale, weights, intercept]``."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, ridge = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], penalty * len(x) / 10), 1e-6)
    weight = np.sqrt(np.where(y == 1, (y == 0).sum(), (y == 1).sum()) / len(y) * 2)  # between equal rows and equal classes
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge)
        step = np.linalg.solve(h, z.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return np.concatenate([mean, scale, w])


def logistic(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    k = x.shape[1]
    z = (x - weights[:k]) / weights[k : 2 * k]
    return 1 / (1 + np.exp(-np.clip(z @ weights[2 * k : 3 * k] + weights[3 * k], -30, 30)))


def held_out(doc_id, fold: int = 3, rest: int = 1):
    """Whether crc32 of the id as text leaves ``rest`` modulo ``fold`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % fold == rest


def _batches(batch: pa.RecordBatch, column: int) -> Iterator[tuple]:
    """Row range, bytes and ends of pieces of an Arrow batch."""
    whole, bounds = utf8(batch.column(column))
    for a, b in spans(bounds, BATCH_BYTES):
        yield a, b, whole[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]


def sample_of(docs: DataFrame, labels: DataFrame, work: Scratch, most_toxic: int, most_ordinary: int, most_bytes: int) -> DataFrame:
    """``text, toxic, calibrate``: of each class the labelled documents first by a hash of the id, up to the bounds.

    Rows and text bytes are bounded; once a class has its bytes, later documents are left out.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit("sample"))
    ids = known.filter("toxic = 1").orderBy(order, "doc_id").limit(most_toxic).unionByName(known.filter("toxic = 0").orderBy(order, "doc_id").limit(most_ordinary))
    ids = work.store(ids.select(F.col("doc_id").alias("id"), "toxic", order.alias("place")), "ids")
    # the two limits bound the ids
    sizes = docs.select(F.col("doc_id").alias("id"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    sizes = work.store(sizes.join(F.broadcast(ids), "id").groupBy("id", "toxic", "place").agg(F.sum("size").alias("size")), "sizes")
    # at most most_toxic + most_ordinary short rows: added up here, in the order of their hashes
    upto, chosen = {0: 0, 1: 0}, []
    for r in sorted(sizes.collect(), key=lambda r: r["place"]):
        upto[r["toxic"]] += r["size"]
        if upto[r["toxic"]] <= most_bytes:
            chosen.append((r["id"], r["toxic"]))
    calibrate = F.pmod(F.xxhash64("id", F.lit("calibrate")), F.lit(CALIBRATE)) == 0
    sizes = docs.sparkSession.createDataFrame(chosen, sizes.select("id", "toxic").schema).withColumn("calibrate", calibrate)
    rows = docs.join(F.broadcast(sizes), F.col("doc_id") == F.col("id")).select("text", "toxic", "calibrate")
    return work.store(rows, "sample")


def count_models(rows: DataFrame, work: Scratch) -> Models:
    """Models of the sample's ``text, toxic``: pairs are summed and pruned in Spark before the driver takes what stays."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False) == 1
            for a, b, data, ends in _batches(batch, 0):
                yield pair_counts(data, ends, toxic[a:b])

    counted = rows.mapInArrow(count, "key long, before long, word long, toxic long, ordinary long")
    pairs = counted.groupBy("key").agg(F.min("before").alias("before"), F.min("word").alias("word"), *[F.sum(c).alias(c) for c in CLASSES])
    pairs = work.store(pairs, "pairs")
    row = pairs.agg(*[F.count_if(F.col(c) == k).alias(f"{c}_{k}") for c in CLASSES for k in (1, 2, 3, 4)]).first()
    d = [discount(*(row[f"{c}_{k}"] for k in (1, 2, 3, 4))) for c in CLASSES]
    left = lambda c, x: F.sum(F.when(F.col(c) < LEAST_COUNT, F.col(c)).otherwise(F.least(F.col(c), F.lit(x)))).alias(f"{c}_left")
    befores = pairs.groupBy(F.col("before").alias("key")).agg(*[F.sum(c).alias(f"{c}_total") for c in CLASSES], *[left(c, x) for c, x in zip(CLASSES, d)], F.max(F.greatest(*CLASSES)).alias("most"))
    words = pairs.groupBy(F.col("word").alias("key")).agg(*[F.count_if(F.col(c) > 0).alias(c) for c in CLASSES], F.count(F.lit(1)).alias("both"))

    def arrays(df: DataFrame, *keys: str) -> dict[str, np.ndarray]:
        table = df.toArrow()
        out = {c: table.column(c).to_numpy() for c in table.column_names}
        out |= {k: out[k].view(np.uint64) for k in keys}
        order = np.argsort(out["key"])
        return {c: v[order] for c, v in out.items()}

    kept = pairs.filter(F.greatest(*CLASSES) >= LEAST_COUNT).select("key", "before", *CLASSES)
    return Models(arrays(words, "key"), arrays(kept, "key", "before"), arrays(befores.filter(F.col("most") >= LEAST_COUNT).drop("most"), "key"), d)


def learn(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_ordinary: int = MOST_ORDINARY, most_bytes: int = MOST_BYTES):
    """Models and calibration from a bounded sample of the labelled documents that are not held out.

    Null labels are ignored; of several labels of a document the toxic one
    counts; rows that repeat an id are all read. Returns None when either class is
    missing among the counted or the calibrating documents.
    """
    work = Scratch(docs.sparkSession, "toxicity")
    rows = sample_of(docs, labels, work, most_toxic, most_ordinary, most_bytes)
    have = {tuple(r) for r in rows.select("toxic", "calibrate").distinct().collect()}
    if len(have) < 4:
        work.close()
        return None
    models = count_models(rows.filter("not calibrate").select("text", "toxic"), work)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, ends in _batches(batch, 0):
                start, stop, at = word_bounds(data, ends)
                x = text_features(models.ratios(word_hashes(data, start, stop), at), at)
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in x.T), batch.column(1).slice(a, b - a)], [*FEATURES, "toxic"])

    seen = rows.filter("calibrate").select("text", "toxic").mapInArrow(measure, ", ".join(f"{x} double" for x in FEATURES) + ", toxic int").toArrow()
    weights = fit_logistic(np.column_stack([seen.column(c).to_numpy() for c in FEATURES]), seen.column("toxic").to_numpy())
    work.close()
    return models, weights


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted`` and the ratios that the score comes from.

    Null and empty texts have ratios of 0. Without labels of both classes every
    score is 0. Repeated rows score alike; other columns are not read; rows
    without an id are scored and never learned from.
    """
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    given = docs.sparkSession.sparkContext.broadcast(learn(rows, known))  # bounded by the sample
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "held_out", "score", "predicted", *FEATURES]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, ends in _batches(batch, 1):
                x, p = np.zeros((b - a, len(FEATURES))), np.zeros(b - a)
                if given.value:
                    start, stop, at = word_bounds(data, ends)
                    x = text_features(given.value[0].ratios(word_hashes(data, start, stop), at), at)
                    p = logistic(given.value[1], x)
                cols = [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(p), pa.array((p >= threshold).astype(np.int32)), *(pa.array(c) for c in x.T)]
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"doc_id {kind}, held_out boolean, score double, predicted int, " + ", ".join(f"{x} double" for x in FEATURES)
    return rows.withColumn("held_out", held_out(F.col("doc_id"))).mapInArrow(score, schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
