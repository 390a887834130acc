"""Substring deduplication by content-defined chunks.

A gear rolling hash over the last bytes picks chunk ends where it is smaller
than all its neighbours, so an insertion moves only the chunks around it.
Chunks are deduplicated by a 128-bit digest; runs of repeated chunks that lie at
neighbouring places of one earlier document form the spans that are reported or
removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from recordloom.llm.names import free_names, join_by_text, quoted
from recordloom.llm.textbatch import spans as row_spans, utf8
from recordloom.sources.scratch import Scratch, materialize

#: A chunk end beats all hashes within so many bytes; no chunk is longer than MOST bytes.
REACH, MOST = 24, 256
#: Shortest run of repeated chunks that counts, in characters.
LEAST_SPAN = 120
#: Bytes that the rolling hash looks back on.
LOOK_BACK = 16
#: Text bytes that are chunked at a time.
BATCH_BYTES = 1 << 20
_GEAR = np.random.default_rng(7_654_321).integers(0, 2**32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash ``h = 2 h + g[byte]`` of the last LOOK_BACK bytes at every byte, by doubling."""
    h, step = _GEAR[data], 1
    while step < LOOK_BACK:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    return h * np.uint32(0x9E3779B1)  # recent bytes alone must not decide the order


def _least(h: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each ``n`` values that begin at a place."""
    out, have = h, 1
    while have < n:
        step = min(have, n - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def chunk_starts(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and row of every chunk. A chunk never begins inside a UTF-8 character."""
    n = len(data)
    cuts = np.zeros(0, np.int64)
    if n > 2 * REACH:
        h = gear(data).copy()
        low = _least(h, REACH)
        at = np.arange(REACH, n - REACH)
        # smaller than the REACH values before, not larger than those after
        at = at[(h[at] < low[at - REACH]) & (h[at] <= low[at + 1])] + 1
        row = np.searchsorted(ends, at, "right") - 1
        whole = (at - 1 - ends[row] >= LOOK_BACK + REACH - 1) & (ends[row + 1] - at >= REACH)
        cuts = at[whole]
    cuts = np.union1d(cuts, ends[:-1][np.diff(ends) > 0])
    gap = np.diff(np.append(cuts, n))
    row = np.searchsorted(ends, cuts, "right") - 1
    gap = np.minimum(gap, ends[row + 1] - cuts)
    more = (gap - 1) // MOST
    if more.any():  # no end found for long: cut every MOST bytes
        steps = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
        cuts = np.union1d(cuts, np.repeat(cuts, more) + steps * MOST)
    first = np.isin(cuts, ends)
    while (inner := ((data[cuts] & 0xC0) == 0x80) & ~first).any():  # never inside a character
        cuts = np.where(inner, cuts + 1, cuts)
        cuts = cuts[cuts < n]
        first = np.isin(cuts, ends)
    cuts = np.unique(cuts)
    return cuts, np.searchsorted(ends, cuts, "right") - 1


def chunk_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per chunk: ``doc_id, text_hash, start, n_chars, d1, d2`` (places in characters).

    ``text_hash`` tells texts apart that share an id; ``d1, d2`` are the halves of
    the chunk's 128-bit digest. Null and empty texts have no chunks.
    """
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"), F.xxhash64(quoted(text_col)).alias("text_hash"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, bounds = utf8(batch.column(1))
            for a, b in row_spans(bounds, BATCH_BYTES):
                data, ends = whole[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
                cuts, row = chunk_starts(data, ends)
                if not len(cuts):
                    continue
                stops = np.append(cuts[1:], len(data))
                body = data.tobytes()
                digest = np.frombuffer(b"".join(hashlib.blake2b(body[x:y], digest_size=16).digest() for x, y in zip(cuts.tolist(), stops.tolist())), np.int64).reshape(-1, 2)
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                begin = chars[cuts] - chars[ends[row]]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).take(pa.array(row + a)) for k in (0, 2)), pa.array(begin.astype(np.int32)), pa.array((chars[stops] - chars[cuts]).astype(np.int32)), pa.array(digest[:, 0]), pa.array(digest[:, 1])],
                    ["doc_id", "text_hash", "start", "n_chars", "d1", "d2"],
                )

    return rows.mapInArrow(chunks, f"doc_id {kind}, text_hash long, start int, n_chars int, d1 long, d2 long")


#: What a document is: an id may stand before several texts.
DOC, FIRST, BEST = ["doc_id", "text_hash"], ["first_doc_id", "first_hash"], ["best_doc_id", "best_hash"]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_SPAN) -> DataFrame:
    """Spans that one earlier document holds: ``doc_id, text_hash, start, n_chars, n_chunks, first_doc_id, first_hash, first_start``.

    A chunk's first place is that in the document with the smallest id, there the
    leftmost; every other place of its digest is a repeat. Neighbouring repeats
    form a run; a span is a part of a run, of at least ``least`` characters, whose
    chunks stand at neighbouring places of one earlier document (or earlier in the
    same one), so its whole text does. The earlier document is the one that the
    run's first places name for most characters, wherever it holds the chunk too,
    and else that of the chunk's own first place.

    Rows that repeat an id with equal text are one document; rows that share an
    id but not the text are documents of their own, told apart (and ordered) by the
    text's hash. Rows without an id are left alone, as are null and empty texts.

    Texts are chunked once; after that only digests and places travel. Digests
    are pre-aggregated before their shuffle, so a passage of a third of all
    documents is one row per task there, and the stored table of first places
    lets Spark split the hot digest when the places are joined with it.
    """
    work = Scratch(docs.sparkSession, "spans")
    chunks = work.store(chunk_table(docs.filter(quoted(id_col).isNotNull()), id_col, text_col), "chunks")
    first = chunks.groupBy("d1", "d2").agg(F.min(F.struct(*DOC, "start")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = work.store(first.select("d1", "d2", F.col("first.doc_id").alias("first_doc_id"), F.col("first.text_hash").alias("first_hash"), F.col("first.start").alias("first_start")), "first")
    hits = chunks.join(first.hint("merge"), ["d1", "d2"]).filter("doc_id <> first_doc_id or text_hash <> first_hash or start <> first_start")
    hits = work.store(hits.withColumn("shift", F.col("start") - F.col("first_start")).drop("first_start"), "hits")
    work.drop("chunks", "first")

    # runs of neighbouring repeats and the earlier document that most of a run names
    near = Window.partitionBy(*DOC).orderBy("start", "d1", "d2")
    runs = hits.repartition(*DOC).distinct()
    runs = runs.withColumn("begins", F.when(F.lag(F.col("start") + F.col("n_chars")).over(near) == F.col("start"), 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("begins").over(near))
    named = F.sum("n_chars").over(Window.partitionBy(*DOC, "run", *FIRST, "shift"))
    runs = runs.withColumn("named", -named).withColumn("best", F.min(F.struct("named", *FIRST, "shift")).over(Window.partitionBy(*DOC, "run")))
    best = [F.col(f"best.{x}").alias(y) for x, y in zip([*FIRST, "shift"], [*BEST, "best_shift"])]
    runs = work.store(runs.select(*DOC, "start", "n_chars", "d1", "d2", *FIRST, "shift", *best), "runs")
    work.drop("hits")

    # chunks first seen elsewhere: does that document hold them at the neighbouring place?
    own = (F.col("first_doc_id") == F.col("best_doc_id")) & (F.col("first_hash") == F.col("best_hash")) & (F.col("shift") == F.col("best_shift"))
    held = runs.select(*[F.col(x).alias(y) for x, y in zip(DOC, BEST)], F.col("start").alias("place"), "d1", "d2", F.lit(True).alias("held"))
    asked = runs.filter(~own).withColumn("place", F.col("start") - F.col("best_shift")).join(held, [*BEST, "place", "d1", "d2"], "left").withColumn("held", F.coalesce("held", F.lit(False)))
    pick = [F.when(F.col("held"), F.col(y)).otherwise(F.col(x)).alias(x) for x, y in zip([*FIRST, "shift"], [*BEST, "best_shift"])]
    placed = runs.filter(own).select(*DOC, "start", "n_chars", *FIRST, "shift").unionByName(asked.select(*DOC, "start", "n_chars", *pick))

    line = Window.partitionBy(*DOC, *FIRST, "shift").orderBy("start")
    placed = placed.repartition(*DOC).withColumn("begins", F.when(F.lag(F.col("start") + F.col("n_chars")).over(line) == F.col("start"), 0).otherwise(1))
    spans = placed.withColumn("span", F.sum("begins").over(line)).groupBy(*DOC, *FIRST, "shift", "span")
    spans = spans.agg(F.min("start").alias("start"), F.sum("n_chars").alias("n_chars"), F.count(F.lit(1)).alias("n_chunks")).filter(F.col("n_chars") >= least)
    spans = materialize(spans.select(*DOC, "start", "n_chars", "n_chunks", *FIRST, (F.col("start") - F.col("shift")).alias("first_start")), "repeated-spans")
    work.close()
    return spans


def remove_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the characters of ``spans``; documents with only white space left then go.

    A span is cut from the rows with its id and text only. Documents without spans
    stay as they are, also empty and null ones and those without an id; repeated
    rows are cut alike. An ``n_chars`` column is brought up to date. Texts are
    dealt by id and hash once, whatever the number of spans.
    """
    key, key_hash, cuts, rest = free_names(docs.columns, "key", "key_hash", "cuts", "rest")
    ranges = spans.groupBy(F.col("doc_id").alias(key), F.col("text_hash").alias(key_hash)).agg(F.sort_array(F.collect_set(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("n_chars")).alias("b")))).alias(cuts))
    ranges = materialize(ranges, "cuts")
    text, n, at = quoted(text_col), F.size(cuts), F.col(cuts)
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(at, i - 1)["b"])
    end = lambda i: F.when(i == n, F.length(text)).otherwise(F.get(at, i)["a"])
    left = F.array_join(F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(text, begin(i) + 1, end(i) - begin(i))), "")
    joined = join_by_text(docs, id_col, text_col, ranges, key, key_hash, "left").withColumn(rest, F.when(at.isNull(), text).otherwise(left))
    joined = joined.filter(at.isNull() | F.col(rest).rlike(r"[^\x20\x09-\x0D]"))
    new = {text_col: F.col(rest)}
    if "n_chars" in docs.columns and text_col != "n_chars":
        new["n_chars"] = F.when(at.isNull(), F.col("n_chars")).otherwise(F.length(rest)).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[new[c].alias(c) if c in new else quoted(c) for c in docs.columns])


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repeated_spans(docs)


def without_repeats(docs: DataFrame) -> DataFrame:
    """Documents without the passages that an earlier one holds; see ``repeated_spans`` and ``remove_spans`` for odd rows."""
    return remove_spans(docs, repeated_spans(docs))
