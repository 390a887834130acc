"""N-gram Jaccard join by MinHash banding.

Signatures are cut into bands; texts that share a band hash become candidates,
and candidates are verified on the full sets of word n-grams. Copies are one
class from the start. Texts around one smallest neighbour form blocks; blocks that
share a band are compared in separate tasks that hand back link counts and
spanning edges, never pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from recordloom.llm.components import connected_components
from recordloom.llm.names import free_names, join_by_text, quoted
from recordloom.llm.textbatch import mix, spans, utf8, word_bounds, word_hashes
from recordloom.sources.scratch import Scratch, materialize

#: Words of an n-gram, least similarity, wanted chance that a pair at that similarity is compared, hashes at most.
WORDS, SIMILARITY, RECALL, MOST_HASHES = 5, 0.8, 0.9999, 128
#: Texts and n-grams of a block in verification, at most; n-grams of a task; text bytes hashed at a time.
BLOCK, BLOCK_GRAMS, TASK_GRAMS, BATCH_BYTES = 256, 1 << 20, 1 << 19, 1 << 20
#: Comparisons that travel with one copy of a text, in the mean of a block's lists.
LIST = 4096


def choose_bands(similarity: float = SIMILARITY, recall: float = RECALL, most_hashes: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: the longest bands whose number reaches the recall within ``most_hashes`` hashes."""
    best = None
    for rows in range(1, most_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands * rows <= most_hashes:
            best = bands, rows
    if best is None:
        raise ValueError("no banding reaches this recall with so few hashes")
    return best


def shingles(data: np.ndarray, ends: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all word n-grams in text order and their offsets by row; word hashes and theirs.

    A text of fewer than ``n`` words has one n-gram of all its words; a text
    without words has none.
    """
    start, stop, words_at = word_bounds(data, ends)
    h = word_hashes(data, start, stop)
    count = np.diff(words_at)
    grams = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(grams)])
    # place of each n-gram's first word
    first = np.arange(at[-1]) - np.repeat(at[:-1] - words_at[:-1], grams)
    last = np.repeat(words_at[1:], grams)
    out = np.zeros(at[-1], np.uint64)
    for k in range(n):
        place = first + k
        word = h[np.minimum(place, max(len(h) - 1, 0))] if len(h) else h
        out = (out ^ np.where(place < last, word, np.uint64(k + 1))) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
    return mix(out), at, h, words_at


def _salts(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20_070_511)
    return r.integers(0, 2**63, n, dtype=np.uint64), r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _minimum(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Minimum by row; rows must not be empty."""
    return np.minimum.reduceat(values, at[:-1])


def fingerprints(body: bytes, ends: np.ndarray) -> np.ndarray:
    """128-bit digest of each text's words (A-Z in lower case), as two int64 columns."""
    digest = (hashlib.blake2b(b" ".join(body[x:y].lower().split()), digest_size=16).digest() for x, y in zip(ends[:-1].tolist(), ends[1:].tolist()))
    return np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)


def signatures(docs: DataFrame, bands: int, rows: int, id_col: str, text_col: str, n: int) -> DataFrame:
    """``doc_id, text_hash, d1, d2, n_grams, bands``: digest of the word sequence, n-grams in the text and band hashes; null for texts without words."""
    table = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"), F.xxhash64(quoted(text_col)).alias("text_hash"))
    kind = table.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xor, odd = _salts(bands * rows)
        for batch in batches:
            whole, bounds = utf8(batch.column(1))
            for a, b in spans(bounds, BATCH_BYTES):
                data, ends = whole[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
                grams, at, _, _ = shingles(data, ends, n)
                size = np.diff(at)
                full = np.flatnonzero(size)
                some = np.append(at[:-1][full], at[-1])
                out = np.zeros((len(full), bands), np.uint64)
                if len(full):
                    for k in range(bands):
                        for j in range(rows):
                            low = _minimum((grams ^ xor[k * rows + j]) * odd[k * rows + j], some)
                            out[:, k] = mix(out[:, k] * np.uint64(0x9E3779B97F4A7C15) + low + np.uint64(k))
                none = np.ones(b - a, bool)
                none[full] = False
                index = pa.array(np.where(none, 0, np.cumsum(~none) - 1), mask=none)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * bands), pa.array(out.view(np.int64).ravel()))
                digest = fingerprints(data.tobytes(), ends)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), *(pa.array(digest[:, k], mask=none) for k in (0, 1)), pa.array(size), lists.take(index)],
                    ["doc_id", "text_hash", "d1", "d2", "n_grams", "bands"],
                )

    return table.mapInArrow(sign, f"doc_id {kind}, text_hash long, d1 long, d2 long, n_grams long, bands array<long>")


def common_counts(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of all intersections between two lists of sorted sets (``None``: within the first)."""
    sets = left + (right or [])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, inverse, count = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1  # only values that two sets share take part
    keep = count[inverse] > 1
    owner, column = owner[keep], number[inverse[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right) if right is not None else len(left)), np.float32)
    for c in range(0, int((count > 1).sum()), 4096):
        x, y = np.searchsorted(column, [c, c + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[x:y], column[x:y] - c] = 1
        out += part[: len(left)] @ (part[len(left) :] if right is not None else part).T
    return out.astype(np.int64)


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, similarity: float) -> np.ndarray:
    """Which pairs reach the similarity; within one list, no set is linked to itself."""
    common = common_counts(left, right)
    a = np.array([len(s) for s in left])[:, None]
    b = np.array([len(s) for s in (left if right is None else right)])[None, :]
    out = common >= similarity * (a + b - common) - 1e-9
    if right is None:
        np.fill_diagonal(out, False)
    return out


def _compare(pdf: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Links and spanning edges of the block pairs in one task."""
    out = []
    for (i, j), g in pdf.groupby(["i", "j"], sort=False):
        g = g.drop_duplicates("node")  # rows that repeat an id
        own = g[g["block"] == i]
        a = [np.frombuffer(x, np.uint64) for x in own["grams"]]
        nodes, copies = own["node"].to_numpy(), own["copies"].to_numpy()
        if i == j:
            hit = linked(a, None, similarity)
            deg = hit @ copies
        else:
            other = g[g["block"] == j]
            hit = linked(a, [np.frombuffer(x, np.uint64) for x in other["grams"]], similarity)
            deg = np.concatenate([hit @ other["copies"].to_numpy(), hit.T @ copies])
            nodes = np.concatenate([nodes, other["node"].to_numpy()])
            hit = np.block([[np.zeros((len(a), len(a)), bool), hit], [hit.T, np.zeros((hit.shape[1],) * 2, bool)]])
        root = np.arange(len(nodes))
        while True:  # smallest index that a node reaches inside these blocks
            new = np.minimum(root, np.where(hit, root[None, :], len(nodes)).min(axis=1, initial=len(nodes)))
            new = new[new]
            if (new == root).all():
                break
            root = new
        some = deg > 0
        out.append(pd.DataFrame({"node": nodes[some], "links": deg[some].astype(np.int64), "root": nodes[root][some]}))
    return pd.concat(out) if out else pd.DataFrame({"node": [], "links": [], "root": []})


def _classes(signed: DataFrame, work: Scratch) -> DataFrame:
    """One row per word sequence: ``node, d1, d2, rep, copies, n_grams, bands``; nodes are numbers, unique in the stored table.

    ``rep`` is the class's first document that has an id, as id and hash of the text.
    """
    classes = signed.filter("d1 is not null").groupBy("d1", "d2")
    classes = classes.agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))).alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("n_grams").alias("n_grams"), F.any_value("bands").alias("bands"))
    return work.store(classes.withColumn("node", F.monotonically_increasing_id()), "classes")


def _blocks(classes: DataFrame, work: Scratch) -> tuple[DataFrame, DataFrame]:
    """Blocks of texts that share bands (``node, block``), and the pairs of blocks with a band in common (``i, j``).

    A bucket's hub is its smallest node, a node's key the smallest hub of its
    buckets, so texts of one key all share a band with one text: near copies
    come together and chains of them do not. Keys are split into blocks of at most
    some BLOCK texts and BLOCK_GRAMS n-grams.
    """
    buckets = classes.select("node", F.explode("bands").alias("bucket"))
    hubs = work.store(buckets.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub <> last").select("bucket", "hub"), "hubs")
    members = work.store(buckets.join(hubs.hint("merge"), "bucket"), "members")
    keyed = work.store(members.groupBy("node").agg(F.min("hub").alias("key")).join(classes.select("node", "n_grams"), "node"), "keyed")
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n_grams") / BLOCK_GRAMS)).cast("int")
    parts = work.store(keyed.groupBy("key").agg(parts.alias("parts")), "parts")
    block = F.xxhash64("key", F.pmod(F.xxhash64("node"), F.col("parts")))
    placed = work.store(keyed.join(parts, "key").select("node", block.alias("block"), "n_grams"), "placed")
    met = work.store(members.join(placed.select("node", "block"), "node").select("bucket", "block").distinct(), "met")
    several = work.store(met.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket"), "several")
    met = met.join(several, "bucket")
    cross = met.select("bucket", F.col("block").alias("i")).join(met.select("bucket", F.col("block").alias("j")), "bucket").filter("i < j").select("i", "j")
    pairs = work.store(placed.select(F.col("block").alias("i"), F.col("block").alias("j")).unionByName(cross).distinct(), "pairs")
    work.drop("hubs", "members", "keyed", "parts", "met", "several")
    return placed, pairs


def _gram_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int, work: Scratch) -> DataFrame:
    """``node, block, copies, tasks, grams`` of the wanted classes, from the texts of their representatives; one row per list of tasks.

    Texts meet the classes once, by id and hash; those that only rows without an id
    hold are found by their digest.
    """
    texts = docs.select(quoted(id_col).alias("rep"), quoted(text_col).alias("text"), F.xxhash64(quoted(text_col)).alias("rep_hash"))
    owners = wanted.filter("rep is not null").withColumns({"rep_hash": F.col("rep.text_hash"), "rep": F.col("rep.doc_id")})
    named = texts.filter("rep is not null").join(owners.hint("merge"), ["rep", "rep_hash"])
    names = ["text", "d1", "d2", "node", "block", "copies", "tasks"]
    nameless = wanted.filter("rep is null").drop("rep")
    found = named.select(*names)
    if not nameless.isEmpty():
        digests = texts.filter("rep is null").select("text").mapInArrow(_with_digest, "text string, d1 long, d2 long")
        found = found.unionByName(digests.join(nameless.hint("merge"), ["d1", "d2"]).select(*names))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, bounds = utf8(batch.column(0))
            for a, b in spans(bounds, BATCH_BYTES):
                data, ends = whole[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
                grams, at, _, _ = shingles(data, ends, words)
                digest = fingerprints(data.tobytes(), ends)
                asked = np.column_stack([batch.column(k).slice(a, b - a).to_numpy() for k in (1, 2)])
                same = (digest == asked).all(axis=1)
                rows = pa.array(np.flatnonzero(same) + a)
                sets = [np.unique(grams[x:y]).tobytes() for x, y, k in zip(at[:-1], at[1:], same) if k]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(rows) for k in range(3, 7)), pa.array(sets, pa.binary())], ["node", "block", "copies", "tasks", "grams"])

    return found.mapInArrow(collect, "node long, block long, copies long, tasks array<struct<i:long,j:long>>, grams binary")


def _with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, ends = utf8(batch.column(0))
        digest = fingerprints(data.tobytes(), ends)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest[:, 0]), pa.array(digest[:, 1])], ["text", "d1", "d2"])


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row per document: ``doc_id, text_hash, class_id, class_hash, n_links, n_copies``.

    Documents whose sets of ``words``-word n-grams (A-Z in lower case) have a
    Jaccard similarity of at least ``similarity`` are linked. ``class_id`` is the
    smallest id among all documents that links connect, ``n_links`` the number
    of other rows linked to this one (copies included), ``n_copies`` the number
    of rows with this word sequence. ``text_hash`` tells texts apart that share an
    id, and ``class_hash`` says which of the texts with ``class_id`` names the class
    (that of the smallest hash). Null and empty texts have no n-grams, hence
    no links, and are their own class. Repeated rows are copies. Rows without an
    id count as copies and links but never name a class; a class of such rows
    alone has none.

    Copies are one class from the start, by a 128-bit digest. Only pairs of blocks
    that share a band are compared, each pair of texts in exactly one task.
    """
    work = Scratch(docs.sparkSession, "jaccard")
    bands, rows = choose_bands(similarity, recall)
    signed = work.store(signatures(docs, bands, rows, id_col, text_col, words), "signed")
    classes = _classes(signed, work)
    placed, pairs = _blocks(classes, work)

    # which comparisons each text takes part in, in lists of some LIST; comparisons share tasks of some TASK_GRAMS n-grams
    sides = pairs.withColumn("block", F.explode(F.array_distinct(F.array("i", "j"))))
    lists = sides.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / LIST).alias("lists"))
    part = F.pmod(F.xxhash64("j", "i"), F.col("lists"))
    tasks = sides.join(lists, "block").groupBy("block", part.alias("part")).agg(F.collect_list(F.struct("i", "j")).alias("tasks"))
    tasks = work.store(tasks.drop("part"), "tasks")
    wanted = placed.select("node", "block").join(tasks, "block").join(classes.select("node", "d1", "d2", "rep", "copies", "n_grams"), "node")
    wanted = work.store(wanted, "wanted")
    moved = wanted.agg(F.sum(F.size("tasks") * F.col("n_grams"))).first()[0] or 0
    sets = _gram_sets(docs, wanted.drop("n_grams"), id_col, text_col, words, work)
    each = sets.select("node", "block", "copies", F.explode("tasks").alias("t"), "grams").select("node", "block", "copies", "t.i", "t.j", "grams")
    each = each.withColumn("task", F.pmod(F.xxhash64("i", "j"), F.lit(moved // TASK_GRAMS + 1)))
    compared = each.groupBy("task").applyInPandas(lambda pdf: _compare(pdf, similarity), "node long, links long, root long")
    compared = work.store(compared, "compared")

    joined = connected_components(compared.select(F.col("node").alias("u"), F.col("root").alias("v")), "classes")
    named = work.store(joined.join(classes.select("node", "rep"), "node").groupBy("label").agg(F.min("rep").alias("first")), "named")
    linked_to = work.store(compared.groupBy("node").agg(F.sum("links").alias("links")), "links")
    known = joined.join(named, "label").join(linked_to, "node").select("node", "first", "links")
    known = classes.select("node", "d1", "d2", "rep", "copies").join(work.store(known, "linked"), "node", "left")
    # a class of linked texts may have an id where this text has none
    first = F.when(F.col("links").isNull(), F.col("rep")).otherwise(F.col("first"))
    known = known.select(
        "d1", "d2", first["doc_id"].alias("class_id"), first["text_hash"].alias("class_hash"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies")
    )
    known = work.store(known, "known")
    names = ["doc_id", "text_hash", "class_id", "class_hash", "n_links", "n_copies"]
    full = signed.filter("d1 is not null").select("doc_id", "text_hash", "d1", "d2").join(known.hint("merge"), ["d1", "d2"]).select(*names)
    none = signed.filter("d1 is null").withColumns({"class_id": F.col("doc_id"), "class_hash": F.col("text_hash"), "n_links": F.lit(0).cast("long"), "n_copies": F.lit(1).cast("long")})
    out = materialize(full.unionByName(none.select(*names)), "jaccard-classes")
    work.close()
    return out


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def one_of_each_class(docs: DataFrame) -> DataFrame:
    """One document of each class of near copies: the one that names it, once (any one of rows that repeat id and text).

    Rows that share an id but not the text are documents of their own. Rows
    without an id all stay, as do null and empty texts under different ids.
    """
    own, own_hash, mark = free_names(docs.columns, "own", "own_hash", "mark")
    rows = jaccard_join(docs).filter("doc_id is not null")
    first = (F.col("class_id") == F.col("doc_id")) & (F.col("class_hash") == F.col("text_hash"))
    ids = rows.groupBy(F.col("doc_id").alias(own), F.col("text_hash").alias(own_hash)).agg(F.count(F.lit(1)).alias("n"), F.bool_or(first).alias("named"))
    ids = materialize(ids, "ids")
    kept = join_by_text(docs, "doc_id", "text", materialize(ids.filter("not named").select(own, own_hash), "dropped"), own, own_hash, "left_anti")
    repeated = ids.filter("named and n > 1").select(own, own_hash)
    if repeated.isEmpty():
        return kept
    marked = join_by_text(kept, "doc_id", "text", materialize(repeated.withColumn(mark, F.lit(True)), "repeated"), own, own_hash, "left")
    once = marked.filter(F.col(mark)).dropDuplicates(["doc_id", "text"])
    return marked.filter(F.col(mark).isNull()).unionByName(once).select(*[quoted(c) for c in docs.columns])
