"""Tokenised documents packed into fixed-length sequences by bounded-space best fit.

Pieces are placed one by one as they arrive. Each packing group keeps a fixed
number of open sequences in a bitset keyed by free space: a piece goes to the
fullest open sequence that still takes it; when no more may be open, the fullest
closes first. Groups are dealt evenly, hold a bounded number of tokens and are
packed independently.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from recordloom.llm.names import free_names, quoted
from recordloom.llm.textbatch import utf8
from recordloom.sources.scratch import materialize

#: Tokens of a sequence, open sequences, tokens of a packing group, words kept by an encoder.
CAPACITY, OPEN, GROUP_TOKENS, CACHED_WORDS = 2048, 128, 8_000_000, 900_000
#: Settings of a vocabulary whose words, parted at white space, are encoded one by one.
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
_ENCODERS: dict = {}


def _byte_letters() -> dict[int, str]:
    """Letters that stand for bytes in byte-level vocabularies: printable bytes for themselves, the others from 256 up."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


_LETTERS = _byte_letters()


class WordEncoder:
    """Token ids of texts as little-endian uint32 bytes.

    A vocabulary with the settings BY_WORDS never merges across white space, so
    each distinct word is encoded once and kept, up to a fixed number of words.
    With any other settings whole texts are encoded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        said = json.loads(self.tokenizer.to_str())
        special = all(a["content"].startswith("<|") and a["special"] and not a["normalized"] for a in said["added_tokens"])
        self.by_words = special and said["model"]["type"] == "BPE" and all(said[k] == v for k, v in BY_WORDS.items())

    def encode(self, text: bytes) -> bytes:
        if not self.by_words:
            return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        # A-Z only; the tokenizer lower-cases the rest itself. Special tokens keep their case.
        words = (text if b"<|" in text else text.lower()).split()
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            pass
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        known, new, ended = self.known, [], []
        for w in set(words).difference(known):
            if w[-1:] in (b".", b",") and w[:-1].decode().isalpha():
                ended.append(w)  # letters and a mark are parted before merging: the letters' ids, then the mark's
                w = w[:-1]
                if w in known:
                    continue
            new.append(w)
        for mark in (b".", b","):
            if mark not in known:
                new.append(mark)
        plain, other = [], []
        for w in new:
            text = w.decode()
            (plain if text.isalpha() and max(text) < "\u0250" and "\u0130" not in text else other).append((w, text))
        merge = self.tokenizer.model.tokenize
        for w, text in plain:  # one run of Latin letters: lower case and bytes as letters are all that comes before merging
            ids = [t.id for t in merge(text.lower().encode().decode("latin-1").translate(_LETTERS))]
            known[w] = struct.pack(f"<{len(ids)}I", *ids)
        found = self.tokenizer.encode_batch_fast([text for _, text in other], add_special_tokens=False)
        known.update((w, np.array(e.ids, "<u4").tobytes()) for (w, _), e in zip(other, found))
        known.update((w, known[w[:-1]] + known[w[-1:]]) for w in ended)
        return b"".join(map(known.__getitem__, words))


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def tokenize_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32`` (and ``ids``, little-endian uint32 bytes).

    A document's ids are those of its text (null: empty) and a final 0; only
    documents over ``capacity`` are cut.
    """
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            data, ends = utf8(batch.column(1))
            body = data.tobytes()
            row, piece, length, crc, ids = [], [], [], [], []
            for i in range(len(ends) - 1):
                got = enc.encode(body[ends[i] : ends[i + 1]]) + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(got), capacity * 4)):
                    part = got[at : at + capacity * 4]
                    row.append(i)
                    piece.append(k)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            piece = np.array(piece, np.int32)
            cols = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece), pa.array(piece.astype(np.int64) * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    return rows.mapInArrow(pieces, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def best_fit(lengths: list[int], capacity: int, most_open: int) -> tuple[list[int], list[int], list[bool]]:
    """Sequence number and offset of each piece, in the order given, and whether an open sequence had to close for it."""
    free_of: list[int] = []
    open_by = [[] for _ in range(capacity + 1)]  # open sequences by free space
    bits, n_open = 0, 0  # bit f: some open sequence has f free
    where, offset, closed = [], [], []
    for need in lengths:
        fits = bits >> need
        if fits:
            f = need + (fits & -fits).bit_length() - 1
            s = open_by[f].pop()
            if not open_by[f]:
                bits &= ~(1 << f)
            n_open -= 1
            closed.append(False)
        else:
            closed.append(n_open >= most_open)
            if n_open >= most_open:
                fullest = (bits & -bits).bit_length() - 1
                open_by[fullest].pop()
                if not open_by[fullest]:
                    bits &= ~(1 << fullest)
                n_open -= 1
            f, s = capacity, len(free_of)
            free_of.append(capacity)
        where.append(s)
        offset.append(capacity - f)
        left = free_of[s] = f - need
        if left:
            open_by[left].append(s)
            bits |= 1 << left
            n_open += 1
    return where, offset, closed


def pack(pieces: DataFrame, capacity: int = CAPACITY, most_open: int = OPEN, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Adds ``sequence_id``, ``offset`` and ``closed_one`` to stored pieces with a ``length`` of 1 to ``capacity``.

    Pieces are dealt in turn to groups of about ``group_tokens`` tokens, so
    repeated rows and ids spread evenly; a group's pieces arrive in the order of
    the stored table. ``closed_one`` says that an open sequence, the fullest, was
    closed to open the piece's own. ``pieces`` must be a stored table (its rows
    keep their places).
    """
    total = pieces.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(total / group_tokens))
    place, group = free_names(pieces.columns, "arrival", "pack_group")
    dealt = pieces.withColumn(place, F.monotonically_increasing_id()).withColumn(group, F.pmod(F.col(place) + F.shiftright(place, 33), F.lit(groups)))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(place)
        where, offset, closed = best_fit(pdf["length"].tolist(), capacity, most_open)
        number = int(pdf[group].iloc[0]) << 32
        return pdf.assign(sequence_id=number + np.array(where, np.int64), offset=np.array(offset, np.int64), closed_one=closed).drop(columns=[place, group])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.groupBy(group).applyInPandas(fill, f"{names}, sequence_id long, offset long, closed_one boolean")


def sequences(packed: DataFrame) -> DataFrame:
    """Token ids of each sequence (``sequence_id, ids``), from packed pieces that carry ``ids``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # at most CAPACITY pieces
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, most_open: int = OPEN) -> DataFrame:
    """Packs all documents; one row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset, closed_one``.

    Null and empty texts are the single id 0. Rows that repeat an id, and rows
    without one, are packed each for itself. Other columns are not read.
    """
    pieces = materialize(tokenize_pieces(docs, tokenizer or word_bpe_path()), "pieces")
    return pack(pieces, most_open=most_open).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "closed_one")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
