"""Audio features of byte payloads kept as 8-bit WAV media.

Samples are resampled by a polyphase filter, turned into overlapped log-mel
frames, segmented by energy with hysteresis, and cut into fixed-shape tensors
with time spans.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from recordloom.llm.textbatch import spans as row_spans, utf8
from recordloom.sources.scratch import shared_dir

#: Stored rate, resampling factors (up, down), frame and hop at the new rate, mel bands, frames of a tensor.
RATE, UP, DOWN, FRAME, HOP, BANDS, STEPS = 12000, 2, 3, 256, 128, 24, 64
#: Decibels below the loudest frame at which a segment begins and ends.
BEGIN_DB, END_DB = 3.0, 6.0
UNIT = 64
#: Media bytes whose tensors are held at a time, and samples that are filtered at a time.
BATCH_BYTES, BLOCK = 4 << 20, 1 << 18


def pad_payload(payload: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return payload + bytes(-len(payload) % UNIT if payload else UNIT)


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """Mono WAV file of unsigned 8-bit samples."""
    tail = bytes(len(samples) % 2)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(tail), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + tail


def from_wav(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of a mono 8-bit WAV file."""
    riff, _, wave = struct.unpack_from("<4sI4s", media)
    at, rate = 12, 0
    if riff != b"RIFF" or wave != b"WAVE":
        raise ValueError("not a WAV file")
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit PCM is stored here")
        elif name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@lru_cache
def _phases(up: int, down: int, half: int = 8) -> np.ndarray:
    """Filter taps of each output phase (rows), time-reversed for a sliding product."""
    width = half * max(up, down)
    t = np.arange(-width, width + 1)
    taps = np.sinc(t / max(up, down)) * np.kaiser(2 * width + 1, 5.0)
    taps *= up / taps.sum()
    per = -(-len(taps) // up)
    return np.pad(taps, (0, per * up - len(taps))).reshape(per, up).T[:, ::-1].astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """``len(x) * up / down`` samples (rounded up); each output phase has its own filter."""
    h = _phases(up, down)
    per, lead = h.shape[1], 8 * max(up, down)  # the filter's centre in upsampled time
    n = -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(per, np.float32), x, np.zeros(per + lead // up + 2, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, per)
    out = np.empty(n, np.float32)
    for k in range(up):  # outputs k, k + up, ... share a phase
        t0 = k * down + lead
        phase, first = t0 % up, t0 // up + 1
        m = len(out[k::up])
        for a in range(0, m, BLOCK):  # a long text is resampled in parts
            b = min(a + BLOCK, m)
            out[k + a * up : k + b * up : up] = windows[first + a * down : first + b * down : down][: b - a] @ h[phase]
    return out


@lru_cache
def _mel(rate: int) -> np.ndarray:
    """Triangular filters over the frame's spectrum, equally spaced in mel."""
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), BANDS + 2)
    hz = 700 * (10 ** (mel / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, 1 / rate)
    up = (f[:, None] - hz[:-2]) / (hz[1:-1] - hz[:-2])
    down = (hz[2:] - f[:, None]) / (hz[2:] - hz[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


_WINDOW = np.hanning(FRAME).astype(np.float32)


def log_mel(x: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames (frames x BANDS) and each frame's energy, both in decibels."""
    if len(x) < FRAME or (len(x) - FRAME) % HOP:
        x = np.pad(x, (0, FRAME - len(x) if len(x) < FRAME else HOP - (len(x) - FRAME) % HOP))
    whole = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    bands, energy = np.empty((len(whole), BANDS), np.float32), np.empty(len(whole), np.float32)
    for a in range(0, len(whole), BLOCK // HOP):  # spectra of a long text are made in parts
        frames = whole[a : a + BLOCK // HOP] * _WINDOW
        power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
        bands[a : a + len(frames)] = 10 * np.log10(np.maximum(power.astype(np.float32) @ _mel(rate), 1e-8))
        energy[a : a + len(frames)] = 10 * np.log10(np.maximum((frames * frames).mean(axis=1), 1e-10))
    return bands, energy


def segments(energy: np.ndarray, begin_db: float = BEGIN_DB, end_db: float = END_DB) -> list[tuple[int, int]]:
    """Frame ranges that begin above one level and end below a lower one, both relative to the loudest frame."""
    top = energy.max()
    state = np.where(energy >= top - begin_db, 1, np.where(energy < top - end_db, 0, -1))
    known = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    active = np.where(known >= 0, state[known], 0) == 1
    edges = np.flatnonzero(np.diff(np.concatenate([[0], active.astype(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in edges.reshape(-1, 2)]


def features(samples: bytes, rate: int = RATE) -> tuple[np.ndarray, list[tuple[float, float]], list[tuple[float, float]]]:
    """Tensors (n x STEPS x BANDS), their time spans, and the active spans, in seconds."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    new = rate * UP // DOWN
    bands, energy = log_mel(resample(x), new)
    n = -(-len(bands) // STEPS)
    tensor = np.full((n * STEPS, BANDS), -80, np.float16)  # to some hundredths of a decibel
    tensor[: len(bands)] = bands
    at = lambda f: round(f * HOP / new, 4)
    return tensor.reshape(n, STEPS, BANDS), [(at(i * STEPS), at((i + 1) * STEPS)) for i in range(n)], [(at(a), at(b)) for a, b in segments(energy)]


def tensor_table(tensor: np.ndarray, spans: list[tuple[float, float]]) -> pa.Table:
    """Fixed-shape Arrow tensors with their time spans."""
    kind = pa.fixed_shape_tensor(pa.float16(), tensor.shape[1:])
    flat = pa.FixedSizeListArray.from_arrays(pa.array(tensor.ravel()), int(np.prod(tensor.shape[1:])))
    begin, end = zip(*spans)
    return pa.table({"begin_s": pa.array(begin), "end_s": pa.array(end), "log_mel": pa.ExtensionArray.from_storage(kind, flat)})


def tensor_bytes(table: pa.Table) -> bytes:
    """Arrow stream of a tensor table, as kept in a binary column."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def read_tensors(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(body).read_all()


def store_media(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes ``doc_id, n_bytes, media`` (a WAV file of each padded payload) to ``path`` and returns the stored table."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = utf8(batch.column(1))
            media = [to_wav(pad_payload(data[a:b].tobytes())) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    rows.mapInArrow(encode, f"doc_id {kind}, n_bytes long, media binary").write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def media_tensors(stored: DataFrame) -> DataFrame:
    """Reads stored media: digests of payload and file, ``active`` spans (begin, end, begin, ... in seconds) and ``tensors``.

    ``tensors`` is an Arrow stream per document: fixed-shape log-mel tensors with
    the time span of each. A payload of zero bytes only is a constant signal; it
    has one segment. Null and empty texts are such payloads; repeated rows and rows
    without an id are computed each for itself, equal payloads alike.
    """
    kind = stored.schema["doc_id"].dataType.simpleString()

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.float64()), pa.binary()]
        for batch in batches:
            data, ends = utf8(batch.column(2))
            for x, y in row_spans(ends, BATCH_BYTES):
                out = [[] for _ in types]
                for a, b in zip(ends[x:y], ends[x + 1 : y + 1]):
                    media = data[a:b].tobytes()
                    samples, rate = from_wav(media)
                    tensor, spans, active = features(samples, rate)
                    row = (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(),
                           [t for span in active for t in span], tensor_bytes(tensor_table(tensor, spans)))
                    for c, v in zip(out, row):
                        c.append(v)
                cols = [batch.column(0).slice(x, y - x), batch.column(1).slice(x, y - x), *(pa.array(c, t) for c, t in zip(out, types))]
                yield pa.RecordBatch.from_arrays(cols, [*_DIGESTS, "active", "tensors"])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(compute, _schema(kind) + ", active array<double>, tensors binary")


def store_tensors(stored: DataFrame, path: str) -> DataFrame:
    """Writes ``media_tensors`` of stored media to ``path`` and returns the stored table."""
    media_tensors(stored).write.option("compression", "zstd").parquet(path)
    return stored.sparkSession.read.parquet(path)


def describe(body: bytes, active: list[float]) -> str:
    """Shape and digest of stored tensors with their time spans, and length, number and digest of the active spans."""
    table = read_tensors(body)
    column = table.column("log_mel").combine_chunks()
    tensor = column.storage.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    spans = np.stack([table.column(c).to_numpy() for c in ("begin_s", "end_s")]).astype("<f8")
    digest = zlib.crc32(spans.tobytes(), zlib.crc32(np.round(tensor, 1).astype("<f4").tobytes()))
    pairs = list(zip(active[::2], active[1::2]))
    said = ";".join(f"{s:.3f}-{e:.3f}" for s, e in pairs)
    loud = round(sum(e - s for s, e in pairs), 3)
    return f"logmel:{'x'.join(map(str, (len(table), *column.type.shape)))}:{digest:08x}:active={loud}s/{len(pairs)}:{zlib.crc32(said.encode()):08x}"


def tensor_features(table: DataFrame, with_tensors: bool = True) -> DataFrame:
    """``feature`` of each row of ``media_tensors``, derived from its tensors and spans alone."""
    kind = table.schema["doc_id"].dataType.simpleString()
    names = [*_DIGESTS, "feature", *["tensors"] * with_tensors]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, active = batch.column(len(_DIGESTS) + 1), batch.column(len(_DIGESTS))
            said = pa.array([describe(body.as_buffer(), spans.as_py()) for body, spans in zip(bodies, active)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(_DIGESTS))), said, *[bodies] * with_tensors], names)

    return table.select(*_DIGESTS, "active", "tensors").mapInArrow(compute, _schema(kind) + ", feature string" + ", tensors binary" * with_tensors)


def media_features(stored: DataFrame, with_tensors: bool = True) -> DataFrame:
    """Digests, ``feature`` and ``tensors`` of stored media, without storing the tensors. Equal media give equal features."""
    return tensor_features(media_tensors(stored), with_tensors)


_DIGESTS = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]


def _schema(kind: str) -> str:
    return f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"


def op4_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    media = store_media(docs, f"{shared_dir(spark)}/media-{uuid.uuid4().hex}")
    return tensor_features(store_tensors(media, f"{shared_dir(spark)}/tensors-{uuid.uuid4().hex}"), with_tensors=False)
