"""A1 for archives of any size: one JSON object, read by many tasks.

Spark's text reader cuts files at closing braces, wherever the file system is.
Such a cut never parts an escape from what it escapes, so all that a task does
not know of the text before it is whether it starts inside a string, and how
deep. Blocks are stored as chunks with what either case would make of them; sums
over chunks settle which case holds; then chunks are cut into the members of
the archive's arrays and objects independently of each other. Only members that
lie across chunks travel, to be put together.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from recordloom.sources.scratch import Scratch, materialize

_ESCAPED = re.compile(r"\\.", re.S)
_REST = re.compile(r'(?:[^"\\]|\\.)*+"?', re.S)
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*+"?|[{}\[\],]', re.S)

_PLACE = ["path", "start", "chunk"]
_CHUNKS = "path string, start long, chunk long, text string, quotes long, outside long, inside long"
_PART = "local long, section string, first long, whole boolean, text string"
_CUT = f"path string, start long, chunk long, opens long, keys array<struct<section string, opener string, first long>>, parts array<struct<{_PART.replace(' ', ': ').replace(',:', ',')}>>"
_CUT_ARROW = pa.schema([
    ("path", pa.string()), ("start", pa.int64()), ("chunk", pa.int64()), ("opens", pa.int64()),
    ("keys", pa.list_(pa.struct([("section", pa.string()), ("opener", pa.string()), ("first", pa.int64())]))),
    ("parts", pa.list_(pa.struct([("local", pa.int64()), ("section", pa.string()), ("first", pa.int64()), ("whole", pa.bool_()), ("text", pa.string())]))),
])


def _depth(pieces: list[str]) -> int:
    text = "".join(pieces)
    return text.count("{") + text.count("[") - text.count("}") - text.count("]")


def _chunked(size: int) -> Callable:
    """Joins the pieces of a block to chunks of some ``size`` characters, with quotes and change of depth in either case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number, held, length = None, 0, [], 0

        def row() -> pa.RecordBatch:
            text = "}".join(held) + "}"
            runs = _ESCAPED.sub("", text).split('"')
            cells = [block[0], block[1], number, text, len(runs) - 1, _depth(runs[0::2]), _depth(runs[1::2])]
            return pa.RecordBatch.from_arrays([pa.array([c]) for c in cells], names=["path", "start", "chunk", "text", "quotes", "outside", "inside"])

        for batch in batches:
            for place, value in zip(zip(batch["path"].to_pylist(), batch["start"].to_pylist()), batch["value"].to_pylist()):
                if place != block:
                    if held:
                        yield row()
                    block, number, held, length = place, 0, [], 0
                held.append(value)
                length += len(value) + 1
                if length >= size:
                    yield row()
                    number, held, length = number + 1, [], 0
        if held:
            yield row()

    return run


def _cut(text: str, inside: bool, depth: int, wanted: tuple[str, ...]) -> tuple[int, list[dict], list[dict]]:
    """Members begun in a chunk, the archive's keys in it, and (parts of) members of the wanted keys.

    A member's number is counted from the chunk's first; -1 is the one begun before.
    """
    opens, keys, parts, name = 0, [], [], None
    section, first, begin = None, None, 0 if depth >= 2 else None

    def part(end: int, whole: bool) -> None:
        if section is None or section in wanted:
            parts.append({"local": opens - 1, "section": section, "first": first, "whole": whole and opens > 0, "text": text[begin:end]})

    for m in _TOKEN.finditer(text, _REST.match(text).end() if inside else 0):
        sign = text[m.start()]
        if sign == '"':
            name = m.group() if depth == 1 else name
        elif sign in "{[":
            depth += 1
            if depth == 2:
                # a key that lies across chunks holds a brace, so it is none that is wanted
                section, first, begin = json.loads(name) if name else "", opens, m.end()
                keys.append({"section": section, "opener": sign, "first": first})
                opens += 1
        elif sign in "}]":
            if depth == 2:
                part(m.start(), True)
                begin = None
            depth -= 1
        elif depth == 2:
            part(m.start(), True)
            opens, begin = opens + 1, m.end()
        elif depth == 1:
            name = None
    if begin is not None:
        part(len(text), False)
    return opens, keys, parts


def _cutting(wanted: tuple[str, ...]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                opens, keys, parts = _cut(row["text"], row["within"], row["depth"], wanted)
                yield pa.RecordBatch.from_pylist([{**{c: row[c] for c in _PLACE}, "opens": opens, "keys": keys, "parts": parts}], schema=_CUT_ARROW)

    return run


def _before(rows: DataFrame, name: str, value: Column, total: Callable[[Column], Column], over: Callable[[Column], Column], none: Column) -> DataFrame:
    """What the values of all earlier chunks of a file come to: first over blocks, then over the chunks of a block, so no task meets all chunks."""
    rows = rows.withColumn("__v", value)
    earlier = (Window.unboundedPreceding, -1)
    blocks = rows.groupBy("path", "start").agg(total(F.col("__v")).alias("__t"))
    blocks = blocks.select("path", "start", over(F.col("__t")).over(Window.partitionBy("path").orderBy("start").rowsBetween(*earlier)).alias("__b"))
    here = over(F.col("__v")).over(Window.partitionBy("path", "start").orderBy("chunk").rowsBetween(*earlier))
    both = F.coalesce(here, none) + F.coalesce("__b", none) if none is not None else F.coalesce(here, "__b")
    return rows.join(blocks, ["path", "start"]).withColumn(name, both).drop("__v", "__b")


def _sum_before(rows: DataFrame, name: str, value: Column) -> DataFrame:
    return _before(rows, name, value.cast("long"), F.sum, F.sum, F.lit(0).cast("long"))


def _last_before(rows: DataFrame, name: str, value: Column) -> DataFrame:
    return _before(rows, name, value, lambda v: F.max_by(v, F.when(v.isNotNull(), F.col("chunk"))), lambda v: F.last(v, ignorenulls=True), None)


def archive_members(spark: SparkSession, path: str, needs: dict[str, str], chunk: int = 1 << 20) -> DataFrame:
    """Members of the top-level arrays and objects that ``needs`` names, of all archives under a path: ``path, section, ord, text``.

    ``needs`` gives each key its opening sign, ``[`` or ``{``. An object's member is its key, a
    colon and its value. ``ord`` counts members from 0. Where a key stands twice in an archive, the
    last one holds; an archive that lacks one, or that ends before its object does (but for the
    object's own closing brace), stops the job. A member is at most as long as a string of Spark.
    A folder without files has no members.
    """
    scratch = Scratch(spark, "members")
    pieces = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    # stored, as a second reading could cut the files elsewhere
    chunks = scratch.store(pieces.mapInArrow(_chunked(chunk), _CHUNKS), "chunks")
    states = _sum_before(chunks.drop("text"), "quoted", F.col("quotes"))
    states = states.withColumn("within", F.col("quoted") % 2 == 1).withColumn("turn", F.when(F.col("within"), F.col("inside")).otherwise(F.col("outside")))
    states = _sum_before(states, "depth", F.col("turn")).select(*_PLACE, "within", "depth", "quotes", "turn")
    states = scratch.store(states, "states")
    ends = states.groupBy("path").agg(F.sum("quotes").alias("quotes"), F.sum("turn").alias("depth")).filter("quotes % 2 = 1 or depth > 0").head(1)
    if ends:
        raise ValueError(f"archive ends before its object does: {ends[0]['path']}")
    cut = chunks.select(*_PLACE, "text").join(states.select(*_PLACE, "within", "depth"), _PLACE)
    cut = materialize(cut.mapInArrow(_cutting(tuple(needs)), _CUT), "members")

    counted = _sum_before(cut.select(*_PLACE, "opens", "keys"), "base", F.col("opens"))
    at = F.transform("keys", lambda k: F.struct(k["section"].alias("section"), k["opener"].alias("opener"), (k["first"] + F.col("base")).alias("first")))
    counted = counted.withColumn("keys", at)
    counted = _last_before(counted, "carried", F.when(F.size("keys") > 0, F.element_at("keys", -1)))
    counted = materialize(counted.select(*_PLACE, "base", "keys", "carried"), "member-counts")
    scratch.close()

    found = counted.select("path", F.explode("keys").alias("k")).filter(F.col("k.section").isin(*needs)).groupBy("path", "k.section").agg(F.max_by("k", "k.first").alias("k"))
    opener = F.create_map(*[F.lit(x) for pair in needs.items() for x in pair])
    found = found.filter(F.col("k.opener") == opener[F.col("section")]).select("path", "section", F.col("k.first").alias("first"))
    lacking = counted.select("path").distinct().join(found.groupBy("path").count(), "path", "left").filter(F.coalesce("count", F.lit(0)) < len(needs)).head(1)
    if lacking:
        raise ValueError(f"archive needs the members {' and '.join(needs)}: {lacking[0]['path']}")

    parts = cut.select(*_PLACE, F.explode("parts").alias("p")).join(counted.drop("keys"), _PLACE)
    own = F.col("p.section").isNotNull()
    parts = parts.select(
        *_PLACE, (F.col("base") + F.col("p.local")).alias("number"), "p.whole", "p.text",
        F.when(own, F.col("p.section")).otherwise(F.col("carried.section")).alias("section"), F.when(own, F.col("base") + F.col("p.first")).otherwise(F.col("carried.first")).alias("first"),
    ).join(found, ["path", "section", "first"])
    shown = ["path", "section", (F.col("number") - F.col("first")).alias("ord"), "text"]
    broken = parts.filter("not whole").groupBy("path", "section", "first", "number").agg(F.sort_array(F.collect_list(F.struct("start", "chunk", "text"))).alias("t"))
    broken = broken.withColumn("text", F.array_join(F.transform("t", lambda x: x["text"]), ""))
    # an array or object without members has one of blanks
    return parts.filter("whole").select(*shown).unionByName(broken.select(*shown)).filter(~F.col("text").rlike(r"\A\s*\z"))
