import hashlib
import json
import random

import pytest
from pyspark.sql import Row, functions as F

from recordloom.operators import intake
from recordloom.operators.ranking import mint_ids, numbered_slugs
from recordloom.sources import tables
from recordloom.sources.buckets import BucketTable
from recordloom.sources.digests import DigestStore
from recordloom.streaming.intake_stream import stream_intake

CAPTURES = "ord long, query_name string, raw_text string, header string, character_name string, captured_at string, captured_date string, captured_epoch string, status string"
ROWS = [
    (0, "Tarn", "Tarn is here", "Tarn", "Tarn", "t1", None, "100", "alive"),
    (1, "tarn", "Tarn is here", "Tarn", "tarn", "t1", None, "100", "alive"),
    (2, "Bel", "Nobody there by name.", None, None, None, "d2", "100", None),
    (3, "Orm", "x", "nobody there", None, "t3", None, "", "lost"),
    (4, "Gus", "BROKEN feed", "Gus", "Gus", "t4", None, "100", "alive"),
    (5, "Sys", "fine", "Sys", "Reserved", "t5", None, "100", "alive"),
    (6, "", "stray", "", "", "t6", None, "100", ""),
]
STORED = "record_id string, name_key string, captured_at string, raw_text string"


def run(spark, rows=ROWS, stored=()):
    entities = spark.createDataFrame([("e1", "TARN", 0), ("e2", "tarn", 1), ("e3", "", 2)], "entity_id string, name string, ord int")
    return intake.intake(spark.createDataFrame(list(rows), CAPTURES), entities, spark.createDataFrame(list(stored), STORED), "nobody there", "BROKEN", "reserved")


def test_flags_and_records(spark):
    out = run(spark)
    got = {r.ord: r for r in out["records"].collect()}
    assert set(got) == {0, 2, 3, 4, 5, 6}
    assert (got[0].entity_id, got[0].confidence, got[0].record_id) == ("e2", "medium", "rec_tarn_100")
    assert (got[2].status, got[2].confidence, got[2].captured_at) == ("not_found", "high", "d2")
    assert got[3].status == "not_found" and got[3].record_id == "rec_orm_3"
    assert got[4].confidence == "low" and got[5].confidence == "low"
    assert got[6].entity_id == "" and got[6].record_id == "rec_unknown_100"
    assert got[0].notes == "query=Tarn | header=Tarn | epoch=100"
    assert out["metrics"].first().asDict() == {"captures": 6, "not_found": 2, "corrupt": 2}


def test_append_twice_is_once(spark):
    first = run(spark)["records"].select("record_id", "name_key", "captured_at", "raw_text").collect()
    assert run(spark, stored=first)["records"].count() == 0
    assert run(spark, rows=ROWS[:3], stored=())["records"].count() == 2
    assert run(spark, rows=[])["records"].count() == 0


def test_minting_skips_taken(spark):
    new = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, "y")], "ord int, b string")
    taken = spark.createDataFrame([("x",), ("x_3",), ("x_03",), ("z_2",)], "id string")
    got = {r.ord: r.minted_id for r in mint_ids(new, "b", ["ord"], taken).collect()}
    assert got == {1: "x_2", 2: "x_4", 3: "x_5", 4: "y"}
    got = {r.ord: r.page_slug for r in numbered_slugs(new, "b", ["ord"]).collect()}
    assert got == {1: "x", 2: "x-2", 3: "x-3", 4: "y"}


def test_upsert_fills_and_overwrites(spark):
    old = spark.createDataFrame([("Tarn", "elf", "", "2001", "", "", "n"), ("Bel", "orc", "9", "", "", "", "")], "name string, race string, level string, first_seen string, last_seen string, checked string, notes string")
    new = spark.createDataFrame([("TARN", "", "7", "2020", False), ("New", "man", None, "2021", False), ("Bad", "x", "x", "2022", True), (None, "x", "x", "2022", False)], "name string, race string, level string, seen_on string, bad boolean")
    got = {r.name: r for r in intake.upsert_entities(old, new, ["race", "level"], F.col("bad"), ["race"]).collect()}
    assert set(got) == {"Tarn", "Bel", "New"}
    assert got["Tarn"][1:] == ("elf", "7", "2001", "2020", "yes", "n | seen in archive")
    assert got["Bel"][1:] == ("orc", "9", "", "", "", "")
    assert got["New"].first_seen == "2021" and got["New"].level == ""


def test_merges_touch_only_their_buckets(spark, tmp_path):
    """A merge leaves the files of other buckets as they are, may run twice, and equals the upsert of the whole table."""
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    bucket = lambda p: int(p.split("bucket=")[1].split("/")[0])
    old = spark.createDataFrame([(f"Name{i}", "elf", "", "", "", "", "") for i in range(200)] + [("", "x", "", "", "", "", "")], "name string, race string, level string, first_seen string, last_seen string, checked string, notes string")
    new = spark.createDataFrame([("NAME7", "", "7", "2020", False), ("Fresh", "man", None, "2021", False), ("Name9", "x", "x", "2022", True), (None, "x", "x", "2022", False)], "name string, race string, level string, seen_on string, bad boolean")
    store = BucketTable(spark, str(tmp_path / "t"), "name", 32)
    store.create(old)
    want = sorted(map(tuple, intake.upsert_entities(old, new, ["race", "level"], F.col("bad"), ["race"]).collect()))
    before = files()
    for _ in range(2):
        touched = intake.merge_entities(store, new, ["race", "level"], F.col("bad"), ["race"])
        after = files()
        assert len(touched) == 2 and {p: t for p, t in before.items() if bucket(p) not in touched} == {p: t for p, t in after.items() if bucket(p) not in touched}
        assert {p for p in before if bucket(p) in touched}.isdisjoint(after)
        assert sorted(map(tuple, store.read().select(*old.columns).collect())) == want
        before = after
    assert intake.merge_entities(store, new.filter("bad"), ["race", "level"], F.col("bad"), ["race"]) == [] and files() == before


def test_queue(spark):
    queue = spark.createDataFrame([(0, "Tarn", "", "no", ""), (1, "Other", "bel", "", "old"), (2, "Orm", "", "yes", ""), (3, "", "", "", "")], "ord int, name string, entity_id string, checked string, notes string")
    caps = spark.createDataFrame([(10, "", "tarn", False), (11, "TARN", "Bel", False), (12, "Bel", "", False), (13, "Orm", "", False), (14, "Tarn", "", True)], "ord int, a string, b string, low boolean")
    entities = spark.createDataFrame([("BEL", "old", 0), ("bel", "bel", 1), ("Orm", "x", 2), ("Zed", "z_2", 3)], "name string, entity_id string, ord int")
    got = {r.ord: (r.checked, r.notes) for r in intake.complete_queue(queue, caps, ["a", "b"], F.col("low"), entities).collect()}
    assert got == {0: ("yes", "capture 10"), 1: ("yes", "old | capture 12"), 2: ("yes", ""), 3: ("", "")}
    # the first row found ends the search, also a closed one; minted ids are found by the entity table; snapshots come last
    queue = spark.createDataFrame([(0, "Tarn", "", "True", ""), (1, "Bel", "b", "", ""), (2, "", "z_2", "done", "n"), (3, "Orm", "o", "", "")], queue.schema)
    caps = spark.createDataFrame([(10, "Tarn", "Bel", False), (11, "Nix", "Zed", False)], caps.schema)
    shots = spark.createDataFrame([("ORM",), ("Zed",), ("",), (None,)], "name string")
    got = {r.ord: (r.checked, r.notes) for r in intake.complete_queue(queue, caps, ["a", "b"], F.col("low"), entities, snapshots=shots).collect()}
    assert got == {0: ("True", ""), 1: ("", ""), 2: ("yes", "n | capture 11"), 3: ("yes", "imported")}


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(i, str(i % 7), i % 3) for i in range(60)], "ord long, k string, v int")
    for day in range(3):
        df.filter(f"ord % 3 = {day}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    start = lambda: stream_intake(spark, str(tmp_path / "in"), df.schema, str(tmp_path / "out"), str(tmp_path / "cp"), ["k", "v"], ["ord"], files=1)
    for _ in range(2):
        q = start()
        q.awaitTermination(120)
        assert q.exception() is None
    df.filter("ord < 5").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    start().awaitTermination(120)
    spark.createDataFrame([(100, "new", 1), (101, "new", 1)], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    start().awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("ord", "k", "v").collect()
    assert len(got) == len({r[1:] for r in got}) == 22 and {r.ord for r in got if r.k == "new"} == {100}
    log = {r.batch: r for r in spark.read.parquet(str(tmp_path / "out-log")).collect()}
    assert [log[k].new for k in range(5)] == [7, 7, 7, 0, 1]
    # the fourth batch repeats five digests and reads their prefixes; the last has one new digest and reads nothing
    assert 1 <= len(log[3].prefixes) <= 5 and log[3].files >= len(log[3].prefixes) and log[4].files == 0


def test_digest_store(spark, tmp_path):
    """Against a plain set over many batches, with replays and merged filters: nothing stored is called new, nothing new is lost."""
    store, seen = DigestStore(spark, str(tmp_path / "store"), prefix=1, merge=2), set()
    for batch in range(5):
        mine = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(batch * 40, batch * 40 + 60)]
        df = spark.createDataFrame([(d,) for d in mine], "digest string")
        for _ in range(2):  # a replay gives the same
            new, read = store.unseen(batch, df)
            assert sorted(r.digest for r in new.collect()) == sorted(set(mine) - seen)
            store.add(batch, new)
        assert {p.rsplit("prefix=", 1)[1][0] for p in read["files"]} <= {d[0] for d in mine}
        seen |= set(mine)
    fresh = spark.createDataFrame([(hashlib.sha256(b"fresh").hexdigest(),)], "digest string")
    new, read = store.unseen(5, fresh)
    assert new.count() == 1 and len(read["prefixes"]) <= 1


def test_archive_and_csv(spark, tmp_path):
    body = {"version": "1", "captures": [{"query_name": "Tarn", "parsed": {"header": "h"}}, "no object", {"query_name": "Bel", "source_queue": {"sent_at": "1"}}], "records": {"tarn": {"latest": {"race": "elf"}}, "x": {}}}
    (tmp_path / "a.json").write_text(json.dumps(body))
    archive = tables.read_archive(spark, str(tmp_path / "a.json"))
    got = tables.archive_captures(archive).collect()
    assert [(r.query_name, r.parsed and r.parsed.header) for r in got] == [("Tarn", "h"), ("Bel", None)]
    assert [(r.key, r.race) for r in tables.archive_snapshots(archive).collect()] == [("tarn", "elf")]
    (tmp_path / "b.json").write_text("{}")
    try:
        tables.archive_captures(tables.read_archive(spark, str(tmp_path / "b.json"))).collect()
        raise AssertionError("an archive without members must stop")
    except Exception as e:
        assert "captures and records" in str(e)
    (tmp_path / "c.csv").write_text('﻿id,text,gone\n1," a ""q""\nb ",x\n')
    assert tables.read_csv(spark, str(tmp_path / "c.csv"), ["id", "text", "more"]).collect() == [Row(id="1", text='a "q"\nb', more="")]
    assert tables.read_csv(spark, str(tmp_path / "none.csv"), ["id"]).count() == 0
    df = spark.createDataFrame([("Tarn", 'x,"y"')], "name string, note string")
    tables.write_table(df, str(tmp_path / "d"), ["note", "name"], "csv")
    assert tables.read_csv(spark, str(tmp_path / "d"), ["name", "note"]).collect() == [Row(name="Tarn", note='x,"y"')]
    tables.write_table(df, str(tmp_path / "p"), ["note"])
    assert spark.read.parquet(str(tmp_path / "p")).columns == ["note"]
    tables.write_names(df, str(tmp_path / "n"))
    assert [r.name for r in tables.read_names(spark, str(tmp_path / "n")).collect()] == ["Tarn"]


def test_times_and_many_taken(spark):
    rows = spark.createDataFrame([(0, "a", None, "d", "e"), (1, "b", "t", "d", "e"), (2, "c", " ", None, "e")], "ord long, query_name string, captured_at string, captured_datetime string, captured_date string")
    for c in ("raw_text", "header", "character_name", "captured_epoch", "status"):
        rows = rows.withColumn(c, F.lit("x") if c == "raw_text" else F.lit(None).cast("string"))
    out = intake.intake(rows, spark.createDataFrame([], "entity_id string, name string, ord int"), spark.createDataFrame([], STORED), "nobody", "BROKEN", "reserved")
    assert {r.ord: r.captured_at for r in out["records"].collect()} == {0: "d", 1: "t", 2: "e"}
    new = spark.createDataFrame([(i, "x") for i in range(50)], "ord int, b string")
    numbers = {1, 2, 3, 5, 8, 13, 14, 15, 40, 41, 99}
    taken = spark.createDataFrame([("x" if n == 1 else f"x_{n}",) for n in numbers] * 2, "id string")
    free = [n for n in range(1, 200) if n not in numbers]
    assert [r.minted_id for r in mint_ids(new, "b", ["ord"], taken).orderBy("ord").collect()] == [f"x_{n}" for n in free[:50]]


def test_sources(spark):
    s = "source_id string, title string, notes string"
    got = intake.upsert_sources(spark.createDataFrame([("a", "", "n"), ("b", "t", "")], s), spark.createDataFrame([("a", "new", "m"), ("c", "x", "y")], s), ["title"]).collect()
    assert sorted(tuple(r) for r in got) == [("a", "new", "n | m"), ("b", "t", ""), ("c", "x", "y")]


def test_large_objects_are_split(spark, tmp_path):
    """Blocks of 300 bytes and chunks of 40 characters give what one reading of the whole object gives."""
    rng = random.Random(5)
    odd = ["", "}", '"', "\\", "}\\", '{"', "], [", "é}€", "\n}", '\\"}', ",", "x" * 700, "}" * 60]
    text = lambda: "".join(rng.choice(odd) for _ in range(rng.randrange(6)))
    for number, indent in enumerate([None, 2, None]):
        members = [rng.choice([{"query_name": text(), "raw_text": text(), "parsed": {"header": text(), "race": "e"}}, {"raw_text": "r" + text()}, text(), 7, None, [text(), {"raw_text": "}"}]]) for _ in range(80)]
        body = {"version": "}", 'k}"': {"captures": [1, {"raw_text": "no"}]}, "captures": members if number < 2 else [], "note}": "}{", "records": {f"{k}}}": rng.choice([{"latest": {"race": text()}}, {}, 3]) for k in range(40)}}
        folder = tmp_path / f"f{number}"
        folder.mkdir()
        (folder / "a.json").write_text(json.dumps(body, indent=indent, ensure_ascii=number == 0) + "\n" * number, encoding="utf-8")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
        try:
            captures, snapshots = tables.split_archives(spark, str(folder), chunk=40)
            got = sorted((r.ord, r.query_name, r.raw_text, r.parsed and (r.parsed.header, r.parsed.race)) for r in captures.collect())
            shots = sorted((r.key, r.race) for r in snapshots.collect())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        want = [(k, m.get("query_name"), m["raw_text"], "parsed" in m and (m["parsed"]["header"], "e") or None) for k, m in enumerate(body["captures"]) if isinstance(m, dict)]
        assert got == want
        assert shots == sorted((k, r["latest"]["race"]) for k, r in body["records"].items() if isinstance(r, dict) and "latest" in r)


def test_large_objects_that_are_wrong(spark, tmp_path):
    for number, (text, said) in enumerate([('{"captures": []}', "records"), ('{"captures": {}, "records": {}}', "captures"), ('{"captures": [{"a": 1}', "ends before"), ('[{"captures": [], "records": {}}]', "captures"), ('{"a": "} ', "ends before")]):
        (tmp_path / f"{number}.json").write_text(text)
        with pytest.raises(ValueError, match=said):
            tables.split_archives(spark, str(tmp_path / f"{number}.json"))
    (tmp_path / "twice.json").write_text('{"captures": [{"raw_text": "a"}], "records": {}, "captures": [3, {"raw_text": "b"}]}')
    captures, snapshots = tables.split_archives(spark, str(tmp_path / "twice.json"))
    assert [(r.ord, r.raw_text) for r in captures.collect()] == [(1, "b")] and snapshots.count() == 0
