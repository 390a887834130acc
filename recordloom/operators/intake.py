"""Intake: captures to records, entities, queue and sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from recordloom.functions.exprs import blank_to_null, clean, first_nonblank, fold, id_slug, is_checked, merge_note
from recordloom.operators.ranking import best_per_key, mint_ids
from recordloom.sources.buckets import BucketTable


def is_not_found(text, header, prefix: str) -> Column:
    """Text or header begins with the phrase, case ignored."""
    p = prefix.lower()
    return F.startswith(fold(text), F.lit(p)) | F.startswith(fold(header), F.lit(p))


def is_corrupt(columns: list, name, marker: str, reserved: str) -> Column:
    """The marker occurs in any of the columns, or the name is the reserved one."""
    hits = [F.contains(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), F.lit(marker)) for c in columns]
    return reduce(lambda a, b: a | b, hits) | (fold(name) == reserved.lower())


def capture_digest(keys: list[str]) -> Column:
    """256-bit digest of a row's keys; null and blank differ, and no two lists of values give the same text."""
    part = lambda k: F.coalesce(F.concat(F.length(F.col(k).cast("string")).cast("string"), F.lit(":"), F.col(k).cast("string")), F.lit("-"))
    return F.sha2(F.concat_ws("|", *[part(k) for k in keys]), 256)


def _place(order: list) -> Column:
    """A row's place; one column stays as it is, which sums in a hash table where a struct must be sorted."""
    return F.col(order[0]) if len(order) == 1 and isinstance(order[0], str) else F.struct(*order)


def first_of_digest(captures: DataFrame, order: list) -> DataFrame:
    """``digest, first``: each digest once, with the place of its first capture; combined before its shuffle, and no text travels."""
    return captures.groupBy("digest").agg(F.min(_place(order)).alias("first"))


def captures_of(captures: DataFrame, picked: DataFrame, order: list) -> DataFrame:
    """The captures at the places that ``picked`` (``digest, first``) names."""
    p = picked.select(F.col("digest").alias("__digest"), F.col("first").alias("__first"))
    return captures.join(p, (F.col("digest") == F.col("__digest")) & _place(order).eqNullSafe(F.col("__first")), "left_semi")


def append_unseen(captures: DataFrame, seen: DataFrame, order: list) -> DataFrame:
    """C3 on digests: captures (with ``digest``) whose digest is not ``seen`` and did not come earlier in this run.

    ``order`` rises and settles ties. Digests are picked and compared first; texts
    are only read again for those that are new.
    """
    return captures_of(captures, first_of_digest(captures, order).join(seen.select("digest"), "digest", "left_anti"), order)


def append_new(captures: DataFrame, stored: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Captures whose key neither is stored nor came earlier in this run.

    Keys are compared by a 256-bit digest, null-safe; of what is stored nothing
    else travels. Running it again on its own output adds nothing.
    """
    digest = capture_digest(keys)
    return append_unseen(captures.withColumn("digest", digest), stored.select(digest.alias("digest")), order).select(*captures.columns)


def resolve_entities(captures: DataFrame, name, entities: DataFrame, entity_name, entity_id: str, order: list) -> DataFrame:
    """C4: entity id by folded name; of several entities with one name the last wins; blank without a hit.

    Blank names never match, so the hot blank key stays out of the join.
    """
    last = best_per_key(entities.withColumn("__key", fold(entity_name)).filter("__key <> ''"), ["__key"], order).select("__key", F.col(entity_id).cast("string").alias("__entity"))
    keyed = captures.withColumn("__name", F.when(fold(name) != "", fold(name)))
    return keyed.join(last, F.col("__name") == F.col("__key"), "left").withColumn("entity_id", F.coalesce("__entity", F.lit(""))).drop("__name", "__key", "__entity")


def status_of(not_found: Column, corrupt: Column, status) -> Column:
    """Status after overrides."""
    return F.when(not_found, F.lit("not_found")).otherwise(clean(status))


def confidence_of(not_found: Column, corrupt: Column) -> Column:
    """High for not found, low for corrupt, else medium."""
    return F.when(not_found, F.lit("high")).when(corrupt, F.lit("low")).otherwise(F.lit("medium"))


def provenance_notes(fields: dict[str, object], separator: str = " | ") -> Column:
    """``label=value`` of the fields that are not blank, in the order given."""
    return F.concat_ws(separator, *[F.when(clean(c) != "", F.concat(F.lit(f"{k}="), clean(c))) for k, c in fields.items()])


def mint_record_ids(captures: DataFrame, name, epoch, order: list, taken: DataFrame, base: str = "rec") -> DataFrame:
    """``base_slug_epoch`` (the row's place where the epoch is blank), with a suffix on collision."""
    stem = F.concat(F.lit(base + "_"), id_slug(name), F.lit("_"), F.coalesce(blank_to_null(epoch), F.col("ord").cast("string")))
    return mint_ids(captures.withColumn("__stem", stem), "__stem", order, taken, "record_id").drop("__stem")


def mint_entity_ids(entities: DataFrame, name, order: list, taken: DataFrame) -> DataFrame:
    """Entity ids from the name's slug, with a suffix on collision."""
    return mint_ids(entities.withColumn("__stem", id_slug(name)), "__stem", order, taken, "entity_id").drop("__stem")


def upsert_entities(entities: DataFrame, snapshots: DataFrame, fields: list[str], skip: Column, order: list, seen=("first_seen", "last_seen"), note: str = "seen in archive") -> DataFrame:
    """Entities after the latest snapshots; one output row per entity and per new name.

    Both sides have ``name``, ``fields`` and ``notes``; ``snapshots`` also ``seen_on``.
    Snapshots that ``skip`` or have no name do nothing; of several with one name
    the first in ``order`` counts. Snapshot values that are not blank overwrite,
    blanks keep; first and last seen are only filled when blank; the entity is
    marked checked and the note is added.
    """
    fresh = best_per_key(snapshots.filter(~skip).withColumn("__key", fold("name")).filter("__key <> ''"), ["__key"], order)
    fresh = fresh.select("__key", *[F.col(c).alias(f"__new_{c}") for c in ["name", *fields, "seen_on"]])
    old = entities.withColumn("__key_old", F.when(fold("name") != "", fold("name")))
    both = old.join(fresh, F.col("__key_old") == F.col("__key"), "full_outer")
    touched = F.col("__key").isNotNull()
    out = {"name": F.coalesce("name", "__new_name")}
    out |= {f: F.coalesce(blank_to_null(f"__new_{f}"), clean(f)) for f in fields}
    out |= {s: F.coalesce(blank_to_null(s), clean("__new_seen_on")) for s in seen}
    out |= {"checked": F.when(touched, F.lit("yes")).otherwise(clean("checked")), "notes": F.when(touched, merge_note("notes", F.lit(note))).otherwise(clean("notes"))}
    keep = [c for c in entities.columns if c not in out]
    return both.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in keep], *[v.alias(k) for k, v in out.items()])


def merge_entities(store: BucketTable, snapshots: DataFrame, fields: list[str], skip: Column, order: list, **named) -> list[int]:
    """C9 on a stored table bucketed by ``name``: only buckets that hold a snapshot's name are rewritten; returns these."""
    usable = snapshots.filter(~skip & (fold("name") != ""))
    return store.merge(usable, lambda old, new: upsert_entities(old, new, fields, F.lit(False), order, **named))


#: Flags that close a queue row.
CLOSED = ["true", "yes", "1"]


def queue_marks(queue: DataFrame, captures: DataFrame, names: list, skip: Column, entities: DataFrame, note=None, snapshots: DataFrame | None = None, snapshot_note: str = "imported") -> DataFrame:
    """C11: ``q_ord, note`` of the queue rows that captures, else the latest snapshots, mark.

    ``queue`` has ``name, entity_id, checked, notes, ord``; ``captures`` ``ord``;
    ``entities`` ``name, entity_id, ord``; ``snapshots`` ``name``. Each capture tries
    its candidate names in order, each as a queue name and then as the name of an
    entity whose id the queue has. Its first hit ends the search, whether that row
    is open or not; an open row is marked with the note of its earliest capture. A
    snapshot then marks the open row of its entity's id, else of its name. Of
    queue rows, and entities, with one name or id the last counts; blanks never
    match.
    """
    note = F.concat(F.lit("capture "), F.col("c_ord").cast("string")) if note is None else note
    last = lambda df, key, value: best_per_key(df.select(key.alias("__k"), value.alias("__v"), F.col("ord").alias("__o")).filter("__k <> ''"), ["__k"], [F.col("__o").desc()])
    by_name, by_id = last(queue, fold("name"), F.col("ord")), last(queue, clean("entity_id"), F.col("ord"))
    ids = last(entities, fold("name"), clean("entity_id"))

    def places(tries: DataFrame) -> DataFrame:
        """Adds the queue rows that a folded ``candidate`` has by name and by its entity's id."""
        named = tries.join(by_name.select(F.col("__k").alias("candidate"), F.col("__v").alias("q_name")), "candidate", "left")
        known = named.join(ids.select(F.col("__k").alias("candidate"), F.col("__v").alias("__id")), "candidate", "left")
        return known.join(by_id.select(F.col("__k").alias("__id"), F.col("__v").alias("q_id")), "__id", "left")

    tries = captures.filter(~skip).select(F.col("ord").alias("c_ord"), F.posexplode(F.array(*[fold(n) for n in names])).alias("place", "candidate")).filter("candidate <> ''")
    found = places(tries).withColumn("q_ord", F.coalesce("q_name", "q_id")).filter("q_ord is not null")
    hits = found.groupBy("c_ord").agg(F.min_by("q_ord", "place").alias("q_ord")).withColumn("__note", note)
    done = hits.groupBy("q_ord").agg(F.min_by("__note", "c_ord").alias("__note"))
    marks = done.select("q_ord", F.col("__note").alias("note"), F.lit(0).alias("place"))
    if snapshots is not None:
        later = places(snapshots.select(fold("name").alias("candidate")).filter("candidate <> ''").distinct()).select(F.coalesce("q_id", "q_name").alias("q_ord")).filter("q_ord is not null").distinct()
        marks = marks.unionByName(later.select("q_ord", F.lit(snapshot_note).alias("note"), F.lit(1).alias("place")))
    return marks.groupBy("q_ord").agg(F.min_by("note", "place").alias("note"))


def mark_queue(queue: DataFrame, marks: DataFrame) -> DataFrame:
    """C11: the queue after ``marks``; rows that are closed already stay."""
    m = marks.select(F.col("q_ord").alias("__ord"), F.col("note").alias("__note"))
    out = queue.join(m, F.col("ord") == F.col("__ord"), "left")
    hit = F.col("__note").isNotNull() & ~is_checked("checked", CLOSED)
    out = out.withColumns({"checked": F.when(hit, F.lit("yes")).otherwise(clean("checked")), "notes": F.when(hit, merge_note("notes", "__note")).otherwise(clean("notes"))})
    return out.drop("__ord", "__note")


def complete_queue(queue: DataFrame, captures: DataFrame, names: list, skip: Column, entities: DataFrame, **more) -> DataFrame:
    """C11: the queue after all captures and snapshots; see ``queue_marks``."""
    return mark_queue(queue, queue_marks(queue, captures, names, skip, entities, **more))


def merge_queue(store: BucketTable, captures: DataFrame, names: list, skip: Column, entities: DataFrame, **more) -> list[int]:
    """C11 on a stored queue bucketed by ``ord``: its names and ids are read, and only buckets with a marked row are rewritten; returns these."""
    return store.merge(queue_marks(store.read().select("ord", "name", "entity_id"), captures, names, skip, entities, **more), mark_queue, "q_ord")


def merge_sources(store: BucketTable, new: DataFrame, fill: list[str]) -> list[int]:
    """C12 on a stored registry bucketed by ``source_id``: only buckets of the new rows' ids are rewritten; returns these."""
    return store.merge(new, lambda old, rows: upsert_sources(old, rows, fill))


def upsert_sources(sources: DataFrame, new: DataFrame, fill: list[str]) -> DataFrame:
    """Registry rows by ``source_id``: blanks filled, notes appended, unknown sources inserted."""
    fresh = new.select(F.col("source_id").alias("__id"), *[F.col(c).alias(f"__{c}") for c in [*fill, "notes"]])
    both = sources.join(fresh, F.col("source_id") == F.col("__id"), "full_outer")
    return both.select(
        F.coalesce("source_id", "__id").alias("source_id"),
        *[F.coalesce(blank_to_null(c), clean(f"__{c}")).alias(c) for c in fill],
        merge_note("notes", F.col("__notes")).alias("notes"),
    )


def intake_metrics(flagged: DataFrame, flags: list[str]) -> DataFrame:
    """One row with the number of captures and of each boolean flag."""
    return flagged.agg(F.count("*").alias("captures"), *[F.count_if(F.col(f)).alias(f) for f in flags])


#: Columns with a capture's time, the best first.
TIMES = ["captured_at", "captured_datetime", "captured_date"]


def intake(captures: DataFrame, entities: DataFrame, stored: DataFrame, prefix: str, marker: str, reserved: str) -> dict[str, DataFrame]:
    """C1 to C8, C13 as one job: records to append and metrics; nothing is written here.

    ``captures``: ``ord, query_name, raw_text, header, character_name, captured_at,
    captured_datetime, captured_date, captured_epoch, status`` (a time that the
    table lacks is blank); ``entities``: ``entity_id, name, ord``;
    ``stored``: earlier records (``record_id, name_key, captured_at, raw_text``).
    """
    missing = is_not_found("raw_text", "header", prefix)
    corrupt = is_corrupt(["raw_text", "header"], "character_name", marker, reserved)
    named = captures.withColumns({"name": first_nonblank("character_name", "query_name"), "captured_at": first_nonblank(*[c for c in TIMES if c in captures.columns]), "raw_text": clean("raw_text"), "not_found": missing, "corrupt": corrupt})
    named = named.withColumn("name_key", fold("name"))
    new = append_new(named, stored, ["name_key", "captured_at", "raw_text"], ["ord"])
    found = resolve_entities(new, "name", entities, "name", "entity_id", [F.col("ord").desc()])
    staged = found.withColumns({"status": status_of(F.col("not_found"), F.col("corrupt"), "status"), "confidence": confidence_of(F.col("not_found"), F.col("corrupt")), "notes": provenance_notes({"query": "query_name", "header": "header", "epoch": "captured_epoch"})})
    records = mint_record_ids(staged, "name", "captured_epoch", ["ord"], stored.select(F.col("record_id").alias("id")))
    return {"records": records, "metrics": intake_metrics(staged, ["not_found", "corrupt"])}
