"""Queries of intake, re-capture and checks over the driver tables (C, D, E)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from recordloom.functions import exprs as E
from recordloom.operators import checks, intake, recapture
from recordloom.operators.ranking import numbered_slugs
from recordloom.sources.buckets import BucketTable
from recordloom.sources.scratch import shared_dir
from recordloom.streaming.intake_stream import stream_intake
from recordloom.plans.tables import sql_clean, sql_fold, sql_id_slug, sql_normalise, sql_page_slug, table

# ---- intake -----------------------------------------------------------------
_PREFIX, _MARKER = "the ", "###"


def c1_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags and overrides of document captures."""
    d = table(spark, sf_dir, "documents")
    missing = intake.is_not_found("text", "lang", _PREFIX)
    corrupt = intake.is_corrupt(["text"], "source", _MARKER, "src3")
    d = d.withColumns({"not_found": missing, "corrupt": corrupt})
    return d.select("doc_id", "not_found", "corrupt", intake.status_of(F.col("not_found"), F.col("corrupt"), "lang").alias("status"), intake.confidence_of(F.col("not_found"), F.col("corrupt")).alias("confidence"))


def _events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.withColumns({"ord": F.col("event_id"), "user": F.col("user_id").cast("string"), "amount": F.col("value").cast("string"), "day": F.date_format("ts", "yyyy-MM-dd")})


def c3_append_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events sent again after those of even ids are stored."""
    e = _events(spark, sf_dir)
    return intake.append_new(e, e.filter("event_id % 2 = 0"), ["user", "event_type", "value"], ["ord"]).select("event_id", "user_id", "event_type", "value")


def c4_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts to the last part of the same folded name."""
    p = table(spark, sf_dir, "part").withColumn("ord", F.col("p_partkey"))
    out = intake.resolve_entities(p, E.first_nonblank("p_name", "p_brand"), p.select("p_name", "p_partkey"), "p_name", "p_partkey", [F.col("p_partkey").desc()])
    return out.select("p_partkey", "entity_id")


def c6_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return e.select("event_id", intake.provenance_notes({"type": "event_type", "user": "user", "flag": F.when(F.col("value") > 50, "big"), "day": "day"}).alias("notes"))


def c7_record_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of events by user and day; some are taken."""
    e = _events(spark, sf_dir)
    taken = e.filter("event_id % 5 = 0").select(F.concat(F.lit("rec_"), F.col("user"), F.lit("_"), F.col("day"), F.lit("_2")).alias("id"))
    return intake.mint_record_ids(e, "user", "day", ["ord"], taken).select("event_id", "record_id")


def c8_entity_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    taken = p.filter("p_partkey % 7 = 0").select(E.id_slug("p_name").alias("id"))
    return intake.mint_entity_ids(p, "p_name", ["p_partkey"], taken).select("p_partkey", "entity_id")


def _entities_and_shots(spark, sf_dir):
    """Customers in credit are known; the latest order of each customer is a snapshot."""
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 0")
    known = c.select(F.col("c_custkey").cast("string").alias("name"), F.col("c_mktsegment").alias("status"), F.lit("").alias("level"), F.lit("").alias("first_seen"), F.lit("2000-01-01").alias("last_seen"), F.lit("").alias("checked"), F.lit("old").alias("notes"))
    o = table(spark, sf_dir, "orders")
    shots = o.select(F.col("o_custkey").cast("string").alias("name"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"), F.col("o_orderpriority").alias("level"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("seen_on"), "o_orderkey", "o_orderpriority", "o_custkey")
    return known, shots, {"fields": ["status", "level"], "skip": F.col("o_orderpriority") == "5-LOW", "order": [F.col("o_orderkey").desc()]}


def c9_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, shots, how = _entities_and_shots(spark, sf_dir)
    return intake.upsert_entities(known, shots, **how)


def c9_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C9 on a stored table that snapshots are merged into; some of them come again."""
    known, shots, how = _entities_and_shots(spark, sf_dir)
    store = _stored(spark, known, "name")
    for some in (shots, shots.filter("o_custkey = 1")):
        intake.merge_entities(store, some, **how)
    return store.read()


def _stored(spark, rows, key):
    store = BucketTable(spark, f"{shared_dir(spark)}/table-{uuid.uuid4().hex}", key, 16)
    store.create(rows)
    return store


def _queue_and_captures(spark, sf_dir):
    """C11: customers as queue (one half by id alone) and, in credit, as entities; orders as captures with the key, then the next key, as
    candidate names; urgent open orders as snapshots."""
    c = table(spark, sf_dir, "customer").withColumns({"ord": F.col("c_custkey"), "key": F.col("c_custkey").cast("string")})
    queue = c.select("ord", F.when(F.col("c_nationkey") % 2 == 0, F.col("key")).alias("name"), F.concat(F.lit("id_"), "key").alias("entity_id"), F.when(F.col("c_mktsegment") == "BUILDING", "yes").otherwise("no").alias("checked"), F.lit("").alias("notes"))
    entities = c.filter("c_acctbal > 0").select("ord", F.col("key").alias("name"), F.concat(F.lit("id_"), "key").alias("entity_id"))
    o = table(spark, sf_dir, "orders").withColumns({"ord": F.col("o_orderkey"), "n1": F.col("o_custkey").cast("string"), "n2": (F.col("o_custkey") + 1).cast("string")})
    shots = o.filter("o_orderstatus = 'O' and o_orderpriority = '1-URGENT'").select(F.col("n1").alias("name"))
    return queue, (o.select("ord", "n1", "n2", "o_orderstatus"), [F.lit(""), "n1", "n2"], F.col("o_orderstatus") != "F", entities), {"snapshots": shots}


def c11_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue, captures, more = _queue_and_captures(spark, sf_dir)
    return intake.complete_queue(queue, *captures, **more).select(F.col("ord").alias("c_custkey"), "checked", "notes")


def c11_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11 on a stored queue, of which only buckets with a marked row are rewritten."""
    queue, captures, more = _queue_and_captures(spark, sf_dir)
    store = _stored(spark, queue, "ord")
    intake.merge_queue(store, *captures, **more)
    return store.read().select(F.col("ord").alias("c_custkey"), "checked", "notes")


def c2_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 to C6 as one job: turns of conversations as captures with one of three times, customers as entities."""
    c = table(spark, sf_dir, "conversations")
    at = lambda k: F.when(F.col("turn") % 3 == k, F.concat(F.lit(f"t{k}_"), F.col("turn").cast("string")))
    caps = c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.col("role").alias("query_name"), F.col("text").alias("raw_text"), F.lit(None).cast("string").alias("header"),
        F.when(F.col("turn") % 2 == 0, F.col("conv_id").cast("string")).alias("character_name"), at(0).alias("captured_at"), at(1).alias("captured_datetime"), at(2).alias("captured_date"),
        F.lit("").alias("captured_epoch"), F.lit("known").alias("status"), "conv_id", "turn",
    )
    entities = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("name"), F.concat(F.lit("e"), F.col("c_custkey").cast("string")).alias("entity_id"), F.col("c_custkey").alias("ord"))
    stored = spark.createDataFrame([], "record_id string, name_key string, captured_at string, raw_text string")
    out = intake.intake(caps, entities, stored, "the ", "###", "system")["records"]
    return out.select("conv_id", "turn", "name", "captured_at", "entity_id", "status", "confidence", "record_id")


def c14_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14: events arriving as files, taken by the stream in four batches: a third of them each, then all of them again."""
    e = _events(spark, sf_dir).select("ord", "user", "event_type", "amount")
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    for k in range(3):
        e.filter(F.col("ord") % 3 == k).repartition(2).write.mode("append").parquet(f"{path}/in")
    e.withColumn("ord", F.col("ord") + 10**9).repartition(2).write.mode("append").parquet(f"{path}/in")
    query = stream_intake(spark, f"{path}/in", e.schema, f"{path}/out", f"{path}/progress", ["user", "event_type", "amount"], ["ord"], files=2, prefix=1)
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.schema(e.schema).parquet(f"{path}/out").select("ord", F.col("user").cast("long").alias("user_id"), "event_type", F.col("amount").cast("double").alias("value"))


def _sources(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("source is not null")
    old = d.filter("doc_id % 3 = 0").select(F.col("source").alias("source_id")).distinct().withColumns({"title": F.lit(""), "notes": F.lit("listed")})
    new = d.groupBy(F.col("source").alias("source_id")).agg(F.concat(F.lit("docs "), F.count("*").cast("string")).alias("title"), F.lit("counted").alias("notes"))
    return old, new


def c12_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.upsert_sources(*_sources(spark, sf_dir), ["title"])


def c12_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C12 on a stored registry that rows are merged into; some of them come again."""
    old, new = _sources(spark, sf_dir)
    store = _stored(spark, old, "source_id")
    for some in (new, new.filter("source_id = 'src1'")):
        intake.merge_sources(store, some, ["title"])
    return store.read()


def c13_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.intake_metrics(c1_flags(spark, sf_dir), ["not_found", "corrupt"])


# ---- re-capture --------------------------------------------------------------
_VOLATILE, _MISSING = r"\d+", "no one"


def _wanted(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("key")).filter("key <> ''").distinct()


def d1_first_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations by role, then id, against a watch list."""
    c = table(spark, sf_dir, "conversations").withColumns({"ord": F.col("conv_id") * 1000 + F.col("turn")})
    wanted = c.filter("conv_id % 4 = 0").select(F.col("conv_id").cast("string").alias("key")).union(c.select(F.lit("assistant").alias("key")))
    return recapture.first_alias(c, [F.col("conv_id").cast("string"), F.col("role")], wanted).select("conv_id", "turn", "alias")


def d2_all_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("ord", F.col("doc_id"))
    wanted = d.filter(F.col("source").isin("src1", "src2") | (F.col("lang") == "fr")).select(F.explode(F.array(F.lit("fr"), "source")).alias("key"))
    return recapture.all_aliases(d, [F.col("lang"), F.col("source"), F.col("lang")], wanted).select(F.col("ord").alias("doc_id"), "key")


def _pairs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumns({"ord": F.col("doc_id")})
    return recapture.last_two(d, "source", "text", _wanted(spark, sf_dir))


def d4_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last two documents of every source."""
    out = recapture.compare_pairs(_pairs(spark, sf_dir), _VOLATILE, "<n>", _MISSING, ["###", "!!", " the ", " de "])
    return out.select(F.col("key").alias("source"), "n_captures", "latest_ord", "previous_ord", "change", F.array_join("phrase_hits", ";").alias("hits"))


def d6_line_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recapture.line_changes(_pairs(spark, sf_dir)).select(F.col("key").alias("source"), "line", "change")


def d7_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recapture.class_counts(d4_changes(spark, sf_dir))


def d9_supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per user and type; purchases and clicks are acceptable."""
    e = _events(spark, sf_dir).select("ord", "user", "event_type").withColumn("quality", F.when(F.col("event_type").isin("purchase", "click"), "high").otherwise("medium"))
    keys = e.filter("ord % 3 <> 0").select("ord", F.explode(F.array("user", "event_type")).alias("key"))
    out = recapture.supersede(e, keys, F.col("quality") == "high")
    by = F.array_join(F.transform("superseded_by", lambda x: F.concat(x["key"], F.lit(":"), x["good_ord"].cast("string"))), ";")
    return out.select(F.col("ord").alias("event_id"), "quality", "original_quality", by.alias("superseded_by"))


def _labelled(spark, sf_dir):
    """Documents as captures: some have text only, some markup only, some both; the id holds a time."""
    l = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    d = table(spark, sf_dir, "documents").join(l, "doc_id", "left")
    q = F.when(F.col("q") == 1, "high").when(F.col("q") == 0, "low").otherwise("")
    return d.select(
        "doc_id", "source", F.when(F.length("text") % 7 > 2, F.col("text")).alias("raw_text"), F.when(F.contains("text", F.lit("|")), F.col("text")).alias("raw_html"), F.when(F.col("lang") == "de", F.col("text")).alias("raw_decho"),
        q.alias("capture_quality"), F.concat(F.lit("q:"), (F.col("n_chars") + 10**9).cast("string"), F.lit(":"), F.col("doc_id").cast("string")).alias("capture_id"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("ansi")).alias("raw_colour_format"), F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("t"), (F.col("n_chars") % 10).cast("string"))).alias("sent_at"),
    )


def _best_display(captures):
    order = [E.clean("sent_at").desc(), recapture.capture_time("capture_id").desc(), F.col("capture_id").desc()]
    return recapture.best_display(captures, "source", "capture_quality", ["raw_text", "raw_html"], ["raw_html", "raw_decho", "raw_colour_format"], order)


def d11_best_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best_display(_labelled(spark, sf_dir)).select("name_key", "doc_id", "capture_quality")


def d12_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index of the chosen documents with an entity id and flags."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("name_key"), F.col("n_name").alias("entity_id"))
    out = recapture.index_of(_best_display(_labelled(spark, sf_dir)), n, "source", {"has_text": "raw_text", "has_quality": "capture_quality"})
    return out.select("doc_id", "name_key", "entity_id", "has_text", "has_quality")


def d13_evidence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.filter((E.clean("html") != "") & (E.clean("url") != "")).select("page_id", E.page_slug("url").alias("slug"), F.length("html").cast("long").alias("n_chars"))


def d14_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("slug", E.page_slug("p_name"))
    return numbered_slugs(p, "slug", ["p_partkey"]).select("p_partkey", "page_slug")


def d15_quality_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _labelled(spark, sf_dir)
    return recapture.quality_shift(l, _best_display(l), "capture_quality")


# ---- checks ------------------------------------------------------------------
def _checks(spark, sf_dir):
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    p, c = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    day = lambda x: F.date_format(x, "yyyy-MM-dd")
    dated = l.join(o, l["l_orderkey"] == o["o_orderkey"]).select("l_orderkey", day("o_orderdate").alias("s"), day("l_shipdate").alias("e"))
    return {
        "e2_unique": checks.check_unique(l, "lineitem", ["l_orderkey", "l_linenumber"]),
        "e3_allowed": checks.check_allowed(o, "orders", "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"], "o_orderkey"),
        "e4_dates": checks.check_dates(dated, "lineitem", "s", "e", "l_orderkey"),
        "e5_foreign_key": checks.check_foreign_key(l.select(F.col("l_orderkey"), F.concat(F.col("l_orderkey").cast("string"), F.lit("; ")).alias("ids")), "lineitem", "ids", "l_orderkey", o.filter("o_orderstatus = 'F'"), "o_orderkey"),
        "e6_repeated_names": checks.check_repeated_names(p, "part", "p_name", p.filter("p_partkey <= 20").select(F.col("p_name").alias("name"))),
        "e7_unlinked": checks.check_unlinked(c, "customer", "c_custkey", o.filter("o_orderdate < timestamp '1993-01-01'"), "o_custkey"),
    }


def _check_query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _checks(spark, sf_dir)[name]

    return run


def e1_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns and tables that are missing, and members that the events' records lack (one of them those of even ids)."""
    o, e = table(spark, sf_dir, "orders"), table(spark, sf_dir, "events")
    records = e.select(F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.to_json(F.struct("event_type", F.get_json_object("props", "$.k").alias("k")))).alias("record"))
    return checks.validate(
        checks.check_members(records, "events", "record", ["k", "event_type", "v"]), checks.check_columns(spark, o, "orders", ["o_orderkey", "o_channel", "o_clerk"]), checks.check_columns(spark, None, "shipments", ["s_id"]))


def e9_issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E9 (with E1): all findings counted by level and check; lineitem, part and customer are scanned once."""
    l, o, p, c = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part", "customer"))
    columns = checks.check_columns(spark, o, "orders", ["o_orderkey", checks.first_existing(o, ["priority", "o_orderpriority"])])
    day = lambda x: F.date_format(x, "yyyy-MM-dd")
    # every line has an order, so the lines with their orders' dates are all lines
    dated = l.select("l_orderkey", "l_linenumber", "l_shipdate").join(o.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    dated = dated.select("l_orderkey", "l_linenumber", day("o_orderdate").alias("s"), day("l_shipdate").alias("e"))
    all_of = checks.Counting().table("lineitem", dated).table("orders", o).table("part", p).table("customer", c)
    all_of.unique("lineitem", ["l_orderkey", "l_linenumber"]).rows("lineitem", [checks.wrong_dates("s", "e")])
    all_of.rows("orders", [checks.not_allowed("o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"])])
    all_of.foreign_key("lineitem", "l_orderkey", "orders", "o_orderkey", F.col("o_orderstatus") == "F")
    all_of.repeated_names("part", "p_name", "part", "p_name", F.col("p_partkey") <= 20)
    all_of.unlinked("customer", "c_custkey", "orders", "o_custkey", F.col("o_orderdate") < F.lit("1993-01-01").cast("timestamp"))
    return checks.issue_counts(columns).unionByName(all_of.counts()).groupBy("level", "check").agg(F.sum("n").alias("n"))


QUERIES = {
    "c1_flags": c1_flags, "c3_append_new": c3_append_new, "c4_resolve": c4_resolve, "c6_notes": c6_notes, "c7_record_ids": c7_record_ids, "c8_entity_ids": c8_entity_ids,
    "c9_upsert": c9_upsert, "c2_intake": c2_intake, "c14_stream": c14_stream, "c11_queue": c11_queue, "c12_sources": c12_sources, "c9_stored": c9_stored, "c11_stored": c11_stored, "c12_stored": c12_stored, "c13_metrics": c13_metrics,
    "d1_first_alias": d1_first_alias, "d2_all_aliases": d2_all_aliases, "d4_changes": d4_changes, "d6_line_changes": d6_line_changes, "d7_class_counts": d7_class_counts,
    "d9_supersede": d9_supersede, "d11_best_display": d11_best_display, "d12_index": d12_index, "d13_evidence_index": d13_evidence_index, "d14_slugs": d14_slugs, "d15_quality_shift": d15_quality_shift,
    **{n: _check_query(n) for n in ("e2_unique", "e3_allowed", "e4_dates", "e5_foreign_key", "e6_repeated_names", "e7_unlinked")}, "e1_columns": e1_columns, "e9_issue_counts": e9_issue_counts,
}

_flags = f"""select doc_id, starts_with({sql_fold('text')}, 'the ') or starts_with({sql_fold('lang')}, 'the ') as not_found,
  contains(coalesce(text, ''), '###') or {sql_fold('source')} = 'src3' as corrupt, lang from documents"""
_minted = lambda base, key, taken, table: f"""
with t as ({taken}), b as (select {key}, {base} as base, row_number() over (partition by {base} order by {key}) as k from {table}),
u as (select distinct case when regexp_matches(id, '_\\d+$') and regexp_extract(id, '_(\\d+)$', 1)::int >= 2 then regexp_replace(id, '_\\d+$', '') end as base, case when regexp_matches(id, '_\\d+$') then regexp_extract(id, '_(\\d+)$', 1)::int end as n from t
  union select distinct id, 1 from t),
m as (select base, max(k) + 200 as top from b group by base),
f as (select base, n, row_number() over (partition by base order by n) as k from (select base, unnest(range(1, top)) as n from m) x where not exists (select 1 from u where u.base = x.base and u.n = x.n))
select b.{key}, b.base || case when f.n = 1 then '' else '_' || f.n end as"""
_n = sql_normalise
_pairs_sql = """
with d as (select doc_id, source, text, row_number() over (partition by source order by doc_id desc) as k, count(*) over (partition by source) as n from documents where source <> ''),
p as (select a.source, a.n as n_captures, a.doc_id as latest_ord, b.doc_id as previous_ord, a.text as latest, b.text as previous from d a left join d b on a.source = b.source and b.k = 2 where a.k = 1)"""
_mask = lambda x: rf"regexp_replace({_n(x)}, '\d+', '<n>', 'g')"
_head = lambda x: rf"coalesce(list_filter(string_split({x}, chr(10)), lambda x: trim(x) <> '')[1], '')"
_changes = rf"""{_pairs_sql}, q as (select *, {_mask('previous')} as a, {_mask('latest')} as b from p)
select source, n_captures, latest_ord, previous_ord, case when previous_ord is null then 'fewer_than_two_captures' when a = b then 'same_or_equivalent'
  when contains(a, 'no one') and trim(b) = 'no one' then 'previous_not_found_with_extra_contamination'
  when starts_with(a, b) and length(a) > length(b) then 'previous_has_extra_after_clean_capture'
  when b <> '' and contains(a, b) then 'latest_is_subset_of_previous_review_previous_extra'
  when {_head('a')} <> '' and {_head('a')} = {_head('b')} then 'same_header_but_body_differs_review' else 'different_review' end as change,
  concat_ws(';', case when contains(latest, '###') then '###' end, case when contains(latest, '!!') then '!!' end, case when contains(latest, ' the ') then ' the ' end, case when contains(latest, ' de ') then ' de ' end) as hits from q"""
_lab = """with l as (select doc_id, max(quality) as q from labels group by 1),
d as (select doc_id, source, lang, n_chars, contains(text, '|') as html, length(text) % 7 > 2 and trim(text) <> '' as plain, case q when 1 then 'high' when 0 then 'low' else '' end as capture_quality from documents left join l using (doc_id)),
b as (select *, lower(coalesce(source, '')) as name_key from (select *, row_number() over (partition by lower(coalesce(source, '')) order by case capture_quality when 'high' then 4 else 2 end desc, html desc, coalesce(lang, '') = 'de' desc, doc_id % 3 = 0 desc, case when doc_id % 5 <> 0 then 't' || n_chars % 10 else '' end desc,
  (1000000000 + n_chars)::varchar desc, 'q:' || (1000000000 + n_chars) || ':' || doc_id desc) as k from d where capture_quality <> 'low' and (plain or html)) where k = 1)"""
_issue = lambda level, check, t, key, msg, rest: f"select {level} as level, '{check}' as \"check\", '{t}' as table_name, {key} as row_key, {msg} as message {rest}"
_E = {
    "e2_unique": _issue("'error'", "unique", "lineitem", "l_orderkey || ',' || l_linenumber", "'repeated ' || count(*)", "from lineitem group by l_orderkey, l_linenumber having count(*) > 1"),
    "e3_allowed": _issue("'error'", "allowed", "orders", "o_orderkey::varchar", "'o_orderpriority: ' || o_orderpriority", "from orders where o_orderpriority not in ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')"),
    "e4_dates": _issue("'error'", "dates", "lineitem", "l_orderkey::varchar", "'start after end'", "from lineitem join orders on l_orderkey = o_orderkey where o_orderdate::date > l_shipdate::date"),
    "e5_foreign_key": _issue("'error'", "foreign key", "lineitem", "l_orderkey::varchar", "'unknown id ' || l_orderkey", "from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')"),
    "e6_repeated_names": _issue("case when p_name in (select p_name from part where p_partkey <= 20) then 'info' else 'warning' end", "repeated name", "part", "lower(p_name)", "'repeated ' || count(*)", "from part group by p_name having count(*) > 1"),
    "e7_unlinked": _issue("'info'", "unlinked", "customer", "''", "'unlinked ' || count(*)", "from customer where c_custkey not in (select o_custkey from orders where o_orderdate < timestamp '1993-01-01')"),
}
SQL = {
    "c1_flags": f"with f as ({_flags}) select doc_id, not_found, corrupt, case when not_found then 'not_found' else lang end as status, case when not_found then 'high' when corrupt then 'low' else 'medium' end as confidence from f",
    "c3_append_new": """select event_id, user_id, event_type, value from (select *, row_number() over (partition by user_id, event_type, value order by event_id) as k from events) e
where k = 1 and not exists (select 1 from events s where s.event_id % 2 = 0 and s.user_id = e.user_id and s.event_type = e.event_type and s.value = e.value)""",
    "c4_resolve": "select p_partkey, (max(p_partkey) over (partition by lower(p_name)))::varchar as entity_id from part",
    "c6_notes": "select event_id, concat_ws(' | ', 'type=' || event_type, 'user=' || user_id, case when value > 50 then 'flag=big' end, 'day=' || strftime(ts, '%Y-%m-%d')) as notes from events",
    "c7_record_ids": _minted("'rec_' || user_id || '_' || strftime(ts, '%Y-%m-%d')", "event_id", "select 'rec_' || user_id || '_' || strftime(ts, '%Y-%m-%d') || '_2' as id from events where event_id % 5 = 0", "events") + " record_id from b join f on b.base = f.base and b.k = f.k",
    "c8_entity_ids": _minted(sql_id_slug("p_name"), "p_partkey", f"select {sql_id_slug('p_name')} as id from part where p_partkey % 7 = 0", "part") + " entity_id from b join f on b.base = f.base and b.k = f.k",
    "c9_upsert": """
with s as (select * from (select o_custkey::varchar as name, case when o_orderstatus <> 'P' then o_orderstatus end as status, o_orderpriority as level, strftime(o_orderdate, '%Y-%m-%d') as seen,
  row_number() over (partition by o_custkey order by o_orderkey desc) as k from orders where o_orderpriority <> '5-LOW') where k = 1),
c as (select c_custkey::varchar as name, c_mktsegment as status from customer where c_acctbal > 0)
select coalesce(c.name, s.name) as name, coalesce(s.status, c.status, '') as status, coalesce(s.level, '') as level, coalesce(s.seen, '') as first_seen,
  case when c.name is null then s.seen else '2000-01-01' end as last_seen, case when s.name is null then '' else 'yes' end as checked,
  case when c.name is null then 'seen in archive' when s.name is null then 'old' else 'old | seen in archive' end as notes from c full join s on c.name = s.name""",
    "c11_queue": """
with r as (select c_custkey as k, c_mktsegment = 'BUILDING' as closed, c_nationkey % 2 = 0 or c_acctbal > 0 as found from customer),
h as (select o_orderkey, case when a.found then a.k when b.found then b.k end as k from orders left join r a on a.k = o_custkey left join r b on b.k = o_custkey + 1 where o_orderstatus = 'F'),
d as (select k, min(o_orderkey) as o from h where k is not null group by 1),
s as (select distinct r.k from orders join r on r.k = o_custkey where found and o_orderstatus = 'O' and o_orderpriority = '1-URGENT')
select r.k as c_custkey, case when closed or d.o is not null or s.k is not null then 'yes' else 'no' end as checked,
  case when closed then '' when d.o is not null then 'capture ' || d.o when s.k is not null then 'imported' else '' end as notes from r left join d on r.k = d.k left join s on r.k = s.k""",
    "c2_intake": f"""
with c as (select conv_id, turn, {sql_clean('text')} as raw, coalesce(text, '') as text, case when turn % 2 = 0 then conv_id::varchar else role end as name, 't' || turn % 3 || '_' || turn as captured_at, turn % 2 = 0 as named from conversations),
f as (select *, row_number() over (partition by lower(name), captured_at, raw order by conv_id, turn) as k from c),
n as (select *, starts_with(lower({sql_clean('text')}), 'the ') as nf, contains(text, '###') or (named and lower(name) = 'system') as bad from f where k = 1)
select conv_id, turn, name, captured_at, coalesce('e' || c_custkey, '') as entity_id, case when nf then 'not_found' else 'known' end as status, case when nf then 'high' when bad then 'low' else 'medium' end as confidence,
  'rec_' || lower(name) || '_' || (conv_id * 1000 + turn) as record_id from n left join customer on name = c_custkey::varchar""",
    "c14_stream": "select event_id as ord, user_id, event_type, value from (select *, row_number() over (partition by user_id, event_type, value order by event_id % 3, event_id) as k from events) where k = 1",
    "c12_sources": """select source as source_id, 'docs ' || count(*) as title, case when count(*) filter (where doc_id % 3 = 0) > 0 then 'listed | counted' else 'counted' end as notes from documents where source is not null group by source""",
    "c13_metrics": f"with f as ({_flags}) select count(*) as captures, count(*) filter (where not_found) as not_found, count(*) filter (where corrupt) as corrupt from f",
    "d1_first_alias": "select conv_id, turn, case when conv_id % 4 = 0 then conv_id::varchar else role end as alias from conversations where conv_id % 4 = 0 or role = 'assistant'",
    "d2_all_aliases": """with w as (select distinct source as key from documents where source in ('src1', 'src2') or lang = 'fr' union select 'fr' from documents where source in ('src1', 'src2') or lang = 'fr')
select doc_id, key from (select doc_id, lang as key from documents union select doc_id, source from documents) where key <> '' and key in (select key from w)""",
    "d4_changes": _changes,
    "d6_line_changes": f"""{_pairs_sql}, x as (select source, unnest(string_split({_n('previous')}, chr(10))) as line, -1 as n from p where previous_ord is not null
  union all select source, unnest(string_split({_n('latest')}, chr(10))), 1 from p where previous_ord is not null)
select source, line, sum(n)::bigint as change from x group by all having sum(n) <> 0""",
    "d7_class_counts": f"select change, count(*) as n from ({_changes}) group by change",
    "d9_supersede": """
with e as (select event_id, user_id::varchar as u, event_type as t, case when event_type in ('purchase', 'click') then 'high' else 'medium' end as quality from events),
k as (select event_id, unnest([u, t]) as key from e where event_id % 3 <> 0), g as (select key, max(event_id) as good from k join e using (event_id) where quality = 'high' group by 1),
p as (select event_id, bool_or(coalesce(k.event_id = good, false)) as stays, string_agg(key || ':' || good, ';' order by key) filter (where good is not null) as later from k left join g using (key) group by 1)
select e.event_id, case when not stays then 'low' else quality end as quality, case when not stays then quality end as original_quality, case when not stays then coalesce(later, '') end as superseded_by from e left join p using (event_id)""",
    "d11_best_display": f"{_lab} select name_key, doc_id, capture_quality from b",
    "d12_index": f"{_lab} select doc_id, name_key, coalesce(n_name, '') as entity_id, case when plain then 'yes' else 'no' end as has_text, case when capture_quality <> '' then 'yes' else 'no' end as has_quality from b left join nation on name_key = 'src' || n_nationkey",
    "d13_evidence_index": f"select page_id, {sql_page_slug('url')} as slug, length(html) as n_chars from pages where trim(html) <> '' and trim(url) <> ''",
    "d14_slugs": f"with s as (select p_partkey, {sql_page_slug('p_name')} as s from part) select p_partkey, case row_number() over w when 1 then s else s || '-' || row_number() over w end as page_slug from s window w as (partition by s order by p_partkey)",
    "d15_quality_shift": f"{_lab}, x as (select capture_quality as q, count(*) as n from d group by 1), y as (select capture_quality as q, count(*) as n from b group by 1) select q as quality, coalesce(x.n, 0) as n_before, coalesce(y.n, 0) as n_after from x full join y using (q)",
    **_E,
    "e1_columns": """select 'error' as level, 'columns' as "check", * from (values ('orders', 'o_channel', 'missing column'), ('orders', 'o_clerk', 'missing column'), ('shipments', '', 'missing table')) t(table_name, row_key, message)
union all select 'error', 'columns', 'events', m, 'missing member in ' || n from (select 'v' as m, count(*) as n from events union all select 'event_type', count(*) filter (where event_id % 2 = 0) from events union all select 'k', count(*) filter (where json_extract(props, '$.k') is null) from events) where n > 0""",
    "e9_issue_counts": "select level, \"check\", count(*) as n from (" + " union all ".join(f"({q})" for q in _E.values()) + ") group by all",
}
SQL |= {f"{n}_stored": SQL[q] for n, q in (("c9", "c9_upsert"), ("c11", "c11_queue"), ("c12", "c12_sources"))}
