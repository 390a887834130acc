"""Content-addressed WARC archive.

Payload bytes are stored once per verified SHA-256; exact record headers live in
a table of their own; joins on the digest give back the original records, as a
WARC 1.1 reader takes them. Which record is a revisit is decided on ids and
digests alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recordloom.llm.names import quoted
from recordloom.sources.scratch import Scratch, shared_dir

#: Payloads below this many bytes are never replaced by a revisit.
MIN_SHARED_BYTES = 100
#: Capture time of records whose table has none.
NO_DATE = "1970-01-01T00:00:00Z"
_CRLF = "\r\n"
_END = _CRLF + _CRLF
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _body(column: Column) -> Column:
    return F.coalesce(column.cast("binary"), F.lit("").cast("binary"))


def _record_id(digest: Column, page_id: Column, row: Column) -> Column:
    """Identifier of one row's record: a UUID (version 8) of its digest, id and place in the table."""
    h = F.sha2(F.concat_ws("|", digest, F.coalesce(page_id.cast("string"), F.lit("")), row.cast("string")), 256)
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-8"), part(13, 3), F.lit("-a"), part(16, 3), F.lit("-"), part(19, 12), F.lit(">"))


def build_headers(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = MIN_SHARED_BYTES, date: str = NO_DATE) -> DataFrame:
    """One record per row, without its payload: ``page_id, uri, payload_bytes, payload_digest, record_type, refers_to, header``.

    The payload is the body in UTF-8 (null: empty). Among records of equal payload
    of at least ``min_bytes`` that with the smallest id is the response, the others
    revisit it. Rows without an id never become the response of a group that has
    ids; repeated rows with the smallest id are all responses. ``header`` holds the
    exact bytes up to the payload: WARC fields and the head of the HTTP response
    (a revisit's block is that head alone). Record ids are unique, also for repeated
    rows. The page's id and, where it is no plain text, its exact URL stand in
    extension fields, percent-encoded.

    Pages are read for their digests only; ids meet digests in a join of two
    stored tables, so a digest of a third of all pages can be split.
    """
    work = Scratch(pages.sparkSession, "warc-keys")
    body = _body(quoted(body_col))
    keys = pages.select(quoted(id_col).alias("page_id"), quoted(url_col).cast("string").alias("uri"), F.length(body).cast("long").alias("payload_bytes"), F.sha2(body, 256).alias("payload_digest"))
    keys = work.store(keys.withColumn("row", F.monotonically_increasing_id()), "keys")
    shared = keys.filter((F.col("payload_bytes") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("payload_digest").agg(F.min(F.struct("page_id", "row")).alias("first"))
    shared = work.store(shared.select("payload_digest", F.col("first.page_id").alias("f_page"), F.col("first.row").alias("f_row")), "first")
    rows = keys.join(shared.hint("merge"), "payload_digest", "left")
    revisit = F.col("f_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("f_page"))

    uri = F.coalesce("uri", F.lit("urn:none"))
    plain = F.regexp_replace(uri, r"[\x00-\x20\x7f]", "%20")
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(_END))
    field = lambda name, value: F.concat(F.lit(f"{_CRLF}{name}: "), value)
    size = F.length(head).cast("long") + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    some = lambda *parts: F.concat(*[F.coalesce(p, F.lit("")) for p in parts])
    header = some(
        F.lit("WARC/1.1"), field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", _record_id(F.col("payload_digest"), F.col("page_id"), F.col("row"))), field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", plain), field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        F.when(revisit, some(
            field("WARC-Refers-To", _record_id(F.col("payload_digest"), F.col("f_page"), F.col("f_row"))),
            field("WARC-Profile", F.lit(_REVISIT)), field("X-Refers-To-Page-ID", F.url_encode(F.col("f_page").cast("string"))),
        )),
        field("X-Page-ID", F.url_encode(F.col("page_id").cast("string"))),
        F.when(F.col("uri").isNull(), field("X-Target-URI-Missing", F.lit("1"))).when(plain != uri, field("X-Target-URI", F.url_encode("uri"))),
        field("Content-Type", F.lit("application/http;msgtype=response")), field("Content-Length", size.cast("string")), F.lit(_END), head,
    )
    # the keys stay in the shared folder: the headers are read from them
    return rows.select(
        "page_id", "uri", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("f_page")).alias("refers_to"), header.cast("binary").alias("header"),
    )


def write_archive(pages: DataFrame, path: str, body_col: str = "html", **columns) -> str:
    """Writes ``path/headers`` (each record's exact header bytes) and ``path/payloads`` (bytes once per digest); takes the arguments of ``build_headers``.

    Equal payloads are put together in each task before they travel.
    """
    build_headers(pages, body_col=body_col, **columns).select("header", F.col("payload_digest").alias("digest"), "record_type").write.parquet(f"{path}/headers")
    bodies = pages.select(_body(quoted(body_col)).alias("payload")).withColumn("digest", F.sha2("payload", 256))
    bodies.groupBy("digest").agg(F.any_value("payload").alias("payload")).write.parquet(f"{path}/payloads")
    return path


def _verified(spark: SparkSession, path: str) -> DataFrame:
    stored = spark.read.parquet(f"{path}/payloads")
    wrong = F.raise_error(F.concat(F.lit("payload does not match "), "digest"))
    return stored.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(wrong))


def rebuild_records(spark: SparkSession, path: str) -> DataFrame:
    """``record, digest, stored_bytes``: every record's bytes and the size of the full payload, also of revisits.

    A stored payload whose SHA-256 is not its address stops the job, as does a
    record whose payload is lost. Revisits meet their payload's size only.
    """
    headers, payloads = spark.read.parquet(f"{path}/headers"), _verified(spark, path)
    lost = F.raise_error(F.concat(F.lit("no payload for "), "digest"))
    kind = F.col("record_type") == "revisit"
    full = headers.filter(~kind).join(payloads, "digest", "left").withColumn("payload", F.coalesce("payload", lost))
    full = full.select(F.concat("header", "payload", F.lit(_END).cast("binary")).alias("record"), "digest", F.length("payload").cast("long").alias("stored_bytes"))
    sizes = payloads.select("digest", F.length("payload").cast("long").alias("stored_bytes"))
    short = headers.filter(kind).join(sizes, "digest", "left").select(F.concat("header", F.lit(_END).cast("binary")).alias("record"), "digest", F.coalesce("stored_bytes", lost.cast("long")).alias("stored_bytes"))
    return full.unionByName(short)


def parse_records(records: DataFrame) -> DataFrame:
    """Reads each ``record``: adds ``record_type, record_id, refers_to_id, uri, payload_digest, page_id, refers_to, payload``.

    Ids are texts. ``payload`` is what follows the HTTP head (null for revisits). A
    record whose length is not that of its header, block and end stops the job.
    """
    rows = records.withColumn("fields", F.substring_index(F.col("record").cast("string"), _END, 1))
    value = lambda key: F.nullif(F.regexp_extract("fields", rf"\r\n{key}: ([^\r\n]*)", 1), F.lit(""))
    size = F.coalesce(value("Content-Length").try_cast("int"), F.lit(-1))
    whole = F.length("record") == F.octet_length("fields") + 4 + size + 4
    wrong = F.raise_error(F.lit("a record's length is not that of its parts")).cast("binary")
    block = F.when(whole, F.substring(F.col("record"), F.octet_length("fields") + 5, size)).otherwise(wrong)
    rows = rows.withColumn("block", block)
    head = F.substring_index(F.col("block").cast("string"), _END, 1)
    decoded = lambda key: F.url_decode(value(key))
    uri = F.when(value("X-Target-URI-Missing").isNull(), F.coalesce(decoded("X-Target-URI"), value("WARC-Target-URI"), F.lit("")))
    return rows.withColumns(
        {
            "record_type": value("WARC-Type"), "record_id": value("WARC-Record-ID"), "refers_to_id": value("WARC-Refers-To"), "uri": uri,
            "payload_digest": F.regexp_replace(value("WARC-Payload-Digest"), "^sha256:", ""), "page_id": decoded("X-Page-ID"), "refers_to": decoded("X-Refers-To-Page-ID"),
            "payload": F.when(value("WARC-Type") == "response", F.substring(F.col("block"), F.octet_length(head) + 5, F.length("block"))),
        }
    ).drop("fields", "block")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = write_archive(pages, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    back = parse_records(rebuild_records(spark, path))
    kind = pages.schema["page_id"].dataType
    return back.select(
        F.col("page_id").cast(kind).alias("page_id"),
        F.coalesce(F.length("payload").cast("long"), "stored_bytes").alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), "payload_digest").alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
        "uri",
    )


SQL = """
with r as (select page_id, url as uri, coalesce(html, '') as body from pages),
d as (select page_id, uri, octet_length(encode(body)) as n, sha256(body) as digest from r),
f as (select *, min(page_id) over (partition by digest) as first_id from d)
select page_id, n::bigint as payload_bytes, digest as payload_digest,
  case when n >= 100 and first_id is not null and page_id is distinct from first_id then 'revisit' else 'response' end as record_type,
  case when n >= 100 and first_id is not null and page_id is distinct from first_id then first_id end as refers_to, uri
from f
"""
