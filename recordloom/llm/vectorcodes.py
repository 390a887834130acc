"""Vector code compression: product codes by Lloyd's rounds whose members stay where they are.

Each vector part is a row that lives with its codebook entry: rows are dealt by
(position, entry, salt). A round reads them in place: every part finds its
nearest entry, parts that keep theirs stay in the file they are in, and only those
that change it go through a shuffle to their new entry. Entries are then renewed
from the parts that live with them, which gives one partial sum per entry and
file. All arithmetic is in whole numbers, so results do not depend on order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from recordloom.llm.names import quoted
from recordloom.llm.vectors import finite, floored, matrix, width
from recordloom.sources.scratch import Scratch, materialize

#: Parts of a vector, entries of a part's codebook, rounds, factor of the integer form.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Parts that a task holds, about; (position, entry, salt) groups per task, at least.
TASK_PARTS, GROUPS = 500_000, 4
#: Codes have two hex digits.
ENTRIES_LIMIT = 256


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each part and its squared distance, ties to the lower index; exact in 64 bits."""
    best, error = np.zeros(len(part), np.int32), np.full(len(part), np.iinfo(np.int64).max)
    for k, entry in enumerate(book):
        d = ((part - entry) ** 2).sum(1)
        less = d < error
        best[less], error[less] = k, d[less]
    return best, error


def _assigned(parts: DataFrame, books: np.ndarray) -> DataFrame:
    """Parts with their nearest entries; ``moved`` marks those that had another."""
    size = books.shape[2]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            position, old = batch.column(1).to_numpy(), batch.column(3).to_numpy()
            part = matrix(batch.column(2), size, np.int64)
            new, error = np.zeros(len(part), np.int32), np.zeros(len(part), np.int64)
            for p in np.unique(position):
                at = np.flatnonzero(position == p)
                new[at], error[at] = nearest(part[at], books[p])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(new), pa.array(error), pa.array(new != old)], ["row", "position", "part", "entry", "error", "moved"])

    return parts.select("row", "position", "part", "entry").mapInArrow(assign, "row long, position int, part array<int>, entry int, error long, moved boolean")


def _settled(movers: DataFrame, tasks: int, work: Scratch, name: str) -> DataFrame:
    """Parts dealt to where their entries live; an entry of many parts has as many salts as its share of all parts asks for."""
    count = {(r["position"], r["entry"]): r["count"] for r in movers.groupBy("position", "entry").count().collect()}  # positions x entries at most
    total = sum(count.values())
    salts = F.lit(1)
    if count:
        pairs = [F.lit(x) for (p, e), n in count.items() for x in (p * ENTRIES_LIMIT + e, max(1, -(-n * GROUPS * tasks // total)))]
        salts = F.element_at(F.create_map(*pairs), F.col("position") * ENTRIES_LIMIT + F.col("entry"))
    return work.store(movers.withColumn("salt", F.pmod(F.xxhash64("row"), salts)).repartition(tasks, "position", "entry", "salt").drop("salt", "error", "moved"), name)


def _renewed(members: DataFrame, books: np.ndarray) -> np.ndarray:
    """Entries as the floored means of the parts that live with them; entries without parts stay."""
    size = books.shape[2]
    sums = members.groupBy("position", "entry").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get("part", F.lit(c)).cast("long")).alias(f"s{c}") for c in range(size)])
    out = books.copy()
    for r in sums.collect():  # positions x entries rows
        out[r["position"], r["entry"]] = [r[f"s{c}"] // r["n"] for c in range(size)]
    return out


def vector_codes(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> DataFrame:
    """One row per vector: ``vec_id, code, error, label_error, codebooks_sha256``.

    Components become integers ``floor(scale * x)``; vectors are cut into
    ``parts`` equal parts, each with a codebook of ``entries`` entries (256 at most)
    that begins as the parts of the rows with the smallest ids. ``code`` has two hex
    digits for each part, ``error`` is the sum of the parts' squared distances,
    ``label_error`` that of all rows of the label (rows without one together), and
    ``codebooks_sha256`` the digest of all final entries.

    Rows whose vector is null or holds null or non-finite components are dropped;
    an empty table gives no rows. Shorter vectors count as filled up with zeros,
    and so do widths that ``parts`` does not divide. Repeated rows all count and
    all return. The first rows are chosen by id, then vector, those without an id
    last; with fewer rows than entries there are fewer entries. A component of 2^26
    or more after scaling stops the job.
    """
    if not 1 <= entries <= ENTRIES_LIMIT:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    spark, work = rows.sparkSession, Scratch(rows.sparkSession, "codes")
    given = rows.select(quoted(id_col).alias("vec_id"), quoted(label_col).alias("label"), quoted(vector_col).alias("vec")).filter(finite(F.col("vec")))
    given = work.store(given.withColumn("vec", floored(F.col("vec"), scale)).withColumn("row", F.monotonically_increasing_id()), "rows")
    size = -(-width(given, "vec") // parts) or 1
    start = given.orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(entries).select("vec").toArrow()
    books = matrix(start.column(0), size * parts, np.int64).reshape(start.num_rows, parts, size).transpose(1, 0, 2)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-given.count() * parts // TASK_PARTS))

    padded = F.concat("vec", F.array_repeat(F.lit(0), F.lit(size * parts) - F.size("vec")))
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice(padded, p * size + 1, F.lit(size)))
    members = given.select("row", F.posexplode(cut).alias("position", "part"), F.lit(-1).alias("entry"))
    for k in range(rounds):
        judged = work.store(_assigned(members, books), f"judged-{k}")
        came = _settled(judged.filter("moved"), tasks, work, f"came-{k}")
        members = judged.filter("not moved").select("row", "position", "part", "entry").unionByName(came)
        books = _renewed(members, books)
        if k:
            work.drop(f"judged-{k - 1}", f"came-{k - 1}")
    last = _assigned(members, books)

    digest = hashlib.sha256(",".join(str(x) for x in books.reshape(-1).tolist()).encode()).hexdigest()
    digits = [F.lower(F.lpad(F.hex(F.max(F.when(F.col("position") == p, F.col("entry")))), 2, "0")) for p in range(parts)]
    coded = last.groupBy("row").agg(F.concat(*digits).alias("code"), F.sum("error").alias("error"))
    coded = work.store(given.select("row", "vec_id", "label").join(coded, "row"), "coded")
    by_label = work.store(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "labels")
    own = by_label.withColumnRenamed("label", "of")
    out = coded.join(own, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
    out = materialize(out, "vector-codes")
    work.close()
    return out


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


def _sql() -> str:
    """Lloyd's rounds one after another."""
    steps = []
    near = "SELECT p.id, p.position, p.part, min({'d': list_sum(list_transform(list_zip(p.part, c.part), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'entry': c.entry}) AS best FROM parts p JOIN c%d c ON c.position = p.position GROUP BY ALL"
    for k in range(ROUNDS):
        steps.append(f"a{k} AS MATERIALIZED ({near % k})")
        mean = f"SELECT position, best.entry AS entry, i, CAST(floor(sum(part[i]) / count(*)) AS BIGINT) AS x FROM a{k}, (SELECT unnest(generate_series(1, (SELECT max(len(part)) FROM parts))) AS i) GROUP BY ALL"
        steps.append(f"m{k} AS (SELECT position, entry, list(x ORDER BY i) AS part FROM ({mean}) GROUP BY ALL)")
        steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c.position, c.entry, coalesce(m.part, c.part) AS part FROM c{k} c LEFT JOIN m{k} m USING (position, entry))")
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), parts AS MATERIALIZED (
  SELECT id, position, vec[position * len(vec) // {PARTS} + 1 : (position + 1) * len(vec) // {PARTS}] AS part
  FROM v, (SELECT unnest(generate_series(0, {PARTS - 1})) AS position)
), c0 AS MATERIALIZED (
  SELECT position, entry, part
  FROM parts JOIN (SELECT id, row_number() OVER (ORDER BY id) - 1 AS entry FROM v QUALIFY entry < {ENTRIES}) USING (id)
), {", ".join(steps)}, last AS MATERIALIZED ({near % ROUNDS}), coded AS (
  SELECT id, string_agg(format('{{:02x}}', best.entry), '' ORDER BY position) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM last GROUP BY id
), digest AS (
  SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY position, entry)) AS codebooks_sha256 FROM c{ROUNDS}
)
SELECT v.id AS vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM v JOIN coded USING (id), digest
"""


SQL = _sql()
