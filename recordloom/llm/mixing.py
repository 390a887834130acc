"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the (source, language, topic) cells are raked until each
marginal meets its target; documents are then drawn with the calibrated
probability of their cell. Native expressions only; the cells are aggregated
before anything is joined.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recordloom.llm.names import free_names, quoted, set_aside
from recordloom.sources.scratch import Scratch, materialize

DIMENSIONS = ["source", "lang", "topic"]
#: Default targets: each marginal share raised to this power, made to sum to 1.
FLATTEN = 0.9
#: Of the registered query: sum of shares by which each marginal may still miss its targets, most rounds.
SETTLED, ROUNDS = 1e-10, 12
#: Topic of the registered query: the first pattern found in the text.
TOPICS = [("lists", r"\|"), ("markup", r"[#$%&*]{3}"), ("shouting", "!!"), ("figures", "[0-9]{4}")]
_NONE = "(none)"
#: Of the pipeline's mixture: share of the input's tokens that it holds in expectation, sum of shares by which each
#: marginal may miss its targets, most rounds.
BUDGET, TOLERANCE, MOST_ROUNDS = 0.9, 0.005, 40
_LOG = logging.getLogger(__name__)


def topic_by_patterns(text: Column, topics=TOPICS, other: str = "prose") -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(topics):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return F.coalesce(out, F.lit(other))


def count_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def flattened_targets(cells: DataFrame, dimensions=DIMENSIONS, power: float = FLATTEN) -> dict[str, DataFrame]:
    """Targets per dimension: its observed token shares to a power below 1."""
    out = {}
    for d in dimensions:
        m = cells.groupBy(d).agg(F.sum("tokens").alias("t")).filter("t > 0")
        whole = m.agg(F.sum(F.pow(F.col("t").cast("double"), F.lit(power)))).first()[0]
        out[d] = m.select(d, (F.pow(F.col("t").cast("double"), F.lit(power)) / F.lit(whole)).alias("target"))
    return out


def marginals(cells: DataFrame, targets: dict[str, DataFrame], weight: str = "weight") -> DataFrame:
    """``dimension, value, target, reached`` of every value; ``reached`` is its share of the cells' weights."""
    out, whole = None, float(cells.agg(F.sum(weight)).first()[0] or 0)
    for d, target in targets.items():
        now = cells.groupBy(d).agg((F.sum(weight) / (whole or 1.0)).alias("__reached"))
        part = now.join(target, d, "full").select(
            F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value"),
            F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce("__reached", F.lit(0.0)).alias("reached"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def furthest(found: DataFrame) -> float:
    """Largest sum of missed shares of a dimension of ``marginals``."""
    row = found.groupBy("dimension").agg(F.sum(F.abs(F.col("reached") - F.col("target"))).alias("off")).agg(F.max("off")).first()
    return float(row[0] or 0)


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float | None = None) -> DataFrame:
    """Adds ``weight``: the share of tokens that each cell should have.

    Each round scales the cells once per dimension to that dimension's targets.
    Values without a target, and cells without tokens, get weight 0. The table
    is stored after every round, so the plan stays short; the last one stays. With a tolerance,
    rounds end once every marginal misses its targets by that sum of shares at
    most, or once a round brings them less than a twentieth nearer: targets that
    contradict each other are never met, and more rounds would empty cells.
    """
    before, work = None, Scratch(cells.sparkSession, "rake")
    out = cells.withColumn("weight", F.col("tokens").cast("double"))
    for k in range(rounds):
        for d, target in targets.items():
            now = out.groupBy(d).agg(F.sum("weight").alias("__now"))
            factor = now.join(target, d, "left").select(d, F.when(F.col("__now") > 0, F.coalesce("target", F.lit(0.0)) / F.col("__now")).otherwise(0.0).alias("__factor"))
            out = out.join(factor, d).withColumn("weight", F.col("weight") * F.col("__factor")).drop("__factor")
        out = work.store(out.select(*cells.columns, "weight"), f"round-{k}")
        if k:
            work.drop(f"round-{k - 1}")
        if tolerance is not None:
            off = furthest(marginals(out, targets))
            if off <= tolerance or (before is not None and off > 0.95 * before):
                break
            before = off
    return out


def scale_of(raked: DataFrame, budget: float) -> float:
    """Factor of weight over tokens at which the cells hold ``budget`` of all tokens, none more than it has."""
    size = raked.filter("tokens > 0")
    row = size.agg(F.sum("tokens").alias("n"), F.sum("weight").alias("w")).first()
    total, weight, scale, full = float(row["n"] or 0), float(row["w"] or 0), 0.0, -1
    while total and weight > 0:
        at = (budget * total - max(full, 0)) / weight
        if at <= scale:
            break
        scale = at
        whole = F.col("weight") * scale >= F.col("tokens")  # such cells are kept whole, the others make up for them
        row = size.agg(F.sum(F.when(whole, F.col("tokens"))).alias("n"), F.sum(F.when(~whole, F.col("weight"))).alias("w")).first()
        if float(row["n"] or 0) == full:
            break
        full, weight = float(row["n"] or 0), float(row["w"] or 0)
    return scale


def report_missed(expected: DataFrame, targets: dict[str, DataFrame], least: float = TOLERANCE) -> DataFrame:
    """Stores ``marginals`` of the expected tokens and logs those furthest from their target."""
    found = materialize(marginals(expected, targets, "expected"), "marginals")
    missed = found.withColumn("off", F.abs(F.col("reached") - F.col("target"))).filter(F.col("off") > least)
    for r in missed.orderBy(F.desc("off"), "dimension", "value").limit(20).collect():
        _LOG.warning("%s %r has %.4f of the mixture's tokens; its target is %.4f", r["dimension"], r["value"], r["reached"], r["target"])
    return found


def draw(key: Column, seed: str) -> Column:
    """Uniform number in [0, 1) that depends on the key and the seed only."""
    hexed = F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13)
    return F.conv(hexed, 16, 10).cast("long") / F.lit(float(16**13))


def measured(docs: DataFrame, text_col: str = "text", topic: Column | None = None) -> DataFrame:
    """Adds ``topic`` and ``tokens`` to every document; columns with these names are replaced."""
    rest = [c for c in docs.columns if c not in ("topic", "tokens")]
    text = quoted(text_col)
    return docs.select(*[quoted(c) for c in rest], (topic_by_patterns(text) if topic is None else F.coalesce(topic, F.lit(_NONE))).alias("topic"), count_words(text).alias("tokens"))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, id_col: str = "doc_id", text_col: str | None = "text", topic: Column | None = None, rounds: int = ROUNDS, seed: str = "mix", budget: float | None = None, tolerance: float | None = None) -> DataFrame:
    """Adds ``topic, tokens, weight, probability, kept`` to every document.

    ``weight`` is the raked share over the observed share of the document's
    cell; ``probability`` is that over the largest, so expected tokens meet the
    targets in proportion. With a ``budget`` it is the weight times the factor at
    which that share of all tokens is expected, 1 at most; values that miss their
    target for it, or for targets that contradict each other, are stored and
    logged. ``kept`` draws by a hash of the id, so rows with the
    same id fall alike. Null sources and languages form a cell value of their
    own. Documents without words weigh and fall as their cell does; where the
    whole cell has no words, weight and probability are 0. Without ``text_col``
    the table has ``topic`` and ``tokens`` already (``measured``). Columns with
    one of the added names are replaced, all others stay.
    """
    added = ["topic", "tokens", "weight", "probability", "kept"]
    rest = [c for c in docs.columns if c not in added]
    source, lang, s, l, t = free_names([*docs.columns, *added], "own_source", "own_lang", "cell_source", "cell_lang", "cell_topic")
    base = measured(docs, text_col, topic) if text_col else docs
    base = base.select(*[quoted(c) for c in [*rest, "topic", "tokens"]], F.coalesce("source", F.lit(_NONE)).alias(source), F.coalesce("lang", F.lit(_NONE)).alias(lang))
    cells = base.groupBy(F.col(source).alias("source"), F.col(lang).alias("lang"), "topic").agg(F.sum("tokens").alias("tokens"))
    cells = materialize(cells, "cells")
    targets = targets or flattened_targets(cells)
    raked = rake(cells, targets, rounds, tolerance)
    top = raked.filter("tokens > 0").agg(F.sum("tokens").alias("n"), F.max(F.col("weight") / F.col("tokens")).alias("r")).first()
    total, most = float(top["n"] or 0), float(top["r"] or 1)
    if budget is not None:
        if not 0 < budget < 1:
            raise ValueError("a budget lies between 0 and 1")
        most = 1 / (scale_of(raked, budget) or 1)
        report_missed(raked.withColumn("expected", F.least(F.col("weight") / F.lit(most), F.col("tokens").cast("double"))), targets)
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    chance = raked.select(
        F.col("source").alias(s), F.col("lang").alias(l), F.col("topic").alias(t),
        (ratio * total).alias("weight"), F.least(ratio / most, F.lit(1.0)).alias("probability"),
    )
    same = (F.col(source) == F.col(s)) & (F.col(lang) == F.col(l)) & (F.col("topic") == F.col(t))
    out = base.join(chance, same).withColumn("kept", draw(quoted(id_col), seed) < F.col("probability"))
    return out.select(*[quoted(c) for c in rest], *added)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    # texts are read once; what is drawn from is narrow
    narrow = materialize(measured(docs).drop("text"), "measured")
    out = mix(narrow, text_col=None, tolerance=SETTLED)
    return out.select("doc_id", "source", "lang", "topic", "tokens", F.round("weight", 8).alias("weight"), F.round("probability", 8).alias("probability"), "kept")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents drawn for the mixture; columns as in ``docs``. For odd rows see ``mix``."""
    own, names = set_aside(docs, ["topic", "tokens", "weight", "probability", "kept"])
    drawn = mix(own, rounds=MOST_ROUNDS, budget=BUDGET, tolerance=TOLERANCE).filter("kept")
    return drawn.select(*[quoted(names.get(c, c)).alias(c) for c in docs.columns])


def _sql() -> str:
    steps = []
    for k in range(ROUNDS):
        for d in DIMENSIONS:
            last = steps[-1][0] if steps else "c"
            name = f"w{k}_{d}"
            steps.append((name, f"{name} as materialized (select a.source, a.lang, a.topic, a.tokens, a.weight * b.target / sum(a.weight) over (partition by a.{d}) as weight from {last} a join t_{d} b on a.{d} = b.v)"))
    marg = ", ".join(
        f"t_{d} as materialized (select {d} as v, pow(sum(tokens)::double, {FLATTEN}) / sum(pow(sum(tokens)::double, {FLATTEN})) over () as target from c group by {d} having sum(tokens) > 0)"
        for d in DIMENSIONS
    )
    topic = "case " + " ".join(f"when regexp_matches(text, '{p}') then '{n}'" for n, p in TOPICS) + " else 'prose' end"
    return f"""
with b as (select doc_id, source, lang, coalesce(source, '{_NONE}') as s, coalesce(lang, '{_NONE}') as l, {topic} as topic,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as tokens from documents),
c as materialized (select s as source, l as lang, topic, sum(tokens)::bigint as tokens, sum(tokens)::double as weight from b group by all),
{marg}, {', '.join(s for _, s in steps)},
r as (select *, weight / tokens as ratio from {steps[-1][0]} where tokens > 0),
f as (select source, lang, topic, ratio * (select sum(tokens) from r) as weight, ratio / (select max(ratio) from r) as probability from r)
select b.doc_id, b.source, b.lang, b.topic, b.tokens, round(coalesce(f.weight, 0), 8) as weight, round(coalesce(f.probability, 0), 8) as probability,
  ('0x' || substr(md5('mix|' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint / {16**13}.0::double < coalesce(f.probability, 0) as kept
from b left join f on b.s = f.source and b.l = f.lang and b.topic = f.topic
"""


SQL = _sql()
