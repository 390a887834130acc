"""Integrity checks whose findings are rows: ``level, check, table_name, row_key, message``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from recordloom.functions.exprs import clean, fold, iso_date, multi_ids

ISSUE = "level string, check string, table_name string, row_key string, message string"


def _issues(df: DataFrame, level, check: str, table: str, key, message) -> DataFrame:
    text = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.select(text(level).alias("level"), F.lit(check).alias("check"), F.lit(table).alias("table_name"), F.coalesce(key.cast("string"), F.lit("")).alias("row_key"), text(message).alias("message"))


def _key_text(df: DataFrame, c) -> Column:
    """A key as cleaned text; only texts can have white space to strip."""
    if isinstance(c, str) and not isinstance(df.schema[c].dataType, T.StringType):
        return F.coalesce(F.col(c).cast("string"), F.lit(""))
    return clean(c)


def check_columns(spark: SparkSession, df: DataFrame | None, table: str, required: list[str]) -> DataFrame:
    """An error per missing table or column."""
    have = [] if df is None else df.columns
    said = [("error", "columns", table, "", "missing table")] if df is None else [("error", "columns", table, c, "missing column") for c in required if c not in have]
    return spark.createDataFrame(said, ISSUE)


def check_members(df: DataFrame, table: str, column: str, required: list[str]) -> DataFrame:
    """E1 for records kept as JSON text: an error per required member that rows lack, with their number; one pass, combined before its shuffle."""
    lacking = df.agg(*[F.count_if(F.get_json_object(column, f"$.{m}").isNull()).alias(m) for m in required])
    each = lacking.select(F.explode(F.array(*[F.struct(F.lit(m).alias("member"), F.col(m).alias("n")) for m in required])).alias("m")).filter("m.n > 0")
    return _issues(each, "error", "columns", table, F.col("m.member"), F.concat(F.lit("missing member in "), F.col("m.n").cast("string")))


def _blank(df: DataFrame, ids: list) -> Column:
    return reduce(lambda a, b: a | b, [_key_text(df, c) == "" for c in ids])


def check_unique(df: DataFrame, table: str, ids: list) -> DataFrame:
    """Ids that repeat (one row each) and rows with a blank id (one row in all)."""
    counted = df.filter(~_blank(df, ids)).groupBy(F.concat_ws(",", *[_key_text(df, c) for c in ids]).alias("k")).agg(F.count("*").alias("n")).filter("n > 1")
    empty = df.filter(_blank(df, ids)).agg(F.count("*").alias("n")).filter("n > 0")
    return _issues(counted, "error", "unique", table, F.col("k"), F.concat(F.lit("repeated "), F.col("n").cast("string"))).unionByName(
        _issues(empty, "error", "unique", table, F.lit(""), F.concat(F.lit("blank "), F.col("n").cast("string")))
    )


def not_allowed(column: str, allowed: list[str], optional: bool = True) -> tuple[str, list[Column]]:
    """E3 as a rule of a row: what is wrong with it, each message null if it is not."""
    v = clean(column)
    bad = ~v.isin(*allowed) & ((v != "") if optional else F.lit(True))
    return "allowed", [F.when(bad, F.concat(F.lit(f"{column}: "), v))]


def wrong_dates(start, end) -> tuple[str, list[Column]]:
    """E4 as a rule of a row: malformed start, malformed end, and start after end (both well-formed)."""
    a, b = iso_date(start), iso_date(end)
    wrong = lambda c, d, text: F.when((clean(c) != "") & d.isNull(), F.lit(text))
    return "dates", [wrong(start, a, "malformed start"), wrong(end, b, "malformed end"), F.when(a > b, F.lit("start after end"))]


def check_rows(df: DataFrame, table: str, key, rules: list[tuple[str, list[Column]]]) -> DataFrame:
    """All rules of a table's rows in one projection: an error per message."""
    found = F.array(*[F.struct(F.lit(check).alias("check"), m.alias("message")) for check, messages in rules for m in messages])
    rows = df.select(F.col(key).alias("__key"), F.explode(found).alias("__i")).filter("__i.message is not null")
    return rows.select(F.lit("error").alias("level"), "__i.check", F.lit(table).alias("table_name"), F.coalesce(F.col("__key").cast("string"), F.lit("")).alias("row_key"), "__i.message")


def check_allowed(df: DataFrame, table: str, column: str, allowed: list[str], key, optional: bool = True) -> DataFrame:
    """Rows whose value is not allowed; blanks pass when optional."""
    return check_rows(df, table, key, [not_allowed(column, allowed, optional)])


def check_dates(df: DataFrame, table: str, start, end, key) -> DataFrame:
    """Malformed start, malformed end, and start after end (both well-formed), one issue each."""
    return check_rows(df, table, key, [wrong_dates(start, end)])


def check_foreign_key(df: DataFrame, table: str, column, key, target: DataFrame, target_id: str) -> DataFrame:
    """E5: ids (several may be parted by semicolons) that the target lacks; blanks pass."""
    each = df.select(F.col(key).alias("__key"), F.explode(multi_ids(column)).alias("__id"))
    lost = each.join(target.select(_key_text(target, target_id).alias("__id")), "__id", "left_anti")
    return _issues(lost, "error", "foreign key", table, F.col("__key"), F.concat(F.lit("unknown id "), F.col("__id")))


def check_repeated_names(df: DataFrame, table: str, name, documented: DataFrame) -> DataFrame:
    """Folded names that repeat: info if documented (column ``name``), else a warning."""
    counted = df.groupBy(fold(name).alias("k")).agg(F.count("*").alias("n")).filter("k <> '' and n > 1")
    known = documented.select(fold("name").alias("k"), F.lit(True).alias("known")).distinct()
    out = counted.join(known, "k", "left")
    return _issues(out, F.when(F.col("known"), "info").otherwise("warning"), "repeated name", table, F.col("k"), F.concat(F.lit("repeated "), F.col("n").cast("string")))


def check_unlinked(df: DataFrame, table: str, key: str, links: DataFrame, link_key: str) -> DataFrame:
    """One info row with the number of entities without a link."""
    lost = df.select(F.col(key).alias("__k")).join(links.select(F.col(link_key).alias("__k")), "__k", "left_anti")
    return _issues(lost.agg(F.count("*").alias("n")), "info", "unlinked", table, F.lit(""), F.concat(F.lit("unlinked "), F.col("n").cast("string")))


def first_existing(df: DataFrame, candidates: list[str]) -> str | None:
    """The first candidate column that the table has."""
    return next((c for c in candidates if c in df.columns), None)


def validate(*issues: DataFrame) -> DataFrame:
    """All findings in one table."""
    return reduce(DataFrame.unionByName, issues)


def issue_counts(issues: DataFrame) -> DataFrame:
    """Findings per level and check."""
    return issues.groupBy("level", "check").agg(F.count("*").alias("n"))


class Counting:
    """E9 in one scan per table: numbers of findings per level and check, without the findings.

    Every check turns a row of its tables into facts: a key that the row holds, or
    one that it is a target for. A table's facts are one projection, and the facts
    of all tables are summed by check and key, combined before their shuffle, so
    hot keys are no burden.
    """

    def __init__(self):
        self.tables: dict[str, DataFrame] = {}
        self.facts: dict[str, list[Column]] = {}
        self.lists: dict[str, list[Column]] = {}
        self.kinds: list[tuple[str, str]] = []

    def table(self, name: str, df: DataFrame) -> Counting:
        self.tables[name], self.facts[name], self.lists[name] = df, [], []
        return self

    def _add(self, table: str, key: Column, held: bool, number: Column | None = None, when: Column | None = None, check: int | None = None) -> None:
        fact = F.struct(F.lit(len(self.kinds) - 1 if check is None else check).alias("check"), key.alias("key"), (F.lit(1) if number is None else number).cast("long").alias("n") if held else F.lit(0).cast("long").alias("n"), F.lit(not held).alias("target"))
        self.facts[table].append(fact if when is None else F.when(when, fact))

    def unique(self, table: str, ids: list) -> Counting:
        """E2."""
        df = self.tables[table]
        self.kinds.append(("repeat", "unique"))
        self._add(table, F.when(~_blank(df, ids), F.concat_ws(",", *[_key_text(df, c) for c in ids])), True)
        return self

    def rows(self, table: str, rules: list[tuple[str, list[Column]]]) -> Counting:
        """E3, E4."""
        for check, messages in rules:
            self.kinds.append(("row", check))
            self._add(table, F.lit(""), True, reduce(lambda a, b: a + b, [m.isNotNull().cast("long") for m in messages]))
        return self

    def foreign_key(self, table: str, column, target: str, target_id: str, accepted: Column | None = None) -> Counting:
        """E5: ids that no ``accepted`` target row has; only texts can hold several."""
        self.kinds.append(("lost", "foreign key"))
        n, df = len(self.kinds) - 1, self.tables[table]
        if isinstance(column, str) and not isinstance(df.schema[column].dataType, T.StringType):
            self._add(table, F.col(column).cast("string"), True, when=F.col(column).isNotNull())
        else:
            self.lists[table].append(F.transform(multi_ids(column), lambda x: F.struct(F.lit(n).alias("check"), x.alias("key"), F.lit(1).cast("long").alias("n"), F.lit(False).alias("target"))))
        self._add(target, _key_text(self.tables[target], target_id), False, when=accepted)
        return self

    def repeated_names(self, table: str, name, documented: str, documented_name, which: Column | None = None) -> Counting:
        """E6."""
        self.kinds.append(("name", "repeated name"))
        self._add(table, fold(name), True, when=fold(name) != "")
        self._add(documented, fold(documented_name), False, when=which)
        return self

    def unlinked(self, table: str, key: str, links: str, link_key: str, which: Column | None = None) -> Counting:
        """One finding, whatever the number."""
        self.kinds.append(("unlinked", "unlinked"))
        self._add(table, F.col(key).cast("string"), True)
        self._add(links, F.col(link_key).cast("string"), False, when=which)
        return self

    def counts(self) -> DataFrame:
        """``level, check, n``."""
        each = []
        for name, df in self.tables.items():
            if lists := [*([F.array(*self.facts[name])] if self.facts[name] else []), *self.lists[name]]:
                each.append(df.select(F.explode(lists[0] if len(lists) == 1 else F.concat(*lists)).alias("f")).filter("f is not null and (f.target or f.n > 0)").select("f.*"))
        summed = reduce(DataFrame.unionByName, each).groupBy("check", "key").agg(F.sum("n").alias("n"), F.max("target").alias("target"))
        kind = F.get(F.array(*[F.lit(k) for k, _ in self.kinds]), F.col("check"))
        found = (
            F.when(kind == "row", F.col("n")).when(kind == "lost", F.when(~F.col("target"), F.col("n")).otherwise(0)).when(kind == "unlinked", 0)
            .when(kind == "repeat", ((F.col("n") > 1) | F.col("key").isNull()).cast("long")).otherwise((F.col("n") > 1).cast("long"))
        )
        level = F.when(kind == "unlinked", "info").when(kind == "name", F.when(F.col("target"), "info").otherwise("warning")).otherwise("error")
        by = summed.select(level.alias("level"), "check", found.alias("n"), kind.alias("kind")).groupBy("level", "check", "kind").agg(F.sum("n").alias("n"))
        name = F.get(F.array(*[F.lit(c) for _, c in self.kinds]), F.col("check"))
        by = by.select("level", name.alias("check"), F.when(F.col("kind") == "unlinked", F.lit(1)).otherwise(F.col("n")).cast("long").alias("n")).filter("n > 0")
        return by.groupBy("level", "check").agg(F.sum("n").alias("n"))


def gate(issues: DataFrame) -> None:
    """Raises when there is an error among the findings; stops at the first."""
    first = issues.filter("level = 'error'").head(1)
    if first:
        raise ValueError(f"validation failed: {first[0].asDict()}")
