"""Column names that cannot clash with those of a user's table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with underscores before it until no column (case ignored) has it."""
    have, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def set_aside(docs: DataFrame, added: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns that are named like an added one under other names, and those names by the old ones."""
    clash = [c for c in docs.columns if c.lower() in {a.lower() for a in added}]
    names = dict(zip(clash, free_names([*docs.columns, *added], *(f"given_{c}" for c in clash))))
    return docs.withColumnsRenamed(names), names


def join_by_text(docs: DataFrame, id_col: str, text_col: str, small: DataFrame, key: str, key_hash: str, how: str) -> DataFrame:
    """Merge join of whole documents with a stored narrow table by id and hash of the text, ``how`` being ``left`` or ``left_anti``.

    An id may stand before several texts, so the id alone says nothing. The same
    plan at every size: both sides are dealt by id and hash and sorted, which spills
    where a table in memory would fail, and a repeated id can be split. Rows without
    an id match nothing; they go round the join, or they would all meet in one task.
    """
    own = quoted(id_col)
    joined = docs.filter(own.isNotNull()).join(small.hint("merge"), (own == F.col(key)) & (F.xxhash64(quoted(text_col)) == F.col(key_hash)), how)
    rest = docs.filter(own.isNull())
    for c in joined.columns[len(docs.columns) :]:
        rest = rest.withColumn(c, F.lit(None).cast(small.schema[c].dataType))
    return joined.unionByName(rest)
