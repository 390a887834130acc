"""Reading the driver tables, and SQL fragments shared by the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_clean(x: str) -> str:
    return rf"regexp_replace(coalesce({x}, ''), '^\s+|\s+$', '', 'g')"


def sql_fold(x: str) -> str:
    return f"replace(lower({sql_clean(x)}), 'ß', 'ss')"


def sql_norm(x: str) -> str:
    return rf"regexp_replace(translate({sql_fold(x)}, 'áâäéêëíóúû', 'aaaeeeiouu'), '\s+', ' ', 'g')"


def sql_id_slug(x: str) -> str:
    return rf"coalesce(nullif(trim(regexp_replace(regexp_replace(lower({sql_clean(x)}), '[\s-]+', '_', 'g'), '[^\p{{L}}\p{{N}}_]', '', 'g'), '_'), ''), 'unknown')"


#: Letters that page slugs fold, by what they fold to.
SLUG_CLASSES = {"a": "àáâãäåāăą", "e": "èéêëēĕėęě", "i": "ìíîïīĭįı", "o": "òóôõöøōŏő", "u": "ùúûüūŭůűų", "c": "çćĉċč", "n": "ñńņň", "s": "śŝşš", "y": "ýÿŷ", "z": "žźż", "d": "ð"}


def sql_page_slug(x: str) -> str:
    spelled = f"replace(replace(replace(replace(lower({sql_clean(x)}), 'æ', 'ae'), 'œ', 'oe'), 'þ', 'th'), 'ß', 'ss')"
    for letter, forms in SLUG_CLASSES.items():
        spelled = f"regexp_replace({spelled}, '[{forms}]', '{letter}', 'g')"
    return f"coalesce(nullif(trim(regexp_replace({spelled}, '[^a-z0-9]+', '-', 'g'), '-'), ''), 'unknown')"


def sql_normalise(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({x}, ''), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '(?m)[ \t\r\f\v]+$', '', 'g'), '^\n+|\n+$', '', 'g')"


def sql_trim_name(x: str) -> str:
    return rf"regexp_replace(regexp_replace({sql_clean(x)}, '^[^A-Za-zÀ-ÖØ-öø-ÿ]+', ''), '[^A-Za-zÀ-ÖØ-öø-ÿ''’-]+$', '')"


def sql_is_name(x: str) -> str:
    return rf"(length({x}) between 2 and 24 and regexp_matches({x}, '^[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ''’-]*$') and not (length({x}) > 3 and upper({x}) = {x}))"


def sql_squeezed(x: str) -> str:
    """A text as excerpts are cut from it."""
    return sql_clean(rf"regexp_replace(coalesce({x}, ''), '\n{{3,}}', chr(10) || chr(10), 'g')")


def sql_excerpt(flat: str, needle: str) -> str:
    """Excerpt of a squeezed text around the first hit of a needle."""
    hit, size = f"instr({flat}, {needle})", f"length({needle})"
    begin, end = f"greatest({hit} - 351, 0)", f"least({hit} - 1 + {size} + 350, length({flat}))"
    body = sql_clean(f"substr({flat}, {begin} + 1, {end} - {begin})")
    return f"""substr(case when {needle} <> '' and {hit} > 0 then (case when {begin} > 0 then '…' || chr(10) else '' end) || {body} || (case when {end} < length({flat}) then chr(10) || '…' else '' end) else {flat} end, 1, 900)"""
