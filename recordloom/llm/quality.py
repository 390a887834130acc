"""Line-first quality rules, as native array expressions inside each row.

Lines that fail a navigation, boilerplate, shouting, punctuation or repetition
rule are removed first; a document that loses too much of its text that way, or
fails the whole-text base rules, is rejected. Nothing is shuffled: every figure
comes from the row itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recordloom.llm.names import free_names, quoted, set_aside

#: White space that separates words.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MARKUP = "#*$%&<>"
#: Characters between the entries of a menu or a trail of links.
SEPARATORS = "|»›·•"
#: A sentence mark before a blank, a closing mark or the end of the line.
SENTENCE_END = "[.!?…。！？](?:[ \\t\\x0b\\f\\r\"')\\]»”’]|$)"
#: Phrases of notices and forms, in the languages of the corpus.
PHRASES = (
    "all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|we use cookies|accept (?:all )?cookies|sign up for our|subscribe to our|"
    "click here to|enable javascript|skip to (?:main )?content|back to top|add to cart|alle rechte vorbehalten|datenschutzerklärung|"
    "tous droits réservés|mentions légales|politique de confidentialité|todos los derechos reservados|política de privacidad"
)
ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text"]
BOILERPLATE = rf"(?i)(?:^|[^a-z])(?:{PHRASES})(?:[^a-z]|$)"


def _without(text: Column, chars: str) -> Column:
    return reduce(lambda c, ch: F.replace(c, F.lit(ch), F.lit("")), chars, text)


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(_without(text, chars))


def words(text: Column) -> Column:
    """Words of a text: runs of characters other than ASCII white space."""
    spaced = reduce(lambda c, ch: F.replace(c, F.lit(ch), F.lit(" ")), BLANKS[1:], text)
    return F.array_remove(F.split(spaced, " "), "")


def good_line(line: Column, nav: int = 4, markup: int = 10, shout: int = 5, run_on: int = 200, notice: int = 300) -> Column:
    """Whether a line passes: shares are per 100 characters of the line.

    ``nav``: separators of menus; ``markup``: symbol characters; ``shout``: doubled
    exclamation marks; ``run_on``: characters from which a line fails unless a
    sentence ends in it, that is a sentence mark before a blank, a closing mark or
    the line's end (a dot inside a number does not count); ``notice``: characters up
    to which a line with a boilerplate phrase fails.
    """
    size = F.length(line)
    doubled = (size - F.length(F.replace(line, F.lit("!!"), F.lit("")))) / 2
    marked = (
        (_count(line, SEPARATORS) * 100 >= size * nav)
        | (_count(line, MARKUP) * 100 >= size * markup)
        | (doubled * 100 >= size * shout)
    )
    # most lines hold none of these characters: one look decides
    bad = F.when(line.rlike(rf"[#*$%&<>{SEPARATORS}]|!!"), marked).otherwise(F.lit(False))
    boiler = F.when(size <= notice, line.rlike(BOILERPLATE)).otherwise(F.lit(False))
    return ~(bad | ((size >= run_on) & ~line.rlike(SENTENCE_END)) | boiler)


def judge(docs: DataFrame, text_col: str = "text", min_words: int = 50, max_repeat_pct: int = 50, max_loss_pct: int = 50) -> DataFrame:
    """Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, clean_text``.

    ``base_failed``: fewer than ``min_words`` words, or more than
    ``max_repeat_pct`` percent of the words lie in 3-word windows that occur at
    least twice in the text. ``kept`` is false if the base failed or the removed
    lines (also repeats of an earlier line) hold more than ``max_loss_pct``
    percent of the characters of all lines with a word. ``clean_text`` holds the
    lines that stay; blank lines go. Null text counts as empty (rejected, with
    an empty ``clean_text``). Columns with one of the added names are replaced;
    rows, also repeated ones, and all other columns stay as they are.
    """
    rest = [c for c in docs.columns if c not in ADDED]
    whole, ws, lines, bits, first, good, order, twice, at, every = free_names([*docs.columns, *ADDED], "whole", "words", "lines", "bits", "first", "good", "order", "twice", "at", "every")
    df = docs.select(*[quoted(c) for c in rest], F.coalesce(quoted(text_col), F.lit("")).alias(whole))
    df = df.withColumns({ws: words(F.col(whole)), lines: F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")})
    n, word = F.size(ws), lambda i: F.get(ws, i)
    # a window's hash above, its position in the low bits: equal windows are neighbours when sorted
    df = df.withColumns({"n_words": n.cast("long"), bits: F.length(F.bin(n.cast("long"))), first: F.array_distinct(lines)})
    low = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(bits)) - 1
    key = lambda i: F.call_function("shiftleft", F.xxhash64(word(i), word(i + 1), word(i + 2)), F.col(bits)).bitwiseOR(i.cast("long"))
    df = df.withColumns({order: F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), key))), good: F.filter(first, lambda x: good_line(x))})

    def same(x, k):
        """Whether another window, near in the order, has the same three words; those of one hash stand together."""
        other = F.get(order, k)
        i, j = x.bitwiseAND(low).cast("int"), other.bitwiseAND(low).cast("int")
        equal = (word(i) == word(j)) & (word(i + 1) == word(j + 1)) & (word(i + 2) == word(j + 2))
        return F.coalesce((F.call_function("shiftright", x.bitwiseXOR(other), F.col(bits)) == 0) & equal, F.lit(False))

    df = df.withColumn(twice, F.filter(order, lambda x, k: same(x, k - 1) | same(x, k + 1) | same(x, k - 2) | same(x, k + 2)))
    df = df.withColumn(at, F.when(F.size(twice) > 0, F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(low)))))
    covered = F.aggregate(
        F.transform(at, lambda p, k: F.least(F.lit(3).cast("long"), F.coalesce(F.get(at, k + 1) - p, F.lit(3).cast("long")))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    symbols = F.when(F.col(whole).rlike("[#*$%&|<>]"), _count(F.col(whole), SYMBOLS)).otherwise(F.lit(0))
    df = df.withColumns(
        {
            "word_chars": F.length(F.array_join(ws, "")).cast("long"),
            "n_symbols": symbols.cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(first)).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            "clean_text": F.array_join(good, "\n"),
            every: F.length(F.array_join(lines, "\n")),
        }
    )
    df = df.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words")))
    lost = F.col(every) - F.length("clean_text")
    df = df.withColumn("kept", ~F.col("base_failed") & (100 * lost <= max_loss_pct * F.col(every)))
    return df.select(*[quoted(c) for c in rest], *ADDED)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def clean_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their cleaned text and its length; columns as in ``docs``.

    Null, empty and wordless texts go; rows without an id and repeated rows are judged like any other.
    """
    own, names = set_aside(docs, ADDED)
    # a row number stops the filter from moving below the rules, where they would be worked out once more for it
    (row,) = free_names([*own.columns, *ADDED], "row")
    judged = judge(own).withColumn(row, F.monotonically_increasing_id()).filter(F.col("kept") & (F.col(row) >= 0))
    new = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return judged.select(*[new[c].alias(c) if c in new else quoted(names.get(c, c)).alias(c) for c in docs.columns])


SQL = r"""
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from t),
u as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i from w),
g as (select doc_id, i, x || chr(10) || lead(x, 1) over q || chr(10) || lead(x, 2) over q as gram
  from u window q as (partition by doc_id order by i)),
c as (select doc_id, i from (select *, count(*) over (partition by doc_id, gram) as n from g where gram is not null) where n > 1),
p as (select doc_id, count(distinct i + k) as n_repeat_words from c, (values (0), (1), (2)) s(k) group by 1),
o as (select doc_id, unnest(list_distinct(l)) as x from w),
m as (select doc_id, x, length(x) as n, length(x) - length(translate(x, '|»›·•', '')) as bars,
    length(x) - length(translate(x, '#*$%&<>', '')) as marks,
    (length(x) - length(replace(x, '!!', ''))) / 2 as shouts, regexp_matches(x, '@END@') as ends,
    length(x) <= 300 and regexp_matches(x, '@BOILER@') as boiler from o),
k as (select doc_id, sum(n) + count(*) - 1 as good from m
  where not (bars * 100 >= n * 4 or marks * 100 >= n * 10 or shouts * 100 >= n * 5 or (n >= 200 and not ends) or boiler) group by 1),
b as (select doc_id, len(w)::bigint as n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::bigint as n_symbols,
    (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
    length(array_to_string(l, chr(10))) as whole from w)
select b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
  n_words < 50 or 100 * coalesce(n_repeat_words, 0) > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * coalesce(n_repeat_words, 0) > 50 * n_words) and 100 * (whole - coalesce(good, 0)) <= 50 * whole as kept
from b left join p using (doc_id) left join k using (doc_id)
""".replace("@END@", SENTENCE_END.replace("'", "''")).replace("@BOILER@", BOILERPLATE)
