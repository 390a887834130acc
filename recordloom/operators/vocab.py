"""Vocabulary classification of free-text descriptors.

A term matches as a whole word on folded text. Candidates come from an equi-join
of the text's words with each term's rarest word, so they grow with matches and
not with texts times terms, and no common word becomes a hot key unless it is a
term by itself. A candidate is then verified on the positions of its words. Distinct
descriptors are classified once and joined back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from recordloom.functions.exprs import clean, norm, remove_word, unknown_to_blank
from recordloom.operators.ranking import best_per_key
from recordloom.sources.scratch import materialize


def _tokens(c) -> Column:
    """Words and single symbols, blanks among them, in order."""
    return F.regexp_extract_all(c, F.lit(r"(?U)\w+|\W"), F.lit(0))


def _is_word(token: Column) -> Column:
    return F.regexp_extract(F.coalesce(token, F.lit("")), r"(?U)\w", 0) != ""


def _words(texts: DataFrame, text: str, key: str) -> DataFrame:
    """``key, tokens_of, word``: each distinct word or symbol of each text, with the text's tokens."""
    t = texts.select(F.col(key).alias("key"), norm(text).alias("tokens_of")).distinct().withColumn("tokens_of", _tokens("tokens_of"))
    return t.select("key", "tokens_of", F.explode(F.array_distinct(F.filter("tokens_of", lambda x: x != " "))).alias("word"))


def rarest_words(texts: DataFrame, text: str, *terms: tuple[DataFrame, str]) -> DataFrame:
    """``v_norm, tokens, rare``: each term's word or symbol that the fewest texts hold (0 counts; ties by text).

    ``terms`` are tables with the name of their column. The result has the size of
    the vocabularies and is stored, as it is used wherever they are.
    """
    each = reduce(DataFrame.union, [v.select(norm(c).alias("v_norm")) for v, c in terms]).filter("v_norm <> ''").distinct().withColumn("tokens", _tokens("v_norm"))
    each = each.select("v_norm", "tokens", F.explode(F.array_distinct(F.filter("tokens", lambda x: x != " "))).alias("word"))
    held = _words(texts, text, text).select("word").join(each.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rare = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word"))["word"]
    return materialize(each.join(held, "word", "left").groupBy("v_norm").agg(F.any_value("tokens").alias("tokens"), rare.alias("rare")), "rarest")


def matches(texts: DataFrame, text: str, key: str, vocab: DataFrame, term: str, rare: DataFrame | None = None) -> DataFrame:
    """Every (key, vocabulary row) whose term is a whole word of the text: ``key, v_ord, v_term, v_norm`` and the
    vocabulary's columns prefixed ``v_``.

    ``vocab`` has an ``ord``; it is broadcast by Spark only when its size allows.
    Texts meet each term at its rarest word (``rare``, of these or like texts); there
    the term's tokens must stand one after another, with no word character before or
    after the term.
    """
    v = vocab.select(*[F.col(c).alias(f"v_{c}") for c in vocab.columns]).withColumns({"v_norm": norm(f"v_{term}"), "v_term": clean(f"v_{term}")}).filter("v_norm <> ''")
    names = v.columns
    v = v.join(rarest_words(texts, text, (vocab, term)) if rare is None else rare, "v_norm")
    met = _words(texts, text, key).join(v, F.col("word") == F.col("rare"))
    size, at = F.size("tokens"), F.array_position("tokens", F.col("rare")).cast("int") - 1
    # text positions where the rarest word stands as it does in the term
    begins = F.filter(F.transform("tokens_of", lambda x, i: F.when(x == F.col("rare"), i - at)), lambda s: F.coalesce(s >= 0, F.lit(False)))
    edge = lambda inside, outside: ~(_is_word(outside) & ~_is_word(inside))  # noqa: E731  a word beside a word is another token
    stands = lambda s: (F.slice("tokens_of", s + 1, size) == F.col("tokens")) & edge(F.get("tokens", F.lit(0)), F.get("tokens_of", s - 1)) & edge(F.get("tokens", size - 1), F.get("tokens_of", s + size))
    return met.filter(F.exists(begins, stands)).select("key", *names)


def longest_match(texts: DataFrame, text: str, key: str, vocab: DataFrame, term: str, rare: DataFrame | None = None) -> DataFrame:
    """the longest matching term of each text, ties by vocabulary order."""
    return best_per_key(matches(texts, text, key, vocab, term, rare), ["key"], [F.length("v_norm").desc(), "v_ord"])


def all_matches(texts: DataFrame, text: str, key: str, vocab: DataFrame, term: str) -> DataFrame:
    """``key, terms``: all matching terms, longest first."""
    found = matches(texts, text, key, vocab, term)
    return found.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.length("v_norm")).alias("l"), F.col("v_ord").alias("o"), F.col("v_term").alias("t")))), lambda x: x["t"]).alias("terms"))


def remove_terms(text: Column, terms: Column) -> Column:
    """all terms of an array removed from the text, in order."""
    return F.aggregate(terms, text, lambda t, term: remove_word(t, term))


def _edges(c: Column) -> Column:
    return F.btrim(c, F.lit(" ,;:-"))


#: Fixed values of F8: words of the status, by what was found; an own mapping may replace them.
STATUSES = {
    "nothing": "no_descriptor", "ranked": "immortal", "suspect": "parser_suspect_or_custom_descriptor", "all": "classified", "no base class": "generic_title_no_class",
    "race alone": "race_only", "only a rest": "custom_descriptor_unclassified", "none": "needs_review",
}
#: Fixed values of F7: texts inside a rest that speak for a fault of the parser.
SUSPECT = [" is a ", " is an ", " level"]


def classify(descriptors: DataFrame, text: str, races: DataFrame, titles: DataFrame, ranks: DataFrame, factions: list[tuple[Column, str, str]], rank_own: list[str], rank_else: str, rank_faction: str, statuses: dict[str, str] = STATUSES, suspects: list[str] = SUSPECT) -> DataFrame:
    """One row per distinct descriptor with all derived attributes.

    ``races``: ``ord, term, race, subrace``; ``titles``: ``ord, title, base_class,
    gender, gender_confidence``; ``ranks``: ``ord, term, rank_order, rank, code,
    role``. ``factions``: conditions on ``race`` and ``subrace`` with faction and
    confidence, first hit wins; a ranked match overrides them. ``rank_own`` are
    ranks that are races by themselves; others give ``rank_else``. ``statuses``
    names the outcomes; ``suspects`` are texts that mark a rest as the parser's
    fault.
    """
    d = descriptors.select(clean(text).alias("descriptor")).distinct()

    rare = rarest_words(d, "descriptor", (ranks, "term"), (races, "term"), (titles, "title"))

    # lowest rank order, then longest; every ranked term goes
    ranked = matches(d, "descriptor", "descriptor", ranks, "term", rare).withColumn("__o", F.coalesce(F.col("v_rank_order").try_cast("int"), F.lit(999)))
    top = best_per_key(ranked, ["key"], ["__o", F.length("v_norm").desc(), "v_ord"]).select("key", F.col("v_rank").alias("rank"), F.col("v_code").alias("rank_code"), F.col("v_role").alias("rank_role"), F.col("v_term").alias("rank_term"))
    gone = ranked.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("__o", (-F.length("v_norm")).alias("l"), "v_ord", "v_term"))), lambda x: x["v_term"]).alias("__ranked"))
    out = d.join(top.join(gone, "key"), d["descriptor"] == F.col("key"), "left").drop("key")
    hit = F.col("rank").isNotNull()
    out = out.withColumn("__rest", F.when(hit, _edges(remove_terms(F.col("descriptor"), F.col("__ranked")))).otherwise(F.col("descriptor")))

    # race on the whole descriptor; equivalent terms go as well
    race = longest_match(d, "descriptor", "descriptor", races, "term", rare).select(F.col("key").alias("__k"), clean("v_race").alias("__race"), clean("v_subrace").alias("__subrace"), F.col("v_term").alias("race_term"))
    same = races.groupBy(clean("race").alias("__r"), clean("subrace").alias("__s")).agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "term"))), lambda x: x["term"]).alias("__terms"))
    race = race.join(same, (F.col("__race") == F.col("__r")) & (F.col("__subrace") == F.col("__s"))).drop("__r", "__s")
    out = out.join(race, F.col("descriptor") == F.col("__k"), "left").drop("__k")
    own = F.when(F.col("rank").isin(*rank_own), F.col("rank")).when(hit, F.lit(rank_else)).otherwise(F.lit(""))
    out = out.withColumns(
        {
            "race": F.coalesce("__race", own),
            "subrace": F.coalesce("__subrace", F.lit("")),
            "__rest": F.when(F.col("race_term").isNotNull(), remove_terms(remove_word("__rest", "race_term"), F.col("__terms"))).otherwise(F.col("__rest")),
        }
    )

    # title on what is left, or on everything if nothing is
    # stored, as it is read twice
    out = materialize(out.withColumn("__where", F.when(F.col("__rest") != "", F.col("__rest")).otherwise(F.col("descriptor"))), "descriptors")
    title = longest_match(out, "__where", "__where", titles, "title", rare).select(
        F.col("key").alias("__k"), F.col("v_term").alias("class_title"), unknown_to_blank("v_base_class").alias("base_class"),
        unknown_to_blank("v_gender").alias("gender"), clean("v_gender_confidence").alias("__gc"),
    )
    out = out.join(title, F.col("__where") == F.col("__k"), "left").drop("__k")
    titled = F.col("class_title").isNotNull()
    out = out.withColumns(
        {
            "remainder": _edges(F.when(titled, remove_word("__rest", "class_title")).otherwise(F.col("__rest"))),
            "base_class": F.coalesce("base_class", F.lit("")),
            "gender": F.coalesce("gender", F.lit("")),
            "gender_confidence": F.when(F.coalesce("gender", F.lit("")) != "", F.col("__gc")).otherwise(F.lit("")),
        }
    )

    # F7, F8, F9
    cascade = lambda pick, first: reduce(lambda e, r: e.when(r[0], r[pick]), factions, F.when(hit, F.lit(first))).otherwise(F.lit(""))
    plain = norm("remainder")
    suspect = reduce(lambda a, b: a | b, [F.contains(plain, F.lit(x)) for x in suspects])
    none = F.col("descriptor") == ""
    status = (
        F.when(none, statuses["nothing"]).when(hit, statuses["ranked"]).when(suspect, statuses["suspect"])
        .when((F.col("race") != "") & titled & (F.col("base_class") != ""), statuses["all"])
        .when((F.col("race") != "") & titled, statuses["no base class"])
        .when(F.col("race") != "", statuses["race alone"])
        .when(F.col("remainder") != "", statuses["only a rest"]).otherwise(statuses["none"])
    )
    some = lambda name, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{name}="), F.col(c)))
    notes = F.concat_ws(
        " | ", some("rank_term", "rank_term"), some("race_term", "race_term"), some("class_title", "class_title"), some("unmatched", "remainder"),
        F.when(F.col("race") == "", F.lit("race_unknown")),
        F.when((F.col("base_class") == "") & ~F.col("race").isin(*rank_own, rank_else), F.lit("base_class_unknown")),
    )
    text_or_blank = lambda c: F.coalesce(clean(c), F.lit("")).alias(c)
    out = out.withColumns({"faction": cascade(1, rank_faction), "faction_confidence": cascade(2, "high"), "status": status, "notes": F.when(none, "No descriptor").otherwise(notes)})
    return out.select("descriptor", "race", "subrace", "base_class", text_or_blank("class_title"), "gender", "gender_confidence", "faction", "faction_confidence", text_or_blank("rank"), text_or_blank("rank_code"), text_or_blank("rank_role"), "status", "remainder", "notes")


def classify_records(records: DataFrame, text: Column, not_found: Column, **vocabulary) -> DataFrame:
    """records that were found, each with its descriptor's classification."""
    usable = records.filter(~not_found).withColumn("__d", clean(text))
    return usable.join(classify(usable, "__d", **vocabulary), F.col("__d") == F.col("descriptor")).drop("__d")


def frequencies(classified: DataFrame, attributes: list[str], order: str = "ord", n: int = 100, blank: str = "(blank)") -> DataFrame:
    """``attribute, value, n, place`` of the ``n`` most frequent values; ties by first occurrence."""
    pairs = classified.select(order, F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.coalesce(F.nullif(F.col(a), F.lit("")), F.lit(blank)).alias("value")) for a in attributes])).alias("p"))
    counted = pairs.groupBy("p.attribute", "p.value").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    place = F.row_number().over(Window.partitionBy("attribute").orderBy(F.col("n").desc(), "first"))
    return counted.withColumn("place", place).filter(F.col("place") <= n).select("attribute", "value", "n", "place")
