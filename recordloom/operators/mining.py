"""Text mining of captures: lines, names, speakers, groups and character art."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from recordloom.functions.exprs import art_score, clean, excerpt_of, fold, is_name_like, split_names, squeezed, trim_name
from recordloom.operators.ranking import best_per_key, islands
from recordloom.sources.scratch import materialize

#: How names are compared: a function from a name to what equal names share.
Match = Callable[..., Column]

#: Form of a heading (a letter and 1 to 32 letters, blanks, slashes, underscores or hyphens before a colon) and of a name.
HEAD = r"^([A-Za-z][A-Za-z /_-]{1,32})\s*:"
HEADING = HEAD + r"\s*(.*)$"
NAME = "[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ'’-]{1,24}"


def line_array(text) -> Column:
    """Lines of a text; the empty piece after a final line end is none."""
    t = F.col(text) if isinstance(text, str) else text
    return F.split(F.regexp_replace(F.coalesce(t, F.lit("")), r"\R\z", ""), r"\R")


def lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """G1: ``key, pos, line`` of every text that is not blank."""
    usable = texts.filter(clean(text) != "")
    return usable.select(F.col(key).alias("key"), F.posexplode(line_array(text)).alias("pos", "line"))


def empty_texts(texts: DataFrame, text: str) -> DataFrame:
    """G1: one row with the number of blank texts."""
    return texts.agg(F.count_if(clean(text) == "").alias("empty"), F.count("*").alias("texts"))


def known_names(*columns: tuple[DataFrame, str], match: Match = fold) -> DataFrame:
    """Names of several tables as ``match`` gives them (folded by default), each once."""
    return reduce(DataFrame.union, [df.select(match(c).alias("known")) for df, c in columns]).filter("known <> ''").distinct()


def flag_known(mentions: DataFrame, known: DataFrame | None, match: Match = fold) -> DataFrame:
    """Adds ``matched``; a known name has high confidence. ``match`` is that of ``known_names``."""
    if known is None:
        return mentions.withColumn("matched", F.lit(False))
    out = mentions.withColumn("__k", match("name")).join(known.withColumn("matched", F.lit(True)), F.col("__k") == F.col("known"), "left")
    out = out.withColumn("matched", F.coalesce("matched", F.lit(False)))
    return out.withColumn("confidence", F.when(F.col("matched"), "high").otherwise(F.col("confidence"))).drop("__k", "known")


#: Lines after a heading that may hold its names; characters of the evidence that is kept.
FOLLOWING, EVIDENCE = 8, 500


def _hits(texts: DataFrame, key: str, text: str, keep) -> DataFrame:
    """``key, pos, line, after, flat`` of the lines that ``keep`` holds for; nothing else leaves its row.

    ``after`` are the next FOLLOWING lines, ``flat`` is the text as excerpts are cut from it.
    """
    t = texts.filter(clean(text) != "").select(F.col(key).alias("key"), squeezed(text).alias("flat"), line_array(text).alias("ls"))
    numbered = F.transform("ls", lambda x, i: F.struct(i.alias("pos"), x.alias("line")))
    found = F.transform(F.filter(numbered, lambda h: keep(h["line"])), lambda h: F.struct(h["pos"].alias("pos"), h["line"].alias("line"), F.slice("ls", h["pos"] + 2, F.lit(FOLLOWING)).alias("after")))
    return t.select("key", "flat", F.explode(found).alias("h")).select("key", "h.*", "flat")


def _finding(kind: str, heading: Column, confidence: str, needle: Column, names: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), heading.alias("heading"), F.lit(confidence).alias("confidence"), needle.alias("needle"), F.coalesce(names, F.array().cast("array<string>")).alias("names"))


def _headed(headings: list[str], stop_words, following: int):
    """Names on the line of a known heading or, if that holds none, on the lines after it until a blank line or any heading."""
    line, after = clean("line"), F.slice("after", F.lit(1), F.lit(following))
    heading, rest = clean(F.regexp_extract(line, HEADING, 1)), clean(F.regexp_extract(line, HEADING, 2))
    stops = F.transform(after, lambda x: (clean(x) == "") | clean(x).rlike(HEAD))
    until = F.when(F.array_contains(stops, True), F.array_position(stops, True).cast("int") - 1).otherwise(F.size(after))
    more = F.when(rest == "", F.slice(after, F.lit(1), until)).otherwise(F.array().cast("array<string>"))
    source = F.when(rest != "", rest).otherwise(F.array_join(F.transform(more, clean), ", "))
    names = F.when(F.lower(heading).isin(*[h.lower() for h in headings]), split_names(source, stop_words))
    return lambda x: F.contains(x, F.lit(":")), _finding("heading_name_list", heading, "medium", F.array_join(F.concat(F.array(line), more), " / "), names)


def _commas(stop_words, longest: int, least: int):
    """Compact lines with a comma and at least ``least`` name-like parts."""
    line = clean("line")
    names = split_names(line, stop_words)
    fits = F.contains(line, F.lit(",")) & (F.length(line) <= longest)
    return lambda x: F.contains(x, F.lit(",")), _finding("comma_name_list", F.lit(""), "low", line, F.when(fits, F.when(F.size(names) >= least, names)))


def _speakers(verbs: list[str], tagged_verbs: list[str], stop_words):
    """A leading name before a speech verb, also after a ``<tag>``; a line may give one mention per pattern."""
    patterns = [rf"^({NAME})\s+(?:{'|'.join(verbs)})\b", rf"^<[^>]+>\s*({NAME})\s+(?:{'|'.join(tagged_verbs)})\b"]
    line = clean("line")
    names = F.filter(F.array(*[trim_name(F.regexp_extract(line, p, 1)) for p in patterns]), lambda n: (n != "") & is_name_like(n, stop_words))
    return lambda x: reduce(lambda a, b: a | b, [x.rlike(p.replace("^", r"(?U)^\s*", 1)) for p in patterns]), _finding("quoted_speaker", F.lit(""), "medium", line, names)


def _mentions(texts: DataFrame, key: str, text: str, finders: list, known: DataFrame | None, match: Match) -> DataFrame:
    """``key, pos, name, kind, heading, evidence, text_excerpt, confidence, matched`` of all finders in one pass; excerpts are cut once per finding."""
    hits = _hits(texts, key, text, lambda x: reduce(lambda a, b: a | b, [keep(x) for keep, _ in finders]))
    found = F.filter(F.array(*[finding for _, finding in finders]), lambda m: F.size(m["names"]) > 0)
    rows = hits.select("key", "pos", "flat", F.explode(found).alias("m"))
    rows = rows.select("key", "pos", "m.kind", "m.heading", "m.confidence", F.substring("m.needle", 1, EVIDENCE).alias("evidence"), excerpt_of("flat", "m.needle").alias("text_excerpt"), F.col("m.names").alias("names"))
    return flag_known(rows.select("key", "pos", F.explode("names").alias("name"), "kind", "heading", "evidence", "text_excerpt", "confidence"), known, match)


def headed_names(texts: DataFrame, key: str, text: str, headings: list[str], known: DataFrame | None = None, stop_words=(), following: int = FOLLOWING, match: Match = fold) -> DataFrame:
    """Names after known headings, on the line itself or, if that holds none, on up to ``following`` lines until
    a blank line or any heading. The lines are joined before a trailing comment is cut; the evidence is all of them."""
    return _mentions(texts, key, text, [_headed(headings, stop_words, following)], known, match)


def comma_names(texts: DataFrame, key: str, text: str, known: DataFrame | None = None, stop_words=(), longest: int = 180, least: int = 3, match: Match = fold) -> DataFrame:
    """Names of compact lines with a comma and at least ``least`` name-like parts."""
    return _mentions(texts, key, text, [_commas(stop_words, longest, least)], known, match)


def quoted_speakers(texts: DataFrame, key: str, text: str, verbs: list[str], tagged_verbs: list[str], known: DataFrame | None = None, stop_words=(), match: Match = fold) -> DataFrame:
    """A leading name before a speech verb, also after a ``<tag>``; a line may give one mention per pattern."""
    return _mentions(texts, key, text, [_speakers(verbs, tagged_verbs, stop_words)], known, match)


def group_lines(texts: DataFrame, key: str, text: str, keywords: list[str], group_words: list[str], role_words: list[str], most: int = EVIDENCE) -> DataFrame:
    """Lines that hold a keyword anywhere; a whole group or role word raises the confidence to medium."""
    hits = _hits(texts, key, text, lambda x: reduce(lambda a, b: a | b, [F.contains(F.lower(x), F.lit(k.lower())) for k in keywords]))
    line = clean("line")
    sure = F.lower(line).rlike(rf"(?U)\b({'|'.join(group_words + role_words)})\b")
    return hits.select("key", "pos", F.substring(line, 1, most).alias("evidence"), excerpt_of("flat", line).alias("text_excerpt"), F.when(sure, "medium").otherwise("low").alias("confidence"))


#: Characters of the pieces by which lines meet a table of keywords.
PIECE = 3


def _pieces(text, size: int) -> Column:
    """All distinct pieces of ``size`` characters, found in one pass."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def keyword_hits(numbered: DataFrame, keywords: DataFrame, keyword: str = "keyword") -> DataFrame:
    """G5, D5 for tables of keywords: ``key, pos, line, keyword`` of every line (``key, pos, line``) that holds a keyword anywhere, case ignored.

    Lines meet a keyword at its rarest piece of up to PIECE characters (measured on
    the lines) and are then searched for the whole of it, so the plan does not
    grow with the keywords and no common piece is a hot key unless it is a keyword
    itself. Blank keywords are left out; equal ones are one.
    """
    words = keywords.select(F.lower(clean(keyword)).alias("keyword")).filter("keyword <> ''").distinct()
    words = words.withColumn("size", F.least(F.length("keyword"), F.lit(PIECE)))
    own = reduce(lambda e, n: e.when(F.col("size") == n, _pieces("keyword", n)), range(1, PIECE), F.when(F.col("size") == PIECE, _pieces("keyword", PIECE)))
    each = words.select("keyword", F.explode(own).alias("piece"))
    sizes = sorted(r["size"] for r in words.select("size").distinct().collect())  # PIECE numbers at most
    low = numbered.select("key", "pos", "line", F.lower("line").alias("low"))
    if not sizes:
        return low.select("key", "pos", "line", F.col("low").alias("keyword")).limit(0)
    held = low.select("key", "pos", "line", "low", F.explode(F.concat(*[_pieces("low", n) for n in sizes])).alias("piece"))
    count = held.join(each.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    rare = each.join(count, "piece").groupBy("keyword").agg(F.min(F.struct("n", "piece"))["piece"].alias("piece"))
    met = held.join(materialize(rare, "pieces"), "piece")
    return met.filter(F.contains("low", F.col("keyword"))).select("key", "pos", "line", "keyword")


def art_clusters(texts: DataFrame, key: str, text: str, least: float = 1.5, gap: int = 2, few: int = 3, strong: float = 5.0, shown: int = 16, most: int = 1000) -> DataFrame:
    """The best cluster of art-like lines of each text: ``key, art_lines, art_score, art_excerpt, text_excerpt``.

    Lines of at least ``least`` join when not more than ``gap`` apart. The best
    cluster has most lines, then the highest score, then comes first; fewer than
    ``few`` lines with less than ``strong`` points in all are no art. Clusters may
    have any length: they are numbered by ranges, and only the first ``shown`` lines
    of the best one come together. Texts are joined back for hits alone.
    """
    # a row number stops the filter from moving below the score, which would be worked out twice
    scored = lines(texts, key, text).withColumns({"score": art_score("line"), "__row": F.monotonically_increasing_id()}).filter((F.col("score") >= least) & (F.col("__row") >= 0)).drop("__row")
    # stored, as dealing by ranges looks at the rows first and would score all lines twice
    placed = islands(materialize(scored, "art-lines"), ["key"], "pos", gap)
    art = placed.groupBy("key", "island").agg(F.count("*").alias("art_lines"), F.sum("score").alias("art_score"))
    best = best_per_key(art, ["key"], [F.col("art_lines").desc(), F.col("art_score").desc(), "island"])
    best = best.filter((F.col("art_lines") >= few) | (F.col("art_score") >= strong))
    first = best_per_key(placed.join(best.select("key", "island"), ["key", "island"]), ["key"], ["pos"], shown)
    drawn = first.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("drawn"))
    whole = texts.select(F.col(key).alias("key"), squeezed(F.array_join(line_array(text), "\n")).alias("flat"))
    out = best.join(drawn, "key").join(whole, "key")
    return out.select("key", "art_lines", F.round("art_score", 2).alias("art_score"), F.substring("drawn", 1, most).alias("art_excerpt"), excerpt_of("flat", "drawn").alias("text_excerpt"))


def mine(texts: DataFrame, key: str, text: str, headings: list[str], verbs: list[str], tagged_verbs: list[str], known: DataFrame | None = None, stop_words=(), least: int = 3, match: Match = fold) -> DataFrame:
    """Mentions of all three kinds in one pass; a name may occur in several, repeats stay."""
    return _mentions(texts, key, text, [_headed(headings, stop_words, FOLLOWING), _commas(stop_words, 180, least), _speakers(verbs, tagged_verbs, stop_words)], known, match)


def mining_summary(mentions: DataFrame, top: int = 30) -> DataFrame:
    """``what, value, n``: mentions by kind, by heading (the ``top`` most frequent) and by match."""
    count = lambda what, c: mentions.groupBy(c.alias("value")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "value", "n")
    heads = count("heading", F.coalesce(F.nullif(F.col("heading"), F.lit("")), F.lit("(none)"))).orderBy(F.col("n").desc(), "value").limit(top)
    return count("kind", F.col("kind")).unionByName(heads).unionByName(count("matched", F.col("matched").cast("string")))
