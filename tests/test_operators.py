import random
import re

import pytest
from pyspark.sql import functions as F

from recordloom.operators import checks, mining, recapture, review, views, vocab
from recordloom.operators.ranking import islands
from recordloom.plans.mining_plans import _vocabulary

PAIRS = [
    ("same", "a 1\n", "a  2", "same_or_equivalent"),
    ("gone", "junk no one here", "no one here", "previous_not_found_with_extra_contamination"),
    ("extra", "head\nbody\nnoise", "head\nbody", "previous_has_extra_after_clean_capture"),
    ("subset", "noise head\nbody more", "head\nbody", "latest_is_subset_of_previous_review_previous_extra"),
    ("header", "head\nold", "head\nnew", "same_header_but_body_differs_review"),
    ("other", "x", "y", "different_review"),
    ("empty", "x", "", "previous_has_extra_after_clean_capture"),
]


@pytest.mark.parametrize("name, a, b, expected", PAIRS)
def test_change_class(spark, name, a, b, expected):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(recapture.change_class("a", "b", r"\d+", "<n>", "no one here")).first()[0] == expected


def test_pairs_and_lines(spark):
    caps = spark.createDataFrame([(0, "k", "a"), (1, "k", "a\nb"), (2, "k", "b\nb"), (3, "lone", "x")], "ord int, key string, text string")
    wanted = spark.createDataFrame([("k",), ("lone",), ("none",)], "key string")
    pairs = recapture.last_two(caps, "key", "text", wanted)
    got = {r.key: (r.n_captures, r.previous, r.latest) for r in pairs.collect()}
    assert got == {"k": (3, "a\nb", "b\nb"), "lone": (1, None, "x"), "none": (0, None, None)}
    assert {(r.line, r.change) for r in recapture.line_changes(pairs).collect()} == {("a", -1), ("b", 1)}
    out = recapture.compare_pairs(pairs, r"\d+", "<n>", "no one", ["b"])
    assert {r.change for r in out.collect() if r.key != "k"} == {"fewer_than_two_captures"}
    assert sum(r.n for r in recapture.class_counts(out).collect()) == 3


def test_supersede_is_idempotent(spark):
    caps = spark.createDataFrame([(0, "high"), (1, "high"), (2, "medium"), (3, "medium"), (4, "high")], "ord int, quality string")
    keys = spark.createDataFrame([(0, "a"), (1, "a"), (1, "b"), (2, "b"), (3, "c")], "ord int, key string")
    good = F.col("quality") == "high"
    once = recapture.supersede(caps, keys, good)
    got = {r.ord: (r.quality, r.original_quality, [tuple(x) for x in r.superseded_by] if r.superseded_by is not None else None) for r in once.collect()}
    assert got[0] == ("low", "high", [("a", 1)]) and got[1] == ("high", None, None) and got[2] == ("low", "medium", [("b", 1)])
    assert got[3] == ("low", "medium", []) and got[4] == ("high", None, None)
    twice = recapture.supersede(once, keys, good)
    assert {r.ord: (r.quality, r.original_quality) for r in twice.collect()} == {k: v[:2] for k, v in got.items()}


def test_best_display(spark):
    caps = spark.createDataFrame(
        [(0, "Tarn", "medium", "text", None, "d", "a:1000000002:x"), (1, "tarn", "medium", None, "<b>", None, "a:1000000001:x"), (2, "Bel", "", "only text", None, None, "b"), (3, "Bel", "low", "t", "<i>", "d", "c"), (4, "Orm", "high", " ", "", "d", "e"),
         (5, "Zed", "", "t", "", "", "q:1000000001:b"), (6, "Zed", "", "t", "", "", "q:1000000002:a"), (7, None, "", "t", "", "", "n")],
        "ord int, name string, q string, t string, h string, d string, id string",
    )
    best = recapture.best_display(caps, "name", "q", ["t", "h"], ["h", "d"], [recapture.capture_time("id").desc(), F.col("id").desc()])
    assert {r.name_key: r.ord for r in best.collect()} == {"tarn": 1, "bel": 2, "zed": 6, "": 7}


def test_checks(spark):
    df = spark.createDataFrame([("1", "a", "2020-01-02", "2020-01-01"), ("1", "", "bad", ""), ("", "c", "", "2020-02-30")], "id string, kind string, s string, e string")
    said = lambda x: sorted((r.row_key, r.message) for r in x.collect())
    assert said(checks.check_unique(df, "t", ["id"])) == [("", "blank 1"), ("1", "repeated 2")]
    assert said(checks.check_allowed(df, "t", "kind", ["a"], "id")) == [("", "kind: c")]
    assert said(checks.check_allowed(df, "t", "kind", ["a", "c"], "id", optional=False)) == [("1", "kind: ")]
    assert said(checks.check_dates(df, "t", "s", "e", "id")) == [("", "malformed end"), ("1", "malformed start"), ("1", "start after end")]
    ids = spark.createDataFrame([("r", "x; y;"), ("q", None)], "id string, refs string")
    assert said(checks.check_foreign_key(ids, "t", "refs", "id", spark.createDataFrame([("x",)], "k string"), "k")) == [("r", "unknown id y")]
    names = spark.createDataFrame([("Tarn",), ("tarn",), ("Bel",), ("BEL",), ("",), ("",)], "n string")
    found = checks.check_repeated_names(names, "t", "n", spark.createDataFrame([("TARN",)], "name string"))
    assert {(r.level, r.row_key) for r in found.collect()} == {("info", "tarn"), ("warning", "bel")}
    assert said(checks.check_columns(spark, df, "t", ["id", "nope"])) == [("nope", "missing column")]
    assert checks.check_columns(spark, None, "t", []).count() == 1
    assert checks.first_existing(df, ["x", "kind"]) == "kind" and checks.first_existing(df, ["x"]) is None
    checks.gate(found)
    with pytest.raises(ValueError):
        checks.gate(checks.validate(found, checks.check_unique(df, "t", ["id"])))


def test_counts_equal_findings(spark):
    """Counts of all checks, one scan per table, against the findings themselves, with odd rows and a hot key."""
    rows = [(i % 11 if i % 13 else None, "ab"[i % 2] if i % 7 else "c", ["2020-01-02", "bad", "", None][i % 4], ["2020-01-01", "2020-02-30"][i % 2], f"x{i % 5}; hot;", f"N{i % 9}") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, kind string, s string, e string, refs string, name string")
    target = spark.createDataFrame([("x1", "n1"), ("hot", ""), (None, "n2")], "k string, name string")
    findings = checks.validate(
        checks.check_unique(df, "t", ["id"]), checks.check_rows(df, "t", "id", [checks.not_allowed("kind", ["a", "b"]), checks.wrong_dates("s", "e")]), checks.check_foreign_key(df, "t", "refs", "id", target, "k"),
        checks.check_repeated_names(df, "t", "name", target), checks.check_unlinked(df, "t", "name", target, "name"),
    )
    c = checks.Counting().table("t", df).table("k", target).unique("t", ["id"]).rows("t", [checks.not_allowed("kind", ["a", "b"]), checks.wrong_dates("s", "e")])
    got = c.foreign_key("t", "refs", "k", "k").repeated_names("t", "name", "k", "name").unlinked("t", "name", "k", "name").counts()
    assert got._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 2
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in checks.issue_counts(findings).collect()}


def classify(spark, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "d string")
    factions = [((F.col("race") == "Part") & (F.col("subrace") == "Round"), "Wheels", "high"), (F.col("race") != "", "Others", "medium")]
    return {r.descriptor: r for r in vocab.classify(df, "d", **_vocabulary(spark), factions=factions, rank_own=["Promo"], rank_else="Ware", rank_faction="Ranked").collect()}


def test_classification_cascade(spark):
    got = classify(spark, "hot gear", "small gear", "gear", "cold anvil", "x is a level y", "odd", "level", "promo blue ring gear", "economy", None, "gears", "Large Blue BOLT", "")
    assert (got["hot gear"].status, got["hot gear"].faction, got["hot gear"].gender) == ("classified", "Wheels", "female")
    assert got["small gear"].status == "generic_title_no_class" and got["gear"].status == "race_only"
    assert got["cold anvil"].status == "generic_title_no_class" and got["cold anvil"].gender == ""
    assert got["x is a level y"].status == "parser_suspect_or_custom_descriptor"
    assert got["odd"].status == "custom_descriptor_unclassified" and got["level"].status == "custom_descriptor_unclassified"
    assert (got["promo blue ring gear"].status, got["promo blue ring gear"].faction, got["promo blue ring gear"].race, got["promo blue ring gear"].remainder) == ("immortal", "Ranked", "Part", "")
    assert got["economy"].race == "Ware" and got["economy"].rank_code == "E"
    assert got[""].status == "no_descriptor" and got["gears"].status == "custom_descriptor_unclassified"
    assert got["Large Blue BOLT"].class_title == "large blue" and got["Large Blue BOLT"].remainder == ""


def test_matches_words_accents_and_symbols(spark):
    texts = spark.createDataFrame([("Élf lord",), ("shelf",), ("(**) mark",), ("elf",)], "d string")
    v = spark.createDataFrame([(1, "elf"), (2, "**"), (3, "elf lord"), (4, "lf"), (5, "")], "ord int, term string")
    got = {(r.key, r.v_term) for r in vocab.matches(texts, "d", "d", v, "term").collect()}
    assert got == {("Élf lord", "elf"), ("Élf lord", "elf lord"), ("(**) mark", "**"), ("elf", "elf")}
    assert {r.key: r.v_term for r in vocab.longest_match(texts, "d", "d", v, "term").collect()}["Élf lord"] == "elf lord"


def test_matches_equal_the_pattern(spark):
    """Words, accents, symbols and blanks at random: the same hits as a whole-word search by pattern, and no pattern per term in the plan."""
    r = random.Random(11)
    bits = ["elf", "half", "-", "'s", " ", "  ", "lord", "(", "**", "é", "x1", ".", "the"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(1, 14))) for _ in range(300)] + ["", " "]
    terms = ["".join(r.choice(bits) for _ in range(r.randrange(1, 4))) for _ in range(150)]
    df, v = spark.createDataFrame([(t,) for t in texts], "d string"), spark.createDataFrame(list(enumerate(terms)), "ord int, term string")
    found = vocab.matches(df, "d", "d", v, "term")
    plain = lambda x: re.sub(r"\s+", " ", x.strip().lower().translate(str.maketrans("áâäéêëíóúû", "aaaeeeiouu")))
    want = {(t, k) for t in texts for k, term in enumerate(terms) if plain(term) and re.search(r"(?<!\w)" + re.escape(plain(term)) + r"(?!\w)", plain(t))}
    assert {(x.key, x.v_ord) for x in found.collect()} == want and len(want) > 300
    assert "RLIKE" not in found._jdf.queryExecution().executedPlan().toString().upper()


def test_large_vocabulary(spark):
    """100,000 terms that begin with one common word meet texts at their rare words."""
    v = spark.range(100_000).select(F.col("id").cast("int").alias("ord"), F.concat(F.lit("old "), F.concat(F.lit("w"), F.col("id").cast("string")), F.lit(" of "), F.concat(F.lit("p"), (F.col("id") % 7).cast("string"))).alias("term"))
    texts = spark.range(2000).select(F.concat(F.lit("the old w"), (F.col("id") * 61).cast("string"), F.lit(" of p"), (F.col("id") * 61 % 7).cast("string"), F.lit(" old")).alias("d"))
    got = vocab.longest_match(texts, "d", "d", v, "term").select("key", "v_ord").collect()
    assert {r.v_ord for r in got} == {k * 61 for k in range(2000) if k * 61 < 100_000} and len(got) == sum(k * 61 < 100_000 for k in range(2000))
    rare = vocab.rarest_words(texts, "d", (v, "term")).groupBy(F.substring("rare", 1, 1).alias("k")).count().collect()
    assert {r.k: r["count"] for r in rare} == {"w": 100_000}


def mined(spark, text, **kw):
    df = spark.createDataFrame([(1, text)], "k int, t string")
    return [(r.pos, r.name) for r in mining.headed_names(df, "k", "t", ["Foes"], **kw).orderBy("pos", "name").collect()]


def test_headed_lists(spark):
    assert mined(spark, "Foes: Tarn, Bel") == [(0, "Bel"), (0, "Tarn")]
    assert mined(spark, "foes:\n Tarn\nBel\n\nOrm") == [(0, "Bel"), (0, "Tarn")]
    assert mined(spark, "Foes:\nTarn\nOther: x\nBel") == [(0, "Tarn")]
    assert mined(spark, "Foes:\n" + "\n".join(f"Na{c}" for c in "abcdefghij")) == [(0, f"Na{c}") for c in "abcdefgh"]
    assert mined(spark, "Foes:\nTarn - late\nBel") == [(0, "Tarn")]
    assert mined(spark, "Pals: Tarn") == [] and mined(spark, None) == [] and mined(spark, "Foes:") == []


def test_commas_speakers_groups_known(spark):
    df = spark.createDataFrame([(1, "Tarn, Bel, Orm\nTarn, Bel\nTarn says hi\n<x> Bel asks y\ntarn says\nBorder order here\nBorder x\n")], "k int, t string")
    ls = mining.lines(df, "k", "t")
    assert ls.count() == 7
    known = mining.known_names((spark.createDataFrame([("TARN",), ("",)], "n string"), "n"))
    got = mining.comma_names(df, "k", "t", known).collect()
    assert {(r.name, r.confidence, r.matched) for r in got} == {("Tarn", "high", True), ("Bel", "low", False), ("Orm", "low", False)}
    assert {(r.pos, r.name) for r in mining.quoted_speakers(df, "k", "t", ["says"], ["asks"], known).collect()} == {(2, "Tarn"), (3, "Bel")}
    assert {(r.pos, r.confidence) for r in mining.group_lines(df, "k", "t", ["order"], ["order"], ["chief"]).collect()} == {(5, "medium"), (6, "low")}
    assert mining.empty_texts(spark.createDataFrame([(None,), (" ",), ("x",)], "t string"), "t").first().asDict() == {"empty": 2, "texts": 3}


def test_excerpts_of_mentions(spark):
    """Evidence and excerpt of each kind; of a list below its heading all lines are evidence, which the text does not hold as one."""
    text = "x" * 500 + "\n\n\n\nFoes:\n  Tarn\nBel\n\n<t> Orm asks y\nTarn, Bel, Orm\nthe Order of it\n" + "y" * 500
    df = spark.createDataFrame([(1, text)], "k int, t string")
    got = {(r.kind, r.name): r for r in mining.mine(df, "k", "t", ["foes"], ["says"], ["asks"]).collect()}
    assert {k: r.evidence for k, r in got.items()} == {
        ("heading_name_list", "Tarn"): "Foes: /   Tarn / Bel", ("heading_name_list", "Bel"): "Foes: /   Tarn / Bel", ("quoted_speaker", "Orm"): "<t> Orm asks y",
        **{("comma_name_list", n): "Tarn, Bel, Orm" for n in ("Tarn", "Bel", "Orm")},
    }
    flat = re.sub("\n{3,}", "\n\n", text)
    assert got["heading_name_list", "Tarn"].text_excerpt == flat[:900]
    at = flat.index("Tarn, Bel, Orm")
    assert got["comma_name_list", "Orm"].text_excerpt == ("…\n" + flat[at - 350 : at + 14 + 350].strip() + "\n…")[:900]
    assert mining.group_lines(df, "k", "t", ["order"], ["order"], ["chief"]).first().text_excerpt.startswith("…\n")


def test_keyword_table(spark):
    """A large table of keywords, of one character up, against a plain search; the plan does not grow with it."""
    r = random.Random(6)
    text = lambda n: "".join(r.choice("abcdé -X") for _ in range(n))
    lines = [(k, p, text(r.randrange(0, 30))) for k in range(20) for p in range(10)]
    keys = [text(r.randrange(1, 6)) for _ in range(400)] + ["", "  ", "A", "zz"]
    df, v = spark.createDataFrame(lines, "key int, pos int, line string"), spark.createDataFrame([(k,) for k in keys] + [(None,)], "keyword string")
    found = mining.keyword_hits(df, v)
    want = {(k, p, w) for k, p, x in lines for w in {y.strip().lower() for y in keys} - {""} if w in x.lower()}
    assert sorted((x.key, x.pos, x.keyword) for x in found.collect()) == sorted(want) and len(want) > 200
    many = spark.range(50_000).select(F.concat(F.lit("kw"), F.col("id").cast("string"), F.lit("x")).alias("keyword"))
    some = spark.createDataFrame([(1, 0, "see KW123x and kw49999x"), (1, 1, "kw x")], df.schema)
    hits = mining.keyword_hits(some, many)
    assert {(x.pos, x.keyword) for x in hits.collect()} == {(0, "kw123x"), (0, "kw49999x")}
    assert len(hits._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    assert mining.keyword_hits(some, many.limit(0)).count() == 0


def test_islands_over_ranges(spark):
    """Runs of any length, cut into many ranges, against a plain pass."""
    r = random.Random(2)
    rows = [(k, p) for k in range(3) for p in sorted(r.sample(range(4000), 1500))] + [(7, p) for p in range(3000)]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "k int, pos int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        got = {(x.k, x.pos): x.island for x in islands(df, ["k"], "pos", 2).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want, last = {}, {}
    for k, p in rows:
        n, q = last.get(k, (0, None))
        n += q is None or p - q > 2
        want[k, p], last[k] = n, (n, p)
    assert got == want


def art(spark, *ls):
    df = spark.createDataFrame([(1, "\n".join(ls))], "k int, t string")
    return [(r.art_lines, r.art_score) for r in mining.art_clusters(df, "k", "t").collect()]


def test_art_clusters(spark):
    a, strong = "-=-=-=-=-=-=", "/\\____/\\----"
    assert art(spark, a, a, a) == [(3, 9.0)]
    assert art(spark, a, "word", a, "text", a) == [(3, 9.0)]
    assert art(spark, a, "one", "two", a) == []
    assert art(spark, strong) == [(1, 5.0)]
    assert art(spark, a, a, "b c", "d e", "f g", a, a) == [(2, 6.0)]
    assert art(spark, "plain", "lines") == []


def test_views(spark):
    rows = spark.createDataFrame([(1, "a", "x", 0), (1, "b", "", 1), (1, "a", "", 2), (2, None, None, 3)], "k int, s string, f string, ord int")
    rules = views.classification_points("s", {"a": 2, "b": 3}, {"f": 150}, "f", F.lit(0), "b")
    assert {r.k: r.ord for r in views.best_by_score(rows, ["k"], rules, ["ord"]).collect()} == {1: 0, 2: 3}
    e = spark.createDataFrame([("1", "Tarn"), ("2", "Bel"), ("3", "")], "id string, n string")
    r = spark.createDataFrame([("1", "Bel", "p"), ("", "bel", "q"), ("", "", "z"), (None, "TARN", "w")], "rid string, rn string, v string")
    assert {(x.entity, x.found_by, x.v) for x in views.by_id_then_name(e, r, "id", "n", "rid", "rn").collect()} == {("1", "id", "p"), ("2", "name", "q"), ("2", "name", "p")}
    assert {(x.entity, x.v) for x in views.by_id_then_name(e, r, "id", "n", "rid", "rn", only_unnamed=True).collect()} == {("1", "p"), ("2", "q")}
    one = views.one_per_entity(e, "id", r.filter("rid = '1'"), "rid", r, {"v": "none"})
    assert {(x.id, x.v, x.n_candidates) for x in one.collect()} == {("1", "p", 1), ("2", "none", 0), ("3", "none", 0)}
    assert views.usable_links(spark.createDataFrame([("accepted",), ("",), (None,), ("no",)], "status string")).count() == 3


def test_review(spark):
    q = spark.createDataFrame([(0, "Tarn", "no"), (1, "TARN", "no"), (2, "", "no"), (3, "Bel", "yes"), (4, "Orm", "no")], "ord int, n string, c string")
    assert [r.ord for r in review.work_queue(q, "n", "c", "ord").orderBy("ord").collect()] == [0, 4]
    assert review.work_queue(q, "n", None, "ord", limit=0).count() == 0 and review.work_queue(q, "n", None, "ord", limit=2).count() == 2
    rows = spark.createDataFrame([(i, f"n{i}") for i in range(6)], "ord long, n string")
    picks = review.cover_sample(rows, "n", "ord", ["N3", "n1"], {"any": F.col("ord") >= 0, "again": F.col("ord") >= 0, "taken": F.col("ord") == 3, "none": F.col("ord") > 99})
    assert [r.ord for r in picks.orderBy("pick").collect()] == [3, 1, 0, 2]
    top = review.top_by_score(spark.createDataFrame([(0, "x"), (1, "2.5"), (2, None), (3, "9")], "ord int, s string"), "s", ["ord"], 3)
    assert [(r.ord, r.score) for r in top.collect()] == [(3, 9.0), (1, 2.5), (0, 0.0)]
