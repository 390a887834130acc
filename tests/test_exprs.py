import html
import html.entities
import random
import re

import pytest
from pyspark.sql import functions as F

from recordloom.functions import exprs as E


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "expr, value, expected",
    [
        (E.clean, "\t a \n", "a"), (E.clean, None, ""), (E.clean, " x ", "x"),
        (E.alnum_key, "Straße-9", "strasse9"), (E.norm, "  Élan \t Vôtal ", "elan votal".replace("votal", "vôtal")), (E.norm, "ÚN", "un"),
        (E.id_slug, "Old  Tarn-ö!", "old_tarn_ö"), (E.id_slug, " ", "unknown"), (E.page_slug, "Ærø  Ñu!", "aero-nu"), (E.page_slug, None, "unknown"), (E.page_slug, "Žižka Þorn Ðő", "zizka-thorn-do"), (E.page_slug, "ĩũğłæœıÿ", "aeoeiy"),
        (E.strip_ansi, "\x1b[1;31mred\x1b[0m", "red"), (E.html_to_text, "a<br/>b</p>c<i>&amp;lt;</i>&nbsp;", "a\nb\nc&lt;\xa0"),
        (E.normalise_text, "\n\na \t b \r\nc\r\n\n", "a b\nc"), (E.first_line, "\n  \n x \ny", "x"), (E.first_line, None, ""),
        (E.trim_name, "'Tarn!", "Tarn"), (E.label, " ", "(blank)"), (E.unknown_to_blank, "Unknown", ""),
    ],
)
def test_text(spark, expr, value, expected):
    assert one(spark, expr("v"), v=value) == expected


@pytest.mark.parametrize(
    "given, expected",
    [
        ("<p onclick=\"a()\" onload=x>t</p>", "<p>t</p>"), ("<b style='background: rgb( 0 , 0,0 ); color: red;'>", "<b style='color: red'>"),
        ("<b style=\"background-color:#000000;\">", "<b >"), ("<b style='background: black'>", "<b >"), ("<b style='background:#0000ff'>", "<b style='background:#0000ff'>"),
        ("x<script>1<2</script>y<embed src=a>z", "xyz"), ("<a href=\"javascript:go()\">", "<a href=\"go()\">"),
    ],
)
def test_sanitise(spark, given, expected):
    assert one(spark, E.sanitise_html("v"), v=given) == expected


@pytest.mark.parametrize("name, ok", [("Tarn", True), ("T", False), ("TARN", False), ("TAR", True), ("tarn", False), ("X" + "a" * 24, False), ("O'Brien", True), ("Stop", False), (None, False)])
def test_names(spark, name, ok):
    assert one(spark, E.is_name_like("v", ("Stop",)), v=name) is ok


def test_split_names(spark):
    assert one(spark, E.split_names("v"), v="Tarn, Bel; not, Orm - Late, Er") == ["Tarn", "Bel", "Orm"]
    assert one(spark, E.split_names("v"), v="Tarn and Bel") == ["Tarn", "Bel"]
    assert one(spark, E.split_names("v"), v=None) == []


def compact(text, needle, around=350, most=900):
    """The definition of an excerpt in plain Python."""
    text = re.sub("\n{3,}", "\n\n", text or "").strip()
    at = text.find(needle) if needle else -1
    if at < 0:
        return text[:most]
    a, b = max(0, at - around), min(len(text), at + len(needle) + around)
    return (("…\n" if a else "") + text[a:b].strip() + ("\n…" if b < len(text) else ""))[:most]


def test_excerpt(spark):
    text = "line one\n\n\n\nline two\nneedle  here\nline four" + " tail" * 300
    texts = [text, "a" * 400 + " needle " + "b" * 400, "x" * 2000, "", None, "  \n needle \n", "é" * 500 + "needle" + "ß\n" * 500, "needle" * 300]
    for t in texts:
        for needle in ("needle", "needle  here", "", "absent", "line two\nneedle"):
            assert one(spark, E.excerpt("t", F.lit(needle)), t=t) == compact(t, needle)


def test_references(spark):
    """Every kind of character reference, mixed at random, against Python's own decoder."""
    r = random.Random(4)
    names = sorted(html.entities.html5)
    pick = [lambda: "&" + r.choice(names), lambda: f"&#{r.randrange(0x120000)};", lambda: f"&#x{r.randrange(0x300):X}", lambda: f"&#{r.randrange(300)}", lambda: "&" + r.choice(names).rstrip(";"), lambda: "a b&", lambda: "<b>&;é", lambda: "&#99999999999999999999;&#x1FFFFFFFFF;"]
    texts = ["".join(r.choice(pick)() + r.choice(["", "x", " ", "1;", "=é"]) for _ in range(30)) for _ in range(200)] + ["&" + n for n in names] + [f"&#{n}" for n in range(0, 400)] + [f"&#{n};" for n in (0xFDD0, 0xFFFE, 0x1FFFF, 0xD800, 0x10FFFF, 0x110000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {x.id: x.d for x in df.select("id", E.unescape_html("t").alias("d")).collect()}
    wrong = [(t, got[k], html.unescape(t)) for k, t in enumerate(texts) if got[k] != html.unescape(t)]
    assert not wrong, wrong[:3]
    assert one(spark, E.html_to_text("t"), t="caf&eacute; &#233; &#x41; &mdash; &lt;b&gt;bold&lt;/b&gt; <> &amp;lt;") == "café é A — bold <> &lt;"


def test_escapes_that_need_their_semicolon(spark):
    closed = lambda t: one(spark, E.unescape_html("t", E.MARKUP_NAMES), t=t)
    assert closed("&amp &ampx &amp; &quot&lt&gt&LT &lt; &ltcc; &copy2024 &notit; &#65") == "&amp &ampx & &quot&lt&gt&LT < ⪦ ©2024 ¬it; A"
    assert one(spark, E.unescape_html("t"), t="&amp &ampx &quot&lt") == '& &x "<'


def test_notes_dates_ids(spark):
    assert one(spark, E.merge_note("a", F.col("b")), a="x | y", b="y") == "x | y"
    assert one(spark, E.merge_note("a", F.col("b")), a=None, b="y") == "y"
    assert one(spark, E.merge_note("a", F.col("b")), a="x", b="y") == "x | y"
    for value, date in [("2024-02-29", "2024-02-29"), ("2024-02-30", None), ("2024", None), ("20240201", None), ("", None), (None, None)]:
        assert one(spark, E.iso_date("v").cast("string"), v=value) == date
    assert one(spark, E.multi_ids("v"), v=" a ;; b;") == ["a", "b"]
    assert one(spark, E.rank_of("v", E.CONFIDENCE_RANKS), v="HIGH") == 3
    assert one(spark, E.is_checked("v"), v=" Yes") is True
    assert one(spark, E.descriptor("a", "b"), a="x", b="x") == "x"


def test_remove_word(spark):
    assert one(spark, E.remove_word("t", F.lit("elf")), t="Elf shelf ELF lord") == "shelf lord"
    assert one(spark, E.remove_word("t", F.lit("a.b")), t="a.b axb") == "axb"
    assert one(spark, E.remove_word("t", F.lit("lf")), t="élf") == "élf"


@pytest.mark.parametrize(
    "line, score",
    [("", 0.0), (None, 0.0), ("  !# HP>", 0.0), ("12 / 34 (56)", 0.0), ("Level ----====", 0.0), ("Just a plain sentence here", 0.0), ("/\\", 1.0), ("/\\____/\\----", 5.0), ("-=-=-=-=-=-=", 3.0), ("   |       |      ", 3.5)],
)
def test_art_score(spark, line, score):
    assert one(spark, E.art_score("v"), v=line) == score
