"""Native column expressions shared by all operators. None of them needs a Python UDF.

Null and blank are one value on input; expressions return blank text, never null,
unless stated. Patterns use Java syntax with Unicode classes switched on.
"""

from __future__ import annotations

import html.entities
import json
import unicodedata
from functools import cache, reduce

from pyspark.sql import Column, functions as F

#: Accented letters and what they fold to in matching.
ACCENTS = "áâäéêëíóúû"
ACCENTS_TO = "aaaeeeiouu"
#: Letters of page slugs that are spelled out, or stand for another without being made of it.
SLUG_SPELLED = [("æ", "ae"), ("œ", "oe"), ("þ", "th"), ("ß", "ss")]
SLUG_SINGLE = {"ø": "o", "ı": "i", "ð": "d"}
#: Base letters whose accented forms page slugs fold, and two forms that they leave alone.
SLUG_BASES, SLUG_LEFT = "aceinosuyz", "ĩũ"


def slug_letters() -> dict[str, str]:
    """Accented small letters of the Latin-1 and Latin Extended-A blocks and what they fold to."""
    parts = {c: unicodedata.normalize("NFD", c) for c in map(chr, range(0xE0, 0x180)) if c.islower() and c not in SLUG_LEFT}
    return {c: d[0] for c, d in parts.items() if len(d) == 2 and d[0] in SLUG_BASES} | SLUG_SINGLE
#: Character entities that ``html_to_text`` knows.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}
#: Forms of lines that are never art (prompts and figures), and words whose lines are none (of the domain the score comes from; an argument).
NO_ART = [r"^!?#?\s*[A-Z]{0,4}\s*>$", r"^[\d\s/]+(\([^)]+\))?$"]
NO_ART_WORDS = ["pkills", "pkdeaths", "mobdeaths", "deaths", "warpoints", "login", "retired", "level"]
#: Characters with Unicode's White_Space property.
WHITE = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
CHECKED = ["yes", "true", "1", "checked", "done"]
CONFIDENCE_RANKS = {"low": 1, "medium": 2, "high": 3}


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c) -> Column:
    """B1: null to blank; all kinds of white space stripped from both ends."""
    return F.btrim(F.coalesce(col(c).cast("string"), F.lit("")), F.lit(WHITE))


def blank_to_null(c) -> Column:
    value = clean(c)
    return F.when(value != "", value)


def fold(c) -> Column:
    """Lower case with sharp s spelled out."""
    return F.replace(F.lower(clean(c)), F.lit("ß"), F.lit("ss"))


def lower_key(c) -> Column:
    """Lower case alone, for names that are compared letter by letter: sharp s is not two letters s."""
    return F.lower(clean(c))


def alnum_key(c) -> Column:
    """B2: only the letters a to z and digits of the folded value."""
    return F.regexp_replace(fold(c), "[^a-z0-9]", "")


def norm(c) -> Column:
    """Folded, accents folded, runs of white space to one blank."""
    return F.regexp_replace(F.translate(fold(c), ACCENTS, ACCENTS_TO), r"(?U)\s+", " ")


def _or_unknown(c: Column) -> Column:
    return F.when(c == "", F.lit("unknown")).otherwise(c)


def id_slug(c) -> Column:
    """Blanks and hyphens to one underscore, other symbols dropped, letters of any script kept."""
    spaced = F.regexp_replace(F.lower(clean(c)), r"(?U)[\s-]+", "_")
    return _or_unknown(F.btrim(F.regexp_replace(spaced, r"(?U)[^\w]", ""), F.lit("_")))


def page_slug(c) -> Column:
    """Ligatures spelled out, Latin accents folded, runs of anything else to a hyphen."""
    spelled = reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), SLUG_SPELLED, F.lower(clean(c)))
    letters = slug_letters()
    return _or_unknown(F.btrim(F.regexp_replace(F.translate(spelled, "".join(letters), "".join(letters.values())), "[^a-z0-9]+", "-"), F.lit("-")))


def strip_ansi(c) -> Column:
    """Terminal escape sequences removed."""
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), "\\x1b\\[[0-9;]*[A-Za-z]", "")


@cache
def _named_references() -> str:
    """The named character references of HTML by their first letter, as JSON; from Python's own list of them."""
    out: dict[str, dict[str, str]] = {}
    for name, value in html.entities.html5.items():
        out.setdefault(name[0], {})[name] = value
    return json.dumps(out)


@cache
def _bare_names(closed: tuple[str, ...] = ()) -> str:
    """Pattern of the names that need no semicolon, the longest first, without those in ``closed``."""
    return "^(" + "|".join(sorted((n for n in html.entities.html5 if not n.endswith(";") and n not in closed), key=lambda n: (-len(n), n))) + ")"


def _one_byte() -> dict[int, str]:
    """References to control characters that stand for letters of the old Windows code page, and two others."""
    old = {}
    for k in range(0x80, 0xA0):
        try:
            old[k] = bytes([k]).decode("cp1252")
        except UnicodeDecodeError:  # no letter there
            old[k] = chr(k)
    return {0x00: "\ufffd", 0x0D: "\r"} | old


def _code_point(n: Column) -> Column:
    """The character of a number; null stands for one of too many digits."""
    n = F.coalesce(n, F.lit(0x110000).cast("long"))
    old = F.get(F.array(*[F.lit(c) for c in _one_byte().values()]), (n - 0x80 + 2).cast("int"))
    none = ((n < 0x20) & ~n.isin(9, 10, 12)) | (n == 0x7F) | n.between(0xFDD0, 0xFDEF) | (n % 0x10000 >= 0xFFFE)
    return (
        F.when((n > 0x10FFFF) | n.between(0xD800, 0xDFFF) | (n == 0), F.lit("\ufffd")).when(n == 0x0D, F.lit("\r")).when(n.between(0x80, 0x9F), old)
        .when(none, F.lit("")).otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
    )


def _look_up(name: Column) -> Column:
    return F.element_at(F.element_at(F.from_json(F.lit(_named_references()), "map<string,map<string,string>>"), F.left(name, F.lit(1))), name)


def _reference(s: Column, closed: tuple[str, ...] = ()) -> Column:
    """A piece after an ampersand, with the reference that it begins with (if any) decoded."""
    piece, number, name, known = s["piece"], s["number"], s["name"], s["known"]
    hexa = F.regexp_extract(number, r"^#[xX]0*([0-9a-fA-F]+)", 1)
    value = F.when(hexa == "", F.regexp_extract(number, "^#0*([0-9]+)", 1).try_cast("long")).when(F.length(hexa) <= 8, F.conv(hexa, 16, 10).cast("long"))
    prefix = F.regexp_extract(name, _bare_names(closed), 1)
    rest = lambda used: F.substring(piece, F.length(used) + 1, F.length(piece))
    return (
        F.when(known.isNotNull(), F.concat(known, rest(name))).when(number != "", F.concat(_code_point(value), rest(number)))
        .when((name != "") & (prefix != ""), F.concat(_look_up(prefix), rest(prefix))).otherwise(F.concat(F.lit("&"), piece))
    )


#: Names by which markup itself is escaped.
MARKUP_NAMES = ("amp", "lt", "gt", "quot", "AMP", "LT", "GT", "QUOT")


def unescape_html(c, closed: tuple[str, ...] = ()) -> Column:
    """Character references (by name, number or hexadecimal number) decoded once, as HTML defines them, also those without a semicolon.

    Names in ``closed`` need their semicolon: in text that was escaped and then
    cut, an escape may have lost its end.
    """
    text = F.coalesce(col(c), F.lit(""))
    pieces = F.split(text, "&")
    numeric = lambda p: F.startswith(p, F.lit("#"))
    # step by step, so that no pattern is matched twice
    read = F.transform(
        F.slice(pieces, F.lit(2), F.size(pieces)),
        lambda p: F.struct(
            p.alias("piece"), F.when(numeric(p), F.regexp_extract(p, r"^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", 0)).otherwise(F.lit("")).alias("number"),
            F.when(numeric(p), F.lit("")).otherwise(F.regexp_extract(p, "^[^\t\n\f <&#;]{1,32};?", 0)).alias("name"),
        ),
    )
    read = F.transform(read, lambda s: F.struct(s["piece"].alias("piece"), s["number"].alias("number"), s["name"].alias("name"), F.when((s["name"] != "") & ~s["name"].isin(*closed), _look_up(s["name"])).alias("known")))
    decoded = F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(read, lambda s: _reference(s, closed)), ""))
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def html_to_text(c, paragraphs: bool = True, closed: tuple[str, ...] = ()) -> Column:
    """Character references decoded (``closed`` as in ``unescape_html``), then line breaks (and paragraph ends) to newlines and tags dropped, so escaped tags go as well."""
    broken = F.regexp_replace(unescape_html(c, closed), r"(?i)<br\s*/?>" + (r"|</p\s*>" if paragraphs else ""), "\n")
    return F.regexp_replace(broken, r"<[^>]+>", "")


def first_nonblank(*columns) -> Column:
    """The first column that is not blank, cleaned; blank if none is."""
    return F.coalesce(*[blank_to_null(c) for c in columns], F.lit(""))


#: Elements removed with their content, elements removed alone, and the ways to write the one background that goes.
BLOCKED, BLOCKED_VOID = ["script", "iframe", "object"], ["embed"]
BLACK = [r"rgb\(\s*0\s*,\s*0\s*,\s*0\s*\)", "#(?:000000ff|000000|000)(?![0-9a-f])", "black"]


def sanitise_html(c, blocked=BLOCKED, void=BLOCKED_VOID, colours=BLACK) -> Column:
    """Active content and event handlers removed; of backgrounds only black ones; style attributes tidied."""
    html = F.coalesce(col(c), F.lit(""))
    for pattern in (rf"(?is)<({'|'.join(blocked)})\b.*?</\1>", *(rf"(?is)<{e}\b.*?>" for e in void)):
        html = F.regexp_replace(html, pattern, "")
    value = r"(?:'[^']*'|\"[^\"]*\"|[^\s>]+)"
    html = F.regexp_replace(html, rf"(?i)\s+on[a-z]+\s*=\s*{value}", "")
    html = F.regexp_replace(html, "(?i)javascript:", "")
    html = F.regexp_replace(html, rf"(?i)background(?:-color)?\s*:\s*(?:{'|'.join(colours)})\s*;?", "")
    html = F.regexp_replace(html, r"style=(['\"])\s*;?\s*\1", "")  # nothing left in it
    return F.regexp_replace(F.regexp_replace(html, r"style=(['\"])\s+", "style=$1"), r";\s*(['\"])", "$1")


def normalise_text(c) -> Column:
    """One kind of line end, blanks and tabs squeezed, lines right-trimmed, outer empty lines dropped."""
    text = F.regexp_replace(F.coalesce(col(c), F.lit("")), "\r\n?", "\n")
    text = F.regexp_replace(text, "[ \t]+", " ")
    text = F.regexp_replace(text, r"(?U)[^\S\n]+(?=\n|\z)", "")
    return F.regexp_replace(text, r"^\n+|\n+\z", "")


def mask(c, pattern: str, placeholder: str) -> Column:
    """Volatile spans replaced; the pattern's dot also takes line ends, case is ignored."""
    return F.regexp_replace(col(c), "(?is)" + pattern, placeholder)


def first_line(c, normalised: bool = False) -> Column:
    """The first line that is not blank, stripped; of a text that ``normalise_text`` gave, if so stated."""
    # the first character that is no white space, and the rest of its line
    return clean(F.regexp_extract(col(c) if normalised else normalise_text(c), r"(?U)^\s*(\S[^\n]*)", 1))


_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"


def trim_name(c) -> Column:
    """Leading non-letters and trailing characters other than letters, apostrophes and hyphens removed."""
    return F.regexp_replace(F.regexp_replace(clean(c), f"^[^{_LETTER}]+", ""), f"[^{_LETTER}'’-]+$", "")


def is_name_like(c, stop_words=()) -> Column:
    """2 to 24 characters, a capital first, no stop word, not all capitals when longer than 3."""
    name = trim_name(c)
    size = F.length(name)
    ok = (size >= 2) & (size <= 24) & name.rlike(f"^[A-ZÀ-ÖØ-Þ][{_LETTER}'’-]*$") & ~((size > 3) & (F.upper(name) == name))
    return ok & ~name.isin(*stop_words) if stop_words else ok


def split_names(c, stop_words=()) -> Column:
    """Names of a list line: a trailing `` - comment`` goes; parted by commas or semicolons, else by blanks."""
    text = F.regexp_replace(clean(c), r"(?U)\s+[–—-]\s+.*$", "")
    parts = F.when(text.rlike("[,;]"), F.split(text, "[,;]")).otherwise(F.split(text, r"(?U)\s+"))
    return F.filter(F.transform(parts, trim_name), lambda x: is_name_like(x, stop_words))


#: Fixed value: what marks that text goes on before or after an excerpt.
MORE = "…"


def squeezed(text) -> Column:
    """A text as excerpts are cut from it: lines stay; of three or more line ends in a row two are left."""
    return clean(F.regexp_replace(F.coalesce(col(text), F.lit("")), "\n{3,}", "\n\n"))


def excerpt_of(flat, needle, around: int = 350, most: int = 900) -> Column:
    """``excerpt`` of a text that ``squeezed`` gave."""
    flat, part = col(flat), F.coalesce(col(needle), F.lit(""))
    at = F.when(part != "", F.instr(flat, part)).otherwise(F.lit(0))
    begin = F.greatest(at - 1 - around, F.lit(0))
    end = F.least(at - 1 + F.length(part) + around, F.length(flat))
    hit = F.concat(F.when(begin > 0, F.lit(MORE + "\n")).otherwise(F.lit("")), clean(F.substring(flat, begin + 1, end - begin)), F.when(end < F.length(flat), F.lit("\n" + MORE)).otherwise(F.lit("")))
    return F.substring(F.when(at > 0, hit).otherwise(flat), 1, most)


def excerpt(text, needle, around: int = 350, most: int = 900) -> Column:
    """Text around the first hit of the needle, taken as it is, with marks on lines of their own where text goes on; without a hit or needle the head."""
    return excerpt_of(squeezed(text), needle, around, most)


def descriptor(first, second) -> Column:
    """Both values with a blank between; an equal second one is not repeated."""
    a, b = clean(first), clean(second)
    return F.btrim(F.concat_ws(" ", F.when(a != "", a), F.when((b != "") & (b != a), b)))


def merge_note(old, new, separator: str = " | ") -> Column:
    """``new`` appended unless it is blank or contained in ``old``."""
    a, b = clean(old), clean(new)
    return F.when((b == "") | F.contains(a, b), a).when(a == "", b).otherwise(F.concat(a, F.lit(separator), b))


def is_checked(c, values=CHECKED) -> Column:
    """Whether a flag says checked."""
    return fold(c).isin(*values)


def iso_date(c) -> Column:
    """A date written YYYY-MM-DD, else null."""
    value = clean(c)
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), value.try_cast("date"))


def multi_ids(c) -> Column:
    """Ids parted by semicolons, blanks dropped."""
    return F.filter(F.transform(F.split(clean(c), ";"), clean), lambda x: x != "")


def rank_of(c, ranks: dict[str, int]) -> Column:
    """Rank of a folded value, 0 if unknown."""
    value = fold(c)
    return reduce(lambda e, r: e.when(value == r[0], r[1]), list(ranks.items())[1:], F.when(value == next(iter(ranks)), next(iter(ranks.values())))).otherwise(0)


def label(c, placeholder: str = "(blank)") -> Column:
    """A placeholder for blanks."""
    return F.coalesce(blank_to_null(c), F.lit(placeholder))


def unknown_to_blank(c, unknown: str = "unknown") -> Column:
    """The value that stands for unknown becomes blank."""
    return F.when(fold(c) == unknown, F.lit("")).otherwise(clean(c))


def array_has_word(text: Column, word: str) -> Column:
    return text.rlike(r"(?iuU)(?<!\w)\Q" + word + r"\E(?!\w)")


def remove_word(text, term) -> Column:
    """every whole-word hit of a term (literal, case ignored) removed, blanks squeezed."""
    t = clean(term)
    pattern = F.concat(F.lit(r"(?iuU)(?<!\w)\Q"), t, F.lit(r"\E(?!\w)"))
    bare = F.when(t == "", clean(text)).otherwise(F.regexp_replace(clean(text), pattern, F.lit(" ")))
    return clean(F.regexp_replace(bare, r"(?U)\s+", " "))


#: Characters that art is drawn with, and the shares (in percent), lengths and points of the score.
ART_MARKS = "/\\|_-+=*#~`'.:;^<>[]{}()"
MANY_MARKS, SOME_MARKS, FEW_LETTERS, WIDE = 55, 40, 35, 35
LONG_BODY, LONG_LINE, SHORT_BODY = 8, 12, 5
#: A mark three times in a row, and strokes with marks between them.
RUN, STROKES = r"([_/\\|*#=~.\-])\1{2,}", r"[/\\][ _./\\|'\-]{3,}[/\\|]"


def art_score(c, words: list[str] = NO_ART_WORDS) -> Column:
    """How much a line looks like character art, 0 to 5.5 in halves; lines with one of ``words`` are none."""
    line = F.coalesce(col(c), F.lit(""))
    body = clean(line)
    left = lambda x, pattern: F.length(x) - F.length(F.regexp_replace(x, pattern, ""))
    letters, marks = left(body, r"\p{L}"), F.length(body) - F.length(F.translate(body, ART_MARKS, ""))
    solid, spaces = left(body, r"(?U)\S"), left(line, r"(?U)\s")
    # share >= k / 100 without division
    at_least = lambda n, whole, pct: n * 100 >= whole * pct
    when = lambda cond, points: F.when(cond, F.lit(points)).otherwise(F.lit(0.0))
    score = (
        F.when(at_least(marks, solid, MANY_MARKS), 2.0).when(at_least(marks, solid, SOME_MARKS), 1.0).otherwise(0.0)
        + when((letters * 100 <= solid * FEW_LETTERS) & (F.length(body) >= LONG_BODY), 1.0)
        + when(body.rlike(RUN), 1.0)
        + when(at_least(spaces, F.greatest(F.length(line), F.lit(1)), WIDE) & (F.length(line) >= LONG_LINE), 0.5)
        + when(body.rlike(STROKES), 1.0)
        - when(F.length(body) <= SHORT_BODY, 1.0)
    )
    never = reduce(lambda e, p: e | body.rlike(p), [*NO_ART, *([rf"(?i)\b({'|'.join(words)})\b"] if words else [])], body == "")
    return F.when(never, 0.0).otherwise(F.greatest(score, F.lit(0.0)))
