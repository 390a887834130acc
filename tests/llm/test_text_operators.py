"""Toxicity, substring dedup, language model, Jaccard join against brute force, and their odd inputs."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from recordloom.llm import chunks, minhash, pitman_yor, registry, toxicity
from recordloom.llm.components import connected_components
from recordloom.llm.textbatch import utf8, word_bounds, word_hashes


@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=8))
@settings(max_examples=60, deadline=None)
def test_words_and_hashes(texts):
    data, ends = utf8(pa.array(texts, pa.string()))
    start, stop, at = word_bounds(data, ends)
    words = [w for t in texts for w in (t or "").encode().lower().split()]
    assert [bytes(data[a:b]).lower() for a, b in zip(start, stop)] == words
    assert np.diff(at).tolist() == [len((t or "").encode().split()) for t in texts]
    of = collections.defaultdict(set)
    for w, h in zip(words, word_hashes(data, start, stop).tolist()):
        of[w].add(h)
    assert all(len(v) == 1 for v in of.values()) and len({min(v) for v in of.values()}) == len(of)


# ---- toxicity
def test_toxicity_learns_and_generalises(spark):
    r = random.Random(5)
    vocabulary = ["".join(r.choice(["an", "er", "th", "ou", "in", "st"]) for _ in range(r.randint(1, 4))) for _ in range(300)]
    bad = ["grumpf", "blorkan", "zwick"]
    docs, labels = [], []
    for i in range(900):
        words = [r.choice(vocabulary) for _ in range(r.randint(5, 60))]
        toxic = i % 5 == 0
        for _ in range(3 if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(bad) + r.choice(["", "er", "in"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs += [(2000, None), (2001, ""), (2002, "th " * 30000)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    l = spark.createDataFrame(labels + [(0, None), (None, 1)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.score_toxicity(d, l).collect()}
    assert len(got) == len(docs) and all(0 <= x.score <= 1 for x in got.values())
    assert got[2000].score == got[2001].score < 0.7 and got[2002].predicted == 0
    held = [(got[i].predicted, y) for i, y in labels if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _ in docs)
    assert sum(p == y for p, y in held) / len(held) > 0.95
    none = toxicity.score_toxicity(d.filter("doc_id < 3"), l.filter("toxic = 0")).collect()
    assert [x.score for x in none] == [0.0] * 3


def test_toxicity_odd(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(8)], "doc_id long, toxic int, text string")
    got = toxicity.score_toxicity(odd.withColumnRenamed("kept", "toxic"), labels).collect()
    assert len(got) == 9 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    assert len({r.score for r in got if r.doc_id == 1}) == 1 and len({r.score for r in got if r.doc_id in (2, 3, 5)}) == 1
    assert toxicity.score_toxicity(none, labels).count() == 0
    assert {r.score for r in toxicity.score_toxicity(odd, labels.limit(0)).collect()} == {0.0}


def test_expressions_of_ordinary_words_are_learned(spark):
    """Two words that are harmless apart and toxic side by side."""
    r = random.Random(9)
    docs, labels = [], []
    for i in range(1500):
        w = [r.choice("abcdefgh") * r.randint(1, 3) for _ in range(40)]
        for _ in range(2):
            w.insert(r.randrange(len(w)), "pack it" if i % 3 == 0 else r.choice(["it was", "a pack"]))
        docs.append((i, " ".join(w)))
        labels.append((i, int(i % 3 == 0)))
    got = toxicity.score_toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    truth = dict(labels)
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.9


def plain_ratio(words, before, docs):
    """Log-likelihood ratio of one word after another, from the counts of (words, class) texts."""
    pairs = {k: collections.Counter() for k in (True, False)}
    for text, toxic in docs:
        pairs[toxic].update(zip(["^", *text], text))
    both = set(pairs[True]) | set(pairs[False])
    kinds = {k: collections.Counter(w for _, w in p) for k, p in {**pairs, None: both}.items()}

    def disc(c):
        n = collections.Counter(c.values())
        return min(2.9, max(0.5, 3 - 4 * n[1] / (n[1] + 2 * n[2]) * n[4] / n[3])) if n[1] and n[2] and n[3] else 1.0

    left = lambda c, d: c if c < toxicity.LEAST_COUNT else min(c, d)
    whole = sum(kinds[None].values())
    shared = (kinds[None][words] - min(kinds[None][words], 0.75)) / whole + sum(min(c, 0.75) for c in kinds[None].values()) / whole / len(kinds[None])
    out = []
    for k in (True, False):
        n, d = sum(kinds[k].values()), disc(kinds[k])
        p = (kinds[k][words] - left(kinds[k][words], d)) / n + sum(left(c, d) for c in kinds[k].values()) / n * shared
        d = disc(pairs[k])
        after = {w: c for (v, w), c in pairs[k].items() if v == before}
        rest = sum(left(c, d) for c in after.values()) / sum(after.values()) if after else 1.0
        c = after.get(words, 0)
        out.append(((c - left(c, d)) / sum(after.values()) if after else 0) + rest * p)
    return math.log(out[0] / out[1])


def test_ratios_against_plain_counts(spark):
    r = random.Random(12)
    docs = [([r.choice("abcdefghijklmnopqrstuvwxyz"[: 8 + 14 * (i % 2)]) for _ in range(r.randint(1, 30))], i % 2 == 0) for i in range(200)]
    from recordloom.sources.scratch import Scratch

    models = toxicity.count_models(spark.createDataFrame([(" ".join(w), int(t)) for w, t in docs], "text string, toxic int"), Scratch(spark, "t"))
    data, ends = utf8(pa.array(["a b c v t a", "q", "t never u"]))
    start, stop, at = word_bounds(data, ends)
    got = models.ratios(word_hashes(data, start, stop), at)[1]
    want = [plain_ratio(w, v, docs) for t in ("abcvta", "q") for v, w in zip("^" + t, t)]
    assert got[:7].tolist() == pytest.approx(want, abs=1e-9) and got[8] == 0


# ---- substring dedup
def test_chunks_resist_insertions():
    r = random.Random(3)
    text = "".join(r.choice("abcdefgh ijklm nop") for _ in range(6000))

    def cut(t):
        c = chunks.chunk_starts(*utf8(pa.array([t])))[0]
        return {t.encode()[x:y] for x, y in zip(c, [*c[1:], len(t.encode())])}

    a, b = cut(text), cut(text[:2000] + "INSERTED" + text[2000:])
    assert len(a - b) <= 4 and len(a) > 80
    for odd in ["é" * 3000, "a" * 5000, "x", "日本語" * 900]:
        starts, _ = chunks.chunk_starts(*utf8(pa.array([odd, None, odd])))
        body = (odd * 2).encode()
        assert all(body[i] & 0xC0 != 0x80 for i in starts) and max(np.diff([*starts, len(body)])) <= chunks.MOST + 4


def brute_repeats(docs, words=51):
    seen = collections.defaultdict(set)
    for i, t in docs:
        w = (t or "").split()
        for k in range(len(w) - words + 1):
            seen[tuple(w[k : k + words])].add(i)
    return {i for s in seen.values() if len(s) > 1 for i in s - {min(s)}}


def brute_runs(docs, words=51):
    """Character ranges of passages of so many words or more that an earlier document holds, each in one of them."""
    first, out = {}, collections.defaultdict(list)
    for i, t in sorted(docs):
        at = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")]
        grams = [t[at[k][0] : at[k + words - 1][1]] for k in range(len(at) - words + 1)]
        for k, g in enumerate(grams):
            if g in first and first[g] != i:
                a, b = at[k][0], at[k + words - 1][1]
                if out[i] and out[i][-1][1] >= a:
                    out[i][-1] = (out[i][-1][0], b)
                else:
                    out[i].append((a, b))
        for g in grams:
            first.setdefault(g, i)
    return out


def test_span_through_a_chunk_seen_earlier(spark):
    """A passage whose middle another document has as well is one span, held by the document that has all of it."""
    r = random.Random(6)
    words = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(n))
    left, middle, right = words(60), words(40), words(60)
    docs = [(1, f"{words(30)} {middle} {words(30)}"), (2, f"{words(20)} {left} {middle} {right} {words(20)}"), (3, f"{left} {middle} {right}"), (4, f"{words(9)} {left} {words(9)} {right}")]
    text = dict(docs)
    spans = chunks.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    for s in spans:
        assert text[s.first_doc_id][s.first_start : s.first_start + s.n_chars] == text[s.doc_id][s.start : s.start + s.n_chars]
    (third,) = [s for s in spans if s.doc_id == 3]
    assert third.first_doc_id == 2 and third.n_chars > len(text[3]) - 300
    assert {s.first_doc_id for s in spans if s.doc_id == 2} == {1} and len([s for s in spans if s.doc_id == 4]) == 2


def test_repeated_passages_found_and_removed(spark, real):
    docs = [(r.doc_id, r.text) for r in real]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    spans = chunks.repeated_spans(df).collect()
    text = dict(docs)
    assert brute_repeats(docs) <= {s.doc_id for s in spans}
    for s in spans:  # each span as a whole stands in the one earlier place that it names
        assert s.n_chars >= chunks.LEAST_SPAN and (s.first_doc_id, s.first_start) < (s.doc_id, s.start)
        body = text[s.doc_id][s.start : s.start + s.n_chars]
        assert len(body) == s.n_chars and text[s.first_doc_id][s.first_start : s.first_start + s.n_chars] == body
    covered = collections.defaultdict(set)
    for s in spans:
        covered[s.doc_id].update(range(s.start, s.start + s.n_chars))
    for i, runs in brute_runs(docs).items():
        for a, b in runs:  # all of a repeated passage but its edges, where chunks reach beyond it
            assert all(c in covered[i] for c in range(a + 2 * chunks.MOST, b - 2 * chunks.MOST))
            assert sum(c in covered[i] for c in range(a, b)) >= 0.5 * (b - a)
    left = {r.doc_id: r.text for r in chunks.without_repeats(df).collect()}
    gone = collections.Counter()
    for s in spans:
        gone[s.doc_id] += s.n_chars
    for i, t in docs:
        assert (len(t) - gone[i] == len(left[i])) if i in left else gone[i] > 0
        assert i in gone or left[i] == t


def test_dedup_odd(spark, odd, none):
    spans = chunks.repeated_spans(odd).collect()
    assert {(s.doc_id, s.first_doc_id) for s in spans} >= {(7, 4)}
    assert all(s.doc_id not in (1, 2, 3, None) for s in spans)
    left = chunks.without_repeats(odd)
    assert left.columns == odd.columns
    ids = sorted((r.doc_id or 0) for r in left.collect())
    assert ids == [0, 1, 1, 2, 3, 4, 5, 6] or ids == [0, 1, 1, 2, 3, 4, 5, 6, 7]
    assert chunks.repeated_spans(none).count() == 0 and chunks.without_repeats(none).count() == 0


# ---- language model
def test_language_model(spark, real):
    docs = [(r.doc_id, r.text) for r in real]
    got = {r.doc_id: r for r in pitman_yor.score_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    tokens = {i: [*t.encode().lower().split(), None] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs}
    c = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    total = {True: [0, 0, 0], False: [0, 0, 0]}
    for i, ws in tokens.items():
        r = got[i]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        for k, x in enumerate((len(ws), base, r.score)):
            total[held[i]][k] += x
    assert total[True][2] > total[True][1]  # better than the base on held-out texts


def test_probabilities_sum_to_one():
    """Over all words of a context, seen and one unseen, the predictive distribution is proper."""
    r = np.random.default_rng(1)
    c = r.integers(0, 5, (40, 3)) * r.integers(0, 40, (40, 3))
    word, ctx = np.nonzero(c)
    pairs = {"word": np.searchsorted(np.unique(word), word), "ctx": ctx, "c": c[word, ctx]}
    tables, parent = pitman_yor.first_seating(pairs)
    whole = pitman_yor.totals_of(pairs, tables, parent, 3)
    *_, (tables, parent) = pitman_yor.sweeps(pairs, whole, 4, [9])
    own = pitman_yor.totals_of(pairs, tables, parent, 3)  # totals of exactly this seating
    everywhere = {"word": np.repeat(np.arange(own.words + 1).astype(int), 3), "ctx": np.tile(np.arange(3), int(own.words) + 1)}  # and one unseen word
    full = {(w, u): (n, t) for w, u, n, t in zip(pairs["word"], pairs["ctx"], pairs["c"], tables)}
    n, t = np.array([full.get(k, (0, 0)) for k in zip(everywhere["word"], everywhere["ctx"])], float).T
    p = pitman_yor.predictive(everywhere | {"c": n}, t, np.append(parent, 0), whole.discounts(), own)
    for u in range(3):
        assert p[everywhere["ctx"] == u].sum() == pytest.approx(1)
    assert (tables[pairs["c"] > 0] >= 1).all() and (tables <= pairs["c"]).all()


def every_seating(c):
    """All ways to seat c customers, as sizes of tables in order of opening, with how often each arises."""
    out = collections.Counter({(1,): 1})
    for _ in range(c - 1):
        new = collections.Counter()
        for sizes, n in out.items():
            new[(*sizes, 1)] += n
            for k in range(len(sizes)):
                new[(*sizes[:k], sizes[k] + 1, *sizes[k + 1 :])] += n
        out = new
    return out


def test_seatings_follow_their_conditional_distribution():
    """Tables of one dish, drawn given a restaurant with others, against the sum over every seating of its customers."""
    d, theta, others, p = 0.6, pitman_yor.STRENGTH, 7, 0.2
    rng = np.random.default_rng(4)
    for c in (2, 4, 7):
        want = np.zeros(c + 1)
        for sizes, n in every_seating(c).items():
            # each table opens with its weight; its later customers come with their number less the discount
            w = math.prod((theta + d * (others + k)) * p for k in range(len(sizes)))
            want[len(sizes)] += n * w * math.prod(j - d for size in sizes for j in range(1, size))
        want /= want.sum()
        got = pitman_yor.reseat(np.full(60_000, c), lambda i, k: np.log((theta + d * (others + k)) * p), d, rng)
        assert np.abs(np.bincount(got.astype(int), minlength=c + 1) / len(got) - want).max() < 0.01


@pytest.mark.parametrize("c, p", [(12, 0.05), (60, 0.01), (60, 0.3)])
def test_draws_against_moving_single_customers(c, p):
    """The one draw against Gibbs sampling that removes one customer at a time and seats it anew."""
    d, theta, others, r = 0.7, pitman_yor.STRENGTH, 20, random.Random(c)
    weight = lambda k: (theta + d * (others + k)) * p
    seats, total, steps = [1] * c, 0, 500_000
    for step in range(-5000, steps):  # the first ones leave the beginning behind
        k = r.choices(range(len(seats)), seats)[0]
        seats[k] -= 1
        seats = [n for n in seats if n]
        k = r.choices(range(len(seats) + 1), [n - d for n in seats] + [weight(len(seats))])[0]
        seats = [*seats, 1] if k == len(seats) else [n + (i == k) for i, n in enumerate(seats)]
        total += len(seats) * (step >= 0)
    got = pitman_yor.reseat(np.full(20_000, c), lambda i, k: np.log(weight(k)), d, np.random.default_rng(1))
    assert got.mean() == pytest.approx(total / steps, rel=0.03)


def test_seatings_beyond_the_table(monkeypatch):
    """Dishes of more customers than the table of seatings holds: their numbers, draws and sweeps follow the same distribution."""
    rng = np.random.default_rng(3)
    for c, d in ((1500, 0.05), (1500, 0.65), (2100, 0.95)):
        row, t = np.append(0.0, np.full(c, -np.inf)), np.arange(c + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            for n in range(c):
                row = np.logaddexp(row + np.log(np.maximum(n - d * t, 0)), np.append(-np.inf, row[:-1]))
        got = pitman_yor.log_range(c, 1, c, d) + math.lgamma(c + 1)
        assert np.abs(got - row[1:]).max() < 1e-7
        assert np.array_equal(pitman_yor.log_range(c, 300, 420, d), pitman_yor.log_range(c, 1, c, d)[299:420])
        for room, others in ((3e4, 50), (1e6, 9e4), (10, 0)):  # some tables, nearly as many as customers, hardly more than one

            def weights(i, k, room=room, others=others, d=d):
                return np.log((room + d * k) * (others + k + 1e-6) / 2e5)

            want = row[1:] + np.cumsum(weights(0, np.arange(c)))
            want = np.exp(want - want.max())
            drawn = pitman_yor.reseat(np.full(3000, c), weights, d, rng).astype(int)
            share = np.cumsum(np.bincount(drawn, minlength=c + 1)[1:]) / len(drawn)
            assert np.abs(share - np.cumsum(want) / want.sum()).max() < 0.04

    # whole sweeps: by the table, and with all dishes and parent's dishes beyond it
    word, ctx = np.divmod(np.arange(1200), 3)
    pairs = {"word": word, "ctx": ctx, "c": np.full(1200, 900)}
    whole = pitman_yor.Totals(3)
    whole.t += 40_000
    whole.words, whole.parent_tables, whole.once = 400.0, 500.0, np.array([60.0, 20, 60, 20])
    tables = []
    for most in (1024, 800):
        monkeypatch.setattr(pitman_yor, "MOST_EXACT", most)
        tables.append(np.mean([[seated for seated, _ in pitman_yor.sweeps(pairs, whole, 2, [seed, most])][-1] for seed in range(8)]))
    assert tables[0] == pytest.approx(tables[1], rel=0.05)


@pytest.mark.parametrize("fan", [3, 1024])
def test_hot_words_and_many_parts_change_nothing(spark, monkeypatch, fan):
    """Base scores and known tokens, which are exact, with split parts and tokens dealt in two steps; rows in any order."""
    monkeypatch.setattr(pitman_yor, "PART_TOKENS", 500)
    monkeypatch.setattr(pitman_yor, "SHARE", 0.2)  # so that words of up to a fifth of all tokens are dealt
    monkeypatch.setattr(pitman_yor, "FAN", fan)
    monkeypatch.setattr(pitman_yor, "LOT_TOKENS", 2000)
    r = random.Random(2)
    docs = [(i, " ".join(r.choice(["hot", "warm"] + [f"w{r.randrange(900)}" for _ in range(8)]) for _ in range(40))) for i in range(500)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    held = df.withColumn("held", F.lit(False))
    _, n, parts, subs = pitman_yor.survey(held)
    assert subs and parts > 30 and n == sum(len(t.split()) + 1 for _, t in docs)
    a, b = ({x.doc_id: x for x in pitman_yor.score_documents(d).collect()} for d in (df.repartition(2), df.repartition(9)))
    tokens = {i: [*t.split(), None] for i, t in docs}
    c = collections.Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert a[i].base_score == pytest.approx(base, rel=1e-9) and a[i].n_known == b[i].n_known == sum(c[w] > 0 for w in ws)
        assert a[i].base_score == pytest.approx(b[i].base_score) and a[i].score == pytest.approx(b[i].score, rel=0.02)


def test_perplexity(spark, real):
    scored = pitman_yor.score_documents(spark.createDataFrame([(r.doc_id, r.text) for r in real], "doc_id long, text string"))
    rows = scored.collect()
    for r in pitman_yor.perplexity(scored).collect():
        some = [x for x in rows if x.held_out == r.held_out]
        n = sum(x.n_tokens for x in some)
        assert r.score_perplexity == pytest.approx(10 ** (-sum(x.score for x in some) / n)) and r.base_score_perplexity == pytest.approx(10 ** (-sum(x.base_score for x in some) / n))
        assert r.score_perplexity < r.base_score_perplexity


def test_scores_sum_to_one(spark, monkeypatch):
    """Scores of short held-out texts give the probabilities of all words after the beginning and after the one frequent word."""
    monkeypatch.setattr(pitman_yor, "PART_TOKENS", 4000)  # several parts
    monkeypatch.setattr(pitman_yor, "SHARE", 0.05)
    r = np.random.default_rng(7)
    words = [f"w{k}" for k in range(400)]
    share = 1 / np.arange(8, 408)
    texts = [" ".join(r.choice(words, p=share / share.sum(), size=30)) for _ in range(600)]
    texts = [t[: len(t) // 2] + " the " + t[len(t) // 2 :] + " the" for t in texts]
    texts = [" the ".join(t.split()[k] for k in range(20)) if i % 3 == 0 else t for i, t in enumerate(texts)]
    held = (k for k in range(10**6, 10**7) if zlib.crc32(str(k).encode()) % 10 == 0)
    train = [k for k in range(2000) if zlib.crc32(str(k).encode()) % 10][: len(texts)]
    seen = sorted({w for t in texts for w in t.split()} - {"the"})
    asked = ["", "the", "the the", "never", "the never", *seen, *(f"the {w}" for w in seen)]
    ids = dict(zip(asked, held))
    rows = [*zip(train, texts), *((i, t) for t, i in ids.items())]
    score = {x.doc_id: x.score for x in pitman_yor.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    p = {t: 10 ** score[i] for t, i in ids.items()}
    end = p[""]
    after_begin = sum(p[w] / end for w in [*seen, "never"]) + end  # all but "the"
    after_the = sum(p[f"the {w}"] / p["the"] for w in [*seen, "the", "never"])  # all but the end
    assert 0 < after_begin < 1 and 0 < after_the < 1
    assert (1 - after_begin) * (1 - after_the) == pytest.approx(p["the"], rel=1e-3)


def test_language_model_odd(spark, odd, none):
    got = pitman_yor.score_documents(odd).collect()
    assert len(got) == 9 and all(r.score < 0 and r.n_tokens >= 1 for r in got)
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.n_tokens, round(r.score, 9)))
    assert len(by[1]) == 1 and next(iter(by[2]))[0] == next(iter(by[3]))[0] == next(iter(by[5]))[0] == 1
    assert pitman_yor.score_documents(none).count() == 0
    alone = pitman_yor.score_documents(odd.filter("doc_id = 3")).collect()
    assert len(alone) == 1 and math.isfinite(alone[0].score) and math.isfinite(alone[0].base_score)


# ---- Jaccard join
def brute_links(docs, n=5, least=0.8):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    links, parent = collections.Counter(), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and (common := len(sets[a] & sets[b])) and common >= least * (len(sets[a]) + len(sets[b]) - common) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in ids}


def near_copies():
    r = random.Random(11)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    docs = [(0, " ".join(base))]
    for i in range(1, 330):  # more than one block of different near copies
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = f"x{r.randrange(9999)}"
        docs.append((i, " ".join(w)))
    return docs + [(1000 + i, " ".join(f"q{r.randrange(9999)}" for _ in range(30))) for i in range(40)] + [(2000, "a b"), (2001, "A  b"), (2002, "a c")]


@pytest.mark.parametrize("source", ["near", "real"])
def test_jaccard_join(spark, real, source):
    docs = near_copies() if source == "near" else [(r.doc_id, r.text) for r in real]
    got = {r.doc_id: (r.class_id, r.n_links) for r in minhash.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute_links(docs)


def test_many_comparisons_of_a_text(spark, monkeypatch):
    """Small blocks and lists: a text that takes part in many comparisons travels once per list of them."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "LIST", 3)
    docs = near_copies()
    got = minhash.jaccard_join(spark.createDataFrame([*docs, *[(None, docs[0][1] + " end")] * 2], "doc_id long, text string").repartition(3))
    want = brute_links([*docs, (9001, docs[0][1] + " end"), (9002, docs[0][1] + " end")])
    assert {r.doc_id: (r.class_id, r.n_links) for r in got.filter("doc_id is not null").collect()} == {i: want[i] for i, _ in docs}


def test_jaccard_odd(spark, odd, none):
    got = minhash.jaccard_join(odd).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in got) == [(0, 0, 0), (1, 1, 1), (1, 1, 1), (2, 2, 0), (3, 3, 0), (4, 4, 1), (5, 5, 0), (6, 6, 0), (7, 4, 1)]
    kept = minhash.one_of_each_class(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6]
    assert minhash.jaccard_join(none).count() == 0


def test_bands():
    bands, rows = minhash.choose_bands()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= minhash.MOST_HASHES
    with pytest.raises(ValueError):
        minhash.choose_bands(0.1, 0.9999, 4)


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_megabytes(spark):
    """Texts of megabytes, twice over, among short ones."""
    big = " ".join(f"w{(i * 7919) % 1_000_003} and" for i in range(250_000))
    df = spark.createDataFrame([(1, "short one"), (2, big), (3, big + " end"), (4, "short one")], "doc_id long, text string")
    assert {(s.doc_id, s.first_doc_id) for s in chunks.repeated_spans(df).filter("n_chars > 1000000").collect()} == {(3, 2)}
    assert {(r.doc_id, r.class_id, r.n_links) for r in minhash.jaccard_join(df).collect()} == {(1, 1, 1), (2, 2, 1), (3, 2, 1), (4, 1, 1)}
    got = {r.doc_id: r for r in pitman_yor.score_documents(df).collect()}
    assert got[2].n_tokens == 500_001 and got[2].score < got[1].score < 0


def test_registry_names():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.QUERIES) == list(range(1, 14))


def test_texts_that_share_an_id(spark):
    """An id may stand before several texts: what repeats is cut from its own text, and no unrelated text is lost."""
    words = lambda k, n: " ".join(f"w{(i * 7919 + k * 104729) % 9973}x{k}" for i in range(n))
    passage, other = words(1, 90), words(2, 160)
    rows = [(1, passage + " " + words(3, 40)), (5, words(4, 30) + " " + passage), (5, other), (5, other), (5, words(5, 150)), (7, other + " end"), (7, None), (7, ""), (None, other), (None, words(6, 20))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    left = sorted((r.doc_id or -1, r.text or "") for r in chunks.without_repeats(df).collect())
    assert {t for i, t in left if i == 5} >= {other, words(5, 150)} and words(6, 20) in {t for i, t in left if i == -1}
    cut = [t for i, t in left if i == 5 and t.startswith(words(4, 30)[:100])]
    assert len(cut) == 1 and len(cut[0]) < len(words(4, 30)) + 200
    kept = sorted((r.doc_id or -1, r.text or "") for r in minhash.one_of_each_class(df).collect())
    # (7, other + end) is a near copy of (5, other); rows without an id all stay
    want = [(1, rows[0][1]), (5, rows[1][1]), (5, other), (5, words(5, 150)), (7, ""), (7, ""), (-1, other), (-1, words(6, 20))]
    assert kept == sorted(want)
    names = {(r.doc_id, r.text_hash): (r.class_id, r.class_hash, r.n_links, r.n_copies) for r in minhash.jaccard_join(df).filter("doc_id = 5").collect()}
    assert sorted(v[2:] for v in names.values()) == [(0, 1), (0, 1), (3, 3)] and all(k == v[:2] for k, v in names.items())
