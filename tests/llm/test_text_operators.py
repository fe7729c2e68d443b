"""Language identification, fill-in-middle and phrases against brute force, with nulls, empties, ties, repeats and clashing names."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberlog.llm import fill_middle, language_id, phrases
from tests.llm.test_corpus_operators import DOCS, EDGES, clashing, docs_of, prose

# fill-in-middle


def brute_middle(text, doc_id):
    t = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    n = len(units)
    digest = hashlib.sha256(("1:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    if h[3] % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


TEXTS = [None, "", " ", "a", "<P>", "x<S", ">y", "<", "a<M>b", "é😀 x\ny\tz", "\r\n\r\n", "ab12cd", "<S<P", "P>S>M>", "a" * 5000, "1" * 3000]


def test_fill_middle(spark):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS * 12)] + [*EDGES, (None, "ab cd", "s"), (None, "ab cd", "s"), (-(2**63), "ab cd", "s"), (2**63 - 1, "<P<S<M", "s")]
    made = fill_middle.transform(clashing(docs_of(spark, rows)))
    out = made.withColumn("back", fill_middle.restored(F.col("form"), F.col("output"))).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    got = sorted(((r.doc_id, r.back, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out), key=key)
    want = sorted(((i, t or "", *brute_middle(t, i)) for i, t, _ in rows), key=key)
    assert got == want
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert fill_middle.transform(docs_of(spark, rows).limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab<>PSM é\n", max_size=40), st.integers(0, 500), st.integers(1, 9))
def test_fill_middle_of_any_text(text, doc_id, block):
    made = fill_middle.transform_text(text, doc_id)
    assert made == brute_middle(text, doc_id)
    assert list(fill_middle.unit_ends(text, block)) == [m.end() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text)]
    form, output = made[1], made[4]
    if form != "plain":  # as a reader without this library would take it apart
        first, second = ("<P>", "<S>") if form == "psm" else ("<S>", "<P>")
        one, rest = output[3:].split(second, 1) if output.startswith(first) else (None, "")
        two, middle = rest.split("<M>", 1)
        assert (one + middle + two if form == "psm" else two + middle + one) == text


def test_fill_middle_long_text():
    """A text of several blocks, in bounded time."""
    text = prose(60_000) * 6
    assert len(text) > 2 * fill_middle.BLOCK - (1 << 20)
    assert fill_middle.transform_text(text, 3)[:4] == brute_middle(text, 3)[:4]


# language identification

SYLLABLES = {"aa": ["ka", "lo", "mi", "ta", "re", "ön"], "bb": ["sch", "ung", "ei", "ver", "ßa", "en"], "cc": ["ção", "que", "os", "de", "lh", "ar"]}


def babble(lang, n, r):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def babel():
    r = random.Random(5)
    return [(i, babble(lang, r.choice((1, 5, 40, 300)), r), lang) for i in range(600) for lang in [r.choice("abc") * 2]]


def test_language_id(spark, babel):
    odd = [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 $$ \n", "aa"), (1003, "ver ung", None), (None, "ver ung schei", "aa"), (None, "ver ung schei", "aa"), (7, "ka lo", "bb"), (7, "ka lo", "bb"), (1004, babble("cc", 200_000, random.Random(1)), None), (1005, "это совсем другой язык и он не похож на них", None), (1006, "VER UNG SCHEI", "aa")]
    df = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in [*babel, *odd]], DOCS)
    out = language_id.decide(clashing(df)).collect()
    assert len(out) == len(babel) + len(odd)
    truth, right, held = {i: lang for i, _, lang in babel}, 0, 0
    for r in out:
        assert r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        if r.held_out and r.doc_id in truth:
            held += 1
            right += r.lang_pred == truth[r.doc_id]
    assert held > 100 and right / held > 0.98
    by = {r.doc_id: r for r in out if r.doc_id is not None and r.doc_id >= 1000}
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and [by[i].score for i in (1000, 1001, 1002)] == [0.0] * 3
    assert by[1003].lang_pred == "bb" and by[1004].lang_pred == "cc" and by[1006].lang_pred == "bb"
    assert by[1005].rejected and by[1005].lang_pred in SYLLABLES and not by[1004].rejected
    assert sum(r.rejected for r in out) <= 10
    assert language_id.decide(df.limit(0)).count() == 0
    none = language_id.decide(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_language_id_bounds(spark, babel):
    """The sample keeps its bounds, is shared out over languages, and doesn't depend on how rows are dealt out."""
    s = language_id.Settings(rows=30, size_mb=1, languages=2)
    df = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in babel], DOCS)
    a, b = language_id.fit(df, s), language_id.fit(df.repartition(7), s)
    assert len(a.languages) == 2 and np.array_equal(a.centroids, b.centroids) and np.array_equal(a.reach, b.reach)
    assert len(a.centroids) <= 2 * s.clusters
    assert np.allclose((a.centroids**2).sum(1), 1, atol=1e-5)


def test_language_counts_in_blocks(monkeypatch):
    """n-grams of a text don't depend on the blocks that it is read in, and are those of a plain count."""
    s = language_id.Settings()
    text = "Añb  c--Dé1f́ g"
    whole, _ = language_id.counts(text, s)
    flat = " " + " ".join(re.findall(r"(?:[^\W\d_]|́)+", text.lower())) + " "
    assert whole.sum() == sum(len(flat) - n + 1 for n in (2, 3)) + sum(c != " " for c in flat)
    for size in (1, 2, 3, 5, 7):
        monkeypatch.setattr(language_id, "BLOCK", size)
        assert np.array_equal(language_id.counts(text, s)[0], whole)


def test_nearest_is_brute_force(babel):
    """The language of the highest cosine over dense vectors."""
    s = language_id.Settings(clusters=3, rounds=5)
    model = language_id.train([t for _, t, _ in babel[:200]], [lang for _, _, lang in babel[:200]], s)
    for _, t, _ in babel[200:300]:
        found, _ = language_id.counts(t, s)
        v = np.where(found > 0, (1 + np.log(np.maximum(found, 1))) * model.idf, 0)
        cosines = model.centroids @ (v / np.linalg.norm(v))
        lang, score, _ = model.predict(t)
        assert lang == model.languages[model.owner[int(np.argmax(cosines))]] and abs(score - cosines.max()) < 1e-5


# phrases


def brute_phrases(rows, top=phrases.TOP, least=10):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(upper)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in (1, 2, 3):
                for i in range(len(ws) - k + 1):
                    f.setdefault(lang, Counter())[tuple(ws[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            if len(p) == 2 and any(100 * b >= 50 * a for q, b in found.items() if len(q) == 3 and p in (q[:2], q[1:])):
                continue
            score, _, left, r = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, r))
        for rank, (score, a, p, left, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, r, n[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def talk():
    r = random.Random(11)
    words = [f"w{k}" for k in range(60)] + ["é", "Ö", "ö", "a b", "A", "\x1c"]
    def sentence():
        out = []
        for _ in range(r.randint(0, 30)):
            out += r.choice((["Big", "red", "dog"], ["red", "dog"], [r.choice(words[:6])], [r.choice(words)], ["x", "x", "x", "x"], ["New\tYork"], ["tick,"], ["é", "Ö."]))
        return " ".join(out) + r.choice(("", "\n", "?!", "  "))
    rows = [("".join(sentence() for _ in range(r.randint(0, 8))), r.choice(("en", "en", "en", "de", "und", None))) for _ in range(260)]
    return [*rows, (None, "en"), ("", "xx"), (None, None), (" , ", "yy"), ("big red dog " * 4000, "en"), ("one two three", "zz")]


@pytest.mark.parametrize("words, pairs", [(phrases.WORDS, phrases.PAIRS), (40, phrases.PAIRS), (phrases.WORDS, 25), (30, 12), (0, 0)])
def test_phrases(spark, talk, words, pairs):
    """Equal to brute force, however few words and pairs the tasks know the ranks of."""
    df = clashing(spark.createDataFrame([(k, t, lang, "s", 0) for k, (t, lang) in enumerate(talk)], DOCS)).repartition(6)
    got = sorted(tuple(r) for r in phrases.mine(df, most_words=words, most_pairs=pairs).collect())
    want = brute_phrases(talk)
    assert len(want) > 100 and got == want


def test_phrases_ties_and_top(spark):
    text = ". ".join(f"p{k} q{k}" for k in range(40)) + ". "
    rows = [(text * 10, "en"), ("é a. é b. 😀 a. z a. " * 10, "de")]
    df = spark.createDataFrame([(k, t, lang, "s", 0) for k, (t, lang) in enumerate(rows)], DOCS)
    got = sorted(tuple(r) for r in phrases.mine(df, top=7).collect())
    assert got == brute_phrases(rows, 7) and sum(r[0] == "en" for r in got) == 7
    assert phrases.mine(df.limit(0)).count() == 0
    assert phrases.mine(df.where("lang = 'none'")).count() == 0


def test_phrase_score_is_exact(spark):
    r = random.Random(2)
    rows = [(a, r.randint(a, 10**14), r.randint(a, 10**14)) for a in [10, 10**7, 10**13, *(r.randint(10, 10**13) for _ in range(200))]]
    rows += [(a, a, a) for a in (10, 3 * 10**9, 10**14)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", phrases.score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert all(x.s == 1000000 * x.a * x.a // (x.l * x.r) for x in got)


def test_tiles(monkeypatch):
    """Dense tiles and coordinates give a plain count, in any mixture and over several takes."""
    monkeypatch.setattr(phrases, "TILE", 4)
    monkeypatch.setattr(phrases, "TILES", 3)
    rng = np.random.default_rng(1)
    tiles, want, got = phrases.Tiles(50), Counter(), Counter()
    for k in range(12):
        x = np.minimum(rng.zipf(1.4, 400) - 1, 49).astype(np.int64)
        tiles.add(x[:-1], x[1:])
        want.update(zip(x[:-1].tolist(), x[1:].tolist(), strict=True))
        if k in (4, 11):
            codes, n = tiles.take(k == 11)
            assert (np.diff(codes) > 0).all()
            for c, m in zip(codes.tolist(), n.tolist(), strict=True):
                got[divmod(c, 50)] += m
            assert len(tiles.dense) == (0 if k == 11 else 3)
    assert got == want


def test_words_in_chunks(monkeypatch):
    text = "Aa bb,cC\tdd  é\x0bee.\x0cff"
    for size in (1, 3, 8, 100):
        monkeypatch.setattr(phrases, "CHUNK", size)
        flat = [w for ws in phrases.words_of(text.encode()) for w in ws]
        assert flat == [b"aa", b"bb", b"\xff", b"cc", b"dd", "é".encode(), b"\xff", b"ee", b"\xff", b"\xff", b"ff"]
