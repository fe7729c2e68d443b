"""The corpus pipeline, stage by stage and whole, against brute force; recall of its near copies."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

import corpus_pipeline
from emberlog.llm import mixing, simhash, toxicity
from emberlog.llm.common import stage
from tests.llm.test_corpus_operators import LONG, edited, jaccard, prose

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `row` string, file string, digest string"
BAD = ["grumblat", "snarfle", "vexolot"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r, folder = random.Random(91), str(tmp_path_factory.mktemp("corpus"))
    texts, toxic, items = [], [], [(k, prose(30 + k, r)) for k in range(6)] + [(90, None), (91, "")]
    for k in range(260):
        words = prose(r.randint(20, 120), r).split()
        if k % 6 == 0:
            for _ in range(3):
                words[r.randrange(len(words))] = r.choice(BAD)
        toxic.append(int(k % 6 == 0))
        texts.append(" ".join(words))
    for k in (1, 2, 3):
        texts += [texts[k]] * 2  # exact copies
    for k in (7, 8, 9, 10):
        texts += [edited(texts[k] + " " + prose(120, random.Random(k)), 2, r) for _ in range(3)]  # near copies of each other
        texts.append(texts[k] + " " + prose(120, random.Random(k)))
    original = prose(200, r)
    texts += [edited(original, 4, r) for _ in range(20)] + [original] + [edited(original, 4, r) for _ in range(20)]  # alike through the original only
    for k in range(4):
        texts.append(prose(50, r) + " " + items[k][1] + " " + prose(40, r))
    texts += [LONG, None, "", "", "one two", "One two", "   "]
    rows = [(k if k != 11 else None, t, "en", ["a", "b", "c", None][k % 4], len(t or ""), "x", "y", "z") for k, t in enumerate(texts)]
    rows.append(rows[20])  # a repeated row
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, t) for k, t in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def shingles(text, n=5, pattern=r"\S+"):
    w = re.findall(pattern, (text or "").lower())
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def brute_toxic(spark, rows, folder):
    """Rows that the model, asked one text at a time, doesn't reject."""
    model = toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    of = model.scorer()
    return [x for x in rows if of(x.text) < toxicity.THRESHOLD]


def brute_exact(spark, rows, folder):
    best = {}
    for x in rows:
        t = x.text or ""
        if t not in best or (x.doc_id if x.doc_id is not None else -1) > (best[t].doc_id if best[t].doc_id is not None else -1):
            best[t] = x
    return list(best.values())


def brute_near(spark, rows, folder):
    """One row, that with the smallest id, of each group linked by a similarity of 0.8, directly or not."""
    own, root = [shingles(x.text) for x in rows], list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(own):
        for j in range(i):
            if len(a & own[j]) >= 0.8 * len(a | own[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    best = {}
    for k, x in enumerate(rows):
        g = find(k)
        if g not in best or (x.doc_id is not None, x.doc_id or 0) < (best[g].doc_id is not None, best[g].doc_id or 0):
            best[g] = x
    return list(best.values())


def brute_benchmark(spark, rows, folder):
    items = [s for x in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if (s := shingles(x.text, pattern=r"[^\W_]+"))]
    return [x for x in rows if all(len(i & shingles(x.text, pattern=r"[^\W_]+")) < 0.8 * len(i) for i in items)]


def brute_mix(spark, rows, folder):
    """(row, copies) of the documents that the mix takes."""
    size, of = {}, {}
    for x in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", x.text or ""))
        size[x.source] = size.get(x.source, 0) + n
        order = hashlib.md5(f"mix-1:{'' if x.doc_id is None else x.doc_id}".encode()).hexdigest()
        of.setdefault(x.source, []).append((order, x.doc_id if x.doc_id is not None else -1, n, x))
    out = []
    for s, t in mixing.targets(size).items():
        passes, rest = divmod(int(t), size[s]) if size[s] else (0, 0)
        past, last, held = 0, None, sorted(of[s], key=lambda y: y[:3])
        for y in held:
            if 2 * past + y[2] <= 2 * rest:
                last = y[:3]
            past += y[2]
        out += [(y[3], copies) for y in held if (copies := passes + (last is not None and rest > 0 and y[:3] <= last))]
    return out


BRUTE = [brute_toxic, brute_exact, brute_near, brute_benchmark]


def key(x):
    return (x.doc_id if x.doc_id is not None else -1, x.text or "", x.source or "")


def test_pipeline(spark, corpus):
    """Each stage on what the one before kept, and the whole: rows, columns, nulls, repeats, clashing names."""
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    names, rows, columns = [n for n, _ in corpus_pipeline.STAGES], docs.collect(), docs.columns
    assert names == ["toxicity", "exact_dedup", "simhash_near_dedup", "benchmark_decontamination", "mixing"]
    sizes = [len(rows)]
    for k, ((_, step), brute) in enumerate(zip(corpus_pipeline.STAGES, BRUTE, strict=False)):
        got = step(spark, docs, corpus)
        want = brute(spark, rows, corpus)
        assert got.columns == columns
        docs = stage(got, f"test-{k}")
        rows = docs.collect()
        assert sorted(map(key, rows)) == sorted(map(key, want))
        sizes.append(len(rows))
    assert all(a > b for a, b in zip(sizes, sizes[1:], strict=False)), sizes
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, corpus).collect()
    want = sorted((key(x), c) for x, c in brute_mix(spark, rows, corpus))
    assert sorted((key(x), x.copies) for x in mixed) == want
    assert sorted((key(x), x.copies) for x in corpus_pipeline.run(spark, corpus).collect()) == want


def test_pipeline_without_rows(spark, corpus, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{corpus}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copy_recall(spark):
    """Pairs at a similarity of 0.8 to 0.9, by length: at least nine in ten meet in a fingerprint and are linked."""
    r, texts, pairs = random.Random(97), [], {}
    for n in (60, 200, 1000, 4000):
        pairs[n] = []
        while len(pairs[n]) < 30:
            a = prose(n, r)
            b = edited(a, max(1, n // 70), r)
            if 0.8 <= jaccard(a, b) < 0.93:
                pairs[n].append(len(texts))
                texts += [a, b]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    kept = {x.doc_id for x in simhash.deduplicate(df).select("doc_id").collect()}
    found = {n: sum(k + 1 not in kept for k in own) for n, own in pairs.items()}
    print("near copies found of 30 by words", found)
    assert sum(found.values()) >= 0.9 * 120 and len(kept) == len(texts) - sum(found.values())
