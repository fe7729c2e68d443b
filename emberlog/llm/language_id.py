"""Language identification by nearest centroids of TF-IDF vectors of character n-grams.

A text's runs of letters, lower-cased, each with a blank at both ends, give n-grams of one to three code points, hashed
into buckets. The logarithm of a bucket's count times its inverse document frequency, at unit length, is the text's
vector. Each language has several centroids, found by k-means on the sphere over its texts of the sample, so that one
language may have several kinds of text. A text gets the language of the centroid with the highest cosine, which is its
score. The centroid's reach is the distance within which all but a small share of the sample's pieces of that length
lie; a text beyond it is `rejected`, as its language is probably none of those learnt.

The sample is bounded: `Settings.rows` documents, shared out evenly over the `Settings.languages` languages with most
documents, in the order of a hash of doc_id and language, until they hold `Settings.size_mb` MB of text; texts of more than a
16th of that aren't learnt from. The model has
languages * clusters * buckets numbers at most. Everything else sees every row and its whole text.

Defined results. Null texts and those without a letter are `und`, with score 0, and not rejected. Rows with a null doc_id
are predicted, not held out, and not learnt from. Of several texts with one doc_id and language the smallest is learnt
from; a doc_id with several languages counts for each. Ties go to the language first by code points. With nothing to learn
from, all texts are `und`. Repeated rows are predicted alike. An empty table gives an empty result. Extra columns, whatever
their names, aren't read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.llm.common import pick, stage, table

NONE = "und"
BLOCK = 1 << 20  # code points of a text that are turned into n-grams at a time
LARGEST = 16  # texts of more than this part of the sample's size aren't learnt from


@dataclass(frozen=True)
class Settings:
    """rows, size_mb, languages: bounds of the sample. outside: share of the sample's pieces that lie beyond the reach."""

    rows: int = 3000
    size_mb: int = 32
    languages: int = 256
    buckets: int = 1 << 15
    grams: int = 3
    clusters: int = 4
    rounds: int = 12
    outside: float = 0.002
    pieces: tuple[int, ...] = (1, 3, 10, 30, 100)


@lru_cache(1)
def letters() -> np.ndarray:
    """Of each code point: 2 for a letter, 1 for a mark that goes with letters, else 0."""
    first = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    return np.fromiter((2 if x == "L" else 1 if x == "M" else 0 for x in first), np.uint8, len(first))


def counts(text: str | None, s: Settings) -> tuple[np.ndarray, bool]:
    """(how often each bucket occurs, whether there is a letter)."""
    found, has, before = np.zeros(s.buckets, np.int64), False, np.array([32], np.uint32)
    text = text or ""
    for at in range(0, len(text), BLOCK):
        points = np.frombuffer(text[at : at + BLOCK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = letters()[points]
        has = has or bool((kind == 2).any())
        inside = kind > 0
        blank = ~inside & np.concatenate(([before[-1] != 32], inside[:-1]))  # one for each run of others
        x = np.concatenate((before, np.where(inside, points, 32)[inside | blank])).astype(np.uint64)
        if at + BLOCK >= len(text) and x[-1] != 32:
            x = np.append(x, np.uint64(32))
        code = np.zeros(len(x), np.uint64)
        for n in range(1, s.grams + 1):
            code = code[: len(x) - n + 1] * np.uint64(0x110001) + x[n - 1 :]
            # those that end in what is new of this block, and for n = 1 aren't blanks
            new = max(len(before) - n + 1, 0)
            own = code[new:] if n > 1 else code[new:][x[new:] != 32]
            mixed = (own + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            found += np.bincount(((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % s.buckets, minlength=s.buckets)
        before = x[-max(s.grams - 1, 1) :].astype(np.uint32)
    return found, has


@dataclass
class Model:
    """centroids: rows of unit length; owner: the language of each; reach: by centroid and band of length, the least cosine that isn't rejected."""

    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    reach: np.ndarray
    settings: Settings

    def vector(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The buckets that aren't zero, and their values at unit length."""
        at = np.flatnonzero(found)
        v = (1 + np.log(found[at])) * self.idf[at]
        return at, v / max(float(np.sqrt(v @ v)), 1e-12)

    def nearest(self, found: np.ndarray) -> tuple[int, float]:
        at, v = self.vector(found)
        near = self.centroids[:, at] @ v
        k = int(np.argmax(near))
        return k, float(min(max(near[k], 0.0), 1.0))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        found, has = counts(text, self.settings)
        if not has or not len(self.languages):
            return NONE, 0.0, False
        k, cosine = self.nearest(found)
        return self.languages[self.owner[k]], cosine, cosine < self.reach[k, band(found)]


def band(found: np.ndarray) -> int:
    """A band of texts of about equal length, by the logarithm of their number of n-grams."""
    return int(np.log2(max(int(found.sum()), 1)))


BANDS = 48


def clusters(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """k-means on the sphere; the first centres are the mean and the vectors that are farthest from those before. Empty ones go."""
    unit = lambda m: m / np.maximum(np.sqrt((m * m).sum(-1, keepdims=True)), 1e-12)
    centres = unit(x.mean(0, keepdims=True))
    while len(centres) < min(k, len(x)):
        centres = np.concatenate((centres, x[np.argmin((x @ centres.T).max(1))][None]))
    for _ in range(rounds):
        mine = (x @ centres.T).argmax(1)
        centres = unit(np.stack([x[mine == j].mean(0) for j in range(len(centres)) if (mine == j).any()]))
    return centres.astype(np.float32)


def train(texts: list[str | None], langs: list[str], s: Settings = Settings()) -> Model:
    """Centroids of each language, and their reach by pieces of the texts of several lengths."""
    known = sorted(set(langs), key=lambda x: x.encode("utf-8", "surrogatepass"))
    sparse: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {x: [] for x in known}
    seen, n = np.zeros(s.buckets, np.int64), 0
    for t, lang in zip(texts, langs, strict=True):
        found, has = counts(t, s)
        if has:
            at = np.flatnonzero(found)
            sparse[lang].append((at.astype(np.int32), found[at]))
            seen[at] += 1
            n += 1
    known = [x for x in known if sparse[x]]
    idf = np.log((1 + n) / (1 + seen)) + 1
    model = Model(known, idf, np.zeros((0, s.buckets), np.float32), np.zeros(0, np.int64), np.zeros((0, BANDS)), s)
    if not known:
        return model
    made, owner = [], []
    for k, lang in enumerate(known):
        x = np.zeros((len(sparse[lang]), s.buckets), np.float32)
        for row, (at, c) in zip(x, sparse[lang], strict=True):
            v = (1 + np.log(c)) * idf[at]
            row[at] = v / np.sqrt(v @ v)
        found = clusters(x, s.clusters, s.rounds)
        made.append(found)
        owner += [k] * len(found)
    model.centroids, model.owner = np.concatenate(made), np.array(owner)
    near: dict[int, list[float]] = {}
    for t in texts:
        words = (t or "").split()
        for size in s.pieces:
            if len(words) > size:
                begin = len(words) * size % (len(words) - size + 1)
                found, has = counts(" ".join(words[begin : begin + size]), s)
                if has:
                    near.setdefault(band(found), []).append(model.nearest(found)[1])
        found, has = counts(t, s)
        if has:
            near.setdefault(band(found), []).append(model.nearest(found)[1])
    # few pieces of a length say little of their tail: the margin is wider there, and the reach never rises as texts get shorter
    least = np.full(BANDS, np.nan)
    for b, values in near.items():
        least[b] = np.quantile(values, s.outside) - 0.5 / np.sqrt(len(values))
    filled = [x for x in range(BANDS) if not np.isnan(least[x])]
    if filled:
        for b in range(BANDS):
            if np.isnan(least[b]):
                least[b] = least[min(filled, key=lambda x: (abs(x - b), x))]
        least = np.minimum.accumulate(least[::-1])[::-1]
    model.reach = np.tile(least, (len(model.owner), 1))
    return model


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def fit(docs: DataFrame, s: Settings = Settings()) -> Model:
    """Learns from documents with a language that aren't held out; see the module for the bounds of the sample."""
    rows = pick(docs, "doc_id", "lang", "text")
    h = F.xxhash64("doc_id", "lang")
    known = rows.select("doc_id", "lang", h.alias("h")).where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).orderBy(F.desc("n"), "lang").limit(s.languages)
    sizes = stage(sizes, "language-sizes")  # languages rows at most
    if not (n := sizes.count()):
        return train([], [], s)
    each = max(s.rows // n, 1)
    # about twice as many as wanted by a bound on the hash, then exactly the first of them
    share = F.least(F.lit(1.0), F.lit(2.0 * each + 32) / F.col("n"))
    some = known.join(F.broadcast(sizes), "lang").where(F.pmod("h", F.lit(1 << 40)) <= share * (1 << 40)).select("lang", "doc_id", "h").distinct()
    order = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 40)), "h", "doc_id")
    chosen = some.withColumn("k", F.row_number().over(order)).where(F.col("k") <= each).select("lang", "doc_id", "k")
    chosen = stage(chosen, "language-sample")  # rows rows at most
    sample = rows.join(F.broadcast(chosen), ["lang", "doc_id"]).groupBy("lang", "doc_id", "k").agg(F.min("text").alias("text"))
    sample = stage(sample, "language-texts")
    order = "k", "lang"  # one row each
    sizes = sample.select(*order, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n")).orderBy(*order).toPandas()
    sizes = sizes[sizes.n <= (s.size_mb << 20) // LARGEST]
    fits = sizes[sizes.n.cumsum() <= s.size_mb << 20]
    wanted = docs.sparkSession.createDataFrame(pa.table({"k": pa.array(fits.k, pa.int32()), "lang": pa.array(fits.lang, pa.string())}))
    taken = sample.join(F.broadcast(wanted), ["k", "lang"]).orderBy(*order).toArrow()
    return train(taken["text"].to_pylist(), taken["lang"].to_pylist(), s)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = pick(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.predict
        for b in batches:
            made = [of(t.as_py()) for t in b.column("text")]
            columns = [pa.array([m[k] for m in made], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], names=["doc_id", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def decide(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for each row of docs (doc_id, text, lang)."""
    found = identify(docs, fit(docs, s))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(table(spark, sf_dir, "documents"))
