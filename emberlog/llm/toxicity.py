"""Toxicity by subword-bag embeddings: n-gram vectors of the words of a window, averaged into a linear softmax.

A word is a run of non-blank characters, lower-cased, stripped of punctuation at its ends; its vector is the mean
of the vectors of itself and its character n-grams (hashed into buckets while it is trained), so a misspelling that was never seen
shares most of them; n-grams that the sample doesn't hold have none. A text is read in windows of `WINDOW` words that overlap by half, all of it; a window's
vector is the mean over its words, and the softmax of a linear layer gives its probability. A text scores as its
most toxic window, since a toxic passage doesn't colour the average of a long text. Vectors and layer are trained
together, in numpy, by Adam on the log loss of texts.

The sample that it is trained on is bounded: `Settings.rows` labelled rows, half of them toxic at most, taken in
the order of a hash of doc_id until they hold `Settings.size_mb` MB of text. Everything else sees every row.

Defined results. Null and empty texts, and those without a word, score as a window of nothing (the layer's bias).
Repeated rows score alike, and rows with a null doc_id have scores but aren't learnt from. Of several texts with
one doc_id the smallest by code points is learnt from. Labels that are null, or disagree on one doc_id, are left out. With no toxic or no
clean row to learn from, every score is the share of toxic rows among those seen (0 without any). An empty table
gives an empty result. Other columns are neither read nor changed.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import pick, stage, table

WINDOW, THRESHOLD = 256, 0.3
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»„“”‚‘’…–—¿¡|"


@dataclass(frozen=True)
class Settings:
    """rows, size_mb: bounds of the training sample. least, signal: texts of it that a bucket must occur in, and the deviations
    by which it must be more frequent in toxic ones, to get a vector other than zero; its start is in proportion."""

    rows: int = 4000
    size_mb: int = 64
    buckets: int = 1 << 21
    size: int = 8
    grams: tuple[int, int] = (3, 6)
    epochs: int = 400
    rate: float = 0.1
    decay: float = 1e-5
    least: int = 3
    signal: float = 3.0
    start: float = 1.0
    seed: int = 7


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().split()


def grams(token: str, s: Settings) -> list[str]:
    """The whole word and its n-grams, with < and > at the ends."""
    word = f"<{token.strip(EDGES) or token}>"
    lo, hi = s.grams
    return [word, *(word[i : i + n] for n in range(lo, min(hi, len(word) - 1) + 1) for i in range(len(word) - n + 1))]


def n_grams(length: int, s: Settings) -> int:
    """How many `grams` a word of that length, < and > included, has."""
    lo, hi = s.grams
    return 1 + sum(length - n + 1 for n in range(lo, min(hi, length - 1) + 1))


def windows(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the windows over n words."""
    if n <= WINDOW:
        return np.array([0]), np.array([n])
    begins = np.arange(0, n - WINDOW // 2, WINDOW // 2)
    return begins, np.minimum(begins + WINDOW, n)


@dataclass
class Model:
    """values: an n-gram's vector times the layer's weight (toxic less clean), all that scoring needs; others are zero.

    They come from the training sample, and so are bounded by it.
    """

    values: dict[str, float]
    bias: float
    settings: Settings

    def scorer(self):
        """A function of a text; one automaton finds the n-grams of all its words."""
        import ahocorasick

        found = ahocorasick.Automaton()
        for gram, v in self.values.items():
            found.add_word(gram, v)
        if self.values:
            found.make_automaton()
        per = np.array([n_grams(n, self.settings) for n in range(256)], float)

        def score(text: str | None) -> float:
            words = [f"<{w.strip(EDGES) or w}>" for w in tokens(text)]
            total = np.zeros(len(words) + 1)
            if self.values and words:
                ends, values = [], []
                for end, v in found.iter("".join(words)):
                    ends.append(end)
                    values.append(v)
                sizes = np.fromiter(map(len, words), np.int64, len(words))
                if ends:
                    at = np.searchsorted(np.cumsum(sizes), ends, "right")
                    long = sizes >= len(per)
                    n = per[np.minimum(sizes, len(per) - 1)]
                    n[long] = [n_grams(int(x), self.settings) for x in sizes[long]]
                    total[1:] = np.cumsum(np.bincount(at, values, len(words)) / n)
            begins, ends = windows(len(words))
            top = float(((total[ends] - total[begins]) / np.maximum(ends - begins, 1)).max()) + self.bias
            return float(1 / (1 + np.exp(-np.clip(top, -500, 500))))

        return score


@dataclass
class Bag:
    """Windows of words of n-grams. flat, owner: the n-grams of each word, by place among those with vectors; sizes: how many n-grams
    a word has with those without; stream: the words of all texts; begins, ends: of each window in it."""

    flat: np.ndarray
    owner: np.ndarray
    sizes: np.ndarray
    stream: np.ndarray
    begins: np.ndarray
    ends: np.ndarray

    def scores(self, vec: np.ndarray, layer: np.ndarray) -> np.ndarray:
        """Of each window, but for the bias."""
        words = np.bincount(self.owner, (vec @ layer)[self.flat], len(self.sizes)) / self.sizes
        total = np.concatenate(([0.0], np.cumsum(words[self.stream])))
        return (total[self.ends] - total[self.begins]) / np.maximum(self.ends - self.begins, 1)

    def gradients(self, vec: np.ndarray, layer: np.ndarray, bias: np.ndarray, z: np.ndarray, win: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float) -> tuple:
        """Of the weighted log loss of the windows `win` with labels y, and of the decay, by vectors, layer and bias."""
        g = weight * (1 / (1 + np.exp(-np.clip(z[win] + bias, -500, 500))) - y)
        each = g / np.maximum(self.ends[win] - self.begins[win], 1)
        delta = np.zeros(len(self.stream) + 1)
        np.add.at(delta, self.begins[win], each)
        np.add.at(delta, self.ends[win], -each)
        by_word = np.bincount(self.stream, np.cumsum(delta)[:-1], len(self.sizes)) / self.sizes
        by_bucket = np.bincount(self.flat, by_word[self.owner], len(vec))
        return by_bucket[:, None] * layer + decay * vec, by_bucket @ vec + decay * layer, np.array([g.sum()])


def train(texts: list[str | None], toxic: list[int], s: Settings = Settings()) -> Model:
    """Joint training of bucket vectors and layer; the gradient reaches the window that decides each text, and one more window of a clean text."""
    y = np.asarray(toxic, float)
    share = float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        return Model({}, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), s)
    ids: dict[str, int] = {}
    seqs = [np.fromiter((ids.setdefault(w, len(ids)) for w in tokens(t)), np.int32) for t in texts]
    lengths, packed = array("i"), array("i")
    for w in ids:
        own = grams(w, s)
        lengths.append(len(own))
        packed.extend(crc32(x.encode("utf-8", "surrogatepass")) % s.buckets for x in own)
    sizes, flat = np.frombuffer(lengths, np.int32).astype(np.int64), np.frombuffer(packed, np.int32)
    seen = np.zeros(s.buckets, np.int64)
    at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    stream, base = np.concatenate(seqs) if seqs else np.empty(0, np.int32), np.concatenate(([0], np.cumsum([len(x) for x in seqs])))
    wins = [windows(len(x)) for x in seqs]
    begins, ends = np.concatenate([b + o for (b, _), o in zip(wins, base, strict=False)]), np.concatenate([e + o for (_, e), o in zip(wins, base, strict=False)])
    first = np.concatenate(([0], np.cumsum([len(b) for b, _ in wins])))
    doc = np.repeat(np.arange(len(seqs)), np.diff(first))

    in_toxic = np.zeros(s.buckets, np.int64)
    for x, label in zip(seqs, y, strict=True):
        if len(x):
            own = np.unique(np.concatenate([flat[at[w] : at[w] + sizes[w]] for w in np.unique(x)]))
            seen[own] += 1
            in_toxic[own] += int(label)
    pooled = np.clip(seen / len(y), 1e-9, 1 - 1e-9)
    pull = (in_toxic / y.sum() - (seen - in_toxic) / (len(y) - y.sum())) / np.sqrt(pooled * (1 - pooled) * (1 / y.sum() + 1 / (len(y) - y.sum())))
    chosen = (seen >= s.least) & (pull >= s.signal)
    live = np.flatnonzero(chosen)
    del seen, in_toxic, pooled
    place = np.full(s.buckets, -1, np.int32)
    place[live] = np.arange(len(live))
    kept = chosen[flat]
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[kept]
    flat = place[flat[kept]]
    del kept, packed, lengths

    rng = np.random.default_rng(s.seed)
    layer, bias = rng.normal(0, 0.5, s.size), np.array([np.log(share / (1 - share))])
    vec = s.start * pull[live, None] * layer / (layer @ layer) + rng.normal(0, 0.1, (len(live), s.size))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (vec, layer, bias)]
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) ** 0.5
    bag = Bag(flat, owner, sizes, stream, begins, ends)
    for epoch in range(1, s.epochs + 1):
        z = bag.scores(vec, layer)
        order = np.lexsort((z, doc))
        top = order[first[1:] - 1]
        extra = first[:-1] + (rng.random(len(seqs)) * np.diff(first)).astype(np.int64)
        win, dy, dw = np.concatenate((top, extra[y == 0])), np.concatenate((y, y[y == 0])), np.concatenate((weight, 0.5 * weight[y == 0]))
        grads = bag.gradients(vec, layer, bias, z, win, dy, dw / len(y), s.decay)
        for x, dx, (m, v) in zip((vec, layer, bias), grads, state, strict=True):
            m += 0.1 * (dx - m)
            v += 0.001 * (dx * dx - v)
            x -= s.rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-9)
    value = vec @ layer
    return Model({x: float(value[k]) for w in ids for x in grams(w, s) if (k := place[crc32(x.encode("utf-8", "surrogatepass")) % s.buckets]) >= 0}, float(bias[0]), s)


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Learns from rows that aren't held out; see the module for the bound of the sample."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("toxic").alias("y"), F.max("toxic").alias("y2")).where("y = y2")
    order = F.xxhash64("doc_id"), F.col("doc_id")
    toxic = known.where("y = 1").orderBy(*order).limit(s.rows // 2)
    clean = known.where("y = 0").orderBy(*order).limit(s.rows)
    chosen = toxic.unionByName(clean).select("doc_id", "y").toPandas()
    n = max(s.rows - int((chosen.y == 1).sum()), 0)
    chosen = pd.concat([chosen[chosen.y == 1], chosen[chosen.y == 0].iloc[:n]])
    if chosen.empty:
        return train([], [], s)
    wanted = docs.sparkSession.createDataFrame(pa.table({c: pa.array(chosen[c].astype("int64")) for c in ("doc_id", "y")}))
    sample = pick(docs, "doc_id", "text").join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # Settings.rows rows at most
    sample = stage(sample.select(F.xxhash64("doc_id").alias("h"), "doc_id", "y", "text"), "toxicity-sample")
    sizes = sample.select("h", "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).orderBy("h", "doc_id").toPandas()
    fits = sizes[sizes.n.cumsum() <= s.size_mb << 20]
    if fits.empty:
        return train([], [], s)
    last = fits.iloc[-1]
    h, doc_id = int(last.h), int(last.doc_id)
    rows = sample.where((F.col("h") < h) | (F.col("h") == h) & (F.col("doc_id") <= doc_id)).toArrow().sort_by("doc_id")
    return train(rows["text"].to_pylist(), rows["y"].to_pylist(), s)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text and other columns) with score, text left out."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.drop("text").withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.scorer()
        for b in batches:
            names = [n for n in b.schema.names if n != "text"]
            found = pa.array([of(t.as_py()) for t in b.column("text")], pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), found], names=[*names, "score"])

    return docs.mapInArrow(run, schema)


def decide(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs."""
    scored = score(pick(docs, "doc_id", "text"), fit(docs, labels, s))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, s))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.value.scorer()
        for b in batches:
            yield b.filter(pa.array([of(x.as_py()) < THRESHOLD for x in b.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
