"""Benchmark decontamination: short items are searched in long documents by size-partitioned containment MinHash.

Words are runs of letters and digits, lower-cased; shingles are five words, or all of an item's where it has fewer.
Items are partitioned by size: class c holds those of up to 2**c distinct shingles, and its sketches are the
`sketch_size(c)` smallest hashes of an item's shingles. Only the short side is sketched (containment MinHash): a
minimum of the item is looked up among all shingles of a document, so a match doesn't fade with the document's
length. An item of n shingles that a document holds to `THRESHOLD` lacks n - need of them at most, and the sketch
of its class is longer than that; so at least `least` = sketch less lacking of its minima are in the document,
wherever they stand, whole or in pieces. Nothing is missed, at any size: the bound is counted, not probable.
Larger classes ask for more minima (`witnesses`), so that phrases which many texts share don't make candidates.
Candidates are verified by exact containment of their shingles, as words.

One pass over the documents, whatever the size of the benchmark. Tasks get a Bloom filter of the items' shingles
(`BITS` bits for each, 32 MB at most; beyond that it only lets more through) and pass on, for each document, the
distinct shingles that it lets through: few, and no text. Documents with the same such shingles, copies for
instance, are merged before they meet the sketches in a join, so that a passage in a third of all documents is
looked up once.

Defined results. Null and empty texts hold nothing; an item without a word is found nowhere. Null doc_ids and
item_ids are kept as they are. Repeated documents and items each have their own rows, also where they share an id.
Empty tables give an empty result. Extra columns pass through `remove`.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.llm.common import located, marked, pick, stage, table

SHINGLE, THRESHOLD = 5, 0.8
BITS, PROBES, LEAST_BITS, MOST_BITS = 64, 4, 1 << 22, 1 << 28
WORDS = re.compile(r"[^\W_]+")
MIX = np.uint64(0x9E3779B97F4A7C15)  # odd: the golden ratio of 64 bits


def words(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


class _Hashes(dict):
    """Hash of each word, kept for those met lately."""

    def __missing__(self, word: str) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def _hashed(found: list[str], memo: _Hashes, longest: int = SHINGLE) -> list[np.ndarray]:
    """For n from 1 to `longest` a 64-bit hash of each run of n words, in order."""
    w = np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
    out, x = [], np.zeros(len(w), np.uint64)
    for n in range(1, longest + 1):
        x = (x[: max(0, len(w) - n + 1)] ^ w[n - 1 :]) * MIX
        x ^= x >> np.uint64(29)
        out.append(x)
    return out


def need(n: int) -> int:
    """The fewest shingles, of an item's n, that make a containment of THRESHOLD."""
    return math.ceil(THRESHOLD * n)


def witnesses(c: int) -> int:
    """Minima of its sketch that a document which holds an item of class c must hold."""
    return max(1, min(8, (1 << c) // 8))


def sketch_size(c: int) -> int:
    """One more than the shingles that may be lacking from an item of class c, and more so for larger ones."""
    return (1 << c) - need(1 << c) + witnesses(c)


def described(text: str | None, memo: _Hashes) -> tuple[list[str], list[int], int, int, int] | None:
    """(shingles in order of their hashes, the hashes, words of a shingle, length of the sketch, least) of an item."""
    found = words(text)
    if not found:
        return None
    n = min(SHINGLE, len(found))
    by_hash = dict(zip(_hashed(found, memo, n)[-1].tolist(), zip(*(found[i:] for i in range(n)), strict=False), strict=True))
    own = {" ".join(x): h for h, x in by_hash.items()}
    order = sorted(own, key=own.__getitem__)
    c = (len(order) - 1).bit_length()
    size = min(sketch_size(c), len(order))
    return order, [own[s] for s in order], n, size, size - (len(order) - need(len(order)))


def described_items(items: DataFrame) -> DataFrame:
    """(item_id, shingles, hashes, n, size, least) of each item with a word."""
    item_id = items.schema["item_id"]
    schema = T.StructType([item_id, *T.StructType.fromDDL("shingles array<string>, hashes array<long>, n int, size int, least int").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        types = [pa.list_(pa.string()), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int32()]
        for b in batches:
            made = [described(t.as_py(), memo) for t in b.column("text")]
            some = pa.array([m is not None for m in made], pa.bool_())
            cols = list(zip(*(m for m in made if m is not None), strict=True)) or [[]] * 5
            signed = [[h - (1 << 64) if h >> 63 else h for h in x] for x in cols[1]]
            arrays = [pa.array(x, t) for x, t in zip([cols[0], signed, *cols[2:]], types, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("item_id").filter(some), *arrays], names=[f.name for f in schema.fields])

    return pick(items, "item_id", "text").mapInArrow(run, schema)


class Filter:
    """A Bloom filter of hashes; words: its bits, 64 a word."""

    def __init__(self, bits: int, words_: np.ndarray, lengths: list[int]):
        self.width, self.words, self.lengths = np.uint64(64 - (bits.bit_length() - 1)), words_, lengths

    def hits(self, x: np.ndarray) -> np.ndarray:
        """Places of x that may be members."""
        at = np.arange(len(x))
        for k in range(PROBES):
            p = (x[at] * np.uint64(MULTIPLIERS[k])) >> self.width
            at = at[(self.words[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)]
        return at

    def found(self, text: str | None, memo: _Hashes) -> list[str]:
        """The distinct shingles of the text that may be items', sorted."""
        held = words(text)
        if not held or not self.lengths:
            return []
        runs = _hashed(held, memo, max(self.lengths))
        return sorted({" ".join(held[i : i + n]) for n in self.lengths for i in self.hits(runs[n - 1]).tolist()})


#: Odd multipliers of the filter's probes.
MULTIPLIERS = [(0x9E3779B97F4A7C15 * (2 * k + 1)) & ((1 << 64) - 1) for k in range(PROBES)]


def bloom(made: DataFrame, most: int = MOST_BITS) -> Filter:
    """The filter of all shingles of described items. What reaches the driver is its set words, most / 64 rows at most."""
    total = made.agg(F.sum(F.size("hashes"))).first()[0] or 0
    bits = min(max(LEAST_BITS, 1 << (BITS * total).bit_length()), 1 << max(6, most.bit_length() - 1))
    shift = 64 - (bits.bit_length() - 1)

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("hashes").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            p = np.unique(np.concatenate([(x * np.uint64(m)) >> np.uint64(shift) for m in MULTIPLIERS]))
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int64))], names=["p"])

    set_ = made.select("hashes").mapInArrow(positions, "p long").groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("m")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[set_["w"].to_numpy()] = set_["m"].to_numpy().view(np.uint64)
    return Filter(bits, out, sorted(r.n for r in made.select("n").distinct().collect()))  # SHINGLE rows at most


def _met(rows: DataFrame, items: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """rows (text and other columns) that may hold an item, with `set`, text left out; and what each set holds: (set, item_id, shared, item_shingles)."""
    spark = rows.sparkSession
    made = stage(described_items(items), "items")
    shared = spark.sparkContext.broadcast(bloom(made, most))
    schema = T.StructType([*rows.drop("text").schema.fields, T.StructField("found", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, known = _Hashes(), shared.value
        for b in batches:
            found = [known.found(t.as_py(), memo) for t in b.column("text")]
            some = pa.array([bool(x) for x in found], pa.bool_())
            names = [n for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(n).filter(some) for n in names), pa.array([x for x in found if x], pa.list_(pa.string()))], names=[*names, "found"])

    hits = stage(rows.mapInArrow(run, schema).withColumn("set", F.sha2(F.array_join("found", "\n"), 256)), "found")
    sets = stage(hits.groupBy("set").agg(F.min("found").alias("found")), "found-sets")
    items_ = made.select("item_id", "shingles", "size", "least", F.sha2(F.array_join("shingles", "\n"), 256).alias("item"))
    kinds = stage(items_.groupBy("item").agg(F.min(F.struct("shingles", "size", "least")).alias("x"), F.count(F.lit(1)).alias("rows")).select("item", "x.*"), "item-kinds")
    minima = kinds.select("item", "least", F.explode(F.slice("shingles", F.lit(1), F.col("size"))).alias("s"))
    near = sets.select("set", F.explode("found").alias("s")).join(minima, "s").groupBy("set", "item").agg(F.count(F.lit(1)).alias("n"), F.min("least").alias("least")).where("n >= least")
    near = stage(near.select("set", "item"), "candidates")
    held = near.join(sets, "set").join(kinds.select("item", "shingles"), "item")
    held = held.select("set", "item", F.size(F.array_intersect("found", "shingles")).cast("long").alias("shared"), F.size("shingles").cast("long").alias("item_shingles"))
    sure = stage(held.where(F.col("shared") >= F.lit(THRESHOLD) * F.col("item_shingles")), "contained")
    return hits.drop("found"), sure.join(items_.select("item", "item_id"), "item").drop("item")


def find(docs: DataFrame, items: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment) for each item that a document holds.

    most_bits: bound of the filter that is sent to the tasks, rounded down to a power of two; a small one finds the same.
    """
    hits, held = _met(pick(docs, "doc_id", "text"), items, most_bits)
    return hits.join(held, "set").select("doc_id", "item_id", "shared", "item_shingles", (F.col("shared") / F.col("item_shingles")).alias("containment"))


def remove(docs: DataFrame, items: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    rows = located(docs)
    hits, held = _met(rows.select("file", "pos", F.col("row.text").alias("text")), items, most_bits)
    return marked(rows, hits.join(held.select("set").distinct(), "set").select("file", "pos"), keep=False).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM benchmark),
isz AS (SELECT item_id, w, least(len(w), {SHINGLE}) AS n FROM iw WHERE len(w) > 0),
si AS (SELECT DISTINCT item_id, n, unnest([array_to_string(w[i:i + n - 1], ' ') FOR i IN range(1, len(w) - n + 2)]) AS s FROM isz),
ns AS (SELECT DISTINCT n FROM si),
sd AS (SELECT DISTINCT doc_id, n, unnest([array_to_string(w[i:i + n - 1], ' ') FOR i IN range(1, greatest(len(w) - n + 2, 1))]) AS s FROM dw, ns),
c AS (SELECT item_id, count(*) AS item_shingles FROM si GROUP BY item_id),
h AS (SELECT doc_id, item_id, count(*) AS shared FROM sd JOIN si USING (n, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, shared, item_shingles, shared / item_shingles AS containment FROM h JOIN c USING (item_id)
WHERE shared >= {THRESHOLD} * item_shingles
"""
