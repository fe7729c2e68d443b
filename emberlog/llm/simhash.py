"""SimHash near-duplicates, found through Golay-code keys of fingerprint segments.

Fingerprint. A-Z is lower-cased, words are runs of characters other than space, tab, LF, VT, FF and CR; each
shingle of four words, repeats included, is hashed by XXH64 with seed 42; a bit is 1 if it is set in more than
half of the hashes. Fewer words make one shingle of them all; no word gives zero. Null texts are empty.

Linking, at four or fewer differing bits. A fingerprint splits into three segments of 22, 21 and 21 bits, read
as words of the perfect binary Golay code (23, 12, 7). `near` is the one codeword within three bits of a
segment; `around` are those within four bits: that codeword alone, or six where the segment lies three bits
off, whose six difference sets then part the 23 positions (the blocks of S(4, 7, 23)). Hence
  (a) segments that differ in at most one bit: the near codeword of either is around the other;
  (b) segments that differ in at most two bits: some codeword is around both.
Four errors over three segments leave either two segments with at most one error each, found by keys
(near of one, around of the other) met with (around, near), or the split 2, 2, 0, found by keys (equal
segment, codeword around another). So no link is missed; candidates are verified on all 64 bits.

A key holds 24 to 34 bits. Rows of a key come sorted into a task that compares them in numpy and
passes on a forest that connects what is linked, never all pairs; a key of more than `block` fingerprints is
dealt out as pairs of blocks, each its own group of bounded size, so a hot key is shared among tasks.
Equal fingerprints are merged before any of this.

`deduplicate`, for pipelines, wants near copies at a Jaccard similarity of 0.8 or more of five-word shingles. At
that similarity four-word fingerprints differ in some eight bits, too many for keys of any use, so it links texts
by `PRINTS` fingerprints of their sets of words, at the same four bits by the same keys, and verifies by shingles.

Defined results. Rows that repeat each have their row; null doc_ids are left aside in component_id and sort first
in `deduplicate`. An empty table gives an empty result. Extra columns pass through `deduplicate`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.llm.common import located, marked, pick, stage, table
from emberlog.llm.components import components

WORDS_PER_SHINGLE, SEED, MAX_BITS = 4, 42, 4
PRINTS, SHINGLE, MINIMA = 4, 5, 8  # of deduplicate: fingerprints of a text, words of a shingle, minima of its shingles
PLACE = 52  # bit of a key at which the number of the fingerprint begins
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # shift and width
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 of the cyclic code, or its reciprocal


def fingerprint(text: str | None) -> int:
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # of bytes: A-Z and the six white-space bytes only
    if not words:
        return 0
    if len(words) <= WORDS_PER_SHINGLE:
        return xxh64_intdigest(b" ".join(words), SEED)
    joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    k = WORDS_PER_SHINGLE - 1
    begins = np.concatenate(([0], ends[: -k - 1])).tolist()
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begins, (ends[k:] - 1).tolist(), strict=True)), np.uint64, len(begins))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (text and other columns) with the column fp: the fingerprint as a signed long; text is left out."""
    schema = docs.drop("text").withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(x.as_py()) for x in b.column("text")), np.uint64, b.num_rows)
            cols = {n: b.column(n) for n in b.schema.names if n != "text"} | {"fp": pa.array(fp.view(np.int64))}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return docs.mapInArrow(run, schema)


@cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """near[v]: index of the codeword within three bits of the 23-bit v; code[i]: codeword i; blocks[place[t]]: for a
    set t of three positions, the five codewords of weight seven that hold it."""
    message = np.arange(1 << 12, dtype=np.int64)
    code = np.zeros(1 << 12, np.int64)
    for i in range(12):
        code ^= np.where(message >> i & 1, GENERATOR << i, 0)
    bits = [1 << i for i in range(23)]
    threes = np.array([a | b | c for a in bits for b in bits for c in bits if a < b < c])
    near = np.empty(1 << 23, np.int16)
    for e in [0, *bits, *(a | b for a in bits for b in bits if a < b), *threes]:
        near[code ^ e] = message
    seven = code[np.bitwise_count(code) == 7]
    blocks = seven[np.nonzero((seven[None, :] & threes[:, None]) == threes[:, None])[1]].reshape(-1, 5)
    place = np.zeros(1 << 23, np.int16)
    place[threes] = np.arange(len(threes))
    return near, code, blocks, place


def around(v: np.ndarray) -> np.ndarray:
    """Six codeword indices for each 23-bit v, those within four bits; the first is the nearest, spare places repeat it."""
    near, code, blocks, place = golay()
    first = near[v]
    out = np.repeat(first[:, None], 6, axis=1)
    off = code[first] ^ v
    three = np.flatnonzero(np.bitwise_count(off) == 3)
    out[three, 1:] = near[code[first[three]][:, None] ^ blocks[place[off[three]]]]
    return out.astype(np.int64)


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of uint64 fingerprints, each pair once: rows that may be linked have a key in common."""
    seg = [((fp >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    far = [around(x) for x in seg]
    fresh = [np.hstack([np.ones((len(fp), 1), bool), x[:, 1:] != x[:, :1]]) for x in far]
    rows, out = [], []

    def put(tag: int, ok: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        r, c = np.nonzero(ok)
        rows.append(r)
        out.append(tag << 48 | a[r, c] << 12 | b[r, c])

    def wide(x: np.ndarray) -> np.ndarray:
        return np.broadcast_to(x[:, None], (len(fp), 6))

    for tag, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        put(tag, fresh[j], wide(far[i][:, 0]), far[j])
        put(tag, fresh[i] & (np.arange(6) > 0), far[i], wide(far[j][:, 0]))
    for tag, (i, j) in enumerate(((0, 1), (1, 2), (2, 0)), 3):
        put(tag, fresh[j], wide(seg[i]), far[j])
    return np.concatenate(rows), np.concatenate(out)


def forest(fp: np.ndarray) -> list[tuple[int, int]]:
    """Index pairs that connect just what is linked, directly or not, among the fingerprints of one group."""
    left, out = np.arange(len(fp)), []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            i = front.pop()
            hit = np.bitwise_count(fp[left] ^ fp[i]) <= MAX_BITS
            front += list(left[hit])
            out += [(i, j) for j in left[hit]]
            left = left[~hit]
    return out


def _solve(key: np.ndarray, part: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
    """Links within each run of equal (key, part)."""
    u = fp.view(np.uint64)
    starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
    sizes = np.diff(np.r_[starts, len(key)])
    a, b, k = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    run = np.repeat(np.arange(len(starts)), sizes)
    small = sizes <= 8
    for off in range(1, 8):
        i = np.flatnonzero(run[off:] == run[:-off]) if len(run) > off else np.empty(0, np.int64)
        i = i[small[run[i]]]
        hit = i[np.bitwise_count(u[i] ^ u[i + off]) <= MAX_BITS]
        a.append(fp[hit])
        b.append(fp[hit + off])
        k.append(key[hit])
    for s, n in zip(starts[~small], sizes[~small], strict=True):
        if pairs := forest(u[s : s + n]):
            i, j = np.array(pairs).T
            a.append(fp[s + i])
            b.append(fp[s + j])
            k.append(np.full(len(i), key[s]))
    got = pd.DataFrame({"u": np.concatenate(a), "v": np.concatenate(b), "k": np.concatenate(k) >> PLACE})
    return got[got.u != got.v].drop_duplicates()


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """batches: (key, part, fp), a task's in that order. A group is held whole; it has two blocks at most."""
    carry = None
    for pdf in batches:
        pdf = pdf if carry is None else pd.concat([carry, pdf], ignore_index=True)
        last = (pdf["key"] == pdf["key"].iloc[-1]) & (pdf["part"] == pdf["part"].iloc[-1])
        carry, done = pdf[last], pdf[~last]
        if len(done):
            yield _solve(*(done[c].to_numpy() for c in ("key", "part", "fp")))
    if carry is not None and len(carry):
        yield _solve(*(carry[c].to_numpy() for c in ("key", "part", "fp")))


def links(fps: DataFrame, block: int = 1024) -> DataFrame:
    """(u, v, k): a set of links between distinct fingerprints (columns fp and k, those of one k apart from others)
    with the same components as all links."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, which = b.column("fp").to_numpy(zero_copy_only=False), b.column("k").to_numpy(zero_copy_only=False)
            for i in range(0, len(fp), 2048):
                r, found = keys(fp[i : i + 2048].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(fp[i : i + 2048][r]), pa.array(found | which[i : i + 2048][r] << PLACE)], names=["fp", "key"])

    rows = stage(fps.mapInArrow(keyed, "fp long, key long"), "simhash-keys")
    # keys are nearly all different, and too many to count: few bins of them hold more than a block, and only those are
    bins = 1 << max(18, (rows.count() // 256).bit_length())
    bin_ = F.pmod(F.xxhash64("key"), F.lit(bins))
    full = stage(rows.groupBy(bin_.alias("bin")).count().where(F.col("count") > block).select("bin"), "simhash-bins")
    hot = rows.join(full, bin_ == F.col("bin"), "left_semi").groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("n"))
    hot = stage(hot, "simhash-hot")  # written down, so that the join with it can be split
    n = F.coalesce("n", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), n).cast("int")
    other = F.explode(F.sequence(F.lit(0), n - 1))
    parted = rows.join(hot, "key", "left").select("key", "fp", n.alias("n"), own.alias("own"), other.alias("other"))
    part = F.when(F.col("n") == 1, F.lit(0)).otherwise(F.least("own", "other") * F.col("n") + F.greatest("own", "other"))
    dealt = parted.select("key", part.cast("long").alias("part"), "fp").repartition("key", "part").sortWithinPartitions("key", "part")
    return dealt.mapInPandas(_links, "u long, v long, k long").distinct()


def classes(fps: DataFrame) -> DataFrame:
    """fps (fp and other columns) with `class`, equal for rows whose fingerprints are linked, directly or not."""
    distinct = stage(fps.select("fp", F.lit(0).cast("long").alias("k")).distinct(), "simhash-fps")
    found = components(links(distinct))
    return fps.join(found.select(F.col("node").alias("fp"), F.col("component").alias("class")), "fp", "left").withColumn("class", F.coalesce("class", "fp"))


def decide(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for each row; component_id is the smallest doc_id of the class, nulls left aside."""
    fps = stage(fingerprints(pick(docs, "doc_id", "text")), "simhash")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    by_fp = stage(classes(least), "simhash-classes")
    ids = by_fp.groupBy("class").agg(F.min("least").alias("component_id"))
    named = by_fp.join(ids, "class").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def word_hashes(text: str | None, memo: dict[str, int]) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    words = (text or "").lower().split()
    return np.fromiter((memo[w] for w in words), np.uint64, len(words))


def word_prints(flow: np.ndarray) -> np.ndarray:
    """PRINTS fingerprints, as signed longs, of the set of words of `word_hashes`.

    An edited word changes up to five shingles but one word, so sets of words keep near copies within a few bits.
    """
    own, prints = np.unique(flow), np.zeros(PRINTS, np.uint64)
    for k in range(PRINTS):
        h = (own ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
        ones = np.zeros(64, np.int64)
        for i in range(0, len(h), 1 << 14):
            ones += np.unpackbits(h[i : i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        prints[k] = int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")
    return prints.view(np.int64)


def word_shingles(flow: np.ndarray) -> np.ndarray:
    """Hashes of the distinct shingles of five words, in order, as signed longs; fewer words make one shingle."""
    n = max(1, len(flow) - SHINGLE + 1) if len(flow) else 0
    rolled = np.zeros(n, np.uint64)
    for i in range(min(SHINGLE, len(flow))):
        rolled = (rolled ^ flow[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        rolled ^= rolled >> np.uint64(29)
    return np.unique(rolled).view(np.int64)


class _Words(dict):
    """Hash of each word, kept for those met lately."""

    def __missing__(self, word: str) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def _prints(rows: DataFrame, shingles: bool) -> DataFrame:
    """rows (text and other columns) with prints, or the shingles if asked for; text is left out."""
    name, of = ("shingles", word_shingles) if shingles else ("prints", word_prints)
    schema = T.StructType([*rows.drop("text").schema.fields, T.StructField(name, T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Words()
        for b in batches:
            names, text = [n for n in b.schema.names if n != "text"], b.column("text")
            at = 0
            while at < b.num_rows:  # rows of some 8 MB of numbers at a time
                made, size, begin = [], 0, at
                while at < b.num_rows and size < 1 << 20:
                    made.append(of(word_hashes(text[at].as_py(), memo)))
                    size, at = size + len(made[-1]), at + 1
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, made)]), pa.int32()), pa.array(np.concatenate(made)))
                yield pa.RecordBatch.from_arrays([*(b.column(n).slice(begin, at - begin) for n in names), lists], names=[*names, name])

    return rows.mapInArrow(run, schema)


def candidates(prints: DataFrame) -> DataFrame:
    """(file, pos, doc_id, node, class) of rows that share a near fingerprint with others, of a stored frame with prints and node, a number of each row from 0.

    In the graph fingerprints have numbers of their own, below 0.
    """
    each = prints.select("node", F.posexplode("prints").alias("k", "fp")).withColumn("k", F.col("k").cast("long"))
    counted = stage(each.groupBy("k", "fp").agg(F.count(F.lit(1)).alias("n")).withColumn("id", -1 - F.monotonically_increasing_id()), "simhash-fps")
    near = stage(links(counted.select("k", "fp")), "simhash-links")
    of = lambda end: counted.select("k", F.col("fp").alias(end), F.col("id").alias(f"{end}_id"))
    near = stage(near.join(of("u"), ["k", "u"]).join(of("v"), ["k", "v"]).select("k", "u", "v", "u_id", "v_id"), "simhash-numbered")
    ends = near.select("k", F.explode(F.array(F.struct(F.col("u").alias("fp"), F.col("u_id").alias("id")), F.struct(F.col("v").alias("fp"), F.col("v_id").alias("id")))).alias("e")).select("k", "e.fp", "e.id")
    busy = stage(ends.unionByName(counted.where("n > 1").select("k", "fp", "id")).distinct(), "simhash-busy")
    held = each.join(busy, ["k", "fp"]).select(F.col("node").alias("u"), F.col("id").alias("v"))
    found = components(held.unionByName(near.select(F.col("u_id").alias("u"), F.col("v_id").alias("v"))))
    return prints.select("file", "pos", "doc_id", "node").join(found, "node").select("file", "pos", "doc_id", "node", F.col("component").alias("class"))


def _spread(flat: np.ndarray, sizes: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Index pairs that connect just the sets of one group that are alike, directly or not; flat: their members, set by set."""
    value = np.unique(flat, return_inverse=True)[1]
    ends = np.cumsum(sizes)
    begins, mark = ends - sizes, np.zeros(len(flat), bool)
    left, out = np.arange(len(sizes)), []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            i = front.pop()
            own = value[begins[i] : ends[i]]
            mark[own] = True
            upto = np.r_[0, np.cumsum(mark[value])]
            mark[own] = False
            shared = upto[ends[left]] - upto[begins[left]]
            hit = shared >= similarity * (sizes[i] + sizes[left] - shared)
            front += list(left[hit])
            out += [(i, j) for j in left[hit]]
            left = left[~hit]
    return out


def _verify(similarity: float):
    """Tasks over (key, part, node, shingles) in order of (key, part): links of alike rows of a group, which is held whole."""

    def solve(node: pa.ChunkedArray, shingles: pa.ChunkedArray) -> pa.RecordBatch:
        sets = shingles.combine_chunks()
        sets = pa.concat_arrays(sets.chunks) if isinstance(sets, pa.ChunkedArray) else sets
        found = _spread(sets.flatten().to_numpy(zero_copy_only=False), sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), similarity)
        own, (i, j) = node.to_numpy(), np.array(found, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(own[j])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if carry is None else pa.concat_tables([carry, t])
            key, part = t["key"].to_numpy(), t["part"].to_numpy()
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
            for x, y in zip(starts, starts[1:], strict=False):
                yield solve(t["node"][x:y], t["shingles"][x:y])
            carry = t.slice(starts[-1])
        if carry is not None:
            yield solve(carry["node"], carry["shingles"])

    return run


def alike(told: DataFrame, similarity: float = 0.8, block: int = 256) -> DataFrame:
    """(u, v): links between nodes of told (node, class, shingles) with the same components as all pairs of a class that
    share one of MINIMA minima of their shingles and are alike.

    Equal sets are merged first, and groups with the same members taken once. A group of more than `block` sets is dealt
    out as pairs of blocks, each its own group of bounded size.
    """
    minima = F.array(*[F.coalesce(F.array_min(F.transform("shingles", _mixed(k))), F.lit(0)) for k in range(MINIMA)])
    light = stage(told.select("node", "class", F.struct(F.size("shingles"), F.xxhash64("shingles"), F.xxhash64(F.lit(1), "shingles")).alias("set"), minima.alias("minima")), "simhash-minima")
    same = stage(light.groupBy("class", "set").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("rep")).where("n > 1").drop("n"), "simhash-same")
    known = stage(light.join(same, ["class", "set"], "left").withColumn("rep", F.coalesce("rep", "node")).drop("set"), "simhash-sets")
    group = ["class", "k", "least"]
    keyed = known.where("node = rep").select("node", "class", F.posexplode("minima").alias("k", "least"))
    members = F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")
    held = keyed.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *members).where("n > 1")
    once = held.groupBy("class", "n", "x", "y").agg(F.min(F.struct("k", "least")).alias("g"))
    once = stage(once.select("class", "g.k", "g.least", F.ceil(F.col("n") / block).cast("int").alias("n"), F.xxhash64("class", "g.k", "g.least").alias("key")), "simhash-groups")
    own = F.pmod(F.xxhash64("node"), "n").cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    dealt = keyed.join(once, group).select("node", "key", "n", own.alias("own"), other.alias("other")).where("n = 1 or own <> other")
    part = (F.least("own", "other") * F.col("n").cast("long") + F.greatest("own", "other")).alias("part")
    dealt = stage(dealt.select("node", "key", part), "simhash-dealt")
    rows = dealt.join(told.select("node", "shingles"), "node").select("key", "part", "node", "shingles")
    found = rows.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(_verify(similarity), "u long, v long")
    return found.unionByName(known.where("node <> rep").select(F.col("node").alias("u"), F.col("rep").alias("v")))


def duplicates(rows: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(file, pos) of located rows that belong to the group of another row, one that stays.

    Candidates are classes of fingerprints linked at MAX_BITS or fewer bits, in any of PRINTS. All rows of a class that
    share one of MINIMA minima of their shingles are compared, and linked if their five-word shingles have that Jaccard
    similarity (see alike). Groups are what is linked, directly or not; the first row by (doc_id, place) stays.
    """
    located_ = rows.select(F.col("row.doc_id").alias("doc_id"), "file", "pos", F.col("row.text").alias("text"))
    prints = stage(_prints(located_, False).withColumn("node", F.monotonically_increasing_id()), "simhash-prints")
    member = stage(candidates(prints), "simhash-members")
    held = marked(located_.drop("doc_id"), member.select("file", "pos")).join(member, ["file", "pos"])
    told = stage(_prints(held, True), "simhash-shingles")
    groups = told.select("doc_id", "file", "pos", "node").join(components(alike(told, similarity)), "node")
    stay = stage(groups.groupBy("component").agg(F.min(F.struct("doc_id", "file", "pos")).alias("stay")), "simhash-stay").select("stay.file", "stay.pos")
    return groups.select("file", "pos").join(stay, ["file", "pos"], "left_anti")


def _mixed(k: int):
    return lambda x: F.xxhash64(F.lit(k), x)


def deduplicate(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """docs without near copies (see duplicates), with all their columns. Texts without a word are copies of each other only."""
    rows = located(docs)
    return marked(rows, duplicates(rows, similarity), keep=False).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decide(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
