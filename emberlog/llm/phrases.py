"""Phrase collocations by direct-address tiling: words that occur together far more often than each by itself.

Everything is exact, and per language. Words are counted first; those that occur `least` times, ranked by frequency,
become small numbers, and texts become arrays of them. A pair of neighbours is then an address, left * size + right. Addresses
fall into tiles of `TILE` x `TILE` ranks. A tile that fills up in a task, as those of the most frequent words do, is counted
by `bincount` into a dense array that the task keeps; what falls elsewhere is counted by sorting, as coordinates with
their counts, and merged as it grows. Frequent pairs are ranked in their turn, and the same step on the ranks of neighbouring
pairs counts phrases of three words, so that no phrase is counted whose parts are rare.

Tasks hold the ranks of `WORDS` words and of `PAIRS` pairs at most, the most frequent ones. What is ranked below them and
still frequent is told apart by a filter of `BITS` bits, which lets some rare ones through and loses none, and is
counted as it is: phrases with such a word as text, phrases of such a pair by their words' ranks. So results are exact at any size.

Counts are dealt out by a hash of the address, each task merging parts whose number grows with the words of the corpus.

Defined results. Null texts count as empty; a null language is `und`, together with documents that have that one. Repeated
rows count repeatedly, documents in one piece and split alike. An empty table gives an empty result. Extra columns, whatever
their names, aren't read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.llm.common import Scratch, pick, settings, stage, table, text_of

LEAST, TOP, SCALE, SUBSUMED = 10, 2000, 1_000_000, 50
TILE, FULL, TILES = 256, 8, 16  # ranks of a tile's side; a tile is dense from TILE**2 / FULL pairs of a chunk; dense tiles of a language, a quarter of those of a task
WORDS, PAIRS = 1 << 19, 1 << 21
BITS = 1 << 27  # 16 MB
CHUNK = 1 << 19  # bytes of text, and entries, that a task works on at a time
HELD = 1 << 17  # different words that a task counts before it passes them on, and words of a sequence taken at a time
PART = 1 << 20  # words of the corpus per part that counts are dealt out to
SALTS = 64
BREAK = b"\xff"  # in no UTF-8 text
_lower = bytes(c + 32 if 65 <= c <= 90 else 0xFF if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, BREAK between its pieces, in lists of bounded size that make one sequence."""
    at = 0
    while at < len(text):
        to = at + CHUNK
        if to < len(text):
            ends = [x for x in (text.find(b" ", to), text.find(b"\t", to), text.find(b"\n", to)) if x >= 0]
            to = min(ends) + 1 if ends else len(text)  # whole words
        yield text[at:to].translate(_lower).replace(BREAK, b" \xff ").split()
        at = to


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _merge(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates in order, each once, with their counts added up."""
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    begins = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.empty(0, np.int64)
    return codes[begins], np.add.reduceat(n, begins) if len(codes) else n


class Tiles:
    """Counts of addresses left * size + right: dense tiles, and sorted coordinates for the rest."""

    def __init__(self, size: int):
        self.size, self.dense, self.sparse, self.held = size, {}, [], 0

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        across = -(-self.size // TILE)
        tile = left // TILE * across + right // TILE
        near = tile < TILES * across  # only tiles of frequent words fill up
        n = np.bincount(tile[near])
        for t in np.flatnonzero(n).tolist():
            if t in self.dense or n[t] >= TILE * TILE // FULL and len(self.dense) < TILES:
                own = tile == t
                cells = np.bincount((left[own] % TILE) * TILE + right[own] % TILE, minlength=TILE * TILE)
                self.dense[t] = self.dense[t] + cells if t in self.dense else cells
                left, right, tile = left[~own], right[~own], tile[~own]
        self.add_codes(left * self.size + right, np.ones(len(left), np.int64))

    def add_codes(self, codes: np.ndarray, n: np.ndarray) -> None:
        """Counts of coordinates that needn't be pairs of ranks."""
        if len(codes):
            self.sparse.append(_merge(codes, n))
            self.held += len(self.sparse[-1][0])

    def take(self, last: bool) -> tuple[np.ndarray, np.ndarray]:
        """What was counted in coordinates, and in the tiles if nothing more follows; it is forgotten."""
        parts, self.sparse, self.held = self.sparse, [], 0
        if last:
            across = -(-self.size // TILE)
            for t, cells in self.dense.items():
                at = np.flatnonzero(cells)
                parts.append(((t // across * TILE + at // TILE) * self.size + t % across * TILE + at % TILE, cells[at]))
            self.dense = {}
        if not parts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return _merge(np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts]))


def _in_filter(bits: np.ndarray | None, hashes: np.ndarray) -> np.ndarray:
    if bits is None:
        return np.zeros(len(hashes), bool)
    at = hashes % np.uint64(BITS)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _filter_of(rest: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray | None:
    """A bit set for each row of rest, in BITS bits, None without rows; maps of 4 kB reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = (hashes(b) % np.uint64(BITS)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at)], names=["at"])

    bits = rest.mapInArrow(run, "at long").select(F.shiftright("at", 15).alias("b"), F.col("at").bitwiseAND((1 << 15) - 1).alias("p"))
    maps = bits.groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).toArrow()
    if not maps.num_rows:
        return None
    out = np.zeros(BITS // 8, np.uint8)
    for b, m in zip(maps["b"].to_pylist(), maps["m"], strict=True):
        out[b * 4096 : (b + 1) * 4096] = np.frombuffer(m.as_py(), np.uint8)
    return out


def _word_hash(lang: str, word: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word, xxh64_intdigest(lang.encode()))


def _word_hashes(b: pa.RecordBatch) -> np.ndarray:
    return np.array([_word_hash(lang, w) for lang, w in zip(b.column("lang").to_pylist(), b.column("word").to_pylist(), strict=True)], np.uint64)


def _code_hash(lang: str, codes: np.ndarray) -> np.ndarray:
    return _mix(codes.astype(np.uint64) ^ np.uint64(_word_hash(lang, b"")))


def _code_hashes(b: pa.RecordBatch) -> np.ndarray:
    langs, codes = b.column("lang").to_pylist(), b.column("code").to_numpy()
    return np.array([_code_hash(lang, codes[k : k + 1])[0] for k, lang in enumerate(langs)], np.uint64)


def _sum(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"))


def _texts(docs: DataFrame) -> DataFrame:
    rows = pick(docs, "lang", "text")
    return rows.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.encode(text_of(), "utf-8").alias("text"))


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(lang, text) with the texts of a batch that share a language joined, so that each makes few calls."""
    for b in batches:
        held: dict[str, list[bytes]] = {}
        size: Counter = Counter()
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
            t = text.as_py()
            held.setdefault(lang, []).append(t)
            size[lang] += len(t)
            if size[lang] > CHUNK:
                yield lang, b"\n".join(held.pop(lang))
                size[lang] = 0
        for lang, texts in held.items():
            yield lang, b"\n".join(texts)


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of every word, and with word null of all together. Words are UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, c in found.items():
                c.pop(BREAK, 0)
                words, n = list(c), np.fromiter(c.values(), np.int64, len(c))
                for k in range(0, len(words), CHUNK):
                    part = words[k : k + CHUNK]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part, pa.binary()), pa.array(n[k : k + CHUNK])], names=["lang", "word", "n"])
                if len(n):
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([None], pa.binary()), pa.array([int(n.sum())], pa.int64())], names=["lang", "word", "n"])
            found.clear()

        for lang, text in _each(batches):
            for words in words_of(text):
                found.setdefault(lang, Counter()).update(words)
            if sum(map(len, found.values())) > HELD:
                yield from flush()
        yield from flush()

    return _sum(_texts(docs).mapInArrow(run, "lang string, word binary, n long"), "lang", "word")


STEPS = 64  # levels of frequency to a doubling


def _ranked(rows: DataFrame, most: int, key: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(the most frequent rows, `most` of them at most, with their rank in their language from 0; the others)."""
    level = F.floor(F.log2("n") * STEPS).cast("int")
    least, held = None, 0
    for r in rows.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect():  # 64 * STEPS rows at most
        if held + r.n > most:
            least = r.level
            break
        held += r.n
    top, rest = (rows, rows.limit(0)) if least is None else (rows.where(level > least), rows.where(level <= least))
    # ranks by place in the whole order, without a task for each language
    order = [F.asc("lang"), F.desc("n"), F.asc(key)]
    placed = scratch.stage(top.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).cast("int").alias("part")
    begins, sizes = placed.groupBy("lang", part).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")), Counter()
    out = []
    for r in begins.orderBy("lang", "part").collect():  # as many rows as languages and partitions at most
        out.append((r.lang, r.part, sizes[r.lang] - r.first))
        sizes[r.lang] += r.n
    shift = scratch.stage(rows.sparkSession.createDataFrame(pa.table({k: pa.array([x[i] for x in out], kind) for i, (k, kind) in enumerate((("lang", pa.string()), ("part", pa.int32()), ("shift", pa.int64())))})))
    return placed.withColumn("part", part).join(F.broadcast(shift), ["lang", "part"]).withColumn("rank", F.col("at") + F.col("shift")).drop("at", "shift", "part"), rest


def encode(docs: DataFrame, top: DataFrame, rest: DataFrame) -> DataFrame:
    """(lang, ids, phrase, n): texts as arrays of ranks (int32, -1 where none or between pieces), or a phrase of
    two or three words, one of them ranked in no task, that occurs n times and may be frequent."""
    ordered = top.select("lang", "rank", "word").toArrow().sort_by([("lang", "ascending"), ("rank", "ascending")])  # as many rows as words are ranked at most
    with pa.BufferOutputStream() as out:
        with pa.ipc.new_stream(out, ordered.schema) as writer:
            writer.write_table(ordered)
        packed = out.getvalue().to_pybytes()
    shared = docs.sparkSession.sparkContext.broadcast((packed, _filter_of(rest.select("lang", "word"), _word_hashes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, bits = shared.value
        names: dict[str, dict[bytes, int]] = {}
        for b in pa.ipc.open_stream(packed):
            for lang, k, w in zip(b.column("lang").to_pylist(), b.column("rank").to_pylist(), b.column("word").to_pylist(), strict=True):
                names.setdefault(lang, {})[w] = k
        others: Counter = Counter()
        maybe: Callable[[str, bytes], bool] = (lambda lang, w: False) if bits is None else _maybe(bits)
        columns = ["lang", "ids", "phrase", "n"]

        def rows(lang: list, ids: list, phrase: list, n: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(ids, pa.binary()), pa.array(phrase, pa.binary()), pa.array(n, pa.int64())], names=columns)

        def flush() -> Iterator[pa.RecordBatch]:
            if others:
                yield rows([k[0] for k in others], [None] * len(others), [b" ".join(k[1:]) for k in others], list(others.values()))
                others.clear()

        for lang, text in _each(batches):
            get, made, tail = names.get(lang, {}).get, [], []
            for words in words_of(text):
                ids = np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))
                made.append(ids)
                if bits is not None:
                    # words that may be frequent beside the ranked ones; what is neither parts phrases
                    words, k = [*tail, *words], len(tail)
                    ok = [get(w, -1) >= 0 for w in words]
                    low = [not r and w != BREAK and maybe(lang, w) for r, w in zip(ok, words, strict=True)]
                    for size in (2, 3):
                        for end in (i for i in range(max(size - 1, k), len(words))):
                            own = range(end - size + 1, end + 1)
                            if any(low[i] for i in own) and all(low[i] or ok[i] for i in own):
                                others[(lang, *words[own[0] : end + 1])] += 1
                    tail = words[-2:]
                    if len(others) > HELD // 4:
                        yield from flush()
            if made:
                yield rows([lang], [np.concatenate(made).tobytes()], [None], [None])
        yield from flush()

    return _texts(docs).mapInArrow(run, "lang string, ids binary, phrase binary, n long")


def _maybe(bits: np.ndarray) -> Callable[[str, bytes], bool]:
    """Whether a word may be in the filter."""

    def one(lang: str, word: bytes) -> bool:
        at = _word_hash(lang, word) % BITS
        return bool(bits[at >> 3] >> (at & 7) & 1)

    return one


def _sequences(b: pa.RecordBatch, overlap: int) -> Iterator[tuple[str, np.ndarray]]:
    """(lang, ids) of each row in chunks that overlap by so many ids."""
    for lang, raw in zip(b.column("lang").to_pylist(), b.column("ids"), strict=True):
        ids = np.frombuffer(raw.as_buffer(), np.int32)
        for k in range(0, max(len(ids) - overlap, 0), HELD):
            yield lang, ids[k : k + HELD + overlap].astype(np.int64)


def _tiled(encoded: DataFrame, sizes: dict[str, int], parts: int, find: Callable, split: Callable, overlap: int, split_other: Callable | None = None) -> DataFrame:
    """(lang, other, code, x, y, n): codes that `find` gives of each chunk of ids, counted in tiles where they are read, then merged by parts.

    find: (left, right, codes) of a chunk: ranks of neighbours, whose code is left * size + right, and codes of others.
    split, split_other: x and y of codes of both kinds.
    """
    kind = "lang string, other boolean, part long, codes binary, ns binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: dict[tuple[str, bool], Tiles] = {}

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            for (lang, other), t in tiles.items():
                codes, n = t.take(last)
                part = (_mix(codes) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                begins = np.flatnonzero(np.concatenate(([True], np.diff(part[order]) != 0))) if len(order) else []
                out = [(int(part[own[0]]), codes[own].tobytes(), n[own].tobytes()) for own in np.split(order, begins[1:])] if len(order) else []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(out)), pa.array([other] * len(out)), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], names=["lang", "other", "part", "codes", "ns"])

        for b in batches:
            for lang, ids in _sequences(b, overlap):
                left, right, codes = find(lang, ids)
                if len(left):
                    tiles.setdefault((lang, False), Tiles(sizes[lang])).add(left, right)
                if len(codes):
                    tiles.setdefault((lang, True), Tiles(1)).add_codes(codes, np.ones(len(codes), np.int64))
                if (many := sum(len(t.dense) for t in tiles.values()) > 4 * TILES) or sum(t.held for t in tiles.values()) > CHUNK:
                    yield from flush(many)
        yield from flush(True)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size = None, [], 0

        def close(done: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if held:
                codes, n = _merge(np.concatenate([c for c, _ in held]), np.concatenate([n for _, n in held]))
                held, size = [(codes, n)], 0
                if done:
                    held = []
                    codes, n = codes[n >= LEAST], n[n >= LEAST]
                    yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(codes), pa.string()), pa.array([key[1]] * len(codes), pa.bool_()), *map(pa.array, (codes, *(split_other if key[1] else split)(key[0], codes), n))], names=["lang", "other", "code", "x", "y", "n"])

        for b in batches:
            for lang, other, part, codes, ns in zip(b.column("lang").to_pylist(), b.column("other").to_pylist(), b.column("part").to_pylist(), b.column("codes"), b.column("ns"), strict=True):
                if (lang, other, part) != key:
                    yield from close(True)
                    key = lang, other, part
                held.append((np.frombuffer(codes.as_py(), np.int64), np.frombuffer(ns.as_py(), np.int64)))
                size += len(held[-1][0])
                if size > CHUNK:
                    yield from close(False)
        yield from close(True)

    dealt = encoded.mapInArrow(count, kind).repartition("lang", "other", "part").sortWithinPartitions("lang", "other", "part")
    return dealt.mapInArrow(merge, "lang string, other boolean, code long, x long, y long, n long")


def _parts(words: int) -> int:
    return max(1, -(-words // PART))


BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def mine(docs: DataFrame, top: int = TOP, most_words: int = WORDS, most_pairs: int = PAIRS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each language of docs (lang, text).

    most_words, most_pairs: how many words and pairs tasks know the ranks of; the results are the same with any.
    """
    with settings(docs.sparkSession, BATCH):
        return _mine(docs, top, most_words, most_pairs)


def _mine(docs: DataFrame, top: int, most_words: int, most_pairs: int) -> DataFrame:
    spark = docs.sparkSession
    scratch = Scratch(spark, "phrases")
    counted = scratch.stage(count_words(docs).where(F.col("word").isNull() | (F.col("n") >= LEAST)))
    totals, words = counted.where("word is null").select("lang", F.col("n").alias("total")), counted.where("word is not null")
    parts = _parts(totals.agg(F.sum("total")).first()[0] or 0)
    known, unranked = _ranked(words, most_words, "word", scratch)
    known = scratch.stage(known)
    sizes = {r.lang: r.size for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("size")).collect()}  # a row per language of ranked words
    encoded = scratch.stage(encode(docs, known, unranked))
    ids, written = encoded.where("ids is not null").select("lang", "ids"), encoded.where("ids is null")
    written = scratch.stage(_sum(written, "lang", "phrase").where(F.col("n") >= LEAST).withColumn("words", F.split(F.decode("phrase", "utf-8"), " ")))

    def neighbours(lang: str, x: np.ndarray) -> tuple:
        both = (x[:-1] >= 0) & (x[1:] >= 0)
        return x[:-1][both], x[1:][both], ()

    met = scratch.stage(_tiled(ids, sizes, parts, neighbours, lambda lang, codes: divmod(codes, sizes[lang]), 1))
    ranked, lower = _ranked(met.select("lang", "code", F.col("x").alias("i"), F.col("y").alias("j"), "n"), most_pairs, "code", scratch)
    ranked = scratch.stage(ranked)

    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    taken = ranked.select("lang", "code", "rank").toArrow()  # as many rows as pairs are ranked at most
    langs = taken["lang"].to_numpy()
    codes, ranks = taken["code"].to_numpy(), taken["rank"].to_numpy()
    for lang in set(langs.tolist()):
        own = langs == lang
        order = np.argsort(codes[own])
        held[lang] = codes[own][order], ranks[own][order]
    del taken, langs, codes, ranks
    shared = spark.sparkContext.broadcast((held, _filter_of(lower.select("lang", "code"), _code_hashes), sizes))
    pair_sizes = {lang: len(c) for lang, (c, _) in held.items()}

    def triples(lang: str, x: np.ndarray) -> tuple:
        held, bits, sizes = shared.value
        none = np.empty(0, np.int64)
        codes, ranks = held.get(lang, (none, none))
        size = sizes.get(lang, 1)
        both = (x[:-1] >= 0) & (x[1:] >= 0)
        pair = np.where(both, x[:-1] * size + x[1:], -1)
        at = np.minimum(np.searchsorted(codes, pair), max(len(codes) - 1, 0))
        rank = np.where(both & (codes[at] == pair), ranks[at], -1) if len(codes) else np.full(len(pair), -1)
        whole = (rank[:-1] >= 0) & (rank[1:] >= 0)
        if bits is None:
            return rank[:-1][whole], rank[1:][whole], ()
        maybe = (rank >= 0) | both & _in_filter(bits, _code_hash(lang, pair))
        rest = maybe[:-1] & maybe[1:] & ~whole
        return rank[:-1][whole], rank[1:][whole], (pair[:-1] * size + x[2:])[rest]

    def halves(lang: str, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both pairs of the code of three words."""
        size = sizes[lang]
        x = codes // size
        return x, x % size * size + codes % size

    three = scratch.stage(_tiled(ids, pair_sizes, parts, triples, lambda lang, codes: divmod(codes, pair_sizes[lang]), 2, halves))

    # from ranks to words; frequencies come with them
    name = F.decode("word", "utf-8")
    word = lambda k, w, f: known.select("lang", F.col("rank").alias(k), name.alias(w), F.col("n").alias(f))
    own = ranked.unionByName(lower.withColumn("rank", F.lit(None).cast("long"))).withColumnRenamed("rank", "pair")
    two = own.join(word("i", "w1", "f1"), ["lang", "i"]).join(word("j", "w2", "f2"), ["lang", "j"]).select("lang", "code", "pair", "w1", "w2", "f1", "f2", F.col("n").alias("a"))
    freq = lambda w, f: words.select("lang", name.alias(w), F.col("n").alias(f))
    more = written.where(F.size("words") == 2).select("lang", F.lit(None).cast("long").alias("code"), F.lit(None).cast("long").alias("pair"), F.col("words")[0].alias("w1"), F.col("words")[1].alias("w2"), F.col("n").alias("a"))
    more = more.join(freq("w1", "f1"), ["lang", "w1"]).join(freq("w2", "f2"), ["lang", "w2"])
    two = scratch.stage(two.unionByName(more))

    left = two.select("lang", F.col("pair").alias("x"), "w1", "w2", "f1", F.col("a").alias("f12"))
    right = two.select("lang", F.col("pair").alias("y"), F.col("w2").alias("w3"), F.col("f2").alias("f3"), F.col("a").alias("f23"))
    tiled = three.where("not other").select("lang", "x", "y", F.col("n").alias("a"))
    cols = ["lang", "w1", "w2", "w3", "a", "f1", "f3", "f12", "f23"]
    triple = tiled.join(left, ["lang", "x"]).join(right, ["lang", "y"]).select(*cols)
    if not lower.isEmpty():
        left = two.select("lang", F.col("code").alias("x"), "w1", "w2", "f1", F.col("a").alias("f12"))
        right = two.select("lang", F.col("code").alias("y"), F.col("w2").alias("w3"), F.col("f2").alias("f3"), F.col("a").alias("f23"))
        coded = three.where("other").select("lang", "x", "y", F.col("n").alias("a"))
        triple = triple.unionByName(coded.join(left, ["lang", "x"]).join(right, ["lang", "y"]).select(*cols))
    if not unranked.isEmpty():
        w = F.col("words")
        texts = written.where(F.size("words") == 3).select("lang", w[0].alias("w1"), w[1].alias("w2"), w[2].alias("w3"), F.col("n").alias("a"))
        left = two.select("lang", "w1", "w2", "f1", F.col("a").alias("f12"))
        right = two.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("f2").alias("f3"), F.col("a").alias("f23"))
        triple = triple.unionByName(texts.join(left, ["lang", "w1", "w2"]).join(right, ["lang", "w2", "w3"]).select(*cols))
    triple = scratch.stage(triple)

    inside = triple.select("lang", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"), "a")
    inside = inside.groupBy("lang", "p.w1", "p.w2").agg(F.max("a").alias("most"))
    kept = two.join(inside, ["lang", "w1", "w2"], "left").where(F.col("most").isNull() | (100 * F.col("most") < SUBSUMED * F.col("a")))
    pairs = kept.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), score(F.col("a"), F.col("f1"), F.col("f2")).alias("score"))
    one, other = score(F.col("a"), F.col("f1"), F.col("f23")), score(F.col("a"), F.col("f12"), F.col("f3"))
    cut = triple.withColumns({"one": one, "other": other})
    early = F.col("one") <= F.col("other")
    longer = cut.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(early, F.col("f1")).otherwise(F.col("f12")).alias("l"), F.when(early, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("one", "other").alias("score"))
    every = pairs.unionByName(longer)

    # the first of each share of a language, and of these the first of all
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = every.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= top)
    first = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    out = stage(first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score"), "phrases-out")  # top rows a language
    scratch.clear()
    return out


def score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(SCALE * a * a / (l * r)), exactly: products of up to 38 digits."""
    wide = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(SCALE).cast("decimal(7,0)"), wide(l) * wide(r)).cast("long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM d
), g AS (
  SELECT lang, k, unnest([array_to_string(list_slice(ws, i, i + k - 1), ' ') FOR i IN range(1, len(ws) - k + 2)]) AS phrase FROM w, (VALUES (1), (2), (3)) AS s(k)
), f AS (
  SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL
), n AS (
  SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= {LEAST}
), cut AS (
  SELECT c.lang, c.phrase, c.a, k1, l.a AS l, r.a AS r, ({SCALE}::HUGEINT * c.a * c.a) // (l.a::HUGEINT * r.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS k1 FROM c) AS c
  JOIN f AS l ON l.lang = c.lang AND l.k = c.k1 AND l.phrase = array_to_string(list_slice(ws, 1, k1), ' ')
  JOIN f AS r ON r.lang = c.lang AND r.k = c.k - c.k1 AND r.phrase = array_to_string(list_slice(ws, k1 + 1, c.k), ' ')
), low AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k1) = 1
), inside AS (
  SELECT lang, unnest([array_to_string(list_slice(ws, 1, 2), ' '), array_to_string(list_slice(ws, 2, 3), ' ')]) AS phrase, a FROM c WHERE k = 3
), most AS (
  SELECT lang, phrase, max(a) AS most FROM inside GROUP BY ALL
), kept AS (
  SELECT low.*, n.n FROM low JOIN n USING (lang) LEFT JOIN most USING (lang, phrase) WHERE most IS NULL OR 100 * most < {SUBSUMED} * low.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept QUALIFY rank <= {TOP}
"""
