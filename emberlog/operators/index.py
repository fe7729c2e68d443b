"""An inverted index of stored logs that grows with them: a segment of postings for each batch, merged when days are compacted.

A posting is a token's place in a row's text: (token, id, ingest_batch, pos). A segment is dealt out by rows, as they are read,
and each of its files is in order of tokens, so that postings are neither sampled nor shuffled to be stored, a frequent token
lies in all files, and a search reads the pages of each file that may hold its own. Phrases are found by places: words whose places less their ranks in
the phrase agree. Nothing is deleted from a segment: a row that was replaced or purged is no longer among the current
rows, which hits are joined with by id and batch. A small file names the segments and the writes of the batches in them;
rows of batches that no segment holds as they are now are searched by their text, so that the answer is always that of a scan.
"""

from __future__ import annotations

import json
import operator
import re
import uuid
from collections.abc import Iterable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.predicates import search
from emberlog.functions.text import searchable, split_tokens, tokens
from emberlog.operators import sinks as K

POSTING = "token string, id string, ingest_batch string, pos int"


def postings(rows: DataFrame) -> DataFrame:
    """(token, id, ingest_batch, pos) of rows: each token of their searchable text with its place."""
    return rows.select("id", "ingest_batch", F.posexplode(tokens(searchable())).alias("pos", "token")).select("token", "id", "ingest_batch", "pos")


def _last(spark: SparkSession, path: str) -> tuple[int, dict[str, dict[str, list[str]]]]:
    """(number, {segment: {batch: writes}}) of the index as it is."""
    numbers = [int(m[1]) for n in K._names(spark, f"{path}/_index") if (m := re.fullmatch(r"(\d+)\.json", n))]
    if not numbers:
        return 0, {}
    fs, hadoop = K._filesystem(spark, path)
    stream = fs.open(hadoop.Path(f"{path}/_index/{max(numbers):012}.json"))
    try:
        return max(numbers), json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def _commit(spark: SparkSession, path: str, number: int, segments: dict) -> None:
    fs, hadoop = K._filesystem(spark, path)
    target, temporary = hadoop.Path(f"{path}/_index/{number:012}.json"), hadoop.Path(f"{path}/_index/_{uuid.uuid4().hex}")
    out = fs.create(temporary)
    out.write(bytearray(json.dumps(segments).encode()))
    out.close()
    if fs.exists(target) or not fs.rename(temporary, target):
        raise RuntimeError(f"index {number} of {path} was written by another run")


def _write(rows: DataFrame, folder: str) -> None:
    """A segment, each file of it in order of tokens; all postings of a row of `rows` that a task reads stay in that task."""
    rows.sortWithinPartitions("token", "id", "pos").write.option("parquet.bloom.filter.enabled#token", "true").mode("overwrite").parquet(folder)


def _gone(spark: SparkSession, path: str, index: DataFrame, current: DataFrame) -> DataFrame:
    """(id, ingest_batch) of indexed rows that are no longer current, stored, so that the planner knows whether they are few.

    The first token of a row stands for it. Stored beside the segments, in none of which it is, for the next merge to delete.
    """
    folder = f"{path}/_index/segment-{uuid.uuid4().hex}"
    rows = index.where("pos = 0").select("id", "ingest_batch")
    rows.join(current.select("id", "ingest_batch"), ["id", "ingest_batch"], "left_anti").write.parquet(folder)
    return spark.read.schema("id string, ingest_batch string").parquet(folder)


def index_batch(spark: SparkSession, path: str, batch_id: str) -> None:
    """Adds the segment of a batch that was just written, or written again."""
    writes = sorted({w for _, w, _ in K._files(spark, f"{path}/ingest_batch={batch_id}")})
    number, segments = _last(spark, path)
    name = f"segment-{uuid.uuid4().hex}"
    _write(postings(K._read_batches(spark, path, [batch_id])), f"{path}/_index/{name}")
    kept = {s: {b: w for b, w in held.items() if b != batch_id} for s, held in segments.items()}
    _commit(spark, path, number + 1, {s: held for s, held in kept.items() if held} | {name: {batch_id: writes}})


def forget_changed(spark: SparkSession, path: str) -> None:
    """Batches that were written again since they were indexed are left to scans, until they are indexed anew."""
    number, segments = _last(spark, path)
    live = K._batches(spark, path, K.last_version(spark, path))
    changed = {b for held in segments.values() for b, writes in held.items() if b in live and not {w for _, w, _ in live[b]} <= set(writes)}
    if changed:
        _commit(spark, path, number + 1, {s: rest for s, held in segments.items() if (rest := {b: w for b, w in held.items() if b not in changed})})


def merge_index(spark: SparkSession, path: str) -> None:
    """Puts all segments, and compacted rows that are in none, into one, without the postings of rows that are no longer current.

    The segments that it came from are deleted by the next merge, for searches that began before.
    """
    forget_changed(spark, path)
    number, segments = _last(spark, path)
    fs, hadoop = K._filesystem(spark, path)
    for name in K._names(spark, f"{path}/_index"):
        if name.startswith("segment-") and name not in segments:
            fs.delete(hadoop.Path(f"{path}/_index/{name}"), True)
    batches = {b: w for held in segments.values() for b, w in held.items()}
    version = K.last_version(spark, path)
    base = K._read_base(spark, path, version)
    lacking = [] if base is None else [r.ingest_batch for r in base.where(~F.col("ingest_batch").isin(sorted(batches))).select("ingest_batch").distinct().collect()]  # a name per batch
    lacking = sorted(set(lacking) - set(K._batches(spark, path, version)))
    if len(segments) < 2 and not lacking:
        return
    current = K.read_logs(spark, path)
    name = f"segment-{uuid.uuid4().hex}"
    index = _read(spark, path, segments)
    kept = index.join(_gone(spark, path, index, current), ["id", "ingest_batch"], "left_anti").select("token", "id", "ingest_batch", "pos")
    if lacking:
        kept = kept.unionByName(postings(current.where(F.col("ingest_batch").isin(lacking))))
    _write(kept, f"{path}/_index/{name}")
    _commit(spark, path, number + 1, {name: batches | {b: [] for b in lacking}})


def _read(spark: SparkSession, path: str, segments: dict) -> DataFrame:
    """The postings of the batches that each segment stands for; the one of a batch that was indexed again has newer ones elsewhere."""
    parts = [spark.read.schema(POSTING).parquet(f"{path}/_index/{s}").where(F.col("ingest_batch").isin(sorted(held))) for s, held in sorted(segments.items())]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], POSTING)


def find(index: DataFrame, terms: Iterable[str]) -> DataFrame:
    """(id, ingest_batch) of the rows of postings that hold every term: its tokens in a row, the last as a prefix."""
    phrases = [split_tokens(t) for t in terms]
    if not all(phrases):
        return index.select("id", "ingest_batch").where(F.lit(False))
    words = [(j, k, w, k == len(ws) - 1) for j, ws in enumerate(phrases) for k, w in enumerate(ws)]
    is_word = lambda w, last: F.col("token").startswith(w) if last else F.col("token") == w
    index = index.where(reduce(operator.or_, [is_word(w, last) for _, _, w, last in words]))
    met = F.array_compact(F.array(*[F.when(is_word(w, last), F.struct(F.lit(j).alias("j"), F.lit(k).alias("k"))) for j, k, w, last in words]))
    met = index.select("id", "ingest_batch", "pos", F.explode(met).alias("m")).select("id", "ingest_batch", "m.j", "m.k", (F.col("pos") - F.col("m.k")).alias("begin"))
    sizes = F.element_at(F.array(*[F.lit(len(ws)) for ws in phrases]), F.col("j") + 1)
    longest = max(len(phrases), *map(len, phrases))
    held = lambda c: F.bit_count(F.bit_or(F.expr(f"shiftleft(1L, {c})"))) if longest < 64 else F.count_distinct(c)  # noqa: E731  bits are merged where rows are read
    whole = met.groupBy("id", "ingest_batch", "j", "begin").agg(held("k").alias("n")).where(F.col("n") == sizes)
    return whole.groupBy("id", "ingest_batch").agg(held("j").alias("n")).where(F.col("n") == len(phrases)).select("id", "ingest_batch")


def search_stored(spark: SparkSession, path: str, filters: Iterable = (), terms: Iterable[str] = (), start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """The current rows of a store that all filters, terms and bounds hold for; terms are looked up in the index as far as it goes."""
    rows, terms = K.read_logs(spark, path), list(terms)
    if not terms:
        return search(rows, filters, (), start, end)
    segments = _last(spark, path)[1]
    live = K._batches(spark, path, K.last_version(spark, path))
    held = {b for s in segments.values() for b, writes in s.items() if b not in live or {w for _, w, _ in live[b]} <= set(writes)}
    within = search(rows, filters, (), start, end)
    known = F.coalesce(F.col("ingest_batch").isin(sorted(held)), F.lit(False)) if held else F.lit(False)
    hits = find(_read(spark, path, segments), terms)
    return within.where(known).join(hits, ["id", "ingest_batch"], "left_semi").select(*within.columns).unionByName(search(within.where(~known), (), terms))
