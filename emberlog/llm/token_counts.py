"""Token counts through a digest cache.

The cache is a table of (digest of the content, digest of the tokenizer, token count). Documents are joined to it
by digest; only distinct contents that it lacks are encoded, once each, and their counts are appended to it, so a
later run over the same or a grown corpus encodes just what is new. The tokenizer's digest covers its whole file
and the version of the library, so another version never meets old counts.

Encoding. Counts are those of the library for the file: `tokenizers` (.json) or `sentencepiece` (.model), without
begin, end or added special tokens, truncation or padding; special strings inside texts as the library's default
has them. For a byte-level BPE without a normaliser, whose pieces are encoded independently of each other, a task
keeps the library's counts of pieces it has met, which gives the same sums; other kinds are encoded whole.

Defined results. A null text counts as empty, with 0 bytes and 0 tokens. Repeated rows each have their row. An empty
table gives an empty result and leaves the cache as it was. Extra columns aren't read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import located, marked, new_dir, stage, table

TOKENIZER, LIMIT, MEMO = "byte_bpe_50k.json", 512, 400_000
CACHE = "content string, tokenizer string, n_tokens long"
#: Fixed value: how a byte-level pre-tokenizer parts a text, published with GPT-2; white space as Unicode has it.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def _plain(spec: dict) -> bool:
    """Whether pieces are encoded by themselves: byte-level BPE, split by PIECES, without normaliser or plain added tokens."""
    pre = spec.get("pre_tokenizer") or {}
    added = spec.get("added_tokens") or []
    return spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and (spec.get("model") or {}).get("type") == "BPE" and all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")) for t in added)


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function of texts that gives the token count of each."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    import regex
    from tokenizers import Tokenizer

    spec = json.loads(open(path, encoding="utf-8").read())
    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()

    def whole(texts: list[str]) -> list[int]:
        return [len(model.encode(t, add_special_tokens=False)) for t in texts]

    if not _plain(spec):
        return whole
    pieces = regex.compile(PIECES).findall
    added = [t["content"] for t in spec.get("added_tokens") or []]
    cut = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None

    class Counts(dict):
        def __missing__(self, piece: str) -> int:
            if len(self) > MEMO:
                self.clear()
            n = len(model.encode(piece, add_special_tokens=False))
            if len(piece) < 64:
                self[piece] = n
            return n

    memo = Counts()

    def plain(text: str) -> int:
        return sum(map(memo.__getitem__, pieces(text)))

    def one(text: str) -> int:
        if cut is None or not cut.search(text):
            return plain(text)
        return sum(map(plain, cut.split(text))) + len(cut.findall(text))

    return lambda texts: [one(t) for t in texts]


def version(path: str) -> str:
    """A digest of the tokenizer's file and of the version of the library that reads it."""
    from importlib.metadata import version as of

    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"\n{library} {of(library)}".encode()).hexdigest()


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE).parquet(cache)
    except AnalysisException:  # none yet
        return spark.range(0).select(F.lit("").alias("content"), F.lit("").alias("tokenizer"), F.col("id").alias("n_tokens"))


def count(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs.

    tokenizer: path of its file, the same on driver and executors. cache: folder of the cache, a new one by default.
    """
    spark, tag = docs.sparkSession, version(tokenizer)
    cache = cache or new_dir(spark, "token-cache")
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    rows = located(docs)
    keys = stage(rows.select(F.col("row.doc_id").alias("doc_id"), "file", "pos", F.sha2(text, 256).alias("content"), F.octet_length(text).cast("long").alias("n_bytes")), "token-keys")
    known = read_cache(spark, cache).where(F.col("tokenizer") == tag).dropDuplicates(["content"]).select("content", "n_tokens")
    one_each = keys.groupBy("content").agg(F.min(F.struct("file", "pos")).alias("at"))
    misses = stage(one_each.join(known, "content", "left_anti").select("content", "at.file", "at.pos"), "token-misses")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(tokenizer)
        for b in batches:
            if not b.num_rows:
                continue
            n = [counts([t.as_py()])[0] for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("content"), pa.array([tag] * b.num_rows, pa.string()), pa.array(n, pa.int64())], names=["content", "tokenizer", "n_tokens"])

    if not misses.isEmpty():
        # texts stay where they are read: the places of the misses go to them
        texts = marked(rows.select("file", "pos", text.alias("text")), misses.select("file", "pos")).select(F.sha2("text", 256).alias("content"), "text")
        texts.mapInArrow(run, CACHE).write.mode("append").parquet(cache)
    stored = read_cache(spark, cache).where(F.col("tokenizer") == tag).dropDuplicates(["content"]).select("content", "n_tokens")
    stored = stage(stored, "token-counts")  # so that the join with it can be split where a text is hot
    return keys.join(stored, "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
