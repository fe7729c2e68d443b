"""Deterministic sharded WARC archives: written in key order, committed by renames and a manifest, and read back.

Payload digests are grouped first: of records with equal payloads of `LEAST` bytes or more, that with the smallest
page_id is a response and the others revisit it, without a body. Shards are ranges of page_id, found from exact
sums of payload bytes over slots of the key range, so their bounds depend on nothing but the data; the rows of a
page_id that is larger than a shard, and those without one, are dealt out over shards of their own by digest. Each shard is one task. Within a shard
records are sorted, each becomes a gzip member with headers and digests made anew, and a file rolls once its
compressed size reaches `roll`. Record ids follow from page_id and digest and dates are a parameter: the same
pages always give the same bytes.

A task writes under temporary names and hands on a row of the manifest for each file. Only rows of attempts that
Spark accepted are renamed to final names; the manifest is written last, and a reader takes just the files it
names. What a lost executor leaves is a temporary file that nothing names. Renames may be repeated.

Defined results. Null payloads count as empty. A null page_id leaves its header out and reads back as null, as does
a null url, whose target is then a name of the record; a url with white space is escaped and kept beside it;
rows with null page_ids are never revisits of each other but of a page with an id. Rows that repeat page_id and
payload are all responses if theirs is the smallest page_id, and lie in one shard. An empty table gives no file and an empty result.
Extra columns aren't read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import new_dir, pick, stage, table, text_of

LEAST, DATE = 100, "1970-01-01T00:00:00Z"
SLOTS = 4096
MANIFEST = "name string, temporary string, shard long, part long, records long, bytes long, sha256 string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, date: str) -> bytes:
    """One WARC record; refers_to: page_id of the response that it revisits, None for a response."""
    revisit = refers_to is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (b"" if revisit else payload)
    target = record_id(page_id, digest)[1:-1] if url is None else quote(url, safe="".join(chr(c) for c in range(33, 127)))
    kept = [] if url is None or target == url else [f"X-Target-Base64: {base64.urlsafe_b64encode(url.encode()).decode()}"]
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}", *kept, *(["X-Target-Missing: true"] if url is None else []),
        "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"] if revisit else []),
        *([] if page_id is None else [f"X-Page-Id: {page_id}"]), f"X-Payload-Length: {size}", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(stream) -> Iterator[tuple]:
    """The rows (see RECORD) of a decompressed archive; raises ValueError where a digest doesn't hold."""
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError("not at the start of a record")
        head: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode().partition(": ")
            head[name] = value
        block = stream.read(int(head["Content-Length"]))
        stream.read(4)
        if f"sha256:{hashlib.sha256(block).hexdigest()}" != head["WARC-Block-Digest"]:
            raise ValueError(f"block digest of {head['WARC-Record-ID']}")
        kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:")
        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
        if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload digest of {head['WARC-Record-ID']}")
        url = base64.urlsafe_b64decode(head["X-Target-Base64"]).decode() if "X-Target-Base64" in head else None if "X-Target-Missing" in head else head["WARC-Target-URI"]
        whole = lambda k: int(head[k]) if k in head else None
        yield whole("X-Page-Id"), url, whole("X-Payload-Length"), digest, kind, whole("X-Refers-To-Page"), None if payload is None else payload.decode()


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _unsigned(ids: np.ndarray) -> np.ndarray:
    """Longs in the same order from 0, so that no difference of two overflows."""
    return ids.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)


def _slot_sums(keys: DataFrame, ranges: list[tuple[int, int, int]]) -> dict[int, list[tuple[int, int]]]:
    """By place in ranges (begin, end, width of a slot; in order, apart): (slot, bytes) of the slots that have rows, in one job."""
    begins, ends, widths = (np.array(x, np.uint64) for x in zip(*ranges, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, n = _unsigned(b.column("page_id").to_numpy()), b.column("n").to_numpy()
            at = np.searchsorted(begins, ids, "right") - 1
            own = (at >= 0) & (ids <= ends[at])
            at, ids, n = at[own], ids[own], n[own]
            cells, which = np.unique(np.stack([at.astype(np.uint64), (ids - begins[at]) // widths[at]]), axis=1, return_inverse=True)
            sums = np.zeros(cells.shape[1], np.int64)
            np.add.at(sums, which.ravel(), n)
            yield pa.RecordBatch.from_arrays([pa.array(cells[0].astype(np.int64)), pa.array(cells[1].astype(np.int64)), pa.array(sums)], names=["range", "slot", "n"])

    found: dict[int, list[tuple[int, int]]] = {}
    for r in keys.select("page_id", "n").where("page_id is not null").mapInArrow(run, "range long, slot long, n long").groupBy("range", "slot").agg(F.sum("n").alias("n")).orderBy("range", "slot").collect():
        found.setdefault(r.range, []).append((r.slot, r.n))
    return found


def bounds(keys: DataFrame, target: int) -> list[int]:
    """Largest page_id of each shard but the last, for shards of about `target` payload bytes.

    Sums over slots of the key range reach the driver; those that are too large are divided again, all in one job, into
    slots in proportion to their bytes, so that no round brings more than a few numbers for each shard.
    """
    span = keys.agg(F.min("page_id"), F.max("page_id")).first()
    if span[0] is None:
        return []
    lo, hi = (int(x) + (1 << 63) for x in span)
    parts: list[tuple[int, int, int | None]] = [(lo, hi, None)]  # begin, end, bytes (not known yet: None)
    while heavy := [k for k, (a, b, n) in enumerate(parts) if n is None or n > 4 * target and b > a]:
        slots = [SLOTS if parts[k][2] is None else max(2, min(SLOTS, 8 * parts[k][2] // target)) for k in heavy]
        ranges = [(parts[k][0], parts[k][1], (parts[k][1] - parts[k][0]) // s + 1) for k, s in zip(heavy, slots, strict=True)]
        found, which = _slot_sums(keys, ranges), {k: i for i, k in enumerate(heavy)}
        divided = []
        for k, part in enumerate(parts):
            if k not in which:
                divided.append(part)
                continue
            a, b, width = ranges[which[k]]
            divided += [(a + s * width, min(b, a + (s + 1) * width - 1), int(n)) for s, n in found.get(which[k], [])]
        parts = divided

    out, held = [], 0
    for _, end, n in parts:
        held += n
        if held >= target:
            out.append(end - (1 << 63))
            held = 0
    return out[:-1] if out and out[-1] >= span[1] else out


def write(pages: DataFrame, folder: str, *, shard: int | None = None, roll: int = 64 << 20, date: str = DATE) -> DataFrame:
    """Archives pages (page_id, url, html) in folder, whose manifest it returns.

    shard: payload bytes of a shard, a 64th of all within 8 to 256 MB by default. roll: compressed bytes of a file.
    """
    spark = pages.sparkSession
    rows = pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), "url", text_of("html").alias("html"))
    rows = rows.withColumns({"digest": F.sha2("html", 256), "n": F.octet_length("html").cast("long")})
    keys = stage(rows.select("page_id", "digest", "n"), "warc-keys")
    groups = keys.where(F.col("n") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1 and first is not null").drop("rows")
    groups = stage(groups, "warc-groups")  # so that the join with it can be split where a payload is hot
    total = keys.agg(F.sum("n")).first()[0] or 0
    target = shard or min(max(total // 64, 8 << 20), 256 << 20)
    ends = spark.sparkContext.broadcast(np.array(bounds(keys, target), np.int64))  # a number per shard
    ranges = len(ends.value) + 1
    heavy = keys.groupBy("page_id").agg(F.sum("n").alias("n")).where(F.col("page_id").isNull() | (F.col("n") > target)).orderBy(F.col("page_id").asc_nulls_first()).collect()  # total / target rows at most, and one
    own, count = {}, ranges  # page_id -> (first shard, shards) of those dealt out by digest
    for r in heavy:
        own[r.page_id] = (count, n := max(1, -(-int(r.n) // target)))
        count += n
    ids = sorted(k for k in own if k is not None)
    dealt_out = spark.sparkContext.broadcast((np.array(ids, np.int64), np.array([own[k] for k in ids], np.int64).reshape(-1, 2), own.get(None)))

    @F.arrow_udf("long")
    def shard_of(page_id: pa.Array, digest: pa.Array) -> pa.Array:
        large, place, missing = dealt_out.value
        page, null = page_id.fill_null(0).to_numpy(zero_copy_only=False), page_id.is_null().to_numpy(zero_copy_only=False)
        at = np.searchsorted(ends.value, page, "left")
        k = np.minimum(np.searchsorted(large, page), max(len(large) - 1, 0))
        mine = ~null & (large[k] == page) if len(large) else np.zeros(len(page), bool)
        for i in np.flatnonzero(mine | null):
            first, n = missing if null[i] else place[k[i]]
            at[i] = first + int(digest[int(i)].as_py()[:8], 16) % n
        return pa.array(at, pa.int64())

    # a mark (without html) goes before the rows that are revisits, so that payloads move once and meet no join
    marks = keys.join(groups, "digest").where(~F.col("page_id").eqNullSafe(F.col("first")))
    marks = marks.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "n", F.col("first").alias("refers_to"))
    both = rows.withColumn("refers_to", F.lit(None).cast("long")).unionByName(marks).withColumn("shard", shard_of("page_id", "digest"))
    dealt = both.repartitionById(count, F.col("shard").cast("int")).sortWithinPartitions("shard", "page_id", "digest", F.col("refers_to").desc_nulls_last(), "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(folder)
        store.create_dir(f"{root}/_temporary", recursive=True)
        out, now, mark, made = None, None, (), []

        def close() -> None:
            if out is not None:
                out["stream"].close()
                made.append((out["name"], out["temporary"], *now, out["records"], out["bytes"], out["sha"].hexdigest()))

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("shard", "page_id", "url", "digest", "n", "refers_to", "html")), strict=True):
                if r[5] is not None:
                    mark = r[1], r[3], r[5]
                    continue
                refers_to = mark[2] if mark[:2] == (r[1], r[3]) else None
                if out is None or now[0] != r[0] or out["bytes"] >= roll:
                    close()
                    now = (r[0], now[1] + 1 if now is not None and now[0] == r[0] else 0)
                    name = f"part-{now[0]:06d}-{now[1]:04d}.warc.gz"
                    temporary = f"_temporary/{name}.{uuid.uuid4().hex}"
                    out = {"name": name, "temporary": temporary, "stream": store.open_output_stream(f"{root}/{temporary}", compression=None), "records": 0, "bytes": 0, "sha": hashlib.sha256()}
                member = gzip.compress(record(r[1], r[2], r[6].encode(), r[3], r[4], refers_to, date), 6, mtime=0)
                out["stream"].write(member)
                out["sha"].update(member)
                out["bytes"] += len(member)
                out["records"] += 1
        close()
        names = [x.split()[0] for x in MANIFEST.split(", ")]
        yield pa.RecordBatch.from_pandas(pd.DataFrame(made, columns=names).astype({c: "int64" for c in names[2:6]}), preserve_index=False)

    def commit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = _filesystem(folder)
        for pdf in batches:
            for a, b in zip(pdf["temporary"], pdf["name"], strict=True):
                if store.get_file_info(f"{root}/{a}").type != fs.FileType.NotFound:  # else renamed before
                    store.move(f"{root}/{a}", f"{root}/{b}")
            yield pdf

    pending = stage(dealt.mapInArrow(run, MANIFEST), "warc-pending")
    pending.mapInPandas(commit, MANIFEST).write.parquet(f"{folder}/_manifest")
    return spark.read.parquet(f"{folder}/_manifest")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records (see RECORD) of the archives that the folder's manifest names."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")
    if manifest.isEmpty():
        return spark.createDataFrame([], RECORD)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.gz").load(folder)
    named = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(manifest.select("name"), "name", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for b in batches:
            for content in b.column("content"):
                rows, size = [], 0
                for r in parse(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())))):
                    rows.append(r)
                    size += len(r[6] or "")
                    if size > 4 << 20:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    return named.select("content").mapInArrow(run, RECORD)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_dir(spark, "warc")
    write(table(spark, sf_dir, "pages"), folder)
    return read(spark, folder).drop("payload", "url")


ORACLE = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages
), g AS (
  SELECT *, CASE WHEN n >= {LEAST} THEN min(page_id) OVER (PARTITION BY digest) END AS first FROM p
)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM g
"""
