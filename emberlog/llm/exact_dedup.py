"""Exact deduplication by a streaming keyed state, on disk and without expiry.

The state maps a digest of the text to the number of rows seen, the stable identifier of the row that stays
(largest doc_id) and its content locator (file and position). Rows reach it as a stream, so a store can be fed
again and again; RocksDB keeps it on disk, its snapshots lie in the shared folder. A digest that was seen
before is a hit: the whole bytes of its rows are compared, and rows that share a digest but not their bytes
are grouped by their bytes instead.

A store may be given rows that it has seen, as after a run that was lost, or with a table that has grown: rows are told
by the file and place that they are stored at, and counted once. A store that no caller named is deleted.

Defined results. Null texts count as empty. Null doc_ids are the smallest. Of rows that repeat both doc_id and
text, the one stored last stays. An empty table gives an empty result. Extra columns pass through `deduplicate`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import located, marked, new_dir, remove, settings, stage, table

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition sets aside some MB of disk
}


SALTS = 32  # tasks that share the rows of one digest while their bytes are compared


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _feed(spark: SparkSession, store: str) -> DataFrame:
    """Runs the rows that are new in the store's keys through its state; returns the state, a row per digest."""
    schema = spark.read.parquet(f"{store}/keys/*").schema
    seen = (
        spark.readStream.schema(schema).parquet(f"{store}/keys/*")
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "file", "pos")).alias("keep"))
    )
    with settings(spark, STATE):
        query = (
            seen.writeStream.outputMode("update")
            .option("checkpointLocation", f"{store}/checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{store}/state/batch={k}"))
            .start()
        )
        query.awaitTermination()
    return spark.read.option("basePath", f"{store}/state").parquet(f"{store}/state/*").groupBy("digest").agg(F.max(F.struct("n", "keep")).alias("s")).select("digest", "s.n", "s.keep")


def _written(spark: SparkSession, store: str) -> list[str]:
    """Folders of keys that were written to the end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/keys")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getParent().toString() for f in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{store}/keys/*/_SUCCESS")) or [])


def _write_keys(keys: DataFrame, store: str) -> None:
    """Writes the keys of the rows that the store hasn't seen, under a name that follows from the rows' places."""
    spark = keys.sparkSession
    if known := _written(spark, store):  # a row is told by the place that it is stored at
        keys = keys.join(spark.read.parquet(*known).select("file", "pos"), ["file", "pos"], "left_anti").select(*keys.columns)
    n, a, b = keys.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("file", "pos")), F.bit_xor(F.xxhash64(F.lit(1), "file", "pos"))).first()
    if n or not known:
        keys.write.mode("overwrite").parquet(f"{store}/keys/{n}-{(a or 0) & (1 << 64) - 1:016x}{(b or 0) & (1 << 64) - 1:016x}")


def decide(docs: DataFrame, *, store: str | None = None, digest=sha256) -> DataFrame:
    """(doc_id, file, pos, keep_id, group_size, kept, text_sha256) for each row of docs.

    store: folder of the state; given again with further rows, it goes on from there and decides for all rows that
    it has seen, whose texts it finds by their locators. digest: Column to Column; any function gives right
    results, as hits are checked in full.
    """
    return _decide(docs.sparkSession, located(docs), store, digest)


def _decide(spark: SparkSession, rows: DataFrame, store: str | None = None, digest=sha256) -> DataFrame:
    again = store is not None
    store = store or new_dir(spark, "dedup")
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    _write_keys(rows.select(F.col("row.doc_id").alias("doc_id"), "file", "pos", sha256(text).alias("sha"), digest(text).alias("digest")), store)
    keys = spark.read.parquet(f"{store}/keys/*")
    if again and not keys.isEmpty():
        rows = located(spark.read.parquet(*[r.file for r in keys.select("file").distinct().collect()]))  # a row per file
    if keys.isEmpty():
        return keys.select("doc_id", "file", "pos", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    dup = stage(_feed(spark, store).where("n > 1"), "dedup-groups")  # so that joins with it can be split where a digest is hot
    found = stage(keys.join(dup, "digest", "left"), "dedup-found")

    # texts move only where their digest was met again
    hits = marked(rows.select("file", "pos", F.col("row.doc_id").alias("doc_id"), text.alias("t")), found.where("n > 1").select("file", "pos"))
    hits = hits.withColumn("digest", digest(F.col("t")))
    salt = F.pmod("pos", F.lit(SALTS)).cast("int").alias("salt")
    parts = hits.groupBy("digest", salt).agg(F.min("t").alias("a"), F.max("t").alias("b"))
    clash = stage(parts.groupBy("digest").agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a <> b").select("digest"), "dedup-clash")
    own = F.struct("doc_id", "file", "pos")
    if not clash.isEmpty():  # never with SHA-256: rows of one digest are told apart by their bytes
        exact = hits.join(clash, "digest", "left_semi")
        groups = exact.groupBy("digest", "t").agg(F.count(F.lit(1)).alias("n2"), F.max(F.struct("doc_id", "file", "pos")).alias("keep2"))
        exact = exact.join(groups, ["digest", "t"]).select("file", "pos", "n2", "keep2")
        found = found.join(exact, ["file", "pos"], "left").withColumns({"n": F.coalesce("n2", "n"), "keep": F.coalesce("keep2", "keep")})
    if not again:
        remove(spark, store)
    keep = F.coalesce(F.col("keep"), own)
    return found.select("doc_id", "file", "pos", keep["doc_id"].alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), ((keep["file"] == F.col("file")) & (keep["pos"] == F.col("pos"))).alias("kept"), F.col("sha").alias("text_sha256"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    rows = located(docs)
    return marked(rows, _decide(docs.sparkSession, rows).where("not kept").select("file", "pos"), keep=False).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
