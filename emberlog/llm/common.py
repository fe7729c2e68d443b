"""Reading tables, cutting lineage and naming columns, shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MOST_MAPS, MAP_BITS = 8192, 1 << 15  # maps of places that are broadcast, and places of a map: 32 MB in all


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a temporary one in local mode, else an error."""
    if not (found := spark.conf.get("spark.checkpoint.dir", None)):
        sc = spark.sparkContext
        if (jvm := sc._jsc.sc().getCheckpointDir()).isDefined():
            found = jvm.get()
        elif sc.master.startswith("local"):
            sc.setCheckpointDir(found := tempfile.mkdtemp(prefix="spark-"))
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found.rstrip("/")


def new_dir(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def stage(df: DataFrame, tag: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: a cut of lineage that outlives executors."""
    path = new_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]):
    """Settings of the session while jobs run within."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Scratch:
    """Staged tables that are only steps on the way to others, and can be deleted once those are written."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tag, self.paths = spark, tag, []

    def stage(self, df: DataFrame) -> DataFrame:
        path = new_dir(self.spark, self.tag)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self, but: int = 0) -> None:
        """Deletes all of them but the last few."""
        keep = self.paths[len(self.paths) - but :]
        for path in self.paths[: len(self.paths) - but]:
            remove(self.spark, path)
        self.paths = keep


def text_of(col: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns an operator works on, so that others, whatever their names, can't clash."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def located(df: DataFrame) -> DataFrame:
    """(row, file, pos): each row whole, in a struct so that its names can't clash, with the place it is stored at.

    A df that isn't read straight from Parquet files is written to the shared folder first.
    """
    cols = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("pos")
    try:
        return df.select(*cols)
    except AnalysisException:
        return stage(df, "rows").select(*cols)


def marked(rows: DataFrame, places: DataFrame, keep: bool = True) -> DataFrame:
    """The rows (with file and pos) whose place is, or isn't, among places (file, pos).

    Places become bit maps of MAP_BITS rows of a file each. Up to MOST_MAPS maps are broadcast, so that rows aren't
    shuffled; more places are joined instead.
    """
    bucket = F.shiftright("pos", 15)
    maps = places.groupBy("file", bucket.alias("bucket")).agg(F.bitmap_construct_agg(F.col("pos").bitwiseAND(MAP_BITS - 1)).alias("map"))
    maps = stage(maps, "places")
    if maps.limit(MOST_MAPS + 1).count() > MOST_MAPS:
        return rows.join(places.distinct(), ["file", "pos"], "left_semi" if keep else "left_anti")
    at = F.col("pos").bitwiseAND(MAP_BITS - 1)
    byte = F.conv(F.hex(F.substring("map", F.shiftright(at, 3).cast("int") + 1, 1)), 16, 10).cast("int")
    set_ = F.coalesce(F.getbit(byte, at.bitwiseAND(7).cast("int")) == 1, F.lit(False))
    on = (F.col("bucket") == bucket) & (F.col("file") == F.col("at_file"))
    found = rows.join(F.broadcast(maps.withColumnRenamed("file", "at_file")), on, "left").where(set_ if keep else ~set_)
    return found.drop("bucket", "map", "at_file")
