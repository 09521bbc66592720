"""Shared pieces: the cluster's shared folder, durable cut points, Arrow batch bounds, skew-proof ranks."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space that separates words, as a Java character class and as characters.
SPACES = r"\x20\x09-\x0D"
WORD = f"[^{SPACES}]+"
SPACE_CHARS = " \t\n\x0b\f\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Where that is unset, one of our own in local mode, whose
    only executor is the driver; on a cluster there is no folder that all would see."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tapeloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and goes on from there: survives lost executors, and is computed once."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, kind: str) -> tuple[DataFrame, str]:
    """df written as a table in the shared folder, and that folder. Unlike a checkpoint it holds on to nothing before it."""
    spark = df.sparkSession
    folder = new_folder(spark, kind)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder), folder


def discard(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets the cleaner remove the files of shuffles and checkpoints that no DataFrame refers to any more."""
    for _ in range(2):  # the gateway lets go of Java objects a little after Python has
        gc.collect()
        time.sleep(0.2)
        spark.sparkContext._jvm.System.gc()


def small_arrow_batches(spark: SparkSession, mb: int = 8) -> None:
    """Bounds what a Python worker holds at once by bytes, as texts differ in length by orders of magnitude."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(df: DataFrame, col: str = "text") -> Column:
    """The text, a null as the empty one."""
    return F.coalesce(df[col].cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row however often body uses it."""
    return F.transform(F.array(value), body)[0]


def spread_of(*cols: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("int")


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, buckets: int = 4096) -> DataFrame:
    """Adds out, the rank from 0 of each row among those of equal keys (not null), with no key's rows in one task.

    Rows of a key are dealt over buckets by a hash of the order columns, ranked within (key, bucket), and get the
    number of rows in the key's earlier buckets. Only bucket counts, at most `buckets` a key, meet in one place.
    """
    b, r, n, off = "__bucket", "__rank", "__n", "__off"
    df = df.withColumn(b, spread_of(*[F.col(c) for c in order], buckets=buckets))
    within = Window.partitionBy(*keys, b).orderBy(*order)
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(*keys, b).agg(F.count("*").alias(n)).withColumn(off, F.coalesce(F.sum(n).over(before), F.lit(0))).drop(n)
    ranked = df.withColumn(r, F.row_number().over(within) - 1)
    return ranked.join(offsets, [*keys, b]).withColumn(out, F.col(r) + F.col(off)).drop(b, r, off)
