"""A corpus pipeline of five stages; each works on what its predecessor kept, written as Parquet and read again.

Defined results, for every stage: columns that a stage does not know pass through all but the last, whatever their names;
an empty table gives an empty one. Null and empty texts go with the first stage; a stage that gets them all the same
keeps them. Rows without id or with equal ones are told apart by all their columns; repeated rows are documents of their
own for the mix, and one for near duplicates. Texts of any length are taken whole. Ties: of equal sizes the least id
stays, and the mix chooses by hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, mixing, quality_rules, set_join, sharding
from .common import new_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 of their five-word shingles, that with the least doc_id."""
    return set_join.one_of_each(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, one or two rows each; equal rows share theirs.

    A row is known by two hashes of all its columns; each different one is shuffled once, with the number of its copies.
    """
    cells = [F.col(c).cast("string") for c in docs.columns]
    key = F.struct(F.xxhash64(*cells).alias("a"), F.xxhash64(F.lit("b"), *[F.coalesce(c, F.lit("\0")) for c in cells]).alias("b"))
    keyed = docs.withColumn("__row", key)
    taken = mixing.mix(keyed.select("__row", "text", "source"), id_col="__row").groupBy(F.col("__row").alias("__of")).agg(F.sum("n_copies").alias("__copies"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    single = keyed.repartition(parts, "__row").dropDuplicates(["__row"])
    joined = single.join(taken.filter("__copies > 0"), single["__row"] == taken["__of"])
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each row."""
    return sharding.shard(docs, shards=16)


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("mixing", mixture), ("sharding", shards)]

#: Propagation and rounding are iterative; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each stage's rows written to the shared folder before the next reads them."""
    docs, folder = table(spark, sf_dir, "documents"), new_folder(spark, "pipeline")
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
    return docs
