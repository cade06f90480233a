"""Run tables by key: rows lie in hash buckets, so a look-up, a resumed run or an upsert touches only the buckets of its keys.

A batch is merged by key, and each bucket's folder is exchanged whole when the batch commits. A merge that
was cut off is repeated with the same result: rows that had been written are written over, never twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.checkpoint import cut

BUCKETS, BUCKET = 64, "bucket"


def bucket_of(keys: Sequence[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a table at ``path``: a folder with something in it that isn't hidden."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(store.exists(at)) and any(f.getPath().getName()[0] not in "_." for f in store.listStatus(at))


def touched(spark: SparkSession, path: str, batch: DataFrame, keys: Sequence[str], buckets: int = BUCKETS) -> DataFrame | None:
    """The stored rows of the buckets that ``batch`` has keys in, None where there is no table. At most a number for each bucket reaches the driver."""
    if not exists(spark, path):
        return None
    own = [r[0] for r in batch.select(bucket_of(keys, buckets)).distinct().collect()]
    return spark.read.parquet(path).filter(F.col(BUCKET).isin(*own) if own else F.lit(False))


def unseen(spark: SparkSession, path: str, batch: DataFrame, keys: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``batch`` whose keys the table lacks, one for each key."""
    known, fresh = touched(spark, path, batch, keys, buckets), batch.dropDuplicates(list(keys))
    return fresh if known is None else fresh.join(known.select(*keys).distinct(), list(keys), "left_anti")


def merge(spark: SparkSession, path: str, batch: DataFrame, keys: Sequence[str], latest: str | None = None, buckets: int = BUCKETS) -> None:
    """Put the rows of ``batch`` in the place of those with their keys; of a batch's rows with one key that of the greatest ``latest`` counts.

    Null keys are keys. The new columns of a batch are null in rows from before, and the other way round.
    """
    k = list(keys)
    one = batch if latest is None else batch.withColumn("__k", F.row_number().over(Window.partitionBy(*k).orderBy(F.desc(latest)))).filter("__k = 1").drop("__k")
    one = cut(one.dropDuplicates(k).withColumn(BUCKET, bucket_of(k, buckets)))
    old = touched(spark, path, one, k, buckets)
    if old is not None:
        same = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in k]
        left = old.alias("o").join(one.select(*k).alias("n"), same, "left_anti")
        one = cut(one.unionByName(left, allowMissingColumns=True))  # read before its folders are exchanged
    one.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path).drop(BUCKET)


def look_up(spark: SparkSession, path: str, wanted: DataFrame, keys: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """The rows with the keys of ``wanted``; other buckets aren't read."""
    known = touched(spark, path, wanted, keys, buckets)
    if known is None:
        raise FileNotFoundError(path)
    return known.drop(BUCKET).join(wanted.select(*keys).distinct(), list(keys), "left_semi")
