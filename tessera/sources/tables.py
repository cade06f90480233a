"""Tables partitioned like run folders: package, strategy, model."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T


def save(df: DataFrame, path: str, partition: Sequence[str] = (), mode: str = "append") -> None:
    """Write by Spark's commit protocol; ``overwrite`` replaces only the partitions that ``df`` has."""
    w = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(*partition) if partition else w).parquet(path)


def save_by_route(evidence: DataFrame, path: str) -> None:
    save(evidence, path, ["route"], "overwrite")


def load(spark: SparkSession, path: str, **partition: str) -> DataFrame:
    """A table, restricted to the named partitions (pruned before any file is read)."""
    df = spark.read.parquet(path)
    for k, v in partition.items():
        df = df.filter(F.col(k) == v)
    return df


def safe_part(part: str) -> str:
    """One component of a path: separators and reserved characters become underscores; ``name=value`` keeps its sign. Raises ValueError for ``.``, ``..`` and empty parts."""
    name, sign, value = part.partition("=")
    made = "=".join(re.sub(r'[<>:"/\\|?*]', "_", x) for x in ((name, value) if sign else (name,)))
    if made in ("", ".", "..") or sign and not name:
        raise ValueError(f"not a path component: {part!r}")
    return made


def clear(spark: SparkSession, path: str, *below: str) -> bool:
    """Delete a table or a partition folder; whether there was one. What is named in ``below`` never leads out of ``path``."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path.rstrip("/") or "/")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    root, target = fs.makeQualified(root), fs.makeQualified(jvm.org.apache.hadoop.fs.Path("/".join([path.rstrip("/"), *map(safe_part, below)])))
    if target.toString() != root.toString() and not target.toString().startswith(root.toString().rstrip("/") + "/"):
        raise ValueError(f"{target} is not below {root}")
    return bool(fs.exists(target) and fs.delete(target, True))


def append_numbered(spark: SparkSession, df: DataFrame, path: str, operation: str) -> None:
    """Append rows with a sequence number that goes on within each ``operation``."""
    try:
        last = spark.read.parquet(path).groupBy(operation).agg(F.max("sequence").alias("__last"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        last = spark.createDataFrame([], df.select(operation).schema.add("__last", "long"))
    w = Window.partitionBy(operation).orderBy(*[c for c in df.columns if c != operation])
    numbered = df.withColumn("__n", F.row_number().over(w)).join(last, operation, "left")
    save(numbered.withColumn("sequence", F.col("__n") + F.coalesce("__last", F.lit(0))).drop("__n", "__last"), path)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``new`` and the rows of ``old`` whose keys it lacks."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)
