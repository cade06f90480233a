"""A registry of profiles: one manifest a name, each in a folder of its own."""

from __future__ import annotations

import json
import re

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.operators.selection import IDENTIFIER
from tessera.sources import tables


def _checked(name: str) -> str:
    if not re.fullmatch(IDENTIFIER.strip("^$"), name) or ".." in name:
        raise ValueError(f"not a profile's name: {name!r}")
    return name


def save(spark: SparkSession, path: str, name: str, manifest: dict) -> None:
    """Store a manifest, in place of an older one of its name."""
    row = spark.createDataFrame([(_checked(name), json.dumps(manifest, sort_keys=True))], "name string, manifest string")
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in order; none where nothing was stored yet."""
    try:
        found = spark.read.option("recursiveFileLookup", "true").parquet(path).select("name").distinct()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return []
    return sorted(r[0] for r in found.collect())


def get(spark: SparkSession, path: str, name: str) -> dict | None:
    try:
        row = spark.read.parquet(f"{path}/{_checked(name)}").filter(F.col("name") == name).first()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return json.loads(row.manifest) if row else None


def delete(spark: SparkSession, path: str, name: str) -> bool:
    """Whether there was one."""
    return tables.clear(spark, path, _checked(name))
