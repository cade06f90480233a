"""Run accounting: usage roll-ups, coverage, quality classes, indexes of stored files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usage_rollup(df: DataFrame, agent: str, measures: Sequence[str], total: str = "combined") -> DataFrame:
    """Sums of ``measures`` and number of operations by agent, and over all of them, with averages an operation."""
    sums = df.rollup(agent).agg(F.count("*").alias("operations"), *(F.sum(m).alias(m) for m in measures), F.grouping(agent).alias("__all"))
    named = sums.withColumn(agent, F.when(F.col("__all") == 1, F.lit(total)).otherwise(F.col(agent))).drop("__all")
    return named.select("*", *(F.round(F.col(m) / F.greatest(F.col("operations"), F.lit(1)), 2).alias(f"{m}_per_operation") for m in measures))


def weighted_score(df: DataFrame, keys: Sequence[str], quality: Column, weight: Column, applicable: Column) -> DataFrame:
    """Mean of clamped qualities by weight over the applicable rows; 0 without any."""
    q = F.greatest(F.lit(0.0), F.least(F.lit(1.0), quality))
    w = F.when(applicable, weight).otherwise(0.0)
    return df.groupBy(*keys).agg(F.round(F.coalesce(F.sum(q * w) / F.nullif(F.sum(w), F.lit(0.0)), F.lit(0.0)), 6).alias("score"))


def status_counts(df: DataFrame, status: str, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(*(F.count_if(F.col(status) == v).alias(v) for v in values), F.count("*").alias("total"))


def draft_quality(df: DataFrame, keys: Sequence[str], filled: Column, problem: Column) -> DataFrame:
    """``empty_shell`` without any filled field, ``complete`` where all are filled and none has a problem, else ``imperfect``."""
    some, every, bad = F.bool_or(filled), F.bool_and(filled), F.bool_or(problem)
    return df.groupBy(*keys).agg(F.when(~some, "empty_shell").when(every & ~bad, "complete").otherwise("imperfect").alias("quality"))


def artifact_index(files: DataFrame, path: str, size: str, order: Sequence[str] = ()) -> DataFrame:
    """Stage, strategy and model from the first parts of stored paths; files and bytes of each."""
    parts = F.split(path, "/")
    at = lambda k: F.when(F.size(parts) > k + 1, F.element_at(parts, k + 1)).otherwise(F.lit(""))
    return files.groupBy(at(0).alias("stage"), at(1).alias("strategy"), at(2).alias("model")).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"))


def path_closure(files: DataFrame, path: str) -> DataFrame:
    """All directories above the paths, with their depth and number of files below."""
    parts = F.split(path, "/")
    up = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("directory"), F.size(parts).alias("n"))
    return up.filter("n > 1").groupBy("directory").agg(F.count("*").alias("files")).withColumn("depth", F.size(F.split("directory", "/")).cast("long"))


#: configurations that are broadcast at most, and parts of the datasets that meet a block of more
SHORT, SALTS = 10_000, 64


def run_matrix(datasets: DataFrame, configs: DataFrame) -> DataFrame:
    """Every dataset with every configuration: ``SHORT`` configurations at most are broadcast, more are dealt to blocks of about that size, which meet parts of the datasets by a join."""
    blocks = -(-configs.count() // SHORT)
    if blocks <= 1:
        return datasets.crossJoin(F.broadcast(configs))  # its size is checked above
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda df, n: F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)), F.lit(n)).cast("int")
    left = datasets.withColumn("__salt", own(datasets, SALTS)).withColumn("__block", every(blocks))
    right = configs.withColumn("__block", own(configs, blocks)).withColumn("__salt", every(SALTS))
    return left.join(right, ["__block", "__salt"]).drop("__block", "__salt")


def pair_status(pairs: DataFrame, compatible: DataFrame, kind: str, unit: str) -> DataFrame:
    """compatible, incompatible, or unknown where nothing is stored about the kind."""
    known = compatible.select(F.col(kind)).distinct().withColumn("__known", F.lit(True))
    hit = compatible.select(kind, unit).distinct().withColumn("__hit", F.lit(True))
    joined = pairs.join(hit, [kind, unit], "left").join(known, kind, "left")
    return joined.withColumn("status", F.when(F.col("__hit"), "compatible").when(F.col("__known"), "incompatible").otherwise("unknown")).drop("__hit", "__known")


def choose_pairs(compatible: DataFrame, keys: Sequence[str], kind: str, unit: str) -> DataFrame:
    """The pair of each key where exactly one is compatible, else nulls."""
    n = compatible.select(*keys, kind, unit).distinct().groupBy(*keys).agg(F.count("*").alias("n_pairs"), F.min(kind).alias("k"), F.min(unit).alias("u"))
    one = F.col("n_pairs") == 1
    return n.select(*keys, "n_pairs", F.when(one, F.col("k")).alias(kind), F.when(one, F.col("u")).alias(unit))
