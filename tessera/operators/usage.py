"""Token usage that can be added up in any order: sums, and sums of what nested maps count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def added(a: Column, b: Column) -> Column:
    """Two maps of counts as one: values of keys that both have are added, null maps have no keys."""
    none = F.create_map().cast("map<string,bigint>")
    zero = F.lit(0).cast("bigint")
    return F.map_zip_with(F.coalesce(a, none), F.coalesce(b, none), lambda _, x, y: F.coalesce(x, zero) + F.coalesce(y, zero))


def merge_usage(df: DataFrame, keys: Sequence[str], measures: Sequence[str], details: str) -> DataFrame:
    """By ``keys``: ``operations`` (rows), the sums of ``measures`` and the maps of ``details`` added up; null measures and counts are 0.

    Sums and counts of the maps' keys are combined before they are shuffled, so a group holds a row for each key, however many rows it has. Rows that were merged before
    can be merged again with others: see ``merge_merged``.
    """
    return _merged(df.withColumn("operations", F.lit(1).cast("bigint")), keys, ["operations", *measures], details)


def merge_merged(df: DataFrame, keys: Sequence[str], measures: Sequence[str], details: str) -> DataFrame:
    """Results of ``merge_usage`` or of this as one, whatever rows each was made of."""
    return _merged(df, keys, ["operations", *measures], details)


def _merged(df: DataFrame, keys: Sequence[str], measures: Sequence[str], details: str) -> DataFrame:
    k = list(keys)
    sums = df.groupBy(*k).agg(*(F.sum(F.coalesce(F.col(m), F.lit(0)).cast("bigint")).alias(m) for m in measures))
    counts = df.select(*k, F.explode(details).alias("__name", "__n")).groupBy(*k, "__name").agg(F.sum(F.coalesce("__n", F.lit(0)).cast("bigint")).alias("__n"))
    maps = counts.groupBy(*k).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__name", "__n")))).alias(details))
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"m.{c}")) for c in k]
    joined = sums.alias("s").join(maps.alias("m"), same, "left") if k else sums.alias("s").crossJoin(maps.alias("m"))  # a row each without keys
    none = F.create_map().cast("map<string,bigint>")
    return joined.select(*(f"s.{c}" for c in (*k, *measures)), F.coalesce(F.col(f"m.{details}"), none).alias(details))


def with_ratios(df: DataFrame, inputs: str = "input_tokens", outputs: str = "output_tokens", requests: str = "requests", response_ms: str = "response_duration_ms", total_ms: str = "total_duration_ms") -> DataFrame:
    """Averages an operation and a request, and tokens a second; null where nothing was counted or timed."""
    tokens = F.col(inputs) + F.col(outputs)
    part = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 4)
    return df.select(
        "*",
        part(tokens, F.col("operations")).alias("tokens_per_operation"),
        part(tokens, F.col(requests)).alias("tokens_per_request"),
        part(F.col(requests), F.col("operations")).alias("requests_per_operation"),
        part(F.col(outputs) * 1000, F.col(response_ms)).alias("output_tokens_per_second"),
        part(tokens * 1000, F.col(total_ms)).alias("tokens_per_second"),
    )
