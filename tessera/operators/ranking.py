"""Scores and total orders of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Points by words of a path and by extension.
PATH_POINTS = ((0.45, ("readme", "metadata", "manifest", "method", "protocol")), (0.25, ("sample", "instrument", "experiment", "report", "summary")))
EXTENSION_POINTS = (
    (0.2, (".md", ".txt", ".csv", ".tsv", ".json", ".yaml", ".yml", ".xml", ".xlsx", ".xls", ".pdf")),
    (0.1, (".ipynb", ".py", ".r", ".m")),
    (-0.25, (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".zip", ".gz", ".raw", ".h5", ".hdf5", ".npy")),
)
BASE, LARGE, LARGE_POINTS, UNRANKED = 0.2, 100_000, -0.1, 10_000


def path_score(path: Column, size: Column) -> Column:
    low = F.lower(path)
    ext = F.when(path.contains("."), F.concat(F.lit("."), F.element_at(F.split(low, r"\."), -1))).otherwise(F.lit(""))
    score = F.lit(BASE)
    for points, words in PATH_POINTS:
        score = score + F.when(low.rlike("|".join(words)), F.lit(points)).otherwise(0.0)
    for points, names in EXTENSION_POINTS:
        score = score + F.when(ext.isin(*names), F.lit(points)).otherwise(0.0)
    score = score + F.when(size > LARGE, F.lit(LARGE_POINTS)).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2)


#: Points by words of a file's summary.
SUMMARY_POINTS = (
    (0.38, ("dataset description", "package description", "readme", "metadata", "manifest")),
    (0.28, ("method", "protocol", "program", "plan")),
    (0.26, ("acquisition", "measurement settings", "experiment parameters")),
    (0.22, ("processing", "processed", "post-processing", "process parameters")),
    (0.20, ("instrument", "software", "device", "calibration", "reference")),
    (0.16, ("sample", "specimen", "material", "condition", "solvent")),
    (0.10, ("audit", "provenance", "history", "log")),
)


def summary_score(summary: Column, path: Column | None = None, size: Column | None = None) -> Column:
    """Points for what a summary speaks of, a little for its path; 0 to 1, three decimals."""
    low = F.lower(F.coalesce(summary, F.lit("")))
    score = F.lit(0.08) - F.when(low == "", F.lit(0.12)).otherwise(0.0)
    for points, words in SUMMARY_POINTS:
        score = score + F.when(low.rlike("|".join(words)), F.lit(points)).otherwise(0.0)
    if path is not None:
        score = score + (path_score(path, size if size is not None else F.lit(None).cast("long")) - BASE) * 0.25
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3)


def global_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Ranks 1..n in a total order without bringing all rows to one task.

    Rows are sorted by range, each partition counts its rows, and a prefix sum
    over the partition counts (one number each) shifts the local ranks.
    """
    from tessera.operators.checkpoint import cut

    sized = cut(df.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    counts = sized.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    local = sized.withColumn("__local", (F.col("__at") - F.shiftleft(F.col("__part").cast("long"), 33)) + 1)
    return local.join(F.broadcast(before), "__part").withColumn(name, F.col("__local") + F.col("__before")).drop("__part", "__at", "__local", "__before")


def rank_files(files: DataFrame, path_col: str, size_col: str, tie: str, summary_col: str | None = None) -> DataFrame:
    """Files by score, then path: the score of the path, or that of the summary where there is a column of summaries."""
    path, size = F.col(path_col), F.col(size_col)
    score = path_score(path, size) if summary_col is None else summary_score(F.col(summary_col), path, size)
    return global_rank(files.withColumn("score", score), F.desc("score"), path, F.col(tie))
