"""Vectors of texts from a model, each distinct text once.

Texts are named by their digest under a model; what the cache lacks is sent in batches, with retries, and
stored in it before it is used. So equal texts cost one call, and a second run none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources import runs
from tessera.streaming.recovery import with_retries

#: texts of a call; fixed value
BATCH = 32
KEYS = ["digest"]


def vectors_of(frames: Iterator[pa.RecordBatch], model: Callable[[Sequence[str]], Sequence[Sequence[float]]], batch: int, attempts: int, wait: float) -> Iterator[pa.RecordBatch]:
    """``digest`` and ``vector`` of the texts; only those of one call leave Arrow's buffers at a time."""
    call = with_retries(lambda some: list(model(some)), attempts=attempts, wait=wait)
    for frame in frames:
        for at in range(0, frame.num_rows, batch):
            part = frame.slice(at, batch)
            vectors = call(part.column("__text").to_pylist())
            if len(vectors) != part.num_rows:
                raise ValueError(f"{len(vectors)} vectors for {part.num_rows} texts")
            made = pa.array([[float(x) for x in v] for v in vectors], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column("digest"), made], ["digest", "vector"])


def embed(
    df: DataFrame,
    id_col: str,
    text_col: str,
    model: Callable[[Sequence[str]], Sequence[Sequence[float]]],
    cache: str,
    name: str = "model",
    batch: int = BATCH,
    attempts: int = 5,
    wait: float = 1.0,
) -> DataFrame:
    """``id_col`` and ``vector`` of every row; a null text has a null vector.

    ``model`` takes a list of at most ``batch`` texts and returns as many vectors; it may raise OSError or
    TimeoutError, after which a call is repeated up to ``attempts`` times. ``cache`` is a run table
    (``runs``) by digest of ``name`` and text, so models may share it.
    """
    spark = df.sparkSession
    digest = F.sha2(F.concat(F.lit(name + "\n"), F.col(text_col)), 256)
    rows = df.select(F.col(id_col), F.col(text_col).alias("__text"), digest.alias("digest"))
    texts = rows.filter("__text is not null").groupBy("digest").agg(F.first("__text").alias("__text"))

    missing = runs.unseen(spark, cache, texts, KEYS)
    runs.merge(spark, cache, missing.select("digest", "__text").mapInArrow(partial(vectors_of, model=model, batch=batch, attempts=attempts, wait=wait), "digest string, vector array<double>"), KEYS)
    known = runs.look_up(spark, cache, texts, KEYS) if runs.exists(spark, cache) else spark.createDataFrame([], "digest string, vector array<double>")
    return rows.join(known, "digest", "left").select(id_col, "vector")
