"""What happens when work fails or goes on over many chunks: retries, repairs, accumulated state, progress."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence
from functools import wraps

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.checkpoint import cut


def with_retries(call: Callable, attempts: int = 5, wait: float = 1.0, factor: float = 2.0, most: float = 60.0, errors: tuple[type[Exception], ...] = (OSError, TimeoutError), sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``call``, tried up to ``attempts`` times where it raises one of ``errors``; the waits grow by ``factor`` up to ``most`` seconds. The last error is raised."""

    @wraps(call)
    def run(*args, **kwargs):
        pause = wait
        for k in range(attempts):
            try:
                return call(*args, **kwargs)
            except errors:
                if k + 1 == attempts:
                    raise
            sleep(min(pause, most))
            pause *= factor

    return run


def with_repairs(chunks: DataFrame, process: Callable[[DataFrame], DataFrame], repair: Callable[[DataFrame], DataFrame], keys: Sequence[str]) -> DataFrame:
    """Results of ``process`` for all chunks; those it returns with status ``failed`` wait until it is through and go to ``repair``, once.

    Both return the ``keys``, ``status`` and the same other columns. What is repaired has
    the status ``repaired``; what fails again stays ``failed``. Results are cut, so that neither runs twice.
    """
    k = list(keys)
    first = cut(process(chunks))
    waiting = chunks.join(first.filter("status = 'failed'").select(*k), k, "left_semi")
    second = cut(repair(waiting))
    return first.filter("status <> 'failed'").unionByName(second.withColumn("status", F.when(F.col("status") == "failed", "failed").otherwise("repaired")))


SEEN = "package string, chunk long, n_known long, n_new long"


class _Known(StatefulProcessor):
    """A package's texts by hash, an entry each, and how many there are; a batch writes only what it adds."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "hash bigint", "chunk bigint", self.keep_ms)
        self.count = handle.getValueState("count", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.keep_ms is not None:  # what is kept for a time only must be counted
            n = sum(1 for _ in self.known.keys())
        else:
            n = self.count.get()[0] if self.count.exists() else 0
        out = []
        frame = pd.concat(list(rows)).set_axis(["package", "chunk", "hash"], axis=1)  # names don't reach a processor
        for chunk, part in frame.groupby("chunk", sort=True):
            fresh = [h for h in dict.fromkeys(part["hash"].tolist()) if not self.known.containsKey((h,))]
            for h in fresh:
                self.known.updateValue((h,), (int(chunk),))
            out.append((key[0], int(chunk), n, len(fresh)))
            n += len(fresh)
        self.count.update((n,))
        yield pd.DataFrame(out, columns=["package", "chunk", "n_known", "n_new"])

    def close(self) -> None:
        pass


def accumulate(stream: DataFrame, package: str, chunk: str, text: str, keep_seconds: float | None = None) -> DataFrame:
    """(package, chunk, n_known, n_new) for a stream of evidence: how many distinct texts were known before each chunk, and how many it adds.

    The state of a package is a map of its texts' hashes: a batch reads and writes the entries of its own texts alone, however
    many are known. Entries older than ``keep_seconds`` are forgotten. Chunks of one batch count in their order. The session's state store
    must be RocksDB's (``spark.sql.streaming.stateStore.providerClass``), which holds more than memory does.
    """
    hashed = stream.select(F.col(package).alias("__package"), F.col(chunk).cast("long").alias("__chunk"), F.xxhash64(text).alias("__hash"))
    keep = None if keep_seconds is None else int(keep_seconds * 1000)
    mode = "None" if keep is None else "ProcessingTime"
    return hashed.groupBy("__package").transformWithStateInPandas(_Known(keep), SEEN, "Append", mode)


def progress(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """(batch, rows, seconds, status) of the batches that a streaming query remembers, and its present status."""
    rows = []
    for p in query.recentProgress:
        p = p if isinstance(p, dict) else json.loads(p.json)
        rows.append((int(p["batchId"]), int(p["numInputRows"]), float(p["durationMs"].get("triggerExecution", 0)) / 1000, "completed"))
    status = "crashed" if query.exception() else "running" if query.isActive else "completed"
    return spark.createDataFrame([*rows, (-1, 0, 0.0, status)], "batch long, rows long, seconds double, status string")
