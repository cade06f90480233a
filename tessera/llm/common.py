"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: bytes.translate table: A-Z to a-z, all else as it is
ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: str.translate table of the same
ASCII_LOWER_STR = str.maketrans(UPPER, LOWER)
#: a word: anything but space, tab, line feed, vertical tab, form feed, carriage return
WORD = r"[^\x20\x09-\x0D]+"

#: texts of a block of rows have at most so many bytes together
BLOCK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column | str) -> Column:
    """A-Z only; ``lower`` would also change letters beyond ASCII."""
    return F.translate(F.col(c) if isinstance(c, str) else c, UPPER, LOWER)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the shared folder that the cluster names; make one only where none is set and all runs on one machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there: later steps neither recompute it nor lose it with an executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def blocks(batch: pa.RecordBatch, rows: int, most_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows whose texts have at most ``most_bytes`` bytes together; a longer text is a slice by itself."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + most_bytes, "right"))))
        yield batch.slice(at, end - at)
        at = end


def map_rows(
    df: DataFrame,
    columns: Sequence[str],
    schema: str,
    rows: Callable[..., Iterable[tuple]],
    start: Callable[[], object] | None = None,
    block: int = 256,
    finish: Callable[[object], None] | None = None,
) -> DataFrame:
    """Run ``rows(state, *columns)`` over blocks of plain Python lists and return its tuples as ``schema``.

    Only ``columns`` are read. ``start`` builds the state once a task (tables,
    models, caches), ``finish`` lets go of what a later task in the same worker has
    no use for. A block bounds, by rows and bytes, what is held as Python objects
    at once.
    """
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start() if start else None
        for batch in batches:
            for part in blocks(batch, block):
                made = list(rows(state, *(part.column(k).to_pylist() for k in range(len(columns)))))
                if made:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v, type=f.type) for v, f in zip(zip(*made, strict=True), arrow, strict=True)], schema=arrow
                    )
        if finish:
            finish(state)

    return df.select(*columns).mapInArrow(run, schema)


def arrow_schema(schema: str) -> pa.Schema:
    """Of a schema in DDL; only the driver can read that."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def held_out_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, by ``modulus``; a null id gives null."""
    return F.crc32(doc_id.cast("string")) % modulus


def text_order(text: Column | str, seed: int) -> Column:
    """A seeded hash that orders texts; copies of a text share it."""
    return F.xxhash64(F.lit(seed), text)


def bounded_sample(candidates: DataFrame, texts: DataFrame, per_group: dict | int, most_bytes: int, seed: int) -> list[tuple]:
    """(group, text) of a bounded sample: for each group the distinct texts of least seeded hash.

    ``candidates`` has ``__group``, ``__order`` (see ``text_order``) and ``__bytes``; ``texts`` has ``__text``.
    A group has at most ``per_group`` whole texts (a number, or one by group), without
    those that would take it over ``most_bytes``. Copies are combined
    before they are ranked, and every task passes on at most a group's bound, so
    a hot group or text costs no more than another. Two scans, however many groups there are.
    """
    most = max(per_group.values()) if isinstance(per_group, dict) else per_group
    own = candidates.groupBy("__group", "__order").agg(F.max("__bytes").alias("__bytes"))
    ranked = own.withColumn("__rank", F.row_number().over(Window.partitionBy("__group").orderBy("__order"))).filter(F.col("__rank") <= most)
    chosen, sums = [], {}
    for group, order, size, rank in sorted(ranked.select("__group", "__order", "__bytes", "__rank").collect(), key=lambda r: (str(r[0]), r[3])):
        after = sums.get(group, 0) + (size or 0)
        if rank <= (per_group[group] if isinstance(per_group, dict) else per_group) and after <= most_bytes:
            chosen.append((group, order))
            sums[group] = after
    if not chosen:
        return []
    spark = texts.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(o,) for o in sorted({o for _, o in chosen})], "__order bigint"))
    found = texts.withColumn("__order", text_order("__text", seed)).join(wanted, "__order", "left_semi").groupBy("__order").agg(F.first("__text"))
    by_order = dict(found.collect())
    return [(group, by_order[order]) for group, order in chosen]
