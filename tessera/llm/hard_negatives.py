"""Hard negatives by a block matrix multiply over rows and dimensions.

Anchors and rows are dealt to shards by hash, their vectors packed in the fewest
bytes. Every anchor shard meets every row shard in one task, which multiplies a
few anchors at a time with the rows, one chunk of dimensions after the other, and
adds the partial int64 tiles. Tiles give their best positives, which are reduced
to the first of each anchor; each anchor and positive then opens a window of
scores, and the tiles, multiplied again, give their best negatives inside it,
which are reduced. A score is never stored or shuffled: what is, are the vectors, once
for each shard of the other side, and the best few of a tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import arrow_schema, cut

#: rows and anchors of a shard at most (on average), and bytes of its integers; anchors multiplied at once; dimensions of a chunk
ROWS, ANCHORS, SHARD_BYTES, TOGETHER, DEPTH = 16384, 16384, 16 << 20, 128, 32

_BEST = "anchor bigint, id bigint, score bigint"
_FOUND = "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
RESULT = "anchor_id bigint, positive_id bigint, `rank` int, negative_id bigint, positive_score bigint, negative_score bigint"


def usable(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """``id``, ``label`` and ``x`` (``floor(scale * component)`` as long) of each row that has an id, a label and finite components only; of rows that share an id that of the least label, then vector."""
    finite = F.forall("x", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), F.transform(vector_col, lambda v: v.cast("double")).alias("x"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).filter(finite)
    whole = rows.select("id", F.struct("label", F.transform("x", lambda v: F.floor(v * scale)).alias("x")).alias("row"))
    return whole.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.label", "row.x")


def _matrix(column: pa.ChunkedArray, depth: int) -> np.ndarray:
    """Rows of ``depth`` integers; what a vector lacks is 0."""
    lists = column.combine_chunks()
    flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    sizes = np.diff(offsets)
    if (sizes == depth).all():
        return flat[offsets[0] : offsets[-1]].reshape(len(sizes), depth)
    out = np.zeros((len(sizes), depth), np.int64)
    out[np.arange(depth)[None, :] < sizes[:, None]] = flat[offsets[0] : offsets[-1]]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` exactly; in doubles where no sum can leave the integers that they hold."""
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * a.shape[1]
    if most < 2.0**53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


def packed(tile: np.ndarray) -> bytes:
    """Without loss, in the fewest bytes of 2, 4 or 8 a score that hold the tile."""
    for kind in (np.int16, np.int32):
        if tile.size == 0 or np.iinfo(kind).min <= tile.min() and tile.max() <= np.iinfo(kind).max:
            return tile.astype(kind).tobytes()
    return tile.tobytes()


def unpacked(blob: bytes, anchors: int, ids: int) -> np.ndarray:
    size = anchors * ids
    return np.frombuffer(blob, {2: np.int16, 4: np.int32, 8: np.int64}[len(blob) // size]).reshape(anchors, ids).astype(np.int64)


def first(scores: np.ndarray, ids: np.ndarray, places: np.ndarray, most: int) -> np.ndarray:
    """Of ``places`` the ``most`` of highest score, then smaller id, in this order."""
    if len(places) > 4 * most:
        least = np.partition(scores[places], len(places) - most)[len(places) - most]
        places = places[scores[places] >= least]
    return places[np.lexsort((ids[places], -scores[places]))[:most]]


def packed_rows(rows: DataFrame, dims: int) -> DataFrame:
    """``x`` as binary, of ``dims`` integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                blobs = [packed(x) for x in _matrix(pa.chunked_array([batch.column(2)]), dims)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], names=["id", "label", "x"])

    return rows.select("id", "label", "x").mapInArrow(run, "id bigint, label bigint, x binary")


def tiles(a: pa.Table, b: pa.Table, dims: int) -> Iterator[tuple[int, np.ndarray]]:
    """Scores of all rows of ``b`` for ``TOGETHER`` rows of ``a`` at a time, with the place of the first."""
    left, right = (np.stack([unpacked(x, 1, dims)[0] for x in t.column("x").to_pylist()]) for t in (a, b))
    for at in range(0, len(left), TOGETHER):
        some = left[at : at + TOGETHER]
        total = np.zeros((len(some), len(right)), np.int64)
        for c in range(0, dims, DEPTH):
            total += products(some[:, c : c + DEPTH], right[:, c : c + DEPTH])
        yield at, total


def _columns(found: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True) if found else [[]] * len(schema), schema, strict=True)], schema=schema)


def mine(
    df: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    positives: int = 5,
    negatives: int = 3,
    window: tuple[int, int, int] = (50, 95, 100),
    scale: int = 256,
    rows_per_shard: int = ROWS,
    anchors_per_shard: int = ANCHORS,
) -> DataFrame:
    """The first ``negatives`` rows of another label inside the score window of each anchor and each of its first ``positives``.

    Returns anchor_id, positive_id, ``rank`` (from 1), negative_id,
    positive_score, negative_score. ``is_anchor`` is a condition on ``id`` and
    ``label``. A score is the inner product of ``floor(scale * x)``; higher ones
    come first, ties by smaller id. ``window`` (low, high, whole) keeps negatives
    with low*positive <= whole*negative <= high*positive. Rows without id or label,
    without vector or with a null or non-finite component take no part; of rows that share
    an id that of the least label, then vector, counts. A vector that is shorter than
    others is filled with 0; an empty one scores 0. Scores beyond 64 bits wrap around. Other columns are not
    read; an empty table, or one without anchors, gives an empty result.
    """
    whole_rows = cut(usable(df, id_col, vector_col, label_col, scale))
    count, anchors, dims = whole_rows.agg(F.count("*"), F.count_if(is_anchor), F.max(F.size("x"))).first()
    spark = df.sparkSession
    if not anchors:
        return spark.createDataFrame([], RESULT)
    dims = max(1, dims)
    fit = max(1, SHARD_BYTES // (8 * dims))
    across = -(-anchors // min(anchors_per_shard, fit))
    # shards of fewer rows where the tasks would otherwise be too few for the cluster
    down = max(-(-count // min(rows_per_shard, fit)), min(count, -(-4 * spark.sparkContext.defaultParallelism // across)))
    rows = cut(packed_rows(whole_rows, dims))
    shard = lambda n, *seed: F.pmod(F.xxhash64(*seed, "id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = rows.filter(is_anchor).select("*", shard(across, F.lit(across)).alias("i"))
    dealt = lambda df: df.select("*", each(down).alias("j")).groupBy("i", "j")
    # names of their own: both sides come from the same rows
    other = rows.select(F.col("id").alias("other_id"), F.col("label").alias("other_label"), F.col("x").alias("other_x"), shard(down).alias("at_j"), each(across).alias("at_i")).groupBy("at_i", "at_j")
    low, high, whole = window
    best_schema, found_schema = arrow_schema(_BEST), arrow_schema(_FOUND)

    def plain(b: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        return b.select(["other_x"]).rename_columns(["x"]), b.column("other_id").to_numpy(), b.column("other_label").to_numpy()

    def nearest(a: pa.Table, b: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if len(a) and len(b):
            vectors, ids, labels = plain(b)
            names, kinds = a.column("id").to_pylist(), a.column("label").to_pylist()
            same = {kind: np.flatnonzero(labels == kind) for kind in set(kinds)}
            for at, scores in tiles(a, vectors, dims):
                for anchor, kind, row in zip(names[at : at + TOGETHER], kinds[at : at + TOGETHER], scores, strict=True):
                    places = same[kind]
                    found += [(anchor, int(ids[k]), int(row[k])) for k in first(row, ids, places[ids[places] != anchor], positives).tolist()]
        return _columns(found, best_schema)

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if len(a) and len(b):
            vectors, ids, labels = plain(b)
            names, kinds, wanted = (a.column(c).to_pylist() for c in ("id", "label", "wanted"))
            others = {kind: labels != kind for kind in set(kinds)}
            for at, scores in tiles(a, vectors, dims):
                for anchor, kind, pairs, row in zip(names[at : at + TOGETHER], kinds[at : at + TOGETHER], wanted[at : at + TOGETHER], scores, strict=True):
                    scaled = whole * row
                    for pair in pairs:
                        score = pair["score"]
                        inside = (low * score <= scaled) & (scaled <= high * score) & others[kind]
                        found += [(anchor, pair["id"], score, int(ids[k]), int(row[k])) for k in first(row, ids, np.flatnonzero(inside), negatives).tolist()]
        return _columns(found, found_schema)

    best = dealt(own).cogroup(other).applyInArrow(nearest, _BEST)
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    chosen = best.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= positives)
    wanted = chosen.groupBy("anchor").agg(F.collect_list(F.struct("id", "score")).alias("wanted"))  # at most ``positives``
    asked = own.join(cut(wanted).hint("merge"), F.col("id") == F.col("anchor")).drop("anchor")
    searched = dealt(asked).cogroup(other).applyInArrow(search, _FOUND)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = searched.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
