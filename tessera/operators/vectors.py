"""Nearest vectors for many queries at once: exactly, and over an index of cells with quantised codes.

The index deals vectors to the cells of their nearest centroids, two of them
unless told otherwise (a neighbour just across a border is found in either), and
keeps eight bits a component. A query probes a few cells; every cell is cut into parts of
bounded size, each part meets the queries that probe it in one task, and only
what may be among the best leaves it: the index knows how far a code can be from its
vector. What is left is ranked again by the exact cosine of the whole vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.chunking import cosine

#: vectors that centroids are fitted on at most (those of least seeded hash), and rounds of the fit
SAMPLE, ROUNDS, SEED = 20_000, 12, 7
#: vectors of a part of a cell or of a block, queries that are scored at once
ROWS, TOGETHER = 4096, 512

#: beside the distance of a code: for sums in single precision and scores of six decimals
MARGIN = 1e-5

_FOUND = "query bigint, id bigint, near float"


@dataclass(frozen=True)
class Cells:
    """Unit centroids, a row each."""

    centroids: np.ndarray

    def nearest(self, vectors: np.ndarray, probes: int) -> np.ndarray:
        """Cells of each vector, the nearest first."""
        scores = unit(vectors) @ self.centroids.T
        probes = min(probes, len(self.centroids))
        top = np.argpartition(-scores, probes - 1, axis=1)[:, :probes]
        return np.take_along_axis(top, np.argsort(np.take_along_axis(-scores, top, 1), axis=1, kind="stable"), 1)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero vectors stay."""
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.where(size > 0, size, 1)).astype(np.float32)


def _whole(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``vector`` (doubles) of rows that have both, without null or non-finite components. All vectors of a table have equally many."""
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("vector"))
    fine = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.filter(F.col("id").isNotNull() & F.col("vector").isNotNull()).filter(fine & (F.size("vector") > 0))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def fit_cells(df: DataFrame, id_col: str, vector_col: str, cells: int, sample: int = SAMPLE, rounds: int = ROUNDS, seed: int = SEED) -> Cells:
    """Centroids by k-means on directions, fitted on at most ``sample`` vectors."""
    some = _whole(df, id_col, vector_col).orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample).select("vector").toArrow()
    if not len(some):
        return Cells(np.zeros((1, 1), np.float32))
    points = unit(_matrix(some["vector"]))
    centroids = points[: min(cells, len(points))].copy()
    for _ in range(rounds):
        own = np.argmax(points @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, points)
        empty = ~sums.any(1)
        sums[empty] = centroids[empty]
        centroids = unit(sums)
    return Cells(centroids)


def build_index(df: DataFrame, id_col: str, vector_col: str, cells: Cells, copies: int = 2) -> DataFrame:
    """``id``, ``cell``, ``code`` (the direction in eight bits a component), ``slack`` (by how much a cosine by the code may be wrong) and ``twin`` (a hash of the vector), for each of the ``copies`` nearest cells. Rows without an id or a finite vector are left out."""
    shared = df.sparkSession.sparkContext.broadcast(cells)

    def run(batches):
        for batch in batches:
            vectors = _matrix(batch.column(1)) if batch.num_rows else np.empty((0, 1))
            if len(vectors):
                codes = np.rint(unit(vectors) * 127).astype(np.int8)
                cell = shared.value.nearest(vectors, copies).astype(np.int32)
                slack = np.linalg.norm(unit(vectors) - codes / 127, axis=1) + MARGIN
                times = pa.array(np.repeat(np.arange(batch.num_rows), cell.shape[1]))
                own = [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(slack, pa.float32()), batch.column(2)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(times), pa.array(cell.reshape(-1)), *(c.take(times) for c in own)], names=["id", "cell", "code", "slack", "twin"])

    return _whole(df, id_col, vector_col).withColumn("twin", F.xxhash64("vector")).mapInArrow(run, "id bigint, cell int, code binary, slack float, twin bigint")


def write_index(index: DataFrame, path: str) -> None:
    """A folder for each cell, so that a search reads only those that are probed; large cells are dealt to several files."""
    index.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.partitionBy("cell").parquet(path)


def _probes(queries: DataFrame, cells: Cells, probes: int) -> DataFrame:
    shared = queries.sparkSession.sparkContext.broadcast(cells)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                near = shared.value.nearest(_matrix(batch.column(1)), probes)
                times = np.repeat(np.arange(batch.num_rows), near.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(times)), pa.array(near.reshape(-1).astype(np.int32)), batch.column(1).take(pa.array(times))], names=["query", "cell", "vector"])

    return queries.mapInArrow(run, "query bigint, cell int, vector array<double>")


def _firsts(ids: np.ndarray, twins: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` smallest ids of each vector; the others are behind them for every query."""
    order = np.lexsort((ids, twins))
    i, t = ids[order], twins[order]
    order = order[np.append(True, (t[1:] != t[:-1]) | (i[1:] != i[:-1]))]
    t = twins[order]
    starts = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
    return order[np.arange(len(t)) - np.repeat(starts, np.diff(np.append(starts, len(t)))) < most]


def _ranked(found: DataFrame, vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Candidates (query, id) by the exact cosine, then id; the ``k`` first of each query."""
    exact = found.join(vectors, "id").join(queries.select(F.col("id").alias("query"), F.col("vector").alias("asked")), "query")
    scored = exact.select("query", "id", F.round(cosine(F.col("vector"), F.col("asked")), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)


def _reduced(found: DataFrame, most: int) -> DataFrame:
    """The ``most`` nearest of each query over all parts, the first of the others left out before the shuffle."""
    order = Window.partitionBy("query").orderBy(F.desc("near"), "id")
    return found.groupBy("query", "id").agg(F.max("near").alias("near")).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select("query", "id")


def _possible(found: DataFrame, k: int) -> DataFrame:
    """(query, id) of what may be among the ``k`` nearest of all parts: its cosine can reach the ``k``-th of those that are certain."""
    each = found.groupBy("query", "id").agg(F.max("near").alias("near"), F.max("slack").alias("slack"))
    sure = each.select("query", (F.col("near") - F.col("slack")).alias("low")).withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("low")))).filter(F.col("place") <= k)
    least = sure.groupBy("query").agg(F.when(F.count("*") == k, F.min("low")).alias("least"))
    return each.join(least, "query").filter("least is null or near + slack >= least").select("query", "id")


def search_index(df: DataFrame, id_col: str, vector_col: str, queries: DataFrame, index: DataFrame, cells: Cells, k: int, probes: int = 8) -> DataFrame:
    """(query, id, score, rank): for each row of ``queries`` the ``k`` nearest of those that its cells hold.

    ``queries`` has the columns of ``df``, of which ids and vectors are read. All that may be among them by their
    codes are ranked by their exact cosine. More ``probes`` find more of the true nearest; as many as there are cells find all.
    """
    vectors, asked = _whole(df, id_col, vector_col), _whole(queries, id_col, vector_col)
    parts = index.groupBy("cell").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("parts"))  # a row for each cell
    dealt = index.join(F.broadcast(parts), "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", "code", "slack", "twin")
    wanted = _probes(asked, cells, probes).join(F.broadcast(parts), "cell").select(F.col("cell").alias("of"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("at"), "query", "vector")

    def scan(own: pa.Table, asks: pa.Table) -> pa.Table:
        out = []
        if len(own) and len(asks):
            own = own.take(_firsts(own["id"].to_numpy(), own["twin"].to_numpy(), k))
            ids, slack = own["id"].to_numpy(), own["slack"].to_numpy()
            codes = np.frombuffer(b"".join(own["code"].to_pylist()), np.int8).reshape(len(ids), -1).astype(np.float32) / 127
            query, directions = asks["query"].to_numpy(), unit(_matrix(asks["vector"]))
            for at in range(0, len(query), TOGETHER):
                scores = directions[at : at + TOGETHER] @ codes.T
                least = np.partition(scores - slack, len(ids) - k, axis=1)[:, len(ids) - k, None] if len(ids) > k else -np.inf
                row, place = np.nonzero(scores + slack >= least)
                out.append((query[at : at + TOGETHER][row], ids[place], scores[row, place], slack[place]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[]] * 4
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query", "id", "near", "slack"), columns, (pa.int64(), pa.int64(), pa.float32(), pa.float32()), strict=True)})

    found = dealt.groupBy("cell", "part").cogroup(wanted.groupBy("of", "at")).applyInArrow(scan, f"{_FOUND}, slack float")
    return _ranked(_possible(found, k), vectors, asked, k)


def nearest(df: DataFrame, id_col: str, vector_col: str, queries: DataFrame, k: int, count: int | None = None) -> DataFrame:
    """(query, id, score, rank): for each row of ``queries`` the ``k`` nearest of all rows, in blocks of rows and queries."""
    vectors, asked = _whole(df, id_col, vector_col), _whole(queries, id_col, vector_col)
    down = max(1, -(-(count or vectors.count()) // ROWS))
    across = max(1, -(-asked.count() // TOGETHER))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    own = vectors.select("id", "vector", place(down).alias("j"), every(across).alias("i"))
    asks = asked.select(F.col("id").alias("query"), F.col("vector").alias("asked"), place(across).alias("of"), every(down).alias("at"))
    most = k + 8  # single precision may swap neighbours; the exact ranking has a few more to choose from

    def scan(rows: pa.Table, some: pa.Table) -> pa.Table:
        if not len(rows) or not len(some):
            return pa.table({"query": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "near": pa.array([], pa.float32())})
        ids, query = rows["id"].to_numpy(), some["query"].to_numpy()
        a, b = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (_matrix(some["asked"]), _matrix(rows["vector"])))
        order = np.argsort(ids, kind="stable")
        scores = (a @ b.T)[:, order]
        top = np.argsort(-np.round(scores, 6), axis=1, kind="stable")[:, :most]  # ids are sorted: ties go to the smaller
        return pa.table({"query": pa.array(np.repeat(query, top.shape[1])), "id": pa.array(ids[order][top].reshape(-1)), "near": pa.array(np.take_along_axis(scores, top, 1).reshape(-1).astype(np.float32))})

    found = own.groupBy("i", "j").cogroup(asks.groupBy("of", "at")).applyInArrow(scan, _FOUND)
    return _ranked(_reduced(found, most), vectors, asked, k)


def recall(found: DataFrame, true: DataFrame) -> DataFrame:
    """One row: queries, their true neighbours, and the share of these that was found."""
    hit = true.select("query", "id").join(found.select("query", "id", F.lit(1).alias("hit")), ["query", "id"], "left")
    return hit.agg(F.count_distinct("query").alias("queries"), F.count("*").alias("neighbours"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
