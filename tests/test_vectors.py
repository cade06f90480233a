"""Nearest vectors against a plain search."""

import numpy as np

from tessera.operators import vectors as V


def make(spark, n=3000, dims=16, seed=1):
    r = np.random.default_rng(seed)
    middles = r.normal(size=(20, dims))
    points = middles[r.integers(0, 20, n)] + r.normal(size=(n, dims)) * 0.5
    points[n // 2 : n // 2 + 30] = points[0]  # ties
    rows = [(int(i), p.tolist()) for i, p in enumerate(points)]
    odd = [(None, [1.0] * dims), (90_001, None), (90_002, [float("nan")] * dims), (90_003, [None] * dims), (90_004, [])]
    return points, spark.createDataFrame(rows + odd, "vec long, e array<double>")


def plain(points, ids, k):
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    out = {}
    for i in ids:
        score = np.round(unit @ unit[i], 6)
        out[i] = [(int(j), float(score[j])) for j in np.lexsort((np.arange(len(score)), -score))[:k]]
    return out


def grouped(df):
    out = {}
    for r in df.orderBy("query", "rank").collect():
        out.setdefault(r.query, []).append((r.id, r.score))
    return out


def test_exact_search(spark, monkeypatch):
    points, df = make(spark)
    want = plain(points, range(0, 3000, 50), 10)
    assert grouped(V.nearest(df, "vec", "e", df.filter("vec % 50 = 0"), 10)) == want
    monkeypatch.setattr(V, "ROWS", 700)
    monkeypatch.setattr(V, "TOGETHER", 11)
    assert grouped(V.nearest(df, "vec", "e", df.filter("vec % 50 = 0"), 10)) == want
    assert V.nearest(df.filter("false"), "vec", "e", df.filter("vec = 0"), 10).collect() == []


def test_index_search(spark, monkeypatch, tmp_path):
    points, df = make(spark)
    queries = df.filter("vec % 50 = 0")
    cells = V.fit_cells(df, "vec", "e", 24)
    assert cells.centroids.shape == (24, 16)
    index = V.build_index(df, "vec", "e", cells)
    assert index.count() == 6000 and index.select("id").distinct().count() == 3000 and {len(r.code) for r in index.collect()} == {16}
    true = V.nearest(df, "vec", "e", queries, 10)
    shares = [V.recall(V.search_index(df, "vec", "e", queries, index, cells, 10, probes), true).first() for probes in (1, 6, 24)]
    assert [s.queries for s in shares] == [60] * 3 and [s.neighbours for s in shares] == [600] * 3
    assert shares[1].recall >= 0.9 and shares[2].recall >= 0.99 and shares[0].recall <= shares[1].recall
    monkeypatch.setattr(V, "ROWS", 40)  # cells in several parts
    V.write_index(index, str(tmp_path / "cells"))
    stored = spark.read.parquet(str(tmp_path / "cells"))
    assert grouped(V.search_index(df, "vec", "e", queries, stored, cells, 10, 24)).keys() == set(range(0, 3000, 50))
    assert V.recall(V.search_index(df, "vec", "e", queries, stored, cells, 10, 24), true).first().recall >= 0.99


def test_all_cells_find_all(spark):
    """More vectors than are taken by their codes alone, nearer to each other than codes can tell, and more copies than are asked for."""
    r = np.random.default_rng(3)
    points = r.normal(size=16) + r.normal(size=(2000, 16)) * 0.005
    points[1000:1100] = points[7]
    df = spark.createDataFrame([(int(i), p.tolist()) for i, p in enumerate(points)], "vec long, e array<double>")
    queries, cells = df.filter("vec % 100 = 0"), V.fit_cells(df, "vec", "e", 4)
    found = V.search_index(df, "vec", "e", queries, V.build_index(df, "vec", "e", cells), cells, 10, 4)
    assert grouped(found) == plain(points, range(0, 2000, 100), 10)
