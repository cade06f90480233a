"""Near-duplicates by SimHash, joined on a grid of segment bit counts.

A fingerprint's 32 two-bit segments are mapped to their bit counts. The
Manhattan distance between two such vectors never exceeds the Hamming distance
of the fingerprints, so a range join in that space loses no pair: whatever lies
within ``radius`` agrees in all but ``radius`` of the grid's ``blocks`` of
coordinates, so cells of the remaining blocks are joined by equality, the
Manhattan bound sifts the cell, and the exact distance decides.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ASCII_LOWER, cut, map_rows

SHINGLE, SEED, RADIUS, BLOCKS = 3, 42, 3, 7
_LOW, _SEGMENTS = 0x5555555555555555, 32
_LANES = np.uint64(0x0101010101010101)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits; a bit is set if it is set in over half of the hashes of all word shingles, repeats included. No words: 0."""
    words = (text or "").encode("utf-8", "replace").translate(ASCII_LOWER).split()
    n = len(words)
    if not n:
        return 0
    if n <= shingle:
        made = [b" ".join(words)]
    else:
        made = list(map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in made), np.uint64, len(made))
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of ``hashes``: eight byte lanes are counted at once, in blocks that can't overflow a byte."""
    n, counts = len(hashes), np.zeros(64, np.int64)
    full = np.zeros((-(-n // 255), 255), np.uint64)
    full.reshape(-1)[:n] = hashes
    for k in range(8):
        lanes = ((full >> np.uint64(k)) & _LANES).sum(1, dtype=np.uint64)
        counts[k::8] = lanes.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    bits = (counts * 2 > n).nonzero()[0]
    return int(sum(1 << int(b) for b in bits))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id and ``fp`` (the 64 bits as a signed long) of every row; null texts count as empty."""

    def rows(_, ids, texts):
        for i, t in zip(ids, texts, strict=True):
            f = fingerprint(t, shingle)
            yield i, f - (1 << 64) if f >> 63 else f

    return map_rows(df, [id_col, text_col], f"{id_col} {dict(df.dtypes)[id_col]}, fp bigint", rows)


def embed(fp: Column) -> Column:
    """Segment bit counts in thermometer form (0, 1, 2 as 00, 01, 11), so that the Manhattan distance is the number of differing bits."""
    low, other = F.lit(_LOW), F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(other).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(other).bitwiseAND(low), 1))


def cell_masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """Bit masks of the grid cells: every choice of ``blocks - radius`` of ``blocks`` runs of segments."""
    if not 0 <= radius < blocks <= _SEGMENTS:
        raise ValueError("radius < blocks <= 32")
    edges = [round(k * _SEGMENTS / blocks) * 2 for k in range(blocks + 1)]
    runs = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    masks = (sum(c) for c in combinations(runs, blocks - radius))
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near_pairs(nodes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """All pairs (``a`` < ``b``) of distinct ``fp`` in ``nodes`` that differ in at most ``radius`` bits, each once."""
    masks = cell_masks(radius, blocks)
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # every row becomes as many as there are masks: dealt to all tasks before that, by another key than the nodes were grouped by (else Spark leaves it out)
    nodes = nodes.repartition(parts, F.xxhash64("fp"))
    wide = nodes.select("fp", embed(F.col("fp")).alias("e"), F.posexplode(F.array(*map(F.lit, masks))).alias("grid", "mask"))
    cells = wide.select("fp", "e", "grid", F.col("e").bitwiseAND(F.col("mask")).alias("cell"))
    # sizes are known before the rows are copied, not after: without the hint Spark would broadcast all copies through the driver
    a, b = cells.alias("a"), cells.hint("merge").alias("b")
    near = (
        (F.col("a.grid") == F.col("b.grid"))
        & (F.col("a.cell") == F.col("b.cell"))
        & (F.col("a.fp") < F.col("b.fp"))
        & (F.bit_count(F.col("a.e").bitwiseXOR(F.col("b.e"))) <= radius)
        & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius)
    )
    return a.join(b, near).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (the least node it is linked to) for every node of ``edges``, by large-star and small-star rounds.

    Each round is two minima by key (combined before the shuffle) joined back to
    the edges, a join that adaptive execution splits where a node is hot; the
    edges are checkpointed each round. Nothing but a count and a sum reaches
    the driver, as no table of nodes is broadcast.
    """
    now = cut(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before, after = None, state(now)
    while before != after:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).hint("merge")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).hint("merge")
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = cut(small.distinct())
        before, after = after, state(now)
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """id, ``fp`` and ``component_id`` (the smallest id reachable over links) of every row.

    Rows with equal fingerprints, however many, are one node of the graph, so no
    group of copies is ever paired. All fingerprint pairs within ``radius`` are
    linked, without limit. Empty and null texts have fingerprint 0; very long texts
    are hashed whole. Null ids
    take part but never name a component unless all of it is null; repeated rows
    are returned as often as they occur; an empty table gives an empty result.
    """
    marked = cut(fingerprints(df.select(id_col, text_col), id_col, text_col, shingle))
    nodes = marked.groupBy("fp").agg(F.min(id_col).alias("least"))
    roots = connected_components(near_pairs(nodes.select("fp"), radius, blocks))
    rooted = nodes.join(roots.hint("merge"), nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")).hint("merge"), "root").select("fp", "component_id")
    return marked.join(named.hint("merge"), "fp").select(id_col, "fp", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
