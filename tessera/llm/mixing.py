"""Mixing sources to target weights by fitting a budget of words with whole documents.

Every source gets a target in words: its weight's share of all words, at most
``cap`` times what it has, the excess dealt out again by weight. A target is
met by passes over the whole source and, for what remains, by documents chosen
so that their lengths sum to the remainder: documents are counted by exact
length, most of the remainder is filled in proportion to these counts, and
bounded-knapsack dynamic programming finds the best sum for the rest. Which
documents of a length are taken is decided by a seeded hash.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, cut, text_order

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
SEED = 20_241
#: parts into which the documents of one source and length are dealt by hash before they are ranked
BUCKETS = 1024
#: rows written at once for one document that repeats
REPEATS = 4096


def _sums(items: Sequence[tuple[int, int]], room: int) -> tuple[int, list[tuple[int, int]], np.ndarray]:
    """Bits of the sums up to ``room`` that ``items`` (length, most) can make, the steps (item, copies) that led there, and for each sum the number of the step that first made it; stops once ``room`` itself is among them.

    A sum less its first step's words was made before that step, so the way back takes every step once at most.
    """
    mask, sums, steps = (1 << (room + 1)) - 1, 1, []
    width, first = room // 64 + 1, np.full(room + 1, -1, np.int32)
    for i, (size, most) in enumerate(items):
        most, part = min(most, room // size), 1
        while most and not sums >> room & 1:
            k = min(part, most)
            most, part = most - k, part * 2
            new = (sums << k * size) & mask & ~sums
            if new:
                words = np.frombuffer(new.to_bytes(8 * width, "little"), "<u8")
                full = np.flatnonzero(words)
                bits = np.unpackbits(words[full].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                row, bit = np.nonzero(bits)
                first[full[row] * 64 + bit] = len(steps)
                steps.append((i, k))
                sums |= new
    return sums, steps, first


def _highest(items: Sequence[tuple[int, int]], budget: int) -> int:
    """No choice of ``items`` sums to more than this and not more than ``budget``: its remainder by the length of the most plentiful item can't be made by the others."""
    unit, _ = max(items, key=lambda x: (x[1], x[0]))
    mask, made = (1 << unit) - 1, 1
    for size, most in items:
        if size != unit:
            part = 1
            while most and made != mask:
                k = min(part, most)
                most, part = most - k, part * 2
                by = k * size % unit
                made |= (made << by | made >> (unit - by)) & mask
    at = budget % unit
    low = (made & ((1 << (at + 1)) - 1)).bit_length()  # remainder 0 can always be made
    return budget - at + low - 1


def fit_counts(lengths: Sequence[int], counts: Sequence[int], budget: int) -> list[int]:
    """How many documents of each length to take so that their words come as near to ``budget`` as can be without exceeding it.

    First a proportional share of every length, rounded down, then the longest
    that still fit, until a window of a few lengths is open; the window is
    filled by dynamic programming over a bit for each sum. If the sum found is
    not proved best (by meeting the budget, or the bound of ``_highest``), the window is doubled,
    in the end to the whole budget. Lengths are taken in units of their greatest common divisor.
    """
    total = sum(a * b for a, b in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    unit = gcd(*(s for s, c in zip(lengths, counts, strict=True) if s and c))
    goal = budget // unit
    order = sorted((i for i in range(len(lengths)) if lengths[i] and counts[i]), key=lambda i: -lengths[i])
    size = [s // unit for s in lengths]
    base = [0 if s else c for s, c in zip(lengths, counts, strict=True)]
    share = [c * budget // total if s else 0 for s, c in zip(lengths, counts, strict=True)]
    window, best = 4 * size[order[0]], goal
    while True:
        take, open_ = list(base), max(0, goal - window)  # so many words are filled without a search
        for i in order:
            k = min(share[i], open_ // size[i])
            take[i], open_ = k, open_ - k * size[i]
        for i in order:
            k = min(counts[i] - take[i], open_ // size[i])
            take[i], open_ = take[i] + k, open_ - k * size[i]
        left = goal - sum(take[i] * size[i] for i in order)
        sums, steps, first = _sums([(size[i], counts[i] - take[i]) for i in order], left)
        at = sums.bit_length() - 1
        if at < left and best == goal:
            best = _highest([(size[i], counts[i]) for i in order], goal)
        if at == left or goal - left + at == best or left == goal:
            while at:
                i, k = steps[first[at]]
                take[order[i]], at = take[order[i]] + k, at - k * size[order[i]]
            return take
        window *= 2


def word_counts(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    size = F.regexp_count(F.coalesce(text_col, F.lit("")), F.lit(WORD)).cast("long")
    return df.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), size.alias("__size"), text_order(text_col, SEED).alias("__check"))


def source_targets(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """``__source``, ``source_size`` and ``target`` of every source of ``docs`` (``__source``, ``__size``).

    The water level (words a unit of weight) is found by sums over the sources that
    aren't full yet, a row each; the driver sees three numbers a round, and rounds end
    when no more sources fill up.
    """
    sized = docs.groupBy("__source").agg(F.sum("__size").alias("source_size"))
    # sources in order over range partitions, numbered on from the partitions before
    ordered = cut(sized.orderBy(F.col("__source").asc_nulls_last()).select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at")))
    parts = ordered.groupBy("__part").agg(F.count("*").alias("n"), F.min("__at").alias("first"))
    before = parts.select("__part", "first", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a partition
    place = F.col("before") + F.col("__at") - F.col("first")
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    own = cut(ordered.join(F.broadcast(before), "__part").select("__source", "source_size", weight.alias("weight")))
    level, full = 0.0, F.lit(float(cap)) * F.col("source_size")
    while True:
        holds = F.col("weight") * level >= full
        taken, open_weight, size = own.agg(F.sum(F.when(holds, full).otherwise(0.0)), F.sum(F.when(holds, 0.0).otherwise(F.col("weight"))), F.sum("source_size")).first()
        after = (size - taken) / open_weight if size and open_weight else level
        if after <= level:
            return own.select("__source", "source_size", F.least(full, F.col("weight") * level).alias("target"))
        level = after


def quotas(df: DataFrame, weights: Sequence[float], cap: int, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """For each distinct ``__id``, ``__source``, ``__size`` and ``__check`` (a hash of the text): ``n`` rows, ``source_size``, ``target``, and ``passes`` and ``extra``; of the rows, ``extra`` are taken ``passes`` + 1 times."""
    kind = dict(df.dtypes)[source_col]
    key = ["__id", "__source", "__size", "__check"]
    hashed = F.xxhash64(F.lit(seed), "__id", "__check")
    docs = word_counts(df, id_col, text_col, source_col).groupBy(key).agg(F.count("*").alias("n"))
    docs = cut(docs.select("*", hashed.alias("__hash"), F.pmod(hashed, F.lit(BUCKETS)).cast("int").alias("__bucket")))
    cells = cut(docs.groupBy("__source", "__size", "__bucket").agg(F.sum("n").alias("n")))
    plan = cut(source_targets(cells.select("__source", (F.col("__size") * F.col("n")).alias("__size")), weights, cap))
    lengths = cells.groupBy("__source", "__size").agg(F.sum("n").alias("n")).alias("l")
    same = lambda a, b: F.col(f"{a}.__source").eqNullSafe(F.col(f"{b}.__source"))
    aimed = lengths.join(plan.alias("p"), same("l", "p")).select("l.*", "source_size", "target")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        passes = min(cap, int(target // size)) if size else 1
        extra = fit_counts(pdf["__size"].tolist(), pdf["n"].tolist(), max(0, round(target) - passes * size)) if size and passes < cap else [0] * len(pdf)
        return pdf[["__source", "__size", "source_size", "target"]].assign(passes=passes, extra=extra)

    # one row for each length, of which a source has no more than its longest document has words
    quota = aimed.groupBy("__source").applyInPandas(fit, f"__source {kind}, __size long, source_size long, target double, passes long, extra long")
    offsets = cells.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("__source", "__size").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    o, q = offsets.alias("o"), quota.alias("q")
    rule = o.join(q, same("o", "q") & (F.col("o.__size") == F.col("q.__size"))).select("o.__source", "o.__size", "o.__bucket", "passes", (F.col("extra") - F.col("before")).alias("open"), "source_size", "target")
    earlier = Window.partitionBy("__source", "__size", "__bucket").orderBy("__hash", "__id", "__check").rowsBetween(Window.unboundedPreceding, -1)
    d, r = docs.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("d"), rule.alias("r")
    found = d.join(r, same("d", "r") & (F.col("d.__size") == F.col("r.__size")) & (F.col("d.__bucket") == F.col("r.__bucket")))
    return found.select(*(F.col(f"d.{c}") for c in key), F.col("d.n"), "source_size", "target", "passes", F.greatest(F.lit(0), F.least(F.col("d.n"), F.col("open") - F.col("earlier"))).alias("extra"))


def mix(
    df: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = CAP, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """Return for each row of ``df``: id, ``size``, ``source_size``, ``target`` and ``copies``, how often the mix takes the document.

    Sources by code point, null last, take ``weights`` in turn. A null text has no
    words; documents without words are taken as often as whole passes go, since
    they cost nothing; a source without words has target 0; an empty table
    gives an empty result. Of documents of one length those of least seeded hash
    are taken; rows that repeat id, source and text are interchangeable. Very
    long texts only make large lengths. Only the three columns are read.

    Nothing a source or a document long reaches the driver. Documents of one
    source and length, however many, are ranked in ``BUCKETS`` separate parts.
    """
    own = quotas(df, weights, cap, seed, id_col, text_col, source_col)
    # a row for each of the n rows that share all that matters, in runs of bounded length
    runs = own.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(REPEATS).cast("long"))).alias("start"))
    each = runs.select("*", F.explode(F.sequence(F.col("start"), F.least(F.col("n"), F.col("start") + REPEATS) - 1)).alias("k"))
    return each.select(F.col("__id").alias(id_col), F.col("__size").alias("size"), "source_size", "target", (F.col("passes") + (F.col("k") < F.col("extra")).cast("long")).alias("copies"))
