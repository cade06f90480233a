"""Budgets against plain versions."""

import random

from pyspark.sql import functions as F

from tessera.operators import budgets as B
from tessera.operators import selection as S


def plain_allocations(n, tokens):
    if n == 1:
        return [tokens]
    first = max(1, int(tokens * (0.6 if n == 2 else 0.5)))
    rest = max(1, tokens - first)
    if n == 2:
        return [first, rest]
    middle = max(1, rest // 2)
    return [first, middle, max(1, rest - middle)] + [1] * (n - 3)


def test_window_allocations(spark):
    cases = [(n, t, k) for n in range(1, 6) for t in (1, 2, 3, 7, 10, 900, 8191) for k in range(n)]
    df = spark.createDataFrame(cases, "n int, t long, k int").withColumn("a", B.window_allocation(F.col("k"), F.col("n"), F.col("t")))
    assert all(r.a == plain_allocations(r.n, r.t)[r.k] for r in df.collect())


def test_windows_are_cut_to_their_part(spark):
    rows = [("a", 0, "x" * 400), ("a", 1, "y" * 400), ("b", 0, "z" * 40), ("b", 1, "z" * 40), ("c", 0, "w" * 1000), ("d", 0, "p" * 400), ("d", 1, "q" * 400), ("d", 2, "short")]
    got = {(r.k, r.i): (r.t, r.allocated) for r in B.capped_windows(spark.createDataFrame(rows, "k string, i int, t string"), ["k"], "i", "t", 100).collect()}
    assert got["a", 0] == ("x" * (240 - 12) + " [truncated]", 60) and got["a", 1] == ("y" * (160 - 12) + " [truncated]", 40)
    assert got["b", 0] == ("z" * 40, None) and got["c", 0] == ("w" * 388 + " [truncated]", 100)
    assert got["d", 0][1] == 50 and got["d", 1][1] == 25 and got["d", 2] == ("short", 25)


def plain_shares(needs, shares, budget):
    """Real grants by filling, one section after the other."""
    full, open_ = set(), set(range(len(needs)))
    while open_:
        left = budget - sum(needs[k] for k in full)
        level = left / sum(shares[k] for k in open_)
        now = {k for k in open_ if needs[k] <= shares[k] * level + 1e-12}
        if not now:
            return [needs[k] if k in full else shares[k] * level for k in range(len(needs))]
        full, open_ = full | now, open_ - now
    return list(needs)


def test_shared_budgets(spark):
    r = random.Random(2)
    cases = {k: ([r.randrange(0, 50) for _ in range(r.randrange(1, 7))], r.randrange(0, 120)) for k in range(150)}
    shares = {k: [r.choice((1, 2, 5)) for _ in needs] for k, (needs, _) in cases.items()}
    rows = [(k, i, n, shares[k][i], b) for k, (needs, b) in cases.items() for i, n in enumerate(needs)]
    got = {}
    for x in B.shared_budget(spark.createDataFrame(rows, "k int, i int, n long, s int, b int"), ["k"], "n", "s", F.col("b"), "i").collect():
        got.setdefault(x.k, {})[x.i] = x.granted
    for k, (needs, budget) in cases.items():
        want = plain_shares(needs, shares[k], budget)
        granted = [got[k][i] for i in range(len(needs))]
        assert all(abs(g - w) <= 1.001 for g, w in zip(granted, want)), (needs, shares[k], budget, granted, want)
        assert all(g <= n for g, n in zip(granted, needs)) and sum(granted) == min(budget, sum(needs))


def test_sections_from_the_first_that_fits(spark):
    rows = [("a", 0, 500), ("a", 1, 20), ("a", 2, 20), ("a", 3, 30), ("a", 4, 1), ("b", 0, 500), ("c", 0, 20), ("c", 1, 400), ("c", 2, 4)]
    df = spark.createDataFrame([(k, i, "x" * n) for k, i, n in rows], "k string, i int, t string")
    got = {(r.k, r.i): r.used for r in S.within_budget(df, ["k"], "i", "t", 13).collect()}
    assert got == {("a", 1): 5, ("a", 2): 10, ("c", 0): 5}
