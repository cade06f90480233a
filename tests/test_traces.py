"""Evidence passages in texts: matches, sweeps and segments."""

import random

from pyspark.sql import functions as F

from tessera.operators import traces as R


def ranges(spark, pairs):
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, t string, p string")
    return [r.m and tuple(r.m) for r in rows.select("k", R.trace_range(F.col("t"), F.col("p")).alias("m")).orderBy("k").collect()]


def test_passages_are_found_in_their_order_of_kinds(spark):
    text = "One two  three\nfour FIVE six\n\nseven eight (nine) [ten] a.b $1 \\d\nD:\\Exp 1\\run"
    got = ranges(
        spark,
        [
            (text, "two  three"), (text, "TWO"), (text, "two three four"), (text, "  five six  "), (text, "(NINE) [ten]  A.B $1 \\D"), (text, "D:\\Exp 1"), ("no path", "D:\\Exp 1"), (text, "zzz"), (text, " "), (text, None), (None, "x"),
            (text, "three\\nfour"), (text, "Dataset name: d\nFile path: f\ntwo  three"), (text, "One two three\nseven eight (nine)"), (text, "seven eight (nine)\nOne two three"), (text, "One\nsix"),
            ("\xa0a\u2003b c", "A B\xa0c"), ("a\\Eb", "A\\EB"), ("xab", "ab x"), ("a  b", "a b"),
        ],
    )
    assert got == [
        ("exact", 4, 14), ("case", 4, 7), ("space", 4, 19), ("case", 20, 28), ("space", 42, 64), ("exact", 65, 73), None, None, None, None, None,
        ("exact", 9, 19), ("exact", 4, 14), ("lines", 0, 48), None, None,
        ("space", 1, 6), ("case", 0, 4), None, ("space", 0, 4),
    ]


def plain_sweep(spans):
    kept = []
    for a, b, o in sorted(spans, key=lambda x: (x[0], -x[1], x[2])):
        if not kept or a >= kept[-1][1]:
            kept.append((a, b, o, []))
        elif b <= kept[-1][1]:
            kept[-1][3].append(o)
    return kept


def test_sweep_moves_by_kept_spans_only(spark):
    r = random.Random(1)
    groups = {"a": [(0, 10, 1), (5, 30, 2), (12, 20, 3)], "b": [(0, 5, 1), (3, 4, 2), (5, 9, 3), (5, 7, 4)], "c": [(4, 4, 1), (4, 4, 2)]}
    for k in range(60):
        groups[f"r{k}"] = [(a := r.randrange(60), a + r.randrange(1, 15), o) for o in range(r.randrange(1, 25))]
    rows = spark.createDataFrame([(k, *s) for k, v in groups.items() for s in v], "k string, a long, b long, o long")
    got = {}
    for x in R.separate_spans(rows, ["k"], "a", "b", "o").orderBy("k", "a").collect():
        got.setdefault(x.k, []).append((x.a, x.b, x.o, x.inside))
    assert got["a"] == [(0, 10, 1, []), (12, 20, 3, [])] and got["b"] == [(0, 5, 1, [2]), (5, 9, 3, [4])]
    assert {k: v for k, v in got.items() if k != "c"} == {k: plain_sweep(v) for k, v in groups.items() if k != "c"}


def test_segments_cover_the_text(spark):
    text = "a\nb\nc\nd\ne\nf here\ng there"
    texts = spark.createDataFrame([(1, text), (2, "none"), (3, ""), (4, "all")], "k int, t string")
    spans = spark.createDataFrame([(1, 0, 1, 7), (1, 12, 16, 8), (1, 13, 15, 9), (1, 19, 24, 5), (4, 0, 3, 1)], "k int, a long, b long, o long")
    got = [tuple(r) for r in R.trace_segments(texts, spans, ["k"], "t", "a", "b", "o").orderBy("k", "begin").collect()]
    assert got == [
        (1, 0, 1, [7], True), (1, 1, 12, [], False), (1, 12, 16, [8, 9], False), (1, 16, 19, [], False), (1, 19, 24, [5], False),
        (2, 0, 4, [], False), (3, 0, 0, [], False), (4, 0, 3, [1], True),
    ]
