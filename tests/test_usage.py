"""Usage merges: any split of the rows gives one result."""

import random
from collections import Counter

from tessera.operators import usage as U

KIND = "agent string, requests long, input_tokens long, output_tokens long, response_duration_ms long, total_duration_ms long, details map<string,long>"
MEASURES = ["requests", "input_tokens", "output_tokens", "response_duration_ms", "total_duration_ms"]


def shown(df):
    return sorted((repr((r.agent, r.operations, *(r[m] for m in MEASURES), sorted(r.details.items()))) for r in df.collect()))


def test_any_split_gives_one_result(spark):
    r = random.Random(1)
    rows = []
    for _ in range(300):
        details = r.choice((None, {}, {r.choice("xyz"): r.randrange(9) for _ in range(3)}, {"x": None}))
        rows.append((r.choice(("a", "b", None)), *(r.choice((None, r.randrange(100))) for _ in MEASURES), details))
    rows.append(("lonely", 1, 2, 3, 0, 0, None))
    want = {}
    for agent, *values, details in rows:
        one = want.setdefault(agent, [0, [0] * 5, Counter()])
        one[0] += 1
        one[1] = [a + (b or 0) for a, b in zip(one[1], values)]
        for k, v in (details or {}).items():
            one[2][k] += v or 0
    whole = shown(U.merge_usage(spark.createDataFrame(rows, KIND), ["agent"], MEASURES, "details"))
    assert whole == sorted(repr((a, n, *values, sorted(d.items()))) for a, (n, values, d) in want.items())
    for parts in (2, 5):
        r.shuffle(rows)
        made = [U.merge_usage(spark.createDataFrame(rows[k::parts], KIND), ["agent"], MEASURES, "details") for k in range(parts)]
        some = made[0]
        for m in made[1:]:
            some = U.merge_merged(some.unionByName(m), ["agent"], MEASURES, "details")
        assert shown(some) == whole
    assert U.merge_usage(spark.createDataFrame([], KIND), ["agent"], MEASURES, "details").collect() == []


def test_ratios(spark):
    made = U.with_ratios(U.merge_usage(spark.createDataFrame([("a", 2, 30, 10, 500, 1000, None), ("a", 2, 10, 10, 500, 1000, None), ("b", 0, 0, 0, 0, 0, None)], KIND), ["agent"], MEASURES, "details"))
    got = {r.agent: tuple(r)[-5:] for r in made.collect()}
    assert got == {"a": (30.0, 15.0, 2.0, 20.0, 30.0), "b": (0.0, None, 0.0, None, None)}
