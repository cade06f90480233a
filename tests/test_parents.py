"""Evidence of parents against all pairs."""

import random
import re

from tessera.operators import placement as P


def test_scores_equal_those_of_all_pairs(spark):
    r = random.Random(5)
    words = "topspin version pulse zg30 solvent cdcl chloroform frequency mhz bruker proton spectrum format audit log jcamp acqu made alpha beta gamma delta".split()
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    categories = ["software_signal", "method_signal", "resource_signal", "measurement_condition", "other"]
    parents = [(d, f"/p{k}", r.choice([*P.ROLE_POINTS, "unknown"]), text(2), text(4)) for d in "abc" for k in range(12)]
    evidence = [(d, f"c{k:02d}", r.choice(categories), r.choice((text(6), text(2), "", None))) for d in "abcd" for k in range(40)]
    kinds = "doc string, parent string, role string, title string, words string", "doc string, candidate_id string, category string, text string"

    def points(role, category, x):
        out = 0
        for number, own, pattern, both in P.ROLE_POINTS.get(role, ()):
            tests = ([category in own] if own else []) + ([bool(re.search(pattern, x))] if pattern else [])
            out += number * (all(tests) if both else any(tests))
        return out

    want = set()
    for doc, parent, role, title, about in parents:
        found = []
        for d, candidate, category, raw in evidence:
            if d == doc:
                own, x = set((raw or "").split()), raw or ""
                terms = lambda s: {w for w in s.split() if len(w) >= 3}
                in_title = len(terms(title) & own)
                score = in_title * 4 + min(3, len(terms(about) & own)) + points(role, category, x)
                if role == "manufacturer" and (not in_title or re.search("frequency|mhz|version|topspin|pulse|solvent", x)):
                    score = 0
                if score >= P.LEAST:
                    found.append((-score, candidate))
        want |= {(doc, parent, c, -s, k) for k, (s, c) in enumerate(sorted(found)[:4], 1)}
    got = P.score_parents(spark.createDataFrame(parents, kinds[0]), spark.createDataFrame(evidence, kinds[1]))
    assert {tuple(x) for x in got.collect()} == want and len(want) > 60
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan
