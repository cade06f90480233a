"""Near copies, against a comparison of all pairs."""

import random

import corpus_pipeline
from tessera.llm import near, toxicity

TEXT = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _docs():
    r = random.Random(5)
    line = " ".join(f"common{i}" for i in range(12))
    texts = []
    for _ in range(12):
        words = [f"w{r.randrange(5000)}" for _ in range(r.choice((3, 30, 120)))]
        texts.append(" ".join(words))
        for share in (0.01, 0.02, 0.03, 0.05):
            texts.append(" ".join(f"x{r.randrange(5000)}" if r.random() < share else w for w in words))
        texts.append(line + " " + " ".join(words[:8]))
    return [*texts, texts[0].upper(), None, "", "  "]


def _brute(texts):
    """Ids by the least id of their component, all pairs compared."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    head = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = max(head[i], head[j]), min(head[i], head[j])
                head = [new if h == old else h for h in head]
    return head


def test_stage_keeps_one_of_all_near_copies(spark):
    texts = _docs()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], TEXT)
    want = _brute(texts)
    assert 20 < len(set(want)) < len(texts) - 10
    assert {r.doc_id: r.component_id for r in near.near_copies(docs).collect()} == dict(enumerate(want))
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == sorted(set(want))


def test_unrelated_texts_are_no_family():
    r = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    docs = [[r.choice(words) for _ in range(200)] for _ in range(200)]
    docs.append(docs[0][:-2] + ["changed", "end"])
    found = toxicity.families(docs)
    assert len(set(found)) == 200 and found[0] == found[200]
