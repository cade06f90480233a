"""The chain model's fit and scores against all tag sequences, one by one."""

import itertools
import math
import random

import numpy as np

from tessera.llm import toxicity as X


def sequences(ids, value, before, after, log_trans):
    """(tags, log weight) of every way to tag a document."""
    for tags in itertools.product((0, 1), repeat=len(ids)):
        total = sum(value[i] * t for i, t in zip(ids, tags))
        total += sum(before[ids[k - 1]] * tags[k] for k in range(1, len(ids))) + sum(after[ids[k + 1]] * tags[k] for k in range(len(ids) - 1))
        yield tags, total + sum(log_trans[a, b] for a, b in zip(tags, tags[1:]))


def likelihood(docs, golds, value, before, after, log_trans):
    out = 0.0
    for ids, gold in zip(docs, golds):
        every = dict(sequences(ids, value, before, after, log_trans))
        out += every[tuple(gold)] - math.log(sum(map(math.exp, every.values())))
    return out


def test_gradients_are_those_of_the_likelihood():
    r = random.Random(3)
    n = 5
    docs = [np.array([r.randrange(n) for _ in range(size)], np.int32) for size in (1, 2, 3, 3, 4, 5, 6)]
    labels = [1, 0, 1, 1, 0, 1, 1]
    is_bad = np.array([1.0, 0, 1.0, 0, 0])
    golds = [[int(is_bad[i] * label) for i in d] for d, label in zip(docs, labels)]
    value, before, after = (np.array([r.uniform(-1, 1) for _ in range(n)]) for _ in range(3))
    log_trans = np.array([[r.uniform(-1, 1) for _ in range(2)] for _ in range(2)])
    run = X._Run(docs, labels, is_bad)
    grads, pairs = [np.zeros(n) for _ in range(3)], np.zeros((2, 2))
    run.add_gradients(grads, value, [None, before, after], np.exp(log_trans), pairs)
    step = 1e-5

    def slope(change):
        up, down = ([a.copy() for a in (value, before, after, log_trans)] for _ in range(2))
        change(up, step)
        change(down, -step)
        return (likelihood(docs, golds, *up) - likelihood(docs, golds, *down)) / (2 * step)

    for which in range(3):
        for i in range(n):

            def move(arrays, by, which=which, i=i):
                arrays[which][i] += by

            assert abs(slope(move) - grads[which][i]) < 1e-6
    for a, b in itertools.product((0, 1), repeat=2):

        def move(arrays, by, a=a, b=b):
            arrays[3][a, b] += by

        assert abs(slope(move) - (run.gold() - pairs)[a, b]) < 1e-6


def test_query_scores_are_those_of_all_sequences(spark):
    r = random.Random(4)
    words = [f"word{k}" for k in range(30)]
    rows, labels = [], []
    for i in range(300):
        toxic = i % 5 == 0
        text = " ".join(r.choice([*words, *(["vile"] * 8 if toxic else [])]) for _ in range(r.randrange(3, 9)))
        rows.append((i, text))
        labels.append((i, int(toxic)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = X.learn(docs, known, "doc_id", "text", "toxic")
    got = {x.doc_id: x for x in X.score_documents(docs, known).collect()}
    for i, text in rows[:60]:
        tokens = X.tokens(text)
        odds = np.log(np.array(model.emission(tokens), np.float64))
        every = [(tags, sum(o * t for o, t in zip(odds, tags)) + sum(math.log(model.trans[a, b]) for a, b in zip(tags, tags[1:]))) for tags in itertools.product((0, 1), repeat=len(tokens))]
        whole = sum(math.exp(w) for _, w in every)
        marginals = np.array([sum(math.exp(w) for tags, w in every if tags[k]) / whole for k in range(len(tokens))])
        assert abs(model.score(marginals) - got[i].score) < 1e-5
    assert sum(got[i].predicted for i, t in labels if t) > 40 and sum(got[i].predicted for i, t in labels if not t) < 5
