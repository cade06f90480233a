"""The pipeline and its stages against plain versions, and their edge cases."""

import hashlib
import random
from collections import Counter

import pytest

import corpus_pipeline
from tessera.llm import toxicity
from tessera.llm.queries import vocabulary_path

SF = "/root/testdata/sf0.001"
CLASH = "__copies int, __copy string, __kept boolean, `check` int, key_id string, `rank` int, `row` string, copies long, __id string, `a.b` string, node long"
EXTRA = (4, "copy", True, 5, "k", 6, "r", 7, "i", "dot", 8)
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def low(text):
    return (text or "").translate(LOW)


def plain_exact(rows):
    """Of equal texts one row of the largest id, of those with the least text."""
    groups = {}
    for r in rows:
        groups.setdefault(low(r.text), []).append(r)
    return Counter((best.doc_id, best.text or "") for best in (min(g, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.text or "")) for g in groups.values()))


def shingles(text):
    w = low(text).split()
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def plain_near(rows):
    """Numbers of the components, all pairs compared."""
    sets, head = [shingles(r.text) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = max(head[i], head[j]), min(head[i], head[j])
                head = [new if h == old else h for h in head]
    return head


def check_near(before, after):
    head = plain_near(before)
    ids = {}
    for r, h in zip(before, head):
        ids.setdefault(h, []).append(r.doc_id)
    least = Counter(min((i for i in x if i is not None), default=None) for x in ids.values())
    assert Counter(r.doc_id for r in after) == least
    assert not Counter(after) - Counter(before)


def check_mixed(before, after):
    """Words of each source as near its target as the lengths allow, every row as often as whole passes go or once more."""
    from tests.llm.test_llm_operators import plain_best, plain_targets

    sizes, order = Counter(), None
    for r in before:
        sizes[r.source] += len((r.text or "").split())
    order = sorted(sizes, key=lambda x: (x is None, (x or "").encode()))
    have, seen = Counter(before), Counter(after)
    assert set(seen) <= set(have)
    for source, target in zip(order, plain_targets([sizes[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))])):
        own = [r for r in before if r.source == source]
        passes = min(3, int(target // sizes[source])) if sizes[source] else 1
        lengths = Counter(len((r.text or "").split()) for r in own)
        rest = plain_best(list(lengths), list(lengths.values()), round(target) - passes * sizes[source]) if sizes[source] and passes < 3 else 0
        assert sum(n * len((r.text or "").split()) for r, n in seen.items() if r.source == source) == passes * sizes[source] + rest
        assert all(passes * have[r] <= seen[r] <= (passes + 1) * have[r] for r in set(own))


def plain_codes(rows):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(vocabulary_path())
    coder.no_truncation()
    coder.no_padding()
    out = Counter()
    for r in rows:
        ids = coder.encode(r.text or "", add_special_tokens=False).ids
        out[r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(coder.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    return out


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Some whole documents of the test data with planted copies, near copies, toxic ones, nulls and a hot source."""
    path, draw = tmp_path_factory.mktemp("corpus"), random.Random(9)
    some = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    rows = [tuple(r) for r in some if len(r.text) < 1200][:60]
    rows += [(1000 + k, r[1].upper() if k % 2 else r[1], r[2], "hot", r[4]) for k, r in enumerate(rows[:10] * 3)]
    for k in range(12):
        words = [draw.choice("red green blue grey pink gold".split()) + str(draw.randrange(90)) for _ in range(60)]
        rows += [(2000 + k, " ".join(words), "en", "hot", 0), (2100 + k, " ".join(words[:-1] + ["other"]), "en", "x", 0), (2200 + k, " ".join(words[:30] + ["cut"] + words[30:]), "en", None, 0)]
        rows += [(3000 + k, " ".join(words[:8]) + " vile fool " + " ".join(draw.sample(words, 20)), "en", "hot", 0)]
    rows += [(4000, None, None, None, None), (4001, "", "en", "hot", 0), (4001, "", "en", "hot", 0), (None, "a text without an id", "en", "x", 0), (None, "another text without an id", "en", "x", 0)]
    labels = [(3000 + k, 0, 1) for k in range(12)] + [(r[0], 1, 0) for r in rows if r[0] and r[0] < 3000]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_run_against_brute_force(spark, corpus, monkeypatch):
    """Every stage against its plain version on what the stage before it returned, and run() against the last of them."""
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, after = docs.collect(), None
        docs = stage(spark, docs, corpus)
        after = docs.collect()
        if name == "toxicity":
            judged = toxicity.score_documents(spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long"), spark.read.parquet(f"{corpus}/labels.parquet")).collect()
            clean = Counter((r.doc_id, r.score < 0.5) for r in judged)
            assert Counter((r.doc_id, True) for r in after) == Counter({k: n for k, n in clean.items() if k[1]})
            held = {r.doc_id for r in judged if r.doc_id and 3000 <= r.doc_id < 3012}
            assert held and not {r.doc_id for r in after} & held and len(after) > len(before) - 14
        if name == "exact dedup":
            assert Counter((r.doc_id, r.text or "") for r in after) == plain_exact(before)
        if name == "near-dedup":
            check_near(before, after)
            assert len(after) < len(before)
        if name == "mixing sources":
            check_mixed(before, after)
        if name == "BPE":
            assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in after) == plain_codes(before)
        else:
            assert docs.columns == columns and not Counter(set(after)) - Counter(set(before))
        docs = spark.createDataFrame(after, docs.schema).repartition(3)
    assert Counter(corpus_pipeline.run(spark, corpus).collect()) == Counter(after)


def test_no_stage_is_run_twice(spark, corpus, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def counted(spark_, docs, sf_dir):
        def run(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return docs.mapInArrow(run, docs.schema)

    rest = [(name, stage) for name, stage in corpus_pipeline.STAGES if name != "toxicity"]
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("counted", counted), *rest])
    corpus_pipeline.run(spark, corpus).collect()
    assert seen.value == spark.read.parquet(f"{corpus}/documents.parquet").count()


ODD = [
    (1, "the cat sat on the mat today", "en", "a", 22),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (5, "THE cat sat on the mat today", "en", None, 22),
    (5, "THE cat sat on the mat today", "en", None, 22),
    (5, "the cat SAT on the mat today", "en", None, 22),
    (5, "quite another text of the same id", "en", "a", 22),
    (None, "der hund und die katze und die maus", "de", "b", 22),
    (None, "der hund und die katze und die maus", "de", "b", 22),
    (None, "ein anderer text ganz ohne nummer", "de", "b", 22),
    (7, "long words " * 20_000, "de", "b", 1),
    (8, "long words " * 20_000 + "end", "de", "b", 1),
]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_edges_of_every_stage(spark, corpus, name):
    """Nulls, empty and very long texts, ties, repeated rows, an empty table, clashing names."""
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.createDataFrame([r + EXTRA for r in ODD], DOCS).repartition(3)
    made = stage(spark, docs, corpus)
    before, after = docs.collect(), made.collect()
    assert stage(spark, spark.createDataFrame([], DOCS), corpus).collect() == []
    if name == "BPE":
        assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in after) == plain_codes(before)
        return
    assert made.columns == docs.columns and made.schema.names == docs.schema.names and set(after) <= set(before)
    if name == "toxicity":
        assert Counter(after) == Counter(before)
    if name == "exact dedup":
        assert Counter((r.doc_id, r.text or "") for r in after) == plain_exact(before)
        assert len(after) == 7
    if name == "near-dedup":
        check_near(before, after)
    if name == "mixing sources":
        check_mixed(before, after)
