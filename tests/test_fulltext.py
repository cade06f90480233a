"""English analysis and full-text queries against a plain version."""

import math
import random

import pytest

from tessera.functions import stemming
from tessera.operators import fulltext as T

#: Porter's own examples, whole algorithm
STEMS = """caresses:caress ponies:poni ties:ti caress:caress cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop tanned:tan falling:fall
hissing:hiss fizzed:fizz failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit rational:ration valenci:valenc hesitanci:hesit digitizer:digit conformabli:conform radicalli:radic differentli:differ vileli:vile
analogousli:analog vietnamization:vietnam predication:predic operator:oper feudalism:feudal decisiveness:decis hopefulness:hope callousness:callous formaliti:formal sensitiviti:sensit sensibiliti:sensibl triplicate:triplic
formative:form formalize:formal electriciti:electr electrical:electr hopeful:hope goodness:good revival:reviv allowance:allow inference:infer airliner:airlin gyroscopic:gyroscop adjustable:adjust defensible:defens irritant:irrit
replacement:replac adjustment:adjust dependent:depend adoption:adopt homologou:homolog communism:commun activate:activ angulariti:angular homologous:homolog effective:effect bowdlerize:bowdler probate:probat rate:rate cease:ceas
controll:control roll:roll generalizations:gener oscillators:oscil élan:élan"""


def test_stems():
    assert all(stemming.porter(w) == s for w, s in (x.split(":") for x in STEMS.split()))


def test_stems_agree_with_words_but_for_two_letters():
    r = random.Random(1)
    ends = [*stemming._STEP_2, *stemming._STEP_3, *stemming._STEP_4, "s", "es", "ies", "ed", "ing", "eed", "y", "ly", "bility", "ational", ""]
    for _ in range(20_000):
        word = "".join(r.choice("abcdeioutyrlzs") for _ in range(r.randrange(1, 7))) + r.choice(ends) + r.choice(ends)
        s = stemming.porter(word)
        assert word.startswith(s[: max(1, len(s) - 2)]), (word, s)


TEXTS = [
    "The quick brown fox jumps over the lazy dog's back.",
    "A lazy dog; the DOGS jumped quickly over brown foxes",
    "Quick, quick: jumping jumper jumps. Foxes' dens",
    "state of the art, art of the state", "state art", "", None, "the of and", "licensing licensed license licences",
    "dog " * 500 + "fox", "don't re-do it’s 3.14 naïve café",
]


def plain(texts, judge):
    """Documents and scores by positions in plain dictionaries; ``judge`` gets term, phrase and prefix functions."""
    docs = {i: stemming.analysed(t or "") for i, t in enumerate(texts)}
    size, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    places = {i: {} for i in docs}
    for i, found in docs.items():
        for at, t in found:
            places[i].setdefault(t, []).append(at)
    idf = lambda t: math.log(1 + (size - (n := sum(t in p for p in places.values())) + 0.5) / (n + 0.5))
    out = {}
    for i, p in places.items():
        damped = lambda n: n / (n + 1.2 * (0.25 + 0.75 * len(docs[i]) / mean))

        def term(text):
            hit = [t for t in {t for _, t in stemming.analysed(text)} if t in p]
            return bool(hit), sum(idf(t) * damped(len(p[t])) for t in hit)

        def phrase(text):
            want = stemming.analysed(text)
            n = sum(all(at + k - want[0][0] in p.get(t, ()) for k, t in want) for at in p.get(want[0][1], ())) if want else 0
            return n > 0, sum(idf(t) for _, t in want) * damped(n) if n else 0

        def prefix(text):
            return any(t.startswith(text.lower()) for t in p), 1.0

        m, s = judge(term, phrase, prefix)
        if m:
            out[i] = round(s, 6)
    return out


CASES = [
    (T.Term("jumping foxes"), lambda t, p, x: t("jumping foxes")),
    (T.Phrase("lazy dog"), lambda t, p, x: p("lazy dog")),
    (T.Phrase("state of the art"), lambda t, p, x: p("state of the art")),
    (T.Phrase("state art"), lambda t, p, x: p("state art")),
    (T.Phrase("jumps over the lazy dogs"), lambda t, p, x: p("jumps over the lazy dogs")),
    (T.Prefix("Qu"), lambda t, p, x: x("Qu")),
    (T.Term("license"), lambda t, p, x: t("license")),
    (T.Term("quick") & T.Term("dog"), lambda t, p, x: (t("quick")[0] and t("dog")[0], t("quick")[1] + t("dog")[1])),
    (T.Term("fox") & ~T.Phrase("brown fox"), lambda t, p, x: (t("fox")[0] and not p("brown fox")[0], t("fox")[1])),
    (
        (T.Term("art") | T.Prefix("jump")) & ~(T.Term("lazy") & T.Term("quick")),
        lambda t, p, x: ((t("art")[0] or x("jump")[0]) and not (t("lazy")[0] and t("quick")[0]), t("art")[1] * t("art")[0] + x("jump")[1] * x("jump")[0]),
    ),
    (T.Term("the of"), lambda t, p, x: (False, 0)),
    (~T.Term("dog"), lambda t, p, x: (False, 0)),
    (T.Term("don't it's naïve"), lambda t, p, x: t("don't it's naïve")),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_queries_equal_plain_search(spark, case):
    query, judge = CASES[case]
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    want = plain(TEXTS, judge)
    assert {r.id: r.score for r in T.matches(*T.postings(docs, "doc_id", "text", query), query).collect()} == pytest.approx(want, abs=2e-6)
    assert {r.id: r.score for r in T.matches(*T.postings(docs, "doc_id", "text"), query).collect()} == pytest.approx(want, abs=2e-6)


def test_stored_index_reads_the_buckets_of_its_terms(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    T.write_index(docs, "doc_id", "text", str(tmp_path / "index"))
    query = T.Phrase("lazy dog") & ~T.Term("quick")
    made, lengths = T.read_index(spark, str(tmp_path / "index"), query)
    plan = made._jdf.queryExecution().executedPlan().toString()
    wanted = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert wanted.startswith("bucket") and wanted.count(",") <= 2  # the buckets of three terms at most
    assert len(list((tmp_path / "index" / "postings").glob("bucket=*"))) > 10
    want = T.search(docs, "doc_id", "text", query, 10).collect()
    assert T.best(T.matches(made, lengths, query), 10).collect() == want and want
    members = spark.createDataFrame([(0,)], "id int")
    assert [r.id for r in T.search(docs, "doc_id", "text", T.Term("dog"), 10, members).collect()] == [0]


def test_texts_are_read_once_for_a_query(spark, tmp_path):
    rows = [(0, "Ones' thing’s end's 's it's"), (1, None), (2, "sheds of ones")]
    spark.createDataFrame(rows, "doc_id int, text string").write.parquet(f"{tmp_path}/d.parquet")
    q = T.Term("ones") | T.Term("sheds")
    made, lengths = T.postings(spark.read.parquet(f"{tmp_path}/d.parquet"), "doc_id", "text", q)
    found = T.matches(made, lengths, q)
    assert "parquet" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r[0] for r in found.collect()) == [0, 2]
    assert [r[1] for r in sorted(map(tuple, lengths.collect()))] == [4, 0, 2]
