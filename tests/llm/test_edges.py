"""Every dealt operator and stage: null columns, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import pytest

from tessera.llm import bpe, exact_dedup, html_main, language_id, license_scan, mixing, simhash, toxicity, transport_stream, url_filter
from tessera.llm.queries import vocabulary_path

LONG = "wörd other " * 30_000
CLASH = "score double, host string, kept boolean, size long, __id string, __text string, __copies int, u long, held_out boolean"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"
EXTRA = (0.5, "h", False, 7, "x", "y", 3, 9, True)
ROWS = [
    (1, "the cat sat on the mat", "en", "a", 22),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, LONG, "de", "b", len(LONG)),
    (5, "THE cat sat on the mat", "en", None, 22),
    (5, "THE cat sat on the mat", "en", None, 22),
    (None, "der hund und die katze", "de", "b", 22),
    (7, "!?! 123", "fr", "a", 7),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([r + EXTRA for r in ROWS], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 1), (1, 0, 0), (4, 1, None), (None, 0, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")


def operators(labels):
    return {
        "1": transport_stream.media_columns,
        "2": lambda d: toxicity.score_documents(d, labels),
        "3": lambda d: bpe.encode_documents(d, vocabulary_path()),
        "5": mixing.mix,
        "6": exact_dedup.exact_dedup,
        "8": simhash.near_dedup,
        "9": language_id.identify,
        "10": license_scan.scan_licenses,
    }


@pytest.mark.parametrize("n", ["1", "2", "3", "5", "6", "8", "9", "10"])
def test_one_row_for_each_row(spark, docs, empty, labels, n):
    op = operators(labels)[n]
    assert sorted(str(r[0]) for r in op(docs).collect()) == sorted(str(r[0]) for r in ROWS)
    assert op(empty).collect() == []
    assert op(empty).columns == op(docs).columns


def test_defined_results(docs, labels):
    by = lambda df: {r[0]: r for r in df.collect()}
    media = by(transport_stream.media_columns(docs))
    assert media[2].n_bytes == 0 and media[2].payload_bytes == 64 and media[2].media_sha256 == media[3].media_sha256
    encoded = by(bpe.encode_documents(docs, vocabulary_path()))
    assert encoded[2].n_tokens == 0 == encoded[3].n_tokens and encoded[1].ids_sha256 == encoded[5].ids_sha256
    unique = by(exact_dedup.exact_dedup(docs))
    assert unique[1].keep_id == 5 and not unique[1].kept and unique[5].kept and unique[5].group_size == 3
    assert unique[2].keep_id == 3 and unique[None].kept and unique[None].keep_id is None
    near = by(simhash.near_dedup(docs))
    assert near[2].component_id == near[3].component_id == 2 and near[2].fp == 0 and near[5].component_id == 1 and near[None].component_id is None
    langs = by(language_id.identify(docs))
    assert [langs[k].lang_pred for k in (2, 3, 7)] == ["und"] * 3 and langs[2].score == 0 and langs[None].held_out is False
    found = by(license_scan.scan_licenses(docs))
    assert found[2].n_words == 0 and found[2].labels == "" and found[2].first_word is None and found[7].n_words == 1
    scored = by(toxicity.score_documents(docs, labels))
    assert 0 <= scored[2].score <= 1 and scored[2].spans == [] and scored[None].held_out is False
    mixed = mixing.mix(docs).collect()
    assert {r.copies for r in mixed if r.size == 0} <= {0, 1, 2, 3} and all(r.copies <= 3 for r in mixed)


def test_pages(spark):
    kind = "page_id long, url string, html string, host string, score double, __url string"
    rows = [(1, "http://A.example.net/en/x?y#z", "<p>a, b</p>"), (2, None, None), (3, "no scheme", ""), (3, "no scheme", ""), (None, "https://x.org/fr/", "<div>" * 500 + "t"), (5, "x://h?q", "é" * 50_000)]
    pages = spark.createDataFrame([r + ("h", 1.0, "u") for r in rows], kind)
    got = {r.page_id: r for r in url_filter.filter_urls(pages).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert (got[2].host, got[2].path, got[2].rule, got[2].verdict, got[2].score) == ("", "", None, "allow", 0.0)  # no rule blocks here: the threshold is 0
    assert got[None].rule == "org/fr/" and (got[5].host, got[5].path) == ("h", "")
    assert url_filter.filter_urls(pages).count() == 6
    texts = {r.page_id: r for r in html_main.extract_main_text(pages).collect()}
    assert texts[1].text == "a, b" and texts[2].text == "" == texts[3].text and texts[None].text == "t" and texts[5].n_chars == 50_000
    for op in (url_filter.filter_urls, html_main.extract_main_text):
        assert op(spark.createDataFrame([], kind)).collect() == []
