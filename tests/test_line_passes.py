"""Lines are graded once: how often texts are read, and what filters hold."""

import re

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunking as C
from tessera.operators import lines as L
from tessera.plans import QUERIES


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_counts_of_characters(spark):
    texts = ["", "aB3 é٣\t-", "\U0001d4b3\U0001d7d8x", "   ", None, "no\x00\x01ne"]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    for one in (r"\p{L}", r"\p{Nd}", r"\s", r"[\p{L}\p{N}]", r"[\p{C}&&[^\t\n\r]]"):
        assert [r[0] for r in df.select(T.matches("c", one)).collect()] == [r[0] for r in df.select(F.regexp_count("c", F.lit(one))).collect()]


def test_quality_filter_counts_signals_once(spark):
    found = plan(L.quality_filter(L.explode_lines(spark.createDataFrame([(1, "a line of text")], "doc_id int, text string"))))
    assert not [x for x in found.splitlines() if re.search(r"^\W*Filter .*regexp_replace", x)]


def test_protected_lines_reads_texts_for_marks_and_grades_alone(spark):
    assert plan(QUERIES["protected_lines"](spark, "/root/testdata/sf0.001")).count("parquet") <= 2


def test_chunks_read_texts_once_and_pack_alike(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(row):
        read.add(1)
        return row

    rows = [(d, "\n".join(f"line {k} of the text {'word ' * (k * d % 23)}" for k in range(40))) for d in range(1, 6)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(seen), "doc_id int, text string")
    got = sorted(map(tuple, C.chunk_documents(docs, "fixed", 24, 10, 32).collect()))
    assert read.value == len(rows)
    lines = L.quality_filter(L.explode_lines(docs))
    assert got == sorted(map(tuple, C.post_process(C.pack(lines, 24), lines, 10, 24, 32).collect())) and len(got) > 50
