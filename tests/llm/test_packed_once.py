"""llm_packed_tokens packs once for documents and sequences."""

from tessera.llm.queries import QUERIES


def test_packing_runs_once(spark):
    made = QUERIES["llm_packed_tokens"](spark, "/root/testdata/sf0.001")
    assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert [tuple(r) for r in made.collect()] == [(200, True, True)]
