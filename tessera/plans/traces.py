"""Queries of evidence passages in texts."""

from pyspark.sql import functions as F

from tessera.operators import traces as R
from tessera.plans.base import query, table

_LOW = "abcdefghijklmnopqrstuvwxyz"
_SWAP = (_LOW + _LOW.upper(), _LOW.upper() + _LOW)

_PASSAGES = rf"""c AS (SELECT conv_id, turn, text, regexp_replace(substr(text, 3, 30), '^\s+|\s+$', '', 'g') AS p, trim(regexp_extract(substr(text, 3, 15), '^[^\n]*')) AS l1, trim(regexp_extract(substr(text, 30, 15), '^[^\n]*')) AS l2 FROM conversations),
    s AS (SELECT *, CASE WHEN turn % 5 = 3 AND length(l1) + length(l2) >= 24 THEN 3 WHEN turn % 5 = 3 THEN 0 ELSE turn % 5 END AS k FROM c)"""


def _passages(spark, sf):
    """Conversation turns with a passage each, made in one of five ways (``k``)."""
    end = lambda at: F.trim(F.regexp_extract(F.substring("text", at, 15), r"^[^\n]*", 0))
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text", F.regexp_replace(F.substring("text", 3, 30), r"^\s+|\s+$", "").alias("p"), end(3).alias("l1"), end(30).alias("l2"))
    t = F.col("turn") % 5
    k = F.when((t == 3) & (F.length("l1") + F.length("l2") >= 24), 3).when(t == 3, 0).otherwise(t)
    by_line = F.concat(F.lit("File path: data/run.txt\n"), "l1", F.lit("\r\n\n"), "l2")
    made = F.when(k == 1, F.translate("p", *_SWAP)).when(k == 2, F.regexp_replace("p", r"\s+", "  \n ")).when(k == 3, by_line).when(k == 4, F.concat(F.lit(r"D:\Exp "), "p")).otherwise(F.col("p"))
    return c.select("*", k.alias("k"), made.alias("passage"))


@query(
    rf"""WITH {_PASSAGES}, f AS (SELECT *, instr(text, l1) AS a FROM s)
    SELECT conv_id, turn, CASE WHEN k = 4 OR p = '' THEN NULL WHEN k = 3 THEN 'lines' WHEN k = 2 AND regexp_matches(p, '\s') THEN 'space' WHEN k = 1 AND translate(p, '{_SWAP[0]}', '{_SWAP[1]}') <> p AND NOT contains(text, translate(p, '{_SWAP[0]}', '{_SWAP[1]}')) THEN 'case' ELSE 'exact' END AS kind,
    CASE WHEN k = 4 OR p = '' THEN NULL WHEN k = 3 THEN a - 1 WHEN k IN (1, 2) THEN instr(lower(text), lower(p)) - 1 ELSE instr(text, p) - 1 END AS start,
    CASE WHEN k = 4 OR p = '' THEN NULL WHEN k = 3 THEN a + length(l1) + instr(substr(text, a + length(l1)), l2) + length(l2) - 2 WHEN k IN (1, 2) THEN instr(lower(text), lower(p)) - 1 + length(p) ELSE instr(text, p) - 1 + length(p) END AS "end" FROM f"""
)
def trace_spans(spark, sf):
    """Passages as they stand, in other case, with other white space, as lines with others between them, and one that isn't there."""
    found = _passages(spark, sf).withColumn("m", R.trace_range(F.col("text"), F.col("passage")))
    return found.select("conv_id", "turn", "m.kind", "m.start", "m.end")


_SPANS = "s AS (SELECT l_orderkey AS k, l_partkey AS a, l_partkey + CAST(l_quantity * 12 AS BIGINT) AS b, l_linenumber * 1000000 + l_suppkey AS o FROM lineitem)"
#: the sweep as pointers: from each span to the first one that begins at its end or later; dropped ones belong to the last kept one
_SWEEP = f"""{_SPANS}, r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY a, b DESC, o) AS n FROM s), x AS (SELECT r.k, r.n, r.b, min(q.n) AS nxt FROM r LEFT JOIN r q ON q.k = r.k AND q.n > r.n AND q.a >= r.b GROUP BY ALL),
    kept AS (SELECT k, n, b, nxt FROM x WHERE n = 1 UNION ALL SELECT x.k, x.n, x.b, x.nxt FROM kept JOIN x ON x.k = kept.k AND x.n = kept.nxt)"""


def _spans(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("a"), (F.col("l_partkey") + (F.col("l_quantity") * 12).cast("long")).alias("b"), (F.col("l_linenumber") * 1_000_000 + F.col("l_suppkey")).alias("o")
    )


@query(
    f"""WITH RECURSIVE {_SWEEP} SELECT r.k, r.a, r.b, r.o, coalesce((SELECT string_agg(d.o, ',' ORDER BY d.n) FROM r d WHERE d.k = kept.k AND d.n > kept.n AND (kept.nxt IS NULL OR d.n < kept.nxt) AND d.b <= kept.b AND d.a < kept.b), '') AS inside FROM kept JOIN r USING (k, n)"""
)
def separate_spans(spark, sf):
    return R.separate_spans(_spans(spark, sf), ["k"], "a", "b", "o").select("k", "a", "b", "o", F.array_join("inside", ",").alias("inside"))


@query(
    rf"""WITH {_PASSAGES}, f AS (SELECT conv_id, turn, text, instr(lower(text), lower(p)) - 1 AS a, instr(lower(text), lower(p)) - 1 + length(p) AS b FROM s WHERE k IN (0, 1, 2) AND p <> ''),
    g AS (SELECT conv_id, turn, 0 AS begin, a AS "end", '' AS traces FROM f WHERE a > 0 UNION ALL SELECT conv_id, turn, a, b, 'p' FROM f UNION ALL SELECT conv_id, turn, b, length(text), '' FROM f WHERE b < length(text)
    UNION ALL SELECT conv_id, turn, 0, length(text), '' FROM s WHERE k = 3 AND false OR NOT (k IN (0, 1, 2) AND p <> '') AND k <> 3)
    SELECT g.conv_id, g.turn, begin, "end", traces, traces <> '' AND (len(text) - len(replace(text, chr(10), '')) < 5 OR begin <= instr(text, chr(10))) AS below FROM g JOIN conversations c USING (conv_id, turn)"""
)
def trace_segments(spark, sf):
    """Turns cut at the one passage found in each (those found line by line left out)."""
    p = _passages(spark, sf).filter("k <> 3").withColumn("m", R.trace_range(F.col("text"), F.col("passage")))
    spans = p.filter("m is not null").select("conv_id", "turn", F.col("m.start").alias("a"), F.col("m.end").alias("b"), F.lit("p").alias("o"))
    return R.trace_segments(p.select("conv_id", "turn", "text"), spans, ["conv_id", "turn"], "text", "a", "b", "o").withColumn("traces", F.array_join("traces", ","))
