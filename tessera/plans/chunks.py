"""Chunking and window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunking as C
from tessera.operators.lines import explode_lines, run_lengths
from tessera.plans.base import query, table
from tessera.plans.text import _LINES

BUDGET, LEAST, GAP = 256, 64, 32
_COSINE = "1 - list_dot_product(CAST(a AS DOUBLE[]), CAST(b AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a AS DOUBLE[]), CAST(a AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b AS DOUBLE[]), CAST(b AS DOUBLE[]))))"
_DISTANCE = f"n AS (SELECT vec_id, label, embedding AS a, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings), d AS (SELECT vec_id, label, round({_COSINE}, 6) AS distance FROM n)"


@query(f"WITH {_LINES} SELECT doc_id, line_no, sha256(coalesce(lag(line) OVER w, '') || line || coalesce(lead(line) OVER w, '')) AS window_sha FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)")
def buffer_windows(spark, sf):
    return C.buffer_windows(explode_lines(table(spark, sf, "documents"))).select("doc_id", "line_no", F.sha2("window_text", 256).alias("window_sha"))


@query(f"WITH {_DISTANCE} SELECT vec_id, label, distance FROM d")
def adjacent_cosine(spark, sf):
    return C.adjacent_distances(table(spark, sf, "embeddings"), "vec_id", "embedding", ["label"]).select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query(f"WITH {_DISTANCE}, t AS (SELECT label, quantile_cont(distance, 0.95) AS threshold FROM d GROUP BY label) SELECT vec_id, d.label, round(threshold, 6) AS threshold, coalesce(distance >= threshold, false) AS is_break FROM d JOIN t ON d.label = t.label")
def percentile_breaks(spark, sf):
    return C.percentile_breaks(adjacent_cosine(spark, sf), "vec_id", 95, ["label"]).select("vec_id", "label", F.round("threshold", 6).alias("threshold"), "is_break")


_LETTERS_COUNTED = "aeinorst"
_BY_LETTERS = "[" + ", ".join(f"CAST(length(w) - length(replace(w, '{c}', '')) AS DOUBLE)" for c in _LETTERS_COUNTED) + "]"


@query(
    f"""WITH {_LINES}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS many FROM lines), w AS (SELECT doc_id, line_no, coalesce(lag(line) OVER o, '') || line || coalesce(lead(line) OVER o, '') AS w FROM n WHERE many >= 4 WINDOW o AS (PARTITION BY doc_id ORDER BY line_no)),
    v AS (SELECT doc_id, line_no, {_BY_LETTERS} AS a, lead({_BY_LETTERS}) OVER (PARTITION BY doc_id ORDER BY line_no) AS b FROM w), z AS (SELECT *, sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)) AS size FROM v),
    d AS (SELECT doc_id, line_no, round(CASE WHEN b IS NULL THEN NULL WHEN size > 0 THEN 1 - list_dot_product(a, b) / size ELSE 1.0 END, 9) AS d FROM z), t AS (SELECT doc_id, round(quantile_cont(d, 0.8), 9) AS least FROM d GROUP BY doc_id),
    k AS (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k, count(*) OVER (PARTITION BY doc_id) AS cuts FROM d JOIN t USING (doc_id) WHERE d >= least), e AS (SELECT doc_id, min(line_no) AS lo, max(line_no) AS hi FROM lines GROUP BY doc_id)
    SELECT doc_id, CAST(0 AS BIGINT) AS chunk_no, lo AS start, hi AS "end" FROM e WHERE doc_id NOT IN (SELECT doc_id FROM k)
    UNION ALL SELECT k.doc_id, k.k - 1, CASE WHEN k.k = 1 THEN lo ELSE p.line_no END, CASE WHEN k.k = k.cuts THEN hi ELSE k.line_no END FROM k JOIN e USING (doc_id) LEFT JOIN k p ON p.doc_id = k.doc_id AND p.k = k.k - 1"""
)
def semantic_chunks(spark, sf):
    """Documents cut where counts of letters in windows of lines are least alike; distances to nine places, so that no rounding decides."""
    lines = explode_lines(table(spark, sf, "documents"))
    counts = lambda w: F.array(*((F.length(w) - F.length(F.replace(F.col(w), F.lit(c), F.lit("")))).cast("double") for c in _LETTERS_COUNTED))
    return C.semantic_chunks(lines, percentile=80, buffer=1, min_lines=4, embed=counts, digits=9).select("doc_id", "chunk_no", "start", "end")


@query(
    "WITH g AS (SELECT user_id, event_id, epoch(ts) AS t, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER w > 86400 THEN 1 ELSE 0 END AS far FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch(ts))),"
    " s AS (SELECT user_id, t, sum(far) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS session FROM g)"
    " SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, CAST(round(max(t) - min(t)) AS BIGINT) AS seconds FROM s GROUP BY ALL"
)
def gap_sessions(spark, sf):
    e = table(spark, sf, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("t"))
    return C.gap_sessions(e, "user_id", "t", 86_400).groupBy("user_id", "session").agg(F.count("*").alias("n"), F.round(F.max("t") - F.min("t")).cast("long").alias("seconds"))


_NUM = r"regexp_matches(line, '^[\d\s.,;|-]*$')"


@query(
    f"WITH {_LINES}, m AS (SELECT doc_id, line_no, {_NUM} AS x, coalesce(lag({_NUM}) OVER w, false) AS p, coalesce(lead({_NUM}) OVER w, false) AS q FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))"
    " SELECT doc_id, count(*) AS kept, CAST(sum(line_no) AS BIGINT) AS checksum FROM m WHERE NOT (x AND p AND q) GROUP BY doc_id"
)
def numeric_run_filter(spark, sf):
    lines = explode_lines(table(spark, sf, "documents"))
    kept = C.numeric_run_filter(lines, "doc_id", "line_no", F.col("line").rlike(r"^[\d\s.,;|-]*$"))
    return kept.groupBy("doc_id").agg(F.count("*").alias("kept"), F.sum("line_no").alias("checksum"))


_PACKED = f"""WITH RECURSIVE {_LINES}, t AS (SELECT doc_id, line_no, length(line) + 1 AS chars, CAST(ceil((length(line) + 1) / 4) AS BIGINT) AS n FROM lines),
    p AS (SELECT doc_id, line_no, CASE WHEN n > {BUDGET} THEN 0 ELSE n END AS open, CAST(0 AS BIGINT) AS chunk, CAST(CASE WHEN n > {BUDGET} THEN 1 ELSE 0 END AS BIGINT) AS nxt FROM t WHERE line_no = 0
      UNION ALL SELECT t.doc_id, t.line_no, CASE WHEN t.n > {BUDGET} THEN 0 WHEN p.open > 0 AND p.open + t.n > {BUDGET} THEN t.n ELSE p.open + t.n END,
        CAST(p.nxt + CASE WHEN p.open > 0 AND p.open + t.n > {BUDGET} THEN 1 ELSE 0 END AS BIGINT), CAST(p.nxt + CASE WHEN p.open > 0 AND p.open + t.n > {BUDGET} THEN 1 ELSE 0 END + CASE WHEN t.n > {BUDGET} THEN 1 ELSE 0 END AS BIGINT)
        FROM p JOIN t ON t.doc_id = p.doc_id AND t.line_no = p.line_no + 1)"""


@query(
    f"""{_PACKED} SELECT p.doc_id, CAST(chunk AS INTEGER) AS chunk_no, min(p.line_no) AS start, max(p.line_no) AS "end", count(*) AS n_lines, CAST(sum(n) AS BIGINT) AS tokens FROM p JOIN t ON p.doc_id = t.doc_id AND p.line_no = t.line_no GROUP BY ALL"""
)
def fixed_token_chunks(spark, sf):
    return C.pack(explode_lines(table(spark, sf, "documents")), BUDGET).drop("content")


def merging_sql(least: int, most: int) -> str:
    """The merge of small chunks to a fixed point over ``c`` (doc_id, a, b, lines, chars), a step a round."""
    return f"""
    states AS (SELECT doc_id, list(struct_pack(a := a, b := b, lines := lines, chars := chars, src := CAST(1 AS BIGINT)) ORDER BY a) AS ps, CAST(1 AS BIGINT) AS pos FROM c GROUP BY doc_id
      UNION ALL SELECT doc_id, CASE WHEN k IS NULL THEN ps ELSE list_concat(list_concat(ps[1:k - 1], [struct_pack(a := ps[k].a, b := ps[k + 1].b, lines := ps[k].lines + ps[k + 1].lines, chars := ps[k].chars + ps[k + 1].chars, src := ps[k].src + ps[k + 1].src)]), ps[k + 2:]) END,
        CASE WHEN k IS NULL THEN pos + 1 ELSE greatest(1, k - 1) END
      FROM (SELECT doc_id, ps, pos, CASE WHEN ceil(ps[pos].chars / 4) < {least} THEN CASE WHEN pos > 1 AND ceil((ps[pos - 1].chars + ps[pos].chars) / 4) <= {most} THEN pos - 1 WHEN pos < len(ps) AND ceil((ps[pos].chars + ps[pos + 1].chars) / 4) <= {most} THEN pos END END AS k FROM states WHERE pos <= len(ps))),
    merged AS (SELECT doc_id, unnest(ps) AS x, generate_subscripts(ps, 1) - 1 AS chunk_no FROM states WHERE pos > len(ps))
    SELECT doc_id, chunk_no, x.a AS start, x.b AS "end", x.lines AS n_lines, CAST(ceil(x.chars / 4) AS BIGINT) AS tokens, x.src AS source_chunk_count, CASE WHEN x.src > 1 THEN 'min_token_merge' ELSE '' END AS operations FROM merged"""


@query(
    f"""{_PACKED}, c AS (SELECT p.doc_id, chunk, min(p.line_no) AS a, max(p.line_no) AS b, count(*) AS lines, CAST(sum(t.chars) AS BIGINT) AS chars FROM p JOIN t ON p.doc_id = t.doc_id AND p.line_no = t.line_no GROUP BY ALL),
{merging_sql(LEAST, BUDGET * 2)}"""
)
def min_token_merge(spark, sf):
    lines = explode_lines(table(spark, sf, "documents"))
    return C.post_process(C.pack(lines, BUDGET), lines, LEAST, BUDGET * 2, GAP).withColumn("operations", F.array_join("operations", ","))


@query(
    rf"WITH {_LINES}, n AS (SELECT doc_id, line_no, regexp_replace(regexp_replace(regexp_replace(lower(line), '\s+', ' ', 'g'), '[‐-―]', '-', 'g'), '^\s+|\s+$', '', 'g') AS s FROM lines),"
    " c AS (SELECT *, CASE WHEN s = lag(s) OVER w THEN 0 ELSE 1 END AS new FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)), r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS run FROM c)"
    " SELECT doc_id, CAST(run AS BIGINT) AS run, min(line_no) AS first, count(*) AS n FROM r GROUP BY ALL HAVING count(*) > 1"
)
def repeated_line_runs(spark, sf):
    return run_lengths(explode_lines(table(spark, sf, "documents"))).filter("n > 1").select("doc_id", "run", "first", "n")


@query(
    "WITH d AS (SELECT doc_id, text AS t, length(text) AS n FROM documents) SELECT doc_id, 'whole' AS part, sha256(t) AS content_sha FROM d WHERE n <= 1024 UNION ALL SELECT doc_id, 'beginning', sha256(substr(t, 1, 512)) FROM d WHERE n > 1024"
    " UNION ALL SELECT doc_id, 'middle', sha256(substr(t, n // 2 - 127, 256)) FROM d WHERE n > 1024 UNION ALL SELECT doc_id, 'end', sha256(substr(t, n - 255, 256)) FROM d WHERE n > 1024"
)
def sample_windows(spark, sf):
    return C.sample_windows(table(spark, sf, "documents"), "doc_id", "text", 256).select("doc_id", "part", F.sha2("content", 256).alias("content_sha"))


@query(
    "WITH r AS (SELECT doc_id, quality, CAST(CASE WHEN quality = 1 THEN 1 ELSE 2 END AS INTEGER) AS rank FROM labels) SELECT d.doc_id, source, CAST(coalesce(rank, 10000) AS INTEGER) AS rank, row_number() OVER (PARTITION BY source ORDER BY coalesce(rank, 10000), d.doc_id) AS position FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id"
)
def chunk_order(spark, sf):
    from pyspark.sql import Window

    ranks = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, 1).otherwise(2).alias("rank"))
    joined = table(spark, sf, "documents").join(ranks, "doc_id", "left").select("doc_id", "source", F.coalesce("rank", F.lit(10_000)).alias("rank"))
    return joined.withColumn("position", F.row_number().over(Window.partitionBy("source").orderBy("rank", "doc_id")).cast("long"))


@query(
    "SELECT conv_id, turn, role, count(*) OVER w AS n_before, coalesce(sum(CAST(ceil(length(text) / 4) AS BIGINT)) OVER w, 0)::BIGINT AS tokens_before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
)
def context_prefix_merge(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.count("*").over(w).alias("n_before"), F.coalesce(F.sum(T.estimated_tokens("text")).over(w), F.lit(0)).alias("tokens_before"))
