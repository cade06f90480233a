"""Budgets over conversations: windows of turns, and shares of sections."""

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import budgets as B
from tessera.plans.base import query, table


@query(
    """WITH t AS (SELECT conv_id, turn, text, ceil(length(text) / 4) AS need, sum(ceil(length(text) / 4)) OVER (PARTITION BY conv_id) AS total, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations WHERE turn < 4),
    a AS (SELECT *, CASE WHEN total > 200 THEN CASE WHEN n = 1 THEN 200 WHEN n = 2 THEN CASE k WHEN 0 THEN 120 ELSE 80 END ELSE CASE k WHEN 0 THEN 100 WHEN 1 THEN 50 WHEN 2 THEN 50 ELSE 1 END END END AS allocated FROM t)
    SELECT conv_id, turn, CAST(allocated AS BIGINT) AS allocated, sha256(CASE WHEN allocated IS NULL OR need <= allocated THEN text ELSE regexp_replace(substr(text, 1, greatest(0, allocated * 4 - 12)), '\\s+$', '') || ' [truncated]' END) AS digest FROM a"""
)
def windows_within_budget(spark, sf):
    turns = table(spark, sf, "conversations").filter("turn < 4").select("conv_id", "turn", "text")
    return B.capped_windows(turns, ["conv_id"], "turn", "text", 200).select("conv_id", "turn", "allocated", F.sha2("text", 256).alias("digest"))


@query(
    """WITH RECURSIVE s AS (SELECT conv_id AS c, turn AS t, CAST(ceil(length(text) / 4) AS DOUBLE) AS n, CASE role WHEN 'system' THEN 1.0::DOUBLE WHEN 'user' THEN 2.0 ELSE 5.0 END AS w FROM conversations),
    o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n / w, t) AS k, count(*) OVER (PARTITION BY c) AS many, sum(n) OVER (PARTITION BY c) AS total FROM s),
    f AS (SELECT c, 0::BIGINT AS k, 0.0::DOUBLE AS spent, (SELECT sum(w) FROM s WHERE s.c = o.c) AS open, NULL::DOUBLE AS level FROM o WHERE k = 1
      UNION ALL SELECT o.c, o.k, CASE WHEN (400 - f.spent) / f.open >= o.n / o.w THEN f.spent + o.n ELSE f.spent END, f.open - o.w, CASE WHEN (400 - f.spent) / f.open >= o.n / o.w THEN NULL ELSE (400 - f.spent) / f.open END FROM f JOIN o ON o.c = f.c AND o.k = f.k + 1 WHERE f.level IS NULL),
    l AS (SELECT c, max(level) AS level FROM f GROUP BY c), g AS (SELECT o.*, floor(least(n, coalesce(level * w, n)) + 1e-9) AS granted FROM o JOIN l USING (c)),
    m AS (SELECT *, floor(least(400, total)) - sum(granted) OVER (PARTITION BY c) AS spare, sum(CASE WHEN n > granted THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY t ROWS UNBOUNDED PRECEDING) AS place FROM g)
    SELECT c AS conv_id, t AS turn, CAST(n AS BIGINT) AS need, CAST(granted + CASE WHEN n > granted AND place <= spare THEN 1 ELSE 0 END AS BIGINT) AS granted FROM m"""
)
def shares_of_budget(spark, sf):
    """400 tokens a conversation, dealt to its turns by role."""
    share = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(5)
    turns = table(spark, sf, "conversations").select("conv_id", "turn", T.estimated_tokens("text").alias("need"), share.alias("share"))
    return B.shared_budget(turns, ["conv_id"], "need", "share", 400, "turn").select("conv_id", "turn", "need", "granted")
