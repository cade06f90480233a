"""Hybrid retrieval: exact vector top-k, BM25 over an inverted index, weighted reciprocal-rank fusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.chunking import cosine

K1, B = 1.2, 0.75


def vector_top_k(df: DataFrame, id_col: str, vector_col: str, query: Sequence[float], k: int, members: DataFrame | None = None) -> DataFrame:
    """(id, score, rank) of the ``k`` nearest rows; ``members`` (id) restricts them afterwards, so fewer may remain.

    Top-k keeps k rows a task; the ranks are given to at most k rows.
    """
    q = F.array(*(F.lit(float(x)) for x in query))
    best = df.select(F.col(id_col).alias("id"), F.round(cosine(F.col(vector_col), q), 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)
    if members is not None:
        best = best.join(members.select(F.col(members.columns[0]).alias("id")).distinct(), "id", "left_semi")
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def inverted_index(df: DataFrame, id_col: str, text_col: str, terms: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Postings (term, id, tf), of ``terms`` alone if given, and lengths (id, n_terms)."""
    words = df.select(F.col(id_col).alias("id"), T.search_words(text_col).alias("words"))
    kept = F.col("words") if terms is None else F.filter("words", lambda w: w.isin(*terms))
    postings = words.select("id", F.explode(kept).alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))
    return postings, words.select("id", F.size("words").cast("long").alias("n_terms"))


def bm25(postings: DataFrame, lengths: DataFrame, terms: Sequence[str], k1: float = K1, b: float = B) -> DataFrame:
    """(id, score) of all documents with a query term; only the query's postings are joined."""
    wanted = sorted({t.lower() for t in terms})
    hit = postings.filter(F.col("term").isin(*wanted))
    df_ = hit.groupBy("term").agg(F.count("*").alias("df"))
    size = lengths.agg(F.count("*").alias("n_docs"), F.avg("n_terms").alias("mean"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n_terms") / F.col("mean")))
    scored = hit.join(F.broadcast(df_), "term").join(lengths, "id").join(F.broadcast(size))  # at most a row per query term, and one row
    return scored.groupBy("id").agg(F.round(F.sum(weight), 6).alias("score"))


def full_text_top_k(df: DataFrame, id_col: str, text_col: str, query: str, k: int, members: DataFrame | None = None) -> DataFrame:
    """(id, score, rank) by BM25 of ``query``'s words."""
    import re

    wanted = sorted(set(re.findall(r"\w+", query.lower())))
    best = bm25(*inverted_index(df, id_col, text_col, wanted), wanted).orderBy(F.desc("score"), "id").limit(k)
    if members is not None:
        best = best.join(members.select(F.col(members.columns[0]).alias("id")).distinct(), "id", "left_semi")
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def rrf(vector: DataFrame, full_text: DataFrame, top_k: int, vector_weight: float = 1.0, full_text_weight: float = 1.0, k: int = 60) -> DataFrame:
    """Weighted reciprocal-rank fusion of two ranked lists (id, score, rank): by score, best rank, id."""
    v = vector.select("id", F.col("score").alias("vector_score"), F.col("rank").alias("vector_rank"))
    f = full_text.select("id", F.col("score").alias("full_text_score"), F.col("rank").alias("full_text_rank"))
    part = lambda weight, rank: F.coalesce(F.lit(float(weight)) / (F.lit(k) + F.col(rank)), F.lit(0.0))
    fused = v.join(f, "id", "full_outer").withColumn("rrf_score", F.round(part(vector_weight, "vector_rank") + part(full_text_weight, "full_text_rank"), 9))
    return fused.orderBy(F.desc("rrf_score"), F.least("vector_rank", "full_text_rank"), "id").limit(top_k)


def compact_statements(statements: DataFrame, order: Column) -> DataFrame:
    """Statements (s, p, o), each once, where it comes first in ``order``."""
    w = Window.partitionBy("s", "p", "o").orderBy(order)
    return statements.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")
