"""Full-text search over positional postings: terms, phrases and prefixes, combined with and, or and not.

A query is an expression of ``Term``, ``Phrase`` and ``Prefix`` with ``&``, ``|``
and ``~``. Only the postings of its words are made or read; they are brought
together once by document, and the whole expression with its scores is then a
column over that row. Words of a query pass the same analysis as texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.stemming import STOP_WORDS, analysed, stem, words
from tessera.operators.checkpoint import cut

K1, B = 1.2, 0.75
#: partitions of a stored index; a query reads those of its terms
BUCKETS = 64


class Query:
    """Combines with ``&`` (all), ``|`` (any, at least one) and ``~`` (not); a query of nots alone matches nothing."""

    def __and__(self, other: Query) -> Query:
        return All((self, other))

    def __or__(self, other: Query) -> Query:
        return Any((self, other))

    def __invert__(self) -> Query:
        return Not(self)

    def leaves(self) -> Iterator[Query]:
        for part in getattr(self, "parts", ()):
            yield from part.leaves()


@dataclass(frozen=True)
class Term(Query):
    """The words of ``text``, any of them; stop words match nothing."""

    text: str

    def leaves(self):
        yield self

    @property
    def terms(self) -> list[str]:
        return sorted({t for _, t in analysed(self.text)})


@dataclass(frozen=True)
class Phrase(Query):
    """The words of ``text`` at the distances that they have in it; stop words may be any word."""

    text: str

    def leaves(self):
        yield self

    @property
    def places(self) -> list[tuple[int, str]]:
        found = analysed(self.text)
        return [(at - found[0][0], t) for at, t in found]

    @property
    def terms(self) -> list[str]:
        return sorted({t for _, t in self.places})


@dataclass(frozen=True)
class Prefix(Query):
    """Any indexed term that begins so; matches score 1. Prefixes are lower-cased, not stemmed."""

    text: str
    terms = ()

    def leaves(self):
        yield self


@dataclass(frozen=True)
class All(Query):
    parts: tuple[Query, ...]


@dataclass(frozen=True)
class Any(Query):
    parts: tuple[Query, ...]


@dataclass(frozen=True)
class Not(Query):
    part: Query

    @property
    def parts(self) -> tuple[Query, ...]:
        return (self.part,)


def _terms(query: Query) -> list[str]:
    return sorted({t for leaf in query.leaves() for t in leaf.terms})


def _prefixes(query: Query) -> list[str]:
    return sorted({leaf.text.lower() for leaf in query.leaves() if isinstance(leaf, Prefix)})


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def postings(df: DataFrame, id_col: str, text_col: str, query: Query | None = None) -> tuple[DataFrame, DataFrame]:
    """Postings (term, id, tf, positions) and lengths (id, n_terms: words that aren't stop words).

    With ``query`` only its words' postings: words that can't have one of its stems are
    left out before rows are made of them (a stem agrees with its word in all but its last two letters).
    """
    rows = df.select(F.col(id_col).alias("id"), words(text_col).alias("words"))
    n_terms = F.size(F.filter("words", lambda w: ~w.isin(*STOP_WORDS))).cast("long").alias("n_terms")
    places = F.transform("words", lambda w, k: F.struct(w.alias("word"), k.alias("at")))
    if query is None:
        rows = rows.select("id", n_terms, F.filter(places, lambda x: ~x["word"].isin(*STOP_WORDS)).alias("marked"))
    else:
        starts = sorted({t[: max(1, len(t) - 2)] for t in _terms(query)} | {p[: max(1, len(p) - 2)] for p in _prefixes(query)})
        kept = F.filter(places, lambda x: _any([x["word"].startswith(s) for s in starts]) & ~x["word"].isin(*STOP_WORDS))
        rows = cut(rows.select("id", n_terms, kept.alias("marked")))  # few words a text; else each use would read all texts again
    lengths = rows.select("id", "n_terms")
    one = rows.select("id", F.explode("marked").alias("m")).select("id", stem("m.word").alias("term"), "m.at")
    if query is not None:
        one = one.filter(_any([F.col("term").isin(*_terms(query)), *(F.col("term").startswith(p) for p in _prefixes(query))]))
    made = one.groupBy("term", "id").agg(F.array_sort(F.collect_list("at")).alias("positions"))
    return made.select("term", "id", F.size("positions").cast("long").alias("tf"), "positions"), lengths


def write_index(df: DataFrame, id_col: str, text_col: str, path: str) -> None:
    """Postings by bucket of their term, and lengths, under ``path``."""
    made, lengths = postings(df, id_col, text_col)
    bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
    # a bucket's rows are dealt to tasks by document too: a frequent word has rows for most documents
    made.withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "term", "id").write.partitionBy("bucket").parquet(f"{path}/postings")
    lengths.write.parquet(f"{path}/lengths")


def read_index(spark, path: str, query: Query) -> tuple[DataFrame, DataFrame]:
    """The stored postings of a query's words; without prefixes only the buckets of its terms are read."""
    made, lengths = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths")
    terms, prefixes = _terms(query), _prefixes(query)
    if not prefixes:
        buckets = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")).distinct().collect()]
        made = made.filter(F.col("bucket").isin(*buckets))
    return made.filter(_any([F.col("term").isin(*terms), *(F.col("term").startswith(p) for p in prefixes)])).drop("bucket"), lengths


def matches(made: DataFrame, lengths: DataFrame, query: Query, k1: float = K1, b: float = B) -> DataFrame:
    """(id, score) of every document that a query matches.

    A term scores idf * tf / (tf + k1 * (1 - b + b * length / mean length)); a phrase as one term
    with the sum of its terms' idf, a prefix 1; all and any add up what matches. A document that has
    none of a query's words is never found, whatever its nots.
    """
    terms, prefixes = _terms(query), _prefixes(query)
    place = {t: f"t{k}" for k, t in enumerate(terms)}
    starts = {p: f"p{k}" for k, p in enumerate(prefixes)}
    if not place and not starts:
        return lengths.select("id", F.lit(0.0).alias("score")).filter("false")
    found = [F.max(F.when(F.col("term") == t, F.col("positions"))).alias(c) for t, c in place.items()]
    found += [F.coalesce(F.bool_or(F.col("term").startswith(p)), F.lit(False)).alias(c) for p, c in starts.items()]
    made = made.filter(_any([F.col("term").isin(*terms), *(F.col("term").startswith(p) for p in prefixes)]))
    by_document = made.groupBy("id").agg(*found)
    counted = made.agg(F.lit(0).alias("__none"), *(F.count_if(F.col("term") == t).alias(f"{c}_n") for t, c in place.items()))
    size = lengths.agg(F.count("*").alias("n_docs"), F.avg("n_terms").alias("mean"))
    rows = by_document.join(lengths, "id").join(F.broadcast(counted)).join(F.broadcast(size))  # one row each
    idf = lambda t: F.log(1 + (F.col("n_docs") - F.col(f"{place[t]}_n") + 0.5) / (F.col(f"{place[t]}_n") + 0.5))
    damped = lambda tf: tf / (tf + k1 * (1 - b + b * F.col("n_terms") / F.col("mean")))

    def count(leaf: Phrase) -> Column:
        first, rest = leaf.places[0], leaf.places[1:]
        hits = F.filter(F.col(place[first[1]]), lambda at: reduce(lambda x, y: x & y, [F.array_contains(F.col(place[t]), at + k) for k, t in rest], F.lit(True)))
        return F.coalesce(F.when(reduce(lambda x, y: x & y, [F.col(place[t]).isNotNull() for t in leaf.terms]), F.size(hits)), F.lit(0))

    def judged(q: Query) -> tuple[Column, Column]:
        """Whether it matches, and its score where it does."""
        if isinstance(q, Term):
            has = [F.col(place[t]).isNotNull() for t in q.terms]
            score = [F.when(h, idf(t) * damped(F.size(place[t]))).otherwise(0.0) for h, t in zip(has, q.terms, strict=True)]
            return _any(has), reduce(lambda x, y: x + y, score, F.lit(0.0))
        if isinstance(q, Phrase):
            if not q.places:
                return F.lit(False), F.lit(0.0)
            n = count(q)
            return n > 0, reduce(lambda x, y: x + y, [idf(t) for _, t in q.places]) * damped(n)
        if isinstance(q, Prefix):
            return F.col(starts[q.text.lower()]), F.lit(1.0)
        if isinstance(q, Not):
            return ~judged(q.part)[0], F.lit(0.0)
        parts = [judged(p) for p in q.parts]
        score = reduce(lambda x, y: x + y, [F.when(m, s).otherwise(0.0) for m, s in parts])
        if isinstance(q, All):
            return reduce(lambda x, y: x & y, [m for m, _ in parts]), score
        return _any([m for m, _ in parts]), score

    matched, score = judged(query)
    return rows.filter(matched).select("id", F.round(score, 6).alias("score"))


def search(df: DataFrame, id_col: str, text_col: str, query: Query, k: int, members: DataFrame | None = None) -> DataFrame:
    """(id, score, rank) of the ``k`` best; ``members`` (id) restricts them afterwards, so fewer may remain."""
    return best(matches(*postings(df, id_col, text_col, query), query), k, members)


def best(found: DataFrame, k: int, members: DataFrame | None = None) -> DataFrame:
    top = found.orderBy(F.desc("score"), "id").limit(k)
    if members is not None:
        top = top.join(members.select(F.col(members.columns[0]).alias("id")).distinct(), "id", "left_semi")
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # k rows at most
