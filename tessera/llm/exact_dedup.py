"""Exact deduplication that no hot group can stall.

Texts are combined three times, each time by digest and full content: inside a
partition (Spark's partial aggregate), inside salted digest groups, and over
the winners of all salts. However often one text occurs, a partition sends it
once. Digests that hold more than one ``HOT``-th of all rows, of which there are fewer
than ``HOT``, are salted: their groups hold at most the partitions of one salt,
and the last combination at most ``salts`` rows of a text. Other digests have one salt,
so their texts are shuffled once. Texts are read twice: once for a narrow table
of ids and digests, from which all counts and the last join come, and once to be combined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, cut

SALTS, HOT = 16, 2048


def normalised(c: Column | str) -> Column:
    return ascii_lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest=None) -> DataFrame:
    """Return for every row: id, ``keep_id`` (the largest id of its equal texts), ``group_size``, ``kept`` and ``digest``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    All three combinations compare digest and whole text. Rows then find their
    group by digest, a second hash and length; should different texts agree in
    all three (a count over the groups tells), rows of such groups are matched by
    the text itself. Null ids lose to any other and tie among themselves; rows
    that repeat both id and text of the row that stays are the same document and
    are all marked kept. An empty table gives an empty result. Very long texts are
    compared whole; other columns are not read. ``digest`` maps a
    text column to a string column (SHA-256).
    """
    digest = digest or (lambda text: F.sha2(text, 256))
    text = F.col("__text")
    rows = df.select(F.col(id_col).alias("__id"), normalised(text_col).alias("__text")).select("*", digest(text).alias("__digest"))
    check, size = F.xxhash64(text).alias("__check"), F.length(text).alias("__chars")
    key = ["__digest", "__check", "__chars"]
    keyed = cut(rows.select("__id", "__digest", check, size))
    total = keyed.count()
    hot = keyed.groupBy("__digest").agg(F.count("*").alias("__n")).filter((F.col("__n") > 1) & (F.col("__n") * HOT > total))
    hot = F.broadcast(cut(hot.select("__digest", F.lit(True).alias("__hot"))))  # fewer than HOT rows
    spread = rows.withColumn("__part", F.pmod(F.spark_partition_id(), F.lit(salts))).join(hot, "__digest", "left")
    # the partial half of the first aggregate combines inside each partition, its final half inside each salted group
    salted = spread.groupBy("__digest", "__text", F.when(F.col("__hot"), F.col("__part")).alias("__salt")).agg(F.max("__id").alias("__id"), F.count("*").alias("__n"))
    size_of = lambda df: df.select("__digest", "__text", F.col("__id").alias("__keep"), F.col("__n").alias("__size"))
    # what is done with its one salt goes on without its text; hot groups keep it for the last combination
    combined = cut(salted.select("__digest", check, size, "__salt", F.when(F.col("__salt").isNotNull(), text).alias("__text"), F.col("__id"), F.col("__n")))
    whole = combined.filter("__salt is null").select(*key, F.col("__id").alias("__keep"), F.col("__n").alias("__size"))
    merged = combined.filter("__salt is not null").groupBy(*key, "__text").agg(F.max("__id").alias("__keep"), F.sum("__n").alias("__size"))
    groups = cut(whole.unionByName(merged.drop("__text")))
    clashes = groups.groupBy(key).agg(F.count("*").alias("__texts")).filter("__texts > 1").drop("__texts")
    out = [F.col("__id").alias(id_col), F.col("__keep").alias("keep_id"), F.col("__size").alias("group_size"), F.col("__id").eqNullSafe(F.col("__keep")).alias("kept"), F.col("__digest").alias("digest")]
    if clashes.isEmpty():
        return keyed.join(groups, key).select(out)
    plain = keyed.join(groups.join(clashes, key, "left_anti"), key).select(out)
    winners = size_of(salted.groupBy("__digest", "__text").agg(F.max("__id").alias("__id"), F.sum("__n").alias("__n")))
    by_text = rows.select("*", check, size).join(clashes, key, "left_semi").join(winners, ["__digest", "__text"]).select(out)
    return plain.unionByName(by_text)
