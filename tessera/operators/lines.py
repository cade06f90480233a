"""Texts to numbered lines and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

BREAK = r"\r\n|\n|\r"


def explode_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no from 0, line); a null text has no lines, an empty one has one."""
    return df.select(id_col, F.posexplode(F.split(text_col, BREAK)).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


def grade(df: DataFrame, line_col: str = "line", config: T.QualityConfig = T.QualityConfig()) -> DataFrame:
    """Adds ``quality``: struct(kind, score, reason). Early drops first, then an additive score over signals, clamped to 0..1.

    Counts, signals and verdict are separate projections, so each is computed once a line.
    """
    s, n = F.col("__s"), F.col("__n")
    share = lambda c: (c if isinstance(c, Column) else F.col(c)) / F.greatest(n, F.lit(1))
    stripped = df.withColumn("__s", F.coalesce(T.strip(line_col), F.lit("")))
    counted = stripped.withColumns({
        "__n": F.length("__s"), "__letters": T.matches("__s", r"\p{L}"), "__digits": T.matches("__s", r"\p{Nd}"), "__spaces": T.matches("__s", r"\s"),
        "__alnum": T.matches("__s", r"[\p{L}\p{N}]"), "__words": F.transform(F.regexp_extract_all(s, F.lit(T.WORD), F.lit(0)), lambda w: F.length(w)),
    })
    words, space = F.size("__words"), share("__spaces")
    mean = F.when(words > 0, F.aggregate("__words", F.lit(0), lambda a, w: a + w) / words).otherwise(0.0)
    signals = (
        (words >= 3, 0.35, "has_words"),
        (share("__letters") >= 0.25, 0.20, "enough_letters"),
        (space >= 0.08, 0.15, "has_spacing"),
        (mean >= 3, 0.10, "reasonable_word_length"),
        (T.looks_structured("__s"), config.structured_bonus, "structured_text"),
        (share("__digits") >= config.digit_ratio, -0.25, "too_many_digits"),
        (share(n - F.col("__alnum") - F.col("__spaces")) >= config.symbol_ratio, -0.25, "too_many_symbols"),
        ((space < 0.02) & (n > 60), -0.25, "dense_no_spaces"),
        ((n >= 80) & s.rlike(r"\S{80,}"), -0.30, "long_dense_token"),
        ((n >= 40) & s.rlike(T.HEX_LINE), -0.35, "hex_like"),
        ((n >= 80) & (F.col("__spaces") == 0) & s.rlike(T.BASE64_LINE), -0.30, "base64_like"),
        (F.when(space < 0.05, T.char_entropy("__s") >= 4.5), -0.20, "high_entropy_dense_text"),
    )
    early = (
        F.when(n == 0, "empty").when(n < 2, "too_short").when(T.control_ratio("__s") > 0.02, "many_control_chars")
        .when((n >= 21) & s.rlike(r"(\S)\1{20,}"), "repeated_char_noise").when((F.col("__digits") >= 6) & s.rlike(T.NUMERIC_ARRAY), "numeric_array")
    )
    marked = counted.withColumns({"__early": early, "__hit": F.array(*(F.coalesce(test, F.lit(False)) for test, *_ in signals))})
    total = F.lit(0.0)
    for k, (_, points, _) in enumerate(signals):
        total = total + F.when(F.col("__hit")[k], F.lit(points)).otherwise(0.0)
    names = F.array(*(F.lit(name) for *_, name in signals))
    scored = marked.withColumns({
        "__score": F.when(F.col("__early").isin("repeated_char_noise", "numeric_array"), 0.05).when(F.col("__early").isNotNull(), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))),
        "__reason": F.coalesce("__early", F.array_join(F.transform(F.filter(F.arrays_zip(F.col("__hit").alias("h"), names.alias("w")), lambda x: x["h"]), lambda x: x["w"]), ", ")),
    })
    kind = F.when(F.col("__early").isNull() & (F.col("__score") >= config.keep_score), "keep").otherwise("drop")
    out = scored.withColumn("quality", F.struct(kind.alias("kind"), F.round("__score", 6).alias("score"), F.col("__reason").alias("reason")))
    return out.select(*df.columns, "quality")


def quality_filter(lines: DataFrame, line_col: str = "line", protected: Column | None = None, config: T.QualityConfig = T.QualityConfig()) -> DataFrame:
    """Lines that pass the quality gate, and protected ones whatever their score."""
    keep = F.col("quality.kind") == "keep"
    graded = grade(lines, line_col, config)
    # as an only element, so that the filter stays above: pushed down it would count every signal anew wherever the verdict names it
    held = graded.select(*lines.columns, F.explode(F.array("quality")).alias("quality"))
    return held.filter(keep if protected is None else keep | protected).drop("quality")


def protect(lines: DataFrame, protected: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Lines with ``is_protected``; numbers in ``protected`` (id, line_no) that no line has are ignored, repeated ones count once."""
    marks = protected.select(id_col, "line_no").distinct().withColumn("is_protected", F.lit(True))
    return lines.join(marks, [id_col, "line_no"], "left").withColumn("is_protected", F.coalesce("is_protected", F.lit(False)))


def run_lengths(lines: DataFrame, id_col: str = "doc_id", order: str = "line_no", line_col: str = "line") -> DataFrame:
    """Runs of equal normalised lines as (id, run, first, n, line): gaps and islands by one window over each document."""
    w = Window.partitionBy(id_col).orderBy(order)
    norm = T.normalise_evidence(line_col)
    marked = lines.withColumn("__n", norm).withColumn("__new", F.coalesce((F.col("__n") != F.lag("__n").over(w)).cast("int"), F.lit(1)))
    runs = marked.withColumn("run", F.sum("__new").over(w))
    return runs.groupBy(id_col, "run").agg(F.min(order).alias("first"), F.count("*").alias("n"), F.min("__n").alias("line"))
