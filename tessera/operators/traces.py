"""Where evidence passages stand in a text, and the text cut at them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: white space of passages and texts; fixed value
WHITE = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: lines that prompts put before a passage; fixed values
METADATA = r"(?i)^(Dataset name:|File path:|Line-Index-Span:|Chunk content \(after text-quality line filtering\):)"
#: least characters of a passage that is searched with other white space, and of the lines of one that is searched line by line; fixed values
LEAST_LOOSE, LEAST_LINES = 3, 24
#: segments that begin up to this line have their label below; fixed value
LABEL_LINES = 6

_RANGE = "struct<kind:string,start:bigint,end:bigint>"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WHITE}+|{WHITE}+$", "")


def decoded(c: Column) -> Column:
    r"""Written ``\r\n``, ``\n`` and ``\t`` as what they stand for."""
    return F.replace(F.replace(F.replace(c, F.lit(r"\r\n"), F.lit("\n")), F.lit(r"\n"), F.lit("\n")), F.lit(r"\t"), F.lit("\t"))


def _lines(c: Column) -> Column:
    return F.split(c, r"\r?\n")


def without_metadata(c: Column) -> Column:
    """A passage without its prompt's lines; as it is if nothing else is in it."""
    kept = F.filter(_lines(c), lambda x: ~F.rlike(trimmed(x), F.lit(METADATA)))
    bare = trimmed(F.array_join(kept, "\n"))
    return F.when(bare == "", trimmed(c)).otherwise(bare)


def forms(passage: Column) -> Column:
    """What is searched for a passage, in this order: as it stands, decoded, without metadata, both."""
    p = F.coalesce(passage, F.lit(""))
    made = F.array(trimmed(p), decoded(trimmed(p)), without_metadata(p), decoded(without_metadata(p)))
    return F.filter(F.array_distinct(made), lambda x: x != "")


def _found(kind: str, start: Column, size: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), start.cast("bigint").alias("start"), (start + size).cast("bigint").alias("end"))


def direct(content: Column, p: Column) -> Column:
    """The first place of ``p`` as it stands, else but for case (places are those of the lower-cased text)."""
    exact, caseless = F.instr(content, p), F.instr(F.lower(content), F.lower(p))
    return F.when(exact > 0, _found("exact", exact - 1, F.length(p))).when(caseless > 0, _found("case", caseless - 1, F.length(p)))


def loose(content: Column, p: Column) -> Column:
    """The first place of ``p`` but for case, with any white space where it has some."""
    words = F.regexp_replace(trimmed(F.lower(p)), r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    pattern = F.regexp_replace(words, rf"{WHITE}+", F.lit(WHITE.replace("\\", "\\\\") + "+"))
    text = F.lower(content)
    size = F.length(F.regexp_replace(trimmed(p), rf"{WHITE}+", " "))
    return F.when((size >= LEAST_LOOSE) & F.rlike(text, pattern), _found("space", F.regexp_instr(text, pattern) - 1, F.length(F.regexp_substr(text, pattern))))


def in_order(content: Column, p: Column) -> Column:
    """From the first to the last line of ``p``, each found after the one before it, with anything between them."""
    lines = F.filter(F.transform(_lines(p), trimmed), lambda x: (x != "") & ~F.rlike(x, F.lit(METADATA)))

    def step(done: Column, line: Column) -> Column:
        rest = F.substring(content, done["at"] + 1, F.length(content))
        hit = F.coalesce(direct(rest, line), loose(rest, line))
        missed = done["missed"] | hit.isNull()
        end = (done["at"] + hit["end"]).cast("int")
        return F.struct(
            F.coalesce(done["first"], done["at"] + hit["start"]).cast("bigint").alias("first"), F.coalesce(F.when(missed, done["at"]).otherwise(end), F.lit(0)).cast("int").alias("at"), missed.alias("missed")
        )

    start = F.struct(F.lit(None).cast("bigint").alias("first"), F.lit(0).alias("at"), F.lit(False).alias("missed"))
    enough = (F.size(lines) >= 2) & (F.length(F.array_join(lines, "")) >= LEAST_LINES)
    done = F.aggregate(lines, start, step)
    return F.when(enough & ~done["missed"], F.struct(F.lit("lines").alias("kind"), done["first"].alias("start"), done["at"].cast("bigint").alias("end")))


def trace_range(content: Column, passage: Column) -> Column:
    """struct(kind, start, end) of a passage in a text (0-based, end exclusive), null where it isn't.

    Every form of the passage is searched as it stands or but for case
    (``exact``, ``case``), then every form with other white space (``space``), then line by line
    (``lines``). Characters of patterns in a passage stand for themselves.
    """
    tries = [F.filter(F.transform(forms(passage), partial(f, content)), lambda x: x.isNotNull()) for f in (direct, loose, in_order)]
    return F.coalesce(*(F.get(t, F.lit(0)).cast(_RANGE) for t in tries))


def separate_spans(spans: DataFrame, keys: Sequence[str], start: str, end: str, order: str) -> DataFrame:
    """Of each key the spans that a sweep keeps, with ``inside``: the ``order`` values of dropped spans that end within the kept one before them.

    Spans go by start, longer ones first, then by ``order``; one that begins before the end of the last
    kept one is dropped. Only runs of spans that overlap are swept, each by itself, so a key may have any number of spans.
    """
    rows = spans.select(*keys, F.col(start).alias("__start"), F.col(end).alias("__end"), F.col(order).alias("__order"))
    w = Window.partitionBy(*keys).orderBy("__start", F.desc("__end"), "__order")
    before = F.max("__end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum(F.when(before > F.col("__start"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = rows.withColumn("__run", run).groupBy(*keys, "__run").agg(F.array_sort(F.collect_list(F.struct("__start", (-F.col("__end")).alias("__less"), "__order"))).alias("__spans"))
    of = dict(rows.dtypes)
    kept = f"array<struct<start:{of['__start']},end:{of['__end']},order:{of['__order']},inside:array<{of['__order']}>>>"

    def step(done: Column, x: Column) -> Column:
        last, end_ = F.element_at(done, -1), -x["__less"]
        fresh = F.struct(x["__start"].alias("start"), end_.alias("end"), x["__order"].alias("order"), F.array().cast(f"array<{of['__order']}>").alias("inside"))
        within = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"], last["end"], last["order"], F.concat(last["inside"], F.array(x["__order"])).alias("inside"))))
        return F.when((F.size(done) == 0) | (F.get(done, F.size(done) - 1)["end"] <= x["__start"]), F.concat(done, F.array(fresh)).cast(kept)).when(end_ <= F.get(done, F.size(done) - 1)["end"], within.cast(kept)).otherwise(done)

    swept = runs.select(*keys, F.explode(F.aggregate("__spans", F.array().cast(kept), step)).alias("__kept"))
    return swept.select(*keys, F.col("__kept.start").alias(start), F.col("__kept.end").alias(end), F.col("__kept.order").alias(order), F.col("__kept.inside").alias("inside"))


def trace_segments(texts: DataFrame, spans: DataFrame, keys: Sequence[str], text: str, start: str, end: str, order: str) -> DataFrame:
    """Texts cut at their kept spans: keys, ``begin``, ``end`` (0-based, exclusive), ``traces`` (empty between spans) and ``below``, for segments whose label has no room above them.

    A text without spans is one segment, also an empty one.
    """
    kept = separate_spans(spans, keys, start, end, order)
    w = Window.partitionBy(*keys).orderBy(start)
    piece = lambda a, b, traces: F.struct(a.cast("bigint").alias("begin"), b.cast("bigint").alias("end"), traces.alias("traces"))
    none = F.array().cast(f"array<{dict(spans.dtypes)[order]}>")
    joined = texts.select(*keys, F.col(text).alias("__text")).join(kept, list(keys), "left")
    sixth = F.substring_index(F.concat("__text", F.lit("\n" * LABEL_LINES)), "\n", LABEL_LINES - 1)
    joined = joined.withColumn("__from", F.coalesce(F.lag(end).over(w), F.lit(0))).withColumn("__last", F.lead(start).over(w).isNull())
    size = F.length("__text")
    gap = F.when(F.col(start).isNull(), piece(F.lit(0), size, none)).when(F.col(start) > F.col("__from"), piece(F.col("__from"), F.col(start), none))
    own = F.when(F.col(start).isNotNull(), piece(F.col(start), F.col(end), F.concat(F.array(order), "inside")))
    tail = F.when(F.col("__last") & (F.col(end) < size), piece(F.col(end), size, none))
    below = (F.size("__s.traces") > 0) & (F.col("__s.begin") <= F.least(F.length(sixth) + 1, size))
    cut = joined.select(*keys, "__text", F.explode(F.filter(F.array(gap, own, tail), lambda x: x.isNotNull())).alias("__s"))
    return cut.select(*keys, "__s.begin", "__s.end", "__s.traces", below.alias("below"))
