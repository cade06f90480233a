"""Lines into chunks: token budgets, gap barriers, similarity breaks, small-chunk merges.

Stateless steps are window functions. Packing with a reset is a scan over a
document's ordered lines (an ``aggregate`` inside the JVM); merging to a fixed
point depends on order and runs per document in Arrow batches. Lines of one
document always fit one row, as the document itself does.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T


def buffer_windows(lines: DataFrame, buffer: int = 1, id_col: str = "doc_id", order: str = "line_no", line_col: str = "line") -> DataFrame:
    """Each line with its ``buffer`` neighbours on both sides, cut at the ends."""
    w = Window.partitionBy(id_col).orderBy(order).rowsBetween(-buffer, buffer)
    return lines.withColumn("window_text", F.array_join(F.collect_list(line_col).over(w), ""))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two vectors; 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def adjacent_distances(df: DataFrame, order: str, vector: str, partition: Sequence[str | Column] = ()) -> DataFrame:
    """1 - cosine to the next row in order; null in the last row."""
    w = Window.partitionBy(*partition).orderBy(order)
    nxt = F.lead(vector).over(w)
    return df.withColumn("__next", nxt).withColumn("distance", F.when(F.col("__next").isNotNull(), 1 - cosine(F.col(vector), F.col("__next")))).drop("__next")


def percentile_breaks(distances: DataFrame, order: str, percentile: float, partition: Sequence[str], digits: int | None = None) -> DataFrame:
    """Marks breaks: distances at or above the linear-interpolation percentile of their partition."""
    threshold = F.percentile("distance", F.lit(percentile / 100))
    cut = distances.groupBy(*partition).agg((threshold if digits is None else F.round(threshold, digits)).alias("threshold"))
    return distances.join(cut, list(partition)).withColumn("is_break", F.coalesce(F.col("distance") >= F.col("threshold"), F.lit(False)))


def semantic_groups(breaks: Sequence[int], n: int) -> list[tuple[int, int]]:
    """Inclusive line spans for break positions: a group starts at the break line before it, and the last break never cuts."""
    if not breaks:
        return [(0, n - 1)] if n else []
    return [(0 if k == 0 else breaks[k - 1], n - 1 if k == len(breaks) - 1 else b) for k, b in enumerate(breaks)]


def gap_sessions(df: DataFrame, partition: str, order: str, gap: float, name: str = "session") -> DataFrame:
    """Numbers runs whose neighbours are at most ``gap`` apart."""
    w = Window.partitionBy(partition).orderBy(order)
    far = F.coalesce((F.col(order) - F.lag(order).over(w) > gap).cast("long"), F.lit(0))
    return df.withColumn("__far", far).withColumn(name, F.sum("__far").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__far")


def numeric_run_filter(rows: DataFrame, partition: str, order: str, is_numeric: Column) -> DataFrame:
    """Drops rows that are numeric between two numeric rows: of a run its first and last stay."""
    w = Window.partitionBy(partition).orderBy(order)
    marked = rows.withColumn("__n", is_numeric)
    marked = marked.withColumn("__inside", F.col("__n") & F.coalesce(F.lag("__n").over(w), F.lit(False)) & F.coalesce(F.lead("__n").over(w), F.lit(False)))
    return marked.filter(~F.col("__inside")).drop("__n", "__inside")


def pack(lines: DataFrame, budget: int, id_col: str = "doc_id", order: str = "line_no", line_col: str = "line", within: Sequence[str] = ()) -> DataFrame:
    """Greedy packing of lines up to ``budget`` estimated tokens; a line over the budget stands alone.

    Returns (id, chunk_no, start, end, n_lines, tokens, content); ``within`` names further columns that chunks don't cross.
    """
    keys = [id_col, *within]
    tokens = T.estimated_tokens(F.concat(F.col(line_col), F.lit("\n"))).cast("int")
    ordered = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), tokens.alias("n"), F.col(line_col).alias("line")))).alias("lines"))
    start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("chunk"), F.array().cast("array<int>").alias("chunks"))

    def step(acc: Column, x: Column) -> Column:
        n = x["n"]
        fresh = (acc["open"] > 0) & (acc["open"] + n > budget)
        chunk = acc["chunk"] + fresh.cast("int")
        full = F.when(fresh, F.lit(0)).otherwise(acc["open"]) + n
        over = n > budget
        return F.struct(F.when(over, F.lit(0)).otherwise(full).alias("open"), (chunk + over.cast("int")).alias("chunk"), F.concat(acc["chunks"], F.array(chunk)).alias("chunks"))

    numbered = ordered.select(*keys, "lines", F.aggregate("lines", start, step)["chunks"].alias("chunks"))
    flat = numbered.select(*keys, F.explode(F.arrays_zip("lines", "chunks")).alias("x")).select(*keys, F.col("x.lines.at").alias("at"), F.col("x.lines.n").alias("n"), F.col("x.lines.line").alias("line"), F.col("x.chunks").alias("chunk_no"))
    return flat.groupBy(*keys, "chunk_no").agg(
        F.min("at").alias("start"), F.max("at").alias("end"), F.count("*").alias("n_lines"), F.sum("n").alias("tokens"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda r: r["line"]), "\n").alias("content"),
    )


class Piece:
    __slots__ = ("lines", "sources", "operations", "barrier")

    def __init__(self, lines: list[int], barrier: bool = False):
        self.lines, self.sources, self.operations, self.barrier = lines, 1, [], barrier


def split_at_gaps(chunks: Sequence[Sequence[int]], gap: int) -> list[Piece]:
    """Chunks (lists of line numbers) cut where neighbours are over ``gap`` apart; pieces after a cut are barred from merging to the left."""
    out: list[Piece] = []
    for chunk in chunks:
        parts: list[Piece] = []
        for line in chunk:
            if not parts or line - parts[-1].lines[-1] > gap:
                parts.append(Piece([], barrier=bool(parts)))
            parts[-1].lines.append(line)
        if len(parts) > 1:
            for p in parts:
                p.operations.append("gap_split")
        out += parts
    return out


def merge_small(pieces: list[Piece], sizes: Mapping[int, int], least: int, most: int, distances: Mapping[int, float], tokens: Callable[[int], int] = int) -> list[Piece]:
    """Joins pieces under ``least`` tokens to a neighbour while the sum stays within ``most``, until nothing changes.

    Of two neighbours the one with a known boundary distance wins, then the
    nearer, then the left. ``sizes``: length of each line; ``tokens``: tokens of a
    text of such a length, since a chunk's text is counted as a whole.
    """
    size = lambda lines: tokens(sum(sizes.get(i, 0) for i in set(lines)))

    def boundary(left: Piece, right: Piece) -> float | None:
        return distances.get(left.lines[-1], distances.get(right.lines[0]))

    at = 0
    while least > 0 and at < len(pieces):
        own = pieces[at]
        options = []
        if size(own.lines) < least:
            for side, k in ((0, at - 1), (1, at)):
                if 0 <= k and k + 1 < len(pieces) and not pieces[k + 1].barrier and (most <= 0 or size(pieces[k].lines + pieces[k + 1].lines) <= most):
                    d = boundary(pieces[k], pieces[k + 1])
                    options.append((d is None, d or 0.0, side, k))
        if not options:
            at += 1
            continue
        k = min(options)[3]
        a, b = pieces[k], pieces[k + 1]
        both = Piece(sorted({*a.lines, *b.lines}), a.barrier)
        both.sources, both.operations = a.sources + b.sources, list(dict.fromkeys([*a.operations, *b.operations, "min_token_merge"]))
        pieces[k : k + 2] = [both]
        at = max(0, k - 1)
    return pieces


MERGED = "chunk_no bigint, start bigint, `end` bigint, n_lines bigint, tokens bigint, source_chunk_count bigint, operations array<string>"


def packed_spans(order: Sequence[int], tokens: Sequence[int], budget: int) -> list[tuple[int, int]]:
    """(start, end) of the chunks that ``pack`` makes of lines of so many tokens."""
    spans: list[tuple[int, int]] = []
    held = 0  # tokens of the open chunk; a line over the budget closes it
    for at, n in zip(order, tokens, strict=True):
        if held > 0 and held + n <= budget:
            spans[-1] = spans[-1][0], at
        else:
            spans.append((at, at))
            held = 0
        held = 0 if n > budget else held + n
    return spans


def _sizes(lines: DataFrame, id_col: str) -> DataFrame:
    """The numbers and characters of each text's lines, in order; a text's lines reach one row as numbers."""
    own = lines.select(id_col, F.struct("line_no", (F.length("line") + 1).cast("long").alias("n")).alias("x"))
    b = own.groupBy(id_col).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return b.select(id_col, F.col("x.line_no").alias("order"), F.col("x.n").alias("n"))


def _finished(sized: DataFrame, least: int, most: int, gap: int, id_col: str, known: Mapping[int, float], budget: int | None = None) -> DataFrame:
    """Gap split and merge over rows (id, order, n) with the ``chunks`` of the lines, or packed here within ``budget``."""
    kind = dict(sized.dtypes)[id_col]

    def tokens(chars: int) -> int:
        return -(-chars // T.CHARS_PER_TOKEN)

    def run(batches):
        for pdf in batches:
            rows = []
            for k in range(len(pdf)):
                i, order, n = pdf[id_col].iloc[k], pdf["order"].iloc[k].tolist(), pdf["n"].iloc[k].tolist()
                sizes = dict(zip(order, n, strict=True))
                order = sorted(sizes)
                spans = packed_spans(order, [tokens(sizes[at]) for at in order], budget) if budget is not None else [(c["start"], c["end"]) for c in pdf["chunks"].iloc[k]]
                parts = [order[bisect_left(order, start) : bisect_right(order, end)] for start, end in spans]
                for no, p in enumerate(merge_small(split_at_gaps([p for p in parts if p], gap), sizes, least, most, known, tokens)):
                    rows.append((i, no, p.lines[0], p.lines[-1], len(p.lines), tokens(sum(sizes[at] for at in p.lines)), p.sources, p.operations))
            yield pd.DataFrame(rows, columns=[id_col, "chunk_no", "start", "end", "n_lines", "tokens", "source_chunk_count", "operations"])

    return sized.mapInPandas(run, f"{id_col} {kind}, {MERGED}")


def post_process(chunks: DataFrame, lines: DataFrame, least: int, most: int, gap: int, id_col: str = "doc_id", distances: Mapping[int, float] | None = None) -> DataFrame:
    """Gap split and small-chunk merge of each document's chunks (id, chunk_no, start, end) over its kept lines (id, line_no, line)."""
    a = chunks.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("chunk_no", "start", "end"))).alias("chunks"))
    return _finished(a.join(_sizes(lines, id_col), id_col), least, most, gap, id_col, dict(distances or {}))


def sample_windows(df: DataFrame, id_col: str, text_col: str, budget: int) -> DataFrame:
    """Beginning, middle and end of texts over ``budget`` tokens (half, a quarter, a quarter of it); shorter texts whole."""
    chars, text = budget * 4, F.col(text_col)
    half, quarter = chars // 2, chars // 4
    n = F.length(text)
    window = lambda name, at, size: F.struct(F.lit(name).alias("part"), F.substring(text, at, F.lit(size)).alias("content"))
    whole = F.array(F.struct(F.lit("whole").alias("part"), text.alias("content")))
    three = F.array(window("beginning", F.lit(1), half), window("middle", F.floor(n / 2).cast("int") - quarter // 2 + 1, quarter), window("end", n - quarter + 1, quarter))
    return df.select(id_col, F.explode(F.when(n <= chars, whole).otherwise(three)).alias("w")).select(id_col, "w.part", "w.content")


def hashed_embedding(c: Column | str, dimensions: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: counts of words by hash."""
    words = F.transform(T.search_words(c), lambda w: F.pmod(F.xxhash64(w), F.lit(dimensions)).cast("int"))
    counts = F.aggregate(words, F.array_repeat(F.lit(0), dimensions), lambda a, w: F.transform(a, lambda v, i: v + (i == w).cast("int")))
    return F.transform(counts, lambda v: v.cast("float"))


def semantic_chunks(lines: DataFrame, percentile: float = 95, buffer: int = 1, min_lines: int = 100, embed=hashed_embedding, id_col: str = "doc_id", digits: int | None = None) -> DataFrame:
    """(id, chunk_no, start, end): documents cut where windows of neighbouring lines are least alike.

    The break line ends one chunk and begins the next, and the last break never
    cuts. Documents under ``min_lines`` lines are one chunk and aren't embedded. With
    ``digits`` distances and their percentile are rounded.
    """
    sized = lines.withColumn("__lines", F.count("*").over(Window.partitionBy(id_col)))
    short = sized.filter(F.col("__lines") < min_lines).groupBy(id_col).agg(F.min("line_no").alias("start"), F.max("line_no").alias("end")).select(id_col, F.lit(0).cast("long").alias("chunk_no"), "start", "end")
    windows = buffer_windows(sized.filter(F.col("__lines") >= min_lines), buffer, id_col).withColumn("__v", embed("window_text"))
    distances = adjacent_distances(windows, "line_no", "__v", [id_col])
    if digits is not None:
        distances = distances.withColumn("distance", F.round("distance", digits))
    marked = percentile_breaks(distances, "line_no", percentile, [id_col], digits)
    spans = marked.groupBy(id_col).agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"), F.array_sort(F.collect_list(F.when(F.col("is_break"), F.col("line_no")))).alias("b"))
    n = F.greatest(F.size("b"), F.lit(1))
    cut = spans.select(id_col, "first", "last", "b", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"), n.alias("n"))
    start = F.when(F.col("k") == 0, F.col("first")).otherwise(F.get("b", F.col("k") - 1))
    end = F.when(F.col("k") == F.col("n") - 1, F.col("last")).otherwise(F.get("b", F.col("k")))
    return short.unionByName(cut.select(id_col, F.col("k").cast("long").alias("chunk_no"), start.alias("start"), end.alias("end")))


def cap_chunks(chunks: DataFrame, lines: DataFrame, budget: int, id_col: str = "doc_id") -> DataFrame:
    """Chunks over ``budget`` tokens packed anew, each within its own span; others as they are."""
    c = chunks.select(id_col, "chunk_no", F.col("start").alias("__s"), F.col("end").alias("__e"))
    inside = lines.join(c, id_col).filter((F.col("line_no") >= F.col("__s")) & (F.col("line_no") <= F.col("__e")))
    packed = pack(inside.withColumnRenamed("chunk_no", "__source"), budget, id_col, within=["__source"])
    w = Window.partitionBy(id_col).orderBy("__source", "__part")
    return packed.withColumnRenamed("chunk_no", "__part").withColumn("chunk_no", (F.row_number().over(w) - 1).cast("long")).drop("__source", "__part")


def chunk_documents(docs: DataFrame, strategy: str = "fixed", budget: int = 1024, least: int = 64, gap: int = 32, id_col: str = "doc_id", text_col: str = "text", protected: DataFrame | None = None, **semantic) -> DataFrame:
    """Texts to chunks: lines, quality filter (``protected`` lines stay), ``fixed`` or ``semantic`` chunks, token cap, gap split and small-chunk merge."""
    from tessera.operators.lines import explode_lines, protect, quality_filter

    if strategy not in ("fixed", "semantic"):
        raise ValueError("strategy is fixed or semantic")
    lines = explode_lines(docs, id_col, text_col)
    lines = quality_filter(lines) if protected is None else quality_filter(protect(lines, protected, id_col), protected=F.col("is_protected")).drop("is_protected")
    if strategy == "fixed":  # packing asks for sizes alone, so lines are graded and dealt out once
        return _finished(_sizes(lines, id_col), least, budget, gap, id_col, {}, budget)
    chunks = cap_chunks(semantic_chunks(lines, id_col=id_col, **semantic), lines, budget, id_col)
    return post_process(chunks.select(id_col, "chunk_no", "start", "end"), lines, least, budget, gap, id_col)
