"""Packing of token sequences to source proportions by deficit round-robin.

Each source is a queue of its documents' tokens. Every window takes from each
queue what its deficit counter allows: a quantum in proportion to the source's
weight is added, whole tokens are served, and what is left over or was lent is
carried to the next window. Windows are grouped to blocks; what a block may take
of each queue follows from the cumulative credit at its ends in closed form, so
the deficits of all blocks before it are carried over without running them, and
any task can run any block by itself. A document finds its windows from its place
in its source's queue, so its tokens are never moved to another task.
"""

from __future__ import annotations

import json
import uuid
import zlib
from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Iterator, Mapping, Sequence
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_schema, blocks, ensure_checkpoint_dir

WINDOW, END = 1024, 0
#: windows of a block
BLOCK = 256
#: cells (windows times sources) of the blocks that a task keeps
CELLS = 1 << 20

_STORED = "__id {kind}, __source string, __part int, __before bigint, __n bigint, __ids binary"
PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, `offset` bigint"


class Shares:
    """What each source has granted after any number of tokens in all: queues of ``totals`` tokens, drained in proportion to ``weights``.

    Token ``k`` of a source of weight ``w`` is due at ``(2k + 1) / 2w``; of the
    first ``m`` tokens by due time, then source, a source holds its grant. So grants never
    shrink as ``m`` grows, add up to ``m``, and stay within a token of the proportion among
    the sources that aren't empty yet.
    """

    def __init__(self, totals: Sequence[int], weights: Sequence[Fraction]):
        self.totals, self.weights = list(totals), [Fraction(w) for w in weights]
        self.order = sorted(range(len(self.totals)), key=lambda s: self.totals[s] / self.weights[s])
        # when the sources dry up, one after the other: (tokens drained in all until then, time)
        self.drained, self.times, open_weight, before, spent = [], [], sum(self.weights), Fraction(0), Fraction(0)
        self.open = []
        for s in self.order:
            now = self.totals[s] / self.weights[s]
            self.open.append((spent, before, open_weight))
            spent += (now - before) * open_weight
            before, open_weight = now, open_weight - self.weights[s]
            self.drained.append(spent)

    def time(self, m: int) -> Fraction:
        k = min(bisect_right(self.drained, m), len(self.order) - 1)
        spent, before, weight = self.open[k]
        return before + (m - spent) / weight if weight else before

    def granted(self, m: int) -> list[int]:
        at = self.time(m)
        out = [min(t, int(w * at + Fraction(1, 2))) for t, w in zip(self.totals, self.weights, strict=True)]
        over = sum(out) - m
        due = lambda s, k: (Fraction(2 * k + 1) / self.weights[s], s)
        while over > 0:
            s = max((s for s in range(len(out)) if out[s]), key=lambda s: due(s, out[s] - 1))
            out[s], over = out[s] - 1, over - 1
        while over < 0:
            s = min((s for s in range(len(out)) if out[s] < self.totals[s]), key=lambda s: due(s, out[s]))
            out[s], over = out[s] + 1, over + 1
        return out

    def credit(self, m: int) -> list[Fraction]:
        at = self.time(m)
        return [min(Fraction(t), w * at) for t, w in zip(self.totals, self.weights, strict=True)]


def windows_of(total: int, block: int, window: int = WINDOW, size: int = BLOCK) -> list[int]:
    """Sizes of the sequences of a block; what is left at the very end is cut into powers of two, which need no padding."""
    left = total - block * size * window
    out = [window] * min(size, left // window)
    if len(out) < size:
        left -= len(out) * window
        out += [1 << b for b in reversed(range(window.bit_length())) if left >> b & 1]
    return out


def served(queues: np.ndarray, quanta: np.ndarray, deficits: np.ndarray, sizes: Sequence[int]) -> np.ndarray:
    """Deficit round-robin over a block: tokens that each sequence (row) takes of each source (column).

    ``queues`` hold as many tokens as the sequences, and are empty at the end.
    ``quanta``: weights; ``deficits``: credit beyond what was granted before the block.
    """
    left, owed, out = queues.copy(), deficits.astype(float), np.zeros((len(sizes), len(queues)), np.int64)
    for k, size in enumerate(sizes):
        open_ = left > 0
        owed += np.where(open_, quanta, 0) * (size / quanta[open_].sum())
        take = np.minimum(left, np.maximum(0, np.floor(owed)).astype(np.int64))
        over = np.cumsum(take) - size  # served in turn until the sequence is full
        take = np.maximum(0, take - np.maximum(0, np.minimum(take, over)))
        rest = size - int(take.sum())
        while rest:  # lent to those that are owed most, then in turn
            ready = np.flatnonzero(take < left)
            ready = ready[np.lexsort((ready, (take - owed)[ready]))][:rest]
            more = np.minimum(left[ready] - take[ready], max(1, rest // len(ready)))
            take[ready] += more
            rest -= int(more.sum())
        out[k], left, owed = take, left - take, owed - take
    return out


class Schedule:
    """Where the tokens of each source go; blocks are run when asked for."""

    def __init__(self, totals: Mapping, weights: Mapping | None, window: int = WINDOW, size: int = BLOCK):
        self.names = sorted(totals, key=lambda s: (s is None, s or ""))
        self.place = {s: k for k, s in enumerate(self.names)}
        self.total = sum(totals.values())
        self.weights = [Fraction(totals[s] if weights is None else weights.get(s, 1)) for s in self.names]
        self.shares = Shares([totals[s] for s in self.names], self.weights)
        self.window, self.size, self.kept = window, size, OrderedDict()
        self.bounds = lru_cache(maxsize=4096)(self._bounds)

    def _bounds(self, block: int) -> list[int]:
        return self.shares.granted(min(self.total, block * self.size * self.window))

    def run(self, block: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Of each sequence of a block and source: tokens of the source before it, and the offset inside it; the first sequence's number."""
        if block in self.kept:
            self.kept.move_to_end(block)
            return self.kept[block]
        start, end = np.array(self.bounds(block), np.int64), np.array(self.bounds(block + 1), np.int64)
        credit = self.shares.credit(min(self.total, block * self.size * self.window))
        owed = np.array([float(c - g) for c, g in zip(credit, start.tolist(), strict=True)])
        took = served(end - start, np.array([float(w / max(self.weights)) for w in self.weights]), owed, windows_of(self.total, block, self.window, self.size))
        before = np.vstack([start, start + np.cumsum(took, 0)])
        offsets = np.cumsum(took, 1) - took
        while self.kept and (len(self.kept) + 1) * took.size > CELLS:
            self.kept.popitem(last=False)
        self.kept[block] = before, offsets, block * self.size
        return self.kept[block]

    def pieces(self, source, start: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(start in the document, length, sequence, offset) of the pieces of ``n`` tokens that begin at ``start`` in their source's queue."""
        s, at = self.place[source], start
        low, high = 0, -(-self.total // (self.size * self.window))
        while high - low > 1:  # the block in which the queue reaches ``start``
            middle = (low + high) // 2
            low, high = (middle, high) if self.bounds(middle)[s] <= at else (low, middle)
        block = low
        while at < start + n:
            before, offsets, first = self.run(block)
            own = before[:, s]
            k = int(np.searchsorted(own, at, "right")) - 1
            while k < len(offsets) and at < start + n:
                here = min(int(own[k + 1]), start + n) - at
                if here > 0:
                    yield at - start, here, first + k, int(offsets[k, s]) + at - int(own[k])
                    at += here
                k += 1
            block += 1


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to a folder of its own in the shared checkpoint folder, and read from there: its columns can be read one by one."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def byte_of_letter() -> dict[str, int]:
    """How byte-level vocabularies write bytes: printable ones as they are, the others, in order, as the letters from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoder:
    """The ids that the tokenizers library gives, special tokens in the text included.

    A plain byte-level vocabulary whose ids are in the order of its merges is run
    by the faster library for such ranks, which gives the same ids (the tests compare them on
    all code points); any other file is run by the tokenizers library itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            self.ranks = self._ranks(json.load(f))

    #: splits text as byte-level vocabularies do (fixed value)
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def _ranks(self, file: dict):
        model, before, added = file["model"], file.get("pre_tokenizer") or {}, file.get("added_tokens") or []
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model.get("merges") or []]
        plain = (
            model.get("type") == "BPE"
            and not (file.get("normalizer") or file.get("post_processor") or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"))
            and before.get("type") == "ByteLevel"
            and before.get("use_regex")
            and not before.get("add_prefix_space")
            and len(added) <= 1
            and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
            and all(model["vocab"].get(m) == 256 + k for k, m in enumerate(merges))
        )
        if not plain:
            return None
        import tiktoken

        letter = byte_of_letter()
        vocab = {bytes(letter[c] for c in token): i for token, i in model["vocab"].items() if i < 256 + len(merges)}
        return tiktoken.Encoding("byte-level", pat_str=self.PATTERN, mergeable_ranks=vocab, special_tokens={t["content"]: t["id"] for t in added})

    def ids(self, texts: Sequence[str]) -> list[np.ndarray]:
        if self.ranks:
            return [self.ranks.encode_to_numpy(t, allowed_special="all") for t in texts]
        return [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokens(df: DataFrame, path: str, id_col: str, text_col: str, source_col: str, end: int) -> DataFrame:
    """Ids of each text and ``end``, with the tokens of its source that come before it in its partition."""
    import zstandard

    kind = dict(df.dtypes)[id_col]
    ddl = _STORED.format(kind=kind)
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, coder, before, pack = TaskContext.get().partitionId(), encoder(path), {}, zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for some in blocks(batch, 256):
                made = []
                ids = coder.ids([t or "" for t in some.column(2).to_pylist()])
                for i, source, own in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), ids, strict=True):
                    made.append((i, source, part, before.get(source, 0), len(own) + 1, pack(np.append(own, end).astype("<u4").tobytes())))
                    before[source] = before.get(source, 0) + len(own) + 1
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)

    return df.select(F.col(id_col).alias("__id"), F.col(source_col).cast("string").alias("__source"), F.col(text_col).alias("__text")).mapInArrow(run, ddl)


def pack(
    df: DataFrame,
    path: str,
    weights: Mapping[str | None, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    window: int = WINDOW,
    block: int = BLOCK,
    end: int = END,
) -> DataFrame:
    """The pieces of all documents in sequences of ``window`` tokens, each mixed of the sources in proportion to their weights.

    A document is its text's ids (the tokenizers library's, with the vocabulary at
    ``path``, which executors read under that name) and ``end``. ``weights``: by source, 1 for those not named; None: a source's
    tokens, so that all sources last to the end. With other weights a source that is used up leaves its part to the others. What is left
    at the end is cut into sequences of powers of two, so nothing is padded. Returns ``id_col``, start, length, ids_crc32,
    doc_tokens, sequence_id, offset and the source.

    Null texts count as empty and have ``end`` alone; very long texts are cut where
    windows end; null sources are a source; repeated rows are packed as often as they
    occur; other columns are not read; an empty table gives an empty result. Tokens are kept in the checkpoint folder, in
    the order of the partitions that are read. A row for each source reaches the driver, and one for each source
    and partition is joined; nothing that grows with the documents does.
    """
    import zstandard

    kind = dict(df.dtypes)[id_col]
    docs = stored(tokens(df, path, id_col, text_col, source_col, end))
    sums = docs.groupBy("__source", "__part").agg(F.sum("__n").alias("__sum"))
    totals = dict(sums.groupBy("__source").agg(F.sum("__sum")).collect())
    out = f"{id_col} {kind}, {PIECES}, {source_col if source_col != id_col else '__source'} string"
    if not totals:
        return df.sparkSession.createDataFrame([], out)
    a, b = sums.alias("a"), sums.alias("b")
    earlier = a.join(b, F.col("a.__source").eqNullSafe(F.col("b.__source")) & (F.col("b.__part") < F.col("a.__part")), "left")
    base = earlier.groupBy(F.col("a.__source").alias("__of"), F.col("a.__part").alias("__at")).agg(F.coalesce(F.sum("b.__sum"), F.lit(0)).alias("__base"))
    placed = docs.join(base, F.col("__source").eqNullSafe(F.col("__of")) & (F.col("__part") == F.col("__at")))
    shared = df.sparkSession.sparkContext.broadcast((totals, dict(weights) if weights is not None else None))
    schema = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schedule, unpack = Schedule(*shared.value, window, block), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for some in blocks(batch, 256):
                made = []
                for i, source, start, n, blob in zip(*(c.to_pylist() for c in some.columns), strict=True):
                    ids = memoryview(unpack(blob))
                    for at, length, sequence, offset in schedule.pieces(source, start, n):
                        made.append((i, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), n, sequence, offset, source))
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)

    return placed.select("__id", "__source", (F.col("__base") + F.col("__before")).alias("__start"), "__n", "__ids").mapInArrow(run, out)
