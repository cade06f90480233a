"""Repair of conversation structure by A* over the edit lattice.

A conversation is a path of its rows' role initials; a repaired one reads
``(s?(ua)+)?``. Nodes of the lattice are (rows done, state of that pattern),
edges are edits. The search takes nodes by (cost so far + least cost to come,
audit so far): what is to come costs at least the deletions that rows demand and
the charges that truncated rows can't avoid, both suffix sums. The heuristic is
consistent and every edge that stays at a row costs something, so the first
arrival at a node has its least cost and, among those, its least audit.

Long conversations are searched in segments from every state to every state; the
segments' (cost, audit) tables are joined pairwise, which keeps both minima. A
first pass over narrow rows (initials, flags, digests) plans the edits; a second
one streams the texts past the plans, so texts are never held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_schema, blocks

SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
#: rows that are searched at once
SEGMENT = 128
#: a row's code: its initial (s, u, a, or x for others); upper-case if truncated; ``-`` if it must go
_GO = "-"
#: the role that a state asks for, and the state after it; a conversation may end in states 0 and 3
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
ENDS = (START, ASSISTANT)

_PLAN = "gaps:bigint,blank:bigint,duplicate:bigint,truncated:bigint,illegal:bigint,cost:bigint,audit:string"


def kept(state: int, initial: str) -> int | None:
    """The state after a kept row, None if its role doesn't fit."""
    if initial == "s" and state == START:
        return SYSTEM
    role, after = _NEXT[state]
    return after if initial == role[0] else None


def search(codes: str, entry: int, goals: Sequence[int] | None = None) -> dict[int, tuple[int, str]]:
    """Least (cost, audit) from state ``entry`` over all rows to each state; to the better of ``goals`` alone, if given."""
    n = len(codes)
    to_come = [0] * (n + 1)
    for k in range(n - 1, -1, -1):
        to_come[k] = to_come[k + 1] + (DELETE if codes[k] == _GO else CUT_OFF if codes[k].isupper() else 0)
    queue, done, found = [(to_come[0], "", 0, entry)], set(), {}
    while queue:
        total, audit, at, state = heappop(queue)
        if (at, state) in done:
            continue
        done.add((at, state))
        spent = total - to_come[at]
        if at == n:
            if goals is None or state in goals:
                found[state] = (spent, audit)
            if goals and found or len(found) == 4:
                return found
        _, after = _NEXT[state]
        heappush(queue, (total + INSERT, audit + "I", at, after))
        if at < n:
            code, rest = codes[at], spent + to_come[at + 1]
            heappush(queue, (rest + DELETE, audit + "D", at + 1, state))
            if code != _GO:
                charge = CUT_OFF if code.isupper() else 0
                if (same := kept(state, code.lower())) is not None:
                    heappush(queue, (rest + charge + KEEP, audit + "K", at + 1, same))
                heappush(queue, (rest + charge + REROLE, audit + "R", at + 1, after))
    return found


def _joined(a: list[dict], b: list[dict]) -> list[dict]:
    out = []
    for first in a:
        best: dict[int, tuple[int, str]] = {}
        for middle, (cost, audit) in first.items():
            for state, (more, rest) in b[middle].items():
                if state not in best or cost + more <= best[state][0]:
                    best[state] = min(best.get(state, (cost + more + 1, "")), (cost + more, audit + rest))
        out.append(best)
    return out


@lru_cache(maxsize=1 << 14)
def edits(codes: str, segment: int = SEGMENT) -> tuple[int, str]:
    """Least (cost, audit) of a whole conversation."""
    if len(codes) <= segment:
        return min(search(codes, START, ENDS).values())
    tables = [[search(codes[k : k + segment], entry) for entry in range(4)] for k in range(0, len(codes), segment)]
    while len(tables) > 1:
        tables = [_joined(*tables[k : k + 2]) if k + 1 < len(tables) else tables[k] for k in range(0, len(tables), 2)]
    return min(tables[0][START][s] for s in ENDS if s in tables[0][START])


class Planner:
    """Takes a conversation's rows in order; counts faults and plans the edits. Holds a code and a digest of each row, no text."""

    def __init__(self):
        self.codes, self.seen = [], set()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.before = None

    def take(self, turn: int | None, initial: str, digest: bytes, blank: bool, ended: bool) -> None:
        again, code = digest in self.seen, initial if initial in ("s", "u", "a") else "x"
        self.seen.add(digest)
        if blank or again:
            self.blank, self.duplicate, code = self.blank + blank, self.duplicate + (not blank), _GO
        elif not ended:
            self.truncated, code = self.truncated + 1, code.upper()
        self.codes.append(code)
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1

    def plan(self) -> dict:
        cost, audit = edits("".join(self.codes))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": cost, "audit": audit}


def replay(audit: Iterable[str], rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """Edit, role and text of the repaired turns, one after the other; ``rows`` are taken one at a time, all of them."""
    state = START
    for edit in audit:
        role, after = _NEXT[state]
        if edit == "I":
            state = after
            yield edit, role, ""
            continue
        own, text = next(rows)
        if edit == "R":
            state = after
            yield edit, role, text
        elif edit == "K":
            state = kept(state, own[:1])
            yield edit, own, text


def damage(df: DataFrame) -> DataFrame:
    """``df`` with rows damaged by ``crc32(conv_id:turn) % 20``: 0 marks it ``gone``, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats it, 4 makes it the user's. Nulls count as one space there, and as roles and texts."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = df.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), (F.crc32(F.concat_ws(":", said("conv_id"), said("turn"))) % 20).alias("k"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.col("k") == 0, F.when(F.col("k") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("gone"))


def _named(df: DataFrame) -> DataFrame:
    gone = F.col("gone") if "gone" in df.columns else F.lit(False)
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = df.select(F.col("conv_id").alias("conv"), F.col("turn").cast("bigint").alias("turn"), said("role").alias("role"), said("text").alias("text"), F.coalesce(gone, F.lit(False)).alias("gone"))
    return rows.withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))


def _ordered(df: DataFrame, *before: str) -> DataFrame:
    return df.repartition("conv").sortWithinPartitions("conv", *before, F.asc_nulls_first("turn"), "role", "digest")


def _plans(df: DataFrame) -> DataFrame:
    """A row for each conversation: ``conv`` and ``plan``."""
    kind = dict(df.dtypes)["conv"]
    ends = F.rtrim(F.col("text"), F.lit(SPACE))
    narrow = df.select("conv", "turn", "role", F.substring("role", 1, 1).alias("initial"), "digest", (ends == "").alias("blank"), F.right(ends, F.lit(1)).isin(*".!?").alias("ended"), "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, now, out = None, None, []
        for batch in batches:
            for c, turn, initial, digest, blank, ended, gone in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5, 6, 7)), strict=True):
                if now is None or c != conv:
                    if now is not None:
                        out.append((conv, now.plan()))
                    conv, now = c, Planner()
                if not gone:
                    now.take(turn, initial, digest, blank, ended)
            if len(out) > 1000:
                yield _batch(out, schema)
                out = []
        if now is not None:
            out.append((conv, now.plan()))
        if out:
            yield _batch(out, schema)

    made = f"conv {kind}, plan struct<{_PLAN}>"
    schema = arrow_schema(made)
    return _ordered(narrow).mapInArrow(run, made)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _with_plans(df: DataFrame) -> DataFrame:
    """Each conversation's plan, then its rows in order."""
    rows = _named(df)
    first = _plans(rows).select("conv", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("binary").alias("digest"), "plan")
    texts = rows.filter("not gone").select("conv", F.lit(1).alias("kind"), "turn", "role", "text", "digest", F.lit(None).cast(f"struct<{_PLAN}>").alias("plan"))
    return _ordered(first.union(texts), "kind").drop("digest")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for part in blocks(batch, 256):
            yield from zip(*(part.column(c).to_pylist() for c in ("conv", "kind", "role", "text", "plan")), strict=True)


def repair(df: DataFrame) -> DataFrame:
    """A row for each conversation: its faults, the cheapest edits and the digest of what they make of it.

    ``df`` has conv_id, turn, role, text and perhaps ``gone``: rows marked so only
    keep their conversation in the result. Returns conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256. Rows go by turn, nulls first, then by role,
    then by a digest of the text. Null roles and texts are one space; a null
    conv_id is a conversation like others; empty texts are blank; very long texts are streamed, never joined;
    repeated rows are duplicates. Roles and texts are compared by SHA-256. A conversation passes
    one task in order, as its digest demands; the task holds a code, a digest and an edit for each of its rows. Other
    columns are not read; an empty table gives an empty result.
    """
    kind = dict(df.dtypes)["conv_id"]
    made = f"conv_id {kind}, {_PLAN.replace(':', ' ')}, repaired_sha256 string"
    schema, names = arrow_schema(made), [x.split(":")[0] for x in _PLAN.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, out = _stream(batches), []
        for conv, _, _, _, plan in rows:  # the replay takes the rows that follow the plan
            digest, between = hashlib.sha256(), b""
            for _, role, text in replay(plan["audit"], ((r[2], r[3]) for r in rows)):
                digest.update(between + role.encode() + b":")
                digest.update(text.encode())
                between = b"\n"
            out.append((conv, *(plan[n] for n in names), digest.hexdigest()))
            if len(out) > 1000:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    return _with_plans(df).mapInArrow(run, made)


def repaired_turns(df: DataFrame) -> DataFrame:
    """The repaired conversations themselves: conv_id, ``position`` (from 0), ``edit`` (K, R or I), role and text of each turn. Cases as in ``repair``."""
    made = f"conv_id {dict(df.dtypes)['conv_id']}, position bigint, edit string, role string, text string"
    schema = arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, out, held = _stream(batches), [], 0
        for conv, _, _, _, plan in rows:
            for position, (edit, role, text) in enumerate(replay(plan["audit"], ((r[2], r[3]) for r in rows))):
                out.append((conv, position, edit, role, text))
                held += len(text)
                if len(out) > 1000 or held > 1 << 22:
                    yield _batch(out, schema)
                    out, held = [], 0
        if out:
            yield _batch(out, schema)

    return _with_plans(df).mapInArrow(run, made)
