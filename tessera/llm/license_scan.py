"""License scans by template markup.

A template is wording with ``<<beginOptional>>…<<endOptional>>`` around text that
may be missing and ``<<var;words=min-max>>`` (optionally ``;match=regex`` for each word)
for text that may be replaced. It is compiled into an automaton over words; a
place in a document matches if the automaton reads from there to its end with
every mandatory word exactly as given.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tessera.llm.common import LOWER, UPPER, map_rows
from tessera.llm.license_texts import STATEMENTS, TEXTS

#: bytes of a word: digits, letters (A-Z become a-z) and everything beyond ASCII; the rest becomes a space
WORDS = bytes(ord(LOWER[UPPER.index(chr(b))]) if chr(b) in UPPER else b if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))

#: phrases whose places are counted, and their labels
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: labels and templates of the license texts, notices and statements looked for
TEMPLATES = TEXTS + STATEMENTS
_MARK = re.compile(r"<<(.*?)>>", re.S)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(WORDS).split()


@dataclass(frozen=True)
class Template:
    """``steps[state]``: (test, next state) with a word, a compiled pattern or None (any word) as test; ``free[state]``: states reached without a word."""

    label: str
    steps: tuple[tuple[tuple[object, int], ...], ...]
    free: tuple[tuple[int, ...], ...]
    end: int
    starts: frozenset[bytes]

    def match(self, words: Sequence[bytes], at: int) -> int | None:
        """The place after the longest match that starts at ``at``, or None."""
        now, best = self._closure({0}), None
        while True:
            if self.end in now:
                best = at
            if at >= len(words):
                return best
            word, then = words[at], set()
            for s in now:
                for test, to in self.steps[s]:
                    if test is None or (test == word if isinstance(test, bytes) else test.fullmatch(word)):
                        then.add(to)
            if not then:
                return best
            now, at = self._closure(then), at + 1

    def _closure(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for to in self.free[todo.pop()]:
                if to not in out:
                    out.add(to)
                    todo.append(to)
        return out


def compile_template(label: str, text: str) -> Template:
    """Raises ValueError where optional regions don't nest, or where the template could match no words or start with any."""
    steps: list[list[tuple[object, int]]] = [[]]
    free: list[list[int]] = [[]]

    def new() -> int:
        steps.append([])
        free.append([])
        return len(steps) - 1

    now, open_ = 0, []
    for k, part in enumerate(_MARK.split(text)):
        if not k % 2:
            for w in words_of(part):
                steps[now].append((w, to := new()))
                now = to
        elif part == "beginOptional":
            open_.append(now)
        elif part == "endOptional":
            if not open_:
                raise ValueError(f"{label}: endOptional without beginOptional")
            free[open_.pop()].append(now)
        elif part.startswith("var"):
            options = dict(x.split("=", 1) for x in part.split(";")[1:])
            least, most = map(int, options.get("words", "1-10").split("-"))
            test = re.compile(options["match"].encode()) if "match" in options else None
            before = now
            for i in range(most):
                steps[now].append((test, to := new()))
                if i >= least:
                    free[now].append(-1)
                now = to
            for s in range(before, len(free)):
                free[s] = [now if t == -1 else t for t in free[s]]
        else:
            raise ValueError(f"{label}: unknown markup {part!r}")
    if open_:
        raise ValueError(f"{label}: beginOptional without endOptional")
    made = Template(label, tuple(map(tuple, steps)), tuple(map(tuple, free)), now, frozenset())
    starts: set[bytes] = set()
    for s in (first := made._closure({0})):
        for test, _ in steps[s]:
            if isinstance(test, bytes):
                starts.add(test)
            elif test is not None and re.fullmatch(rb"[a-z0-9|]+", test.pattern):
                starts.update(test.pattern.split(b"|"))
            else:
                raise ValueError(f"{label}: its first word may be anything")
    if made.end in first:
        raise ValueError(f"{label}: it matches no words at all")
    return Template(label, made.steps, made.free, now, frozenset(starts))


class Scanner:
    def __init__(self, phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES):
        self.phrases = [(b" " + b" ".join(words_of(p)) + b" ", label) for p, label in phrases]
        self.templates = [compile_template(*t) for t in templates]
        self.by_start: dict[bytes, list[Template]] = {}
        for t in self.templates:
            for w in t.starts:
                self.by_start.setdefault(w, []).append(t)

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str]]]:
        """Number of words, places of phrases as (start, label), and template matches as (start, end, label), all in words."""
        words = words_of(text)
        places: list[tuple[int, str]] = []
        line = b" " + b" ".join(words) + b" "
        for phrase, label in self.phrases:
            at, place, counted = line.find(phrase), 0, 0
            while at >= 0:
                place, counted = place + line.count(b" ", counted, at), at
                places.append((place, label))
                at = line.find(phrase, at + 1)
        found: list[tuple[int, int, str]] = []
        for w in self.by_start.keys() & set(words):
            at = -1
            for _ in range(words.count(w)):
                at = words.index(w, at + 1)
                for t in self.by_start[w]:
                    if (end := t.match(words, at)) is not None:
                        found.append((at, end, t.label))
        return len(words), sorted(places), sorted(found)


SCHEMA = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, matches array<struct<start:bigint,`end`:bigint,label:string>>"


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Scan whole texts; returns id, counts and labels, and ``matches`` of templates as word spans.

    ``labels`` holds the phrases' labels and those of matched templates; ``score`` is 1
    where a template matched, 0.5 where only phrases stand, else 0. Null texts
    count as empty and have no words, no labels (empty strings) and score 0.
    Where several templates match at one place all count. Very long texts are
    scanned whole, in time in proportion to their length. Repeated rows are
    returned as often as they occur; no other column is read; an empty table
    gives an empty result.
    """
    phrases, templates = tuple(phrases), tuple(templates)

    def rows(s: Scanner, ids, texts):
        for i, text in zip(ids, texts, strict=True):
            n, places, found = s.scan(text)
            base = {x for _, x in places}
            yield (
                i, n, len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base)), ",".join(sorted(base | {x for *_, x in found})),
                1.0 if found else 0.5 if places else 0.0, [{"start": a, "end": b, "label": x} for a, b, x in found],
            )

    return map_rows(df, [id_col, text_col], f"{id_col} {dict(df.dtypes)[id_col]}, {SCHEMA}", rows, start=lambda: Scanner(phrases, templates))
