"""Language identification by prediction by partial matching.

Every language has a context tree over bytes, learnt from a bounded sample and
then frozen. The whole text, blanks, digits and signs included, is coded with
each tree: a byte is predicted from the ``ORDER`` bytes before it, with an escape
to shorter contexts (method C, with exclusion) where it was never seen there.
The language with the shortest exact code is predicted.

All orders are counted at every place, so the bytes seen after a context are
also seen after each shorter one. What an escape excludes from the next
shorter context is therefore a number that belongs to the context, and code
lengths come from sorted tables, many at a time.
"""

from __future__ import annotations

from collections.abc import Iterable
from uuid import uuid4

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_sample, held_out_remainder, map_rows, text_order

ORDER = 4
#: a language is learnt from so many distinct documents and bytes, at most
SAMPLE, SAMPLE_BYTES = 400, 1 << 19
SEED, MODULUS, HELD_OUT = 9, 4, 2
#: stands ``ORDER`` times before every text
EDGE = b"\n"
#: bytes of a worker's cache of code lengths
CACHE_BYTES = 96 << 20


def coded(text: str | None) -> bytes:
    """The bytes that are coded: the whole text in lower case, in UTF-8."""
    return (text or "").lower().encode("utf-8", "replace")


def grams(data: bytes) -> np.ndarray:
    """For every byte of ``data``: itself and the ``ORDER`` bytes before it, as one number."""
    line = np.frombuffer(EDGE * ORDER + data, np.uint8).astype(np.int64)
    out = np.zeros(len(data), np.int64)
    for k in range(ORDER + 1):
        out = out << 8 | line[k : k + len(data)]
    return out


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of ``keys`` in the sorted ``table``, or its length where they are missing."""
    at = np.searchsorted(table, keys)
    safe = np.minimum(at, max(0, len(table) - 1))
    return np.where((at < len(table)) & (table[safe] == keys), at, len(table)) if len(table) else np.zeros(len(keys), np.int64)


class ContextTree:
    """Counts of the bytes after each context of up to ``ORDER`` bytes, as one pair of sorted tables for each order."""

    def __init__(self, texts: Iterable[bytes]):
        every = [grams(t) for t in texts]
        key, n = np.unique(np.concatenate(every) if every else np.empty(0, np.int64), return_counts=True)
        self.levels: list[dict[str, np.ndarray]] = [{}] * (ORDER + 1)
        for k in range(ORDER, -1, -1):
            own, back = np.unique(key & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            count = np.bincount(back, n, minlength=len(own)).astype(np.int64)
            context, first = np.unique(own >> 8, return_index=True)
            total = np.add.reduceat(count, first) if len(own) else count
            kinds = np.diff(np.append(first, len(own)))
            self.levels[k] = {"gram": own, "n": count, "context": context, "total": total, "kinds": kinds}
        for k in range(1, ORDER + 1):  # of the counts after the next shorter context, those of bytes that this context knows
            high, low = self.levels[k], self.levels[k - 1]
            shared = low["n"][_find(low["gram"], high["gram"] & ((1 << 8 * k) - 1))] if len(high["gram"]) else high["n"]
            first = np.searchsorted(high["gram"] >> 8, high["context"])
            high["barred"] = np.add.reduceat(shared, first) if len(first) else shared

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Exact code lengths of grams: of the last byte of each after the others."""
        out = np.zeros(len(keys))
        open_ = np.ones(len(keys), bool)
        barred, gone = np.zeros(len(keys)), np.zeros(len(keys))
        for k in range(ORDER, -1, -1):
            level, key = self.levels[k], keys & ((1 << 8 * (k + 1)) - 1)
            if not len(level["gram"]):
                continue
            place = _find(level["context"], key >> 8)
            known = open_ & (place < len(level["context"]))
            place = np.minimum(place, len(level["context"]) - 1)
            total, kinds = level["total"][place] - barred, level["kinds"][place] - gone
            at = _find(level["gram"], key)
            hit = known & (at < len(level["gram"]))
            out[hit] -= np.log2(level["n"][at[hit]] / (total + kinds)[hit])
            open_ &= ~hit
            escape = known & ~hit & (kinds > 0)
            out[escape] -= np.log2((kinds / np.maximum(total + kinds, 1))[escape])
            if k:
                barred, gone = np.where(known, level["barred"][place], 0.0), np.where(known, level["kinds"][place], 0.0)
            else:
                gone = np.where(known, level["kinds"][place], 0.0)
        out[open_] += np.log2(256 - gone[open_])
        return out


class LanguageModels:
    """The frozen trees, and code lengths of the grams met before."""

    def __init__(self, trees: dict[str, ContextTree]):
        self.langs = sorted(trees)
        self.trees = [trees[x] for x in self.langs]
        self.most = CACHE_BYTES // (8 + 4 * max(1, len(self.langs)))
        self._forget()

    def _forget(self) -> None:
        self.keys, self.known = np.empty(0, np.int64), np.empty((0, len(self.langs)), np.float32)

    def lengths(self, keys: np.ndarray) -> np.ndarray:
        """Bits of each of the distinct, sorted ``keys`` with each tree."""
        at = _find(self.keys, keys)
        new = at == len(self.keys)
        if new.any():
            fresh = keys[new]
            made = np.stack([t.bits(fresh) for t in self.trees], 1).astype(np.float32)
            if len(self.keys) + len(fresh) > self.most:
                out = np.empty((len(keys), len(self.langs)), np.float32)
                out[new], out[~new] = made, self.known[at[~new]]
                self._forget()
                return out
            places = np.searchsorted(self.keys, fresh)
            self.keys, self.known = np.insert(self.keys, places, fresh), np.insert(self.known, places, made, 0)
            at = np.searchsorted(self.keys, keys)
        return self.known[at]

    def code_lengths(self, datas: list[bytes]) -> np.ndarray:
        """Bits of each of ``datas`` (none empty) with each tree."""
        every = [grams(d) for d in datas]
        keys, back = np.unique(np.concatenate(every), return_inverse=True)
        return np.add.reduceat(self.lengths(keys)[back].astype(np.float64), np.cumsum([0] + [len(x) for x in every[:-1]]))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = [("und", 0.0)] * len(texts)
        own = [i for i, t in enumerate(texts) if t and self.langs and any(map(str.isalpha, t))]
        if own:
            for i, bits in zip(own, self.code_lengths([coded(texts[i]) for i in own]), strict=True):
                best = int(bits.argmin())
                out[i] = self.langs[best], float(1 / np.exp2(np.clip(bits[best] - bits, -1000, 0)).sum())
        return out


def learn(
    df: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE, modulus: int = MODULUS, held_out: int = HELD_OUT, sample_bytes: int = SAMPLE_BYTES
) -> dict[str, ContextTree]:
    """A tree for every language of the rows that aren't held out, each from at most ``sample`` distinct whole documents and ``sample_bytes`` bytes."""
    own = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.coalesce(held_out_remainder(F.col(id_col), modulus) != held_out, F.lit(False)))
    own = own.select(F.col(lang_col).alias("__group"), F.col(text_col).alias("__text"))
    candidates = own.select("__group", text_order("__text", SEED).alias("__order"), F.octet_length("__text").alias("__bytes"))
    chosen: dict[str, list[bytes]] = {}
    for lang, text in bounded_sample(candidates, own, sample, sample_bytes, SEED):
        if text:
            chosen.setdefault(lang, []).append(coded(text))
    return {x: ContextTree(t) for x, t in chosen.items()}


_WORKER: dict[str, LanguageModels] = {}


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, modulus: int = MODULUS, held_out: int = HELD_OUT) -> DataFrame:
    """id, ``held_out``, ``lang_pred`` and ``score`` of every row.

    ``score`` is the posterior of the prediction under equal priors. Null texts
    and texts without letters (Unicode category L), and all texts where nothing
    could be learnt, are ``und`` with score 0; equal code lengths go to the
    language first by code point. A null id is not held out and not learnt from.
    Very long texts are coded whole. Repeated rows are returned as often as they
    occur; other columns are not read; an empty table gives an empty result.
    """
    trees = df.sparkSession.sparkContext.broadcast(learn(df, id_col, text_col, lang_col, sample, modulus, held_out))

    key = uuid4().hex

    def start() -> LanguageModels:  # a worker that runs several tasks keeps its cache
        if key not in _WORKER:
            _WORKER.clear()
            _WORKER[key] = LanguageModels(trees.value)
        return _WORKER[key]

    def rows(models: LanguageModels, ids, texts, held):
        for i, h, found in zip(ids, held, models.predict(texts), strict=True):
            yield i, h, *found

    held = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.coalesce(held_out_remainder(F.col(id_col), modulus) == held_out, F.lit(False)).alias("__held"))
    return map_rows(held, ["__id", "__text", "__held"], f"{id_col} {dict(df.dtypes)[id_col]}, held_out boolean, lang_pred string, score double", rows, start=start)
