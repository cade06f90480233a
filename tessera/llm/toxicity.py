"""Toxicity by a linear-chain conditional random field over words.

Only documents are labelled, so the words of a bounded sample are labelled
first: words that stand in toxic documents far more often than chance allows are
toxic where they occur in a toxic document. A chain with two tags is fitted to
these labelled tokens; a token's features are its word, its neighbours, its
ends and its shape. Forward-backward marginals then give every token of every
document its probability. All of them go into the document's score: a logistic
regression on the expected number of toxic tokens, the largest marginal and the
length, fitted on the sample. The tokens above one half are the offending spans.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import near
from tessera.llm.common import blocks, bounded_sample, held_out_remainder, map_rows, text_order

#: distinct labelled documents that are learnt from, at most, by label, and bytes of each label
SAMPLE, SAMPLE_BYTES = {1: 1500, 0: 3000}, 8 << 20
SEED, MODULUS, HELD_OUT = 2, 5, 0
ROUNDS, RATE, DECAY = 16, 1.5, 1e-5
#: a word is labelled toxic from this log-likelihood ratio on, if so many of its documents are toxic
EVIDENCE, PURITY = 8.0, 0.9
_WORD = re.compile(r"[^\W_]+")
CACHE_WORDS = 100_000
#: added to an expected number before its logarithm; bound of the largest marginal's logarithm of odds
FEW, LARGEST = 0.02, 12.0
#: rows whose chains are run together, and cells (places by rows) of one run
TOGETHER, CELLS = 1024, 1 << 19


def fold(text: str) -> str:
    """Lower case that keeps every offset."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(fold(text or ""))


def word_key(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))


def shape_features(word: str) -> list[str]:
    """Features of a word that other words share: digits and length, and the ends of longer words."""
    out = [f"#{any(c.isdigit() for c in word):d}{min(len(word) // 4, 4)}"]
    return [*out, "<" + word[:3], ">" + word[-3:]] if len(word) > 4 else out


def families(docs: Iterable[Sequence[str]]) -> list[int]:
    """A number for each document that near copies among ``docs`` share (all pairs of like shingles, compared exactly): copies are no further evidence."""
    return near.families([w.encode("utf-8", "replace") for w in words] for words in docs)


def toxic_words(docs: Sequence[np.ndarray], labels: Sequence[int], names: Sequence[str]) -> np.ndarray:
    """For each of ``names`` whether its documents (of word numbers) are toxic far more often than all are; near copies count as one document, which has a word as toxic only if all its copies do."""
    own = np.array(families([names[i] for i in ids.tolist()] for ids in docs), np.int64)
    pairs, label = [], []
    for ids, family, toxic in zip(docs, own, labels, strict=True):
        pairs.append(family * len(names) + np.unique(ids))
        label.append(np.full(len(pairs[-1]), toxic, np.int8))
    pair, tag = np.concatenate(pairs), np.concatenate(label)
    order = np.lexsort((tag, pair))
    pair, tag = pair[order], tag[order]
    first = np.flatnonzero(np.diff(pair, prepend=-1))  # of a family and word, with the least label
    pair, tag = pair[first], tag[first].astype(float)
    n = np.bincount(pair % len(names), minlength=len(names))
    toxic = np.bincount(pair % len(names), tag, minlength=len(names))
    rate = len(np.unique(pair[tag > 0] // len(names))) / len(np.unique(own))
    if not 0 < rate < 1:
        return np.zeros(len(names), bool)
    p = toxic / np.maximum(n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = toxic * np.log(p / rate) + np.where(p < 1, (n - toxic) * np.log((1 - p) / (1 - rate)), 0.0)
    return (p >= PURITY) & (p > rate) & (ratio >= EVIDENCE)


def forward_backward(odds: np.ndarray, lengths: np.ndarray, trans: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Probability of tag 1 at each place. ``odds`` (T, B): emission of tag 1 against 0, sequences in columns, 1 past their ends.

    ``trans`` holds the weights of (tag before, tag). ``pairs``, if given, has the
    expected number of each pair of neighbouring tags added to it.
    """
    (t00, t01), (t10, t11) = trans.tolist()
    p, now = np.empty(odds.shape), None
    for t, r in enumerate(odds):
        up = r if now is None else r * ((t01 + (t11 - t01) * now) / (t00 + (t10 - t00) * now))
        now = up / (1 + up)
        p[t] = now
    after = np.ones(odds.shape[1])
    for t in range(len(odds) - 1, -1, -1):
        filtered = p[t]
        up = filtered * after
        p[t] = up / (up + (1 - filtered))
        if not t:
            break
        live = t < lengths
        back = odds[t] * after
        if pairs is not None:
            before = p[t - 1]
            w = np.array([[(1 - before) * t00, (1 - before) * t01 * back], [before * t10, before * t11 * back]])
            pairs += (w / w.sum((0, 1)) * live).sum(2)
        after = np.where(live, (t10 + t11 * back) / (t00 + t01 * back), 1.0)
    p[np.arange(len(odds))[:, None] >= lengths[None, :]] = 0.0
    return p


def summary(marginals: np.ndarray) -> list[float]:
    """What a document's score depends on: its expected number of toxic tokens, its largest marginal and its length, each as a logarithm."""
    if not len(marginals):
        return [math.log(FEW), -LARGEST, 0.0]
    top = min(max(float(marginals.max()), math.exp(-LARGEST)), 1 - math.exp(-LARGEST))
    return [math.log(FEW + float(marginals.sum())), math.log(top / (1 - top)), math.log(len(marginals))]


@dataclass
class ChainModel:
    """Weights of words (as the token, as the one before, as the one after; by the sorted 64-bit hashes of the words, so that workers hold few objects) and of shapes, transition weights, and the regression of the scores."""

    keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.empty((0, 3), np.float32))
    shapes: dict[str, float] = field(default_factory=dict)
    trans: np.ndarray = field(default_factory=lambda: np.ones((2, 2)))
    slopes: np.ndarray = field(default_factory=lambda: np.zeros(3))
    shift: float = -30.0

    def __post_init__(self):
        self._forget()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("place", "table")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def _forget(self) -> None:
        self.place, self.table = {}, np.empty((1024, 3), np.float32)

    def _new(self, word: str) -> int:
        k = self.place[word] = len(self.place)
        if k >= len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        key = np.uint64(word_key(word))
        at = int(np.searchsorted(self.keys, key))
        own, before, after = self.weights[at] if at < len(self.keys) and self.keys[at] == key else (0.0, 0.0, 0.0)
        self.table[k] = own + sum(self.shapes.get(f, 0.0) for f in shape_features(word)), before, after
        return k

    def emission(self, words: Sequence[str]) -> np.ndarray:
        """Odds of tag 1 of each token by its features alone."""
        if len(self.place) > CACHE_WORDS:
            self._forget()
        place = self.place
        at = np.array([place[w] if w in place else self._new(w) for w in words], np.int64)
        own, before, after = self.table[at].T
        total = own.astype(np.float64)
        total[1:] += before[:-1]
        total[:-1] += after[1:]
        return np.exp(np.clip(total, -30, 30)).astype(np.float32)

    def marginals(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Marginals of each text's tokens; texts of like length are run together."""
        own = [self.emission(words) if (words := tokens(t)) else np.empty(0, np.float32) for t in texts]
        out: list[np.ndarray] = [np.empty(0)] * len(own)
        order = sorted((i for i, d in enumerate(own) if len(d)), key=lambda i: len(own[i]))
        for part, lengths in _alike(order, [len(d) for d in own]):
            odds = np.ones((lengths[-1], len(part)))
            for k, i in enumerate(part):
                odds[: lengths[k], k] = own[i]
            p = forward_backward(odds, lengths, self.trans)
            for k, i in enumerate(part):
                out[i] = p[: lengths[k], k].copy()
        return out

    def score(self, marginals: np.ndarray) -> float:
        """The calibrated probability that a document with these marginals is toxic."""
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.shift + float(self.slopes @ summary(marginals))))))


def _alike(order: Sequence[int], sizes: Sequence[int], most: int = 256):
    """Runs of ``order`` (by size) of at most ``most`` documents and ``CELLS`` cells, with their sizes."""
    at = 0
    while at < len(order):
        end = min(len(order), at + most)
        while end > at + 1 and sizes[order[end - 1]] * (end - at) > CELLS:
            end = (at + end) // 2
        yield order[at:end], np.array([sizes[i] for i in order[at:end]])
        at = end


class _Run:
    """Documents of like length for the fit: their tokens one after the other, with the place of each in the matrix of steps and documents."""

    def __init__(self, docs: Sequence[np.ndarray], labels: Sequence[int], is_bad: np.ndarray):
        self.lengths = np.array([len(d) for d in docs])
        self.ids = np.concatenate(docs)
        starts = np.cumsum(self.lengths) - self.lengths
        self.document = np.repeat(np.arange(len(docs), dtype=np.int32), self.lengths)
        self.step = (np.arange(len(self.ids)) - starts[self.document]).astype(np.int32)
        self.later = np.flatnonzero(self.step > 0)  # tokens that one stands before
        self.tags = (is_bad[self.ids] * np.array(labels)[self.document]).astype(np.int8)

    def gold(self) -> np.ndarray:
        """How often a tag follows another."""
        return np.bincount(2 * self.tags[self.later - 1] + self.tags[self.later], minlength=4).reshape(2, 2).astype(float)

    def add_gradients(self, grads: list[np.ndarray], value: np.ndarray, weights: list[np.ndarray], trans: np.ndarray, pairs: np.ndarray) -> None:
        ids, later = self.ids, self.later
        total = value[ids]
        total[later] += weights[1][ids[later - 1]]
        total[later - 1] += weights[2][ids[later]]
        odds = np.ones((self.lengths[-1], len(self.lengths)))
        odds[self.step, self.document] = np.exp(np.clip(total, -30, 30))
        missed = self.tags - forward_backward(odds, self.lengths, trans, pairs)[self.step, self.document]
        for grad, of, by in ((grads[0], ids, missed), (grads[1], ids[later - 1], missed[later]), (grads[2], ids[later], missed[later - 1])):
            grad += np.bincount(of, by, minlength=len(grad))


def fit(labelled: Sequence[tuple[str | None, int]]) -> ChainModel:
    """Fit the chain to the tokens of labelled documents by AdaGrad on the exact gradient, then the regression of the scores.

    Without toxic and other documents to learn from, nothing is toxic.
    """
    place: dict[str, int] = {}
    docs, kept = [], []
    for text, label in labelled:
        if words := tokens(text):
            docs.append(np.array([place.setdefault(w, len(place)) for w in words], np.int32))
            kept.append(label)
    names = list(place)
    is_bad = toxic_words(docs, kept, names).astype(float) if docs else np.empty(0)
    if not is_bad.any():
        return ChainModel()
    shape_of: dict[str, int] = {}
    each = [np.array([shape_of.setdefault(f, len(shape_of)) for f in shape_features(w)], np.int32) for w in names]
    owner, flat = np.repeat(np.arange(len(each), dtype=np.int32), [len(x) for x in each]), np.concatenate(each)
    sizes = [len(x) for x in docs]
    groups = [_Run([docs[i] for i in part], [kept[i] for i in part], is_bad) for part, _ in _alike(sorted(range(len(docs)), key=lambda i: sizes[i]), sizes)]
    gold = sum(g.gold() for g in groups)
    positive = sum(float(g.tags.sum()) for g in groups)
    n, m = len(names), len(shape_of)
    weights = [np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(m)]  # the token, the one before, the one after, shapes
    squares = [np.full(len(w), 1e-9) for w in weights]
    log_trans, square_t = np.zeros((2, 2)), np.full((2, 2), 1e-9)
    for _ in range(ROUNDS):
        value = weights[0] + np.bincount(owner, weights[3][flat], minlength=n)
        grads, pairs, trans = [np.zeros(n), np.zeros(n), np.zeros(n)], np.zeros((2, 2)), np.exp(log_trans)
        for g in groups:
            g.add_gradients(grads, value, weights, trans, pairs)
        grads.append(np.bincount(flat, grads[0][owner], minlength=m))
        for w, g, s in zip(weights, grads, squares, strict=True):
            g = g / positive - DECAY * w
            s += g * g
            w += RATE * g / np.sqrt(s)
        grad_t = (gold - pairs) / positive
        square_t += grad_t * grad_t
        log_trans = np.clip(log_trans + RATE / 2 * grad_t / np.sqrt(square_t), -3, 3)
    keys = np.array([word_key(w) for w in names], np.uint64)
    order = np.argsort(keys)
    model = ChainModel(keys[order], np.stack(weights[:3], 1).astype(np.float32)[order], dict(zip(shape_of, weights[3].tolist(), strict=True)), np.exp(log_trans))
    del docs, names, place, weights, squares, groups, each, owner, flat
    x = []
    for a in range(0, len(labelled), TOGETHER):
        x += [summary(p) for p in model.marginals([t for t, _ in labelled[a : a + TOGETHER]])]
    model._forget()
    model.slopes, model.shift = _logistic(np.array(x), np.array([float(label) for _, label in labelled]))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[np.ndarray, float]:
    """Slopes and shift of a logistic regression by Newton's method, on standardised variables."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    design, w = np.column_stack([(x - mean) / spread, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + ridge * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(hessian, design.T @ (y - p) - ridge * w), -3, 3)
    slopes = w[:-1] / spread
    return slopes, float(w[-1] - slopes @ mean)


def learn(
    df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: dict[int, int] = SAMPLE, modulus: int = MODULUS, held_out: int = HELD_OUT, sample_bytes: int = SAMPLE_BYTES
) -> ChainModel:
    """A model from at most ``sample[label]`` distinct whole documents and ``sample_bytes`` bytes of each label, none of them held out."""
    known = labels.filter(F.coalesce(held_out_remainder(F.col(id_col), modulus) != held_out, F.lit(False)) & F.col(label_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("__pick")).agg(F.max(F.col(label_col).cast("int")).alias("__group"))
    texts = df.select(F.col(id_col).alias("__pick"), F.col(text_col).alias("__text")).filter("__text is not null")
    narrow = texts.select("__pick", text_order("__text", SEED).alias("__order"), F.octet_length("__text").alias("__bytes"))
    candidates = narrow.join(known, "__pick").filter(F.col("__group").isin(*sample))
    got = bounded_sample(candidates.select("__group", "__order", "__bytes"), texts.select("__text"), sample, sample_bytes, SEED)
    return fit([(text, group) for group, text in got])


def spans(text: str, marginals: np.ndarray, least: float = 0.5) -> list[dict]:
    """Offsets (code points) and probabilities of the tokens at or above ``least``."""
    return [{"start": m.start(), "end": m.end(), "p": float(p)} for m, p in zip(_WORD.finditer(fold(text)), marginals, strict=True) if p >= least]


OUT = "held_out boolean, score double, predicted int, spans array<struct<start:int,`end`:int,p:double>>"


def _rows(model: ChainModel, ids, held, texts):
    for i, h, t, p in zip(ids, held, texts, model.marginals(texts), strict=True):
        score = model.score(p)
        yield i, h, score, int(score >= 0.5), spans(t or "", p) if score >= 0.5 else []


def score_documents(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", modulus: int = MODULUS, held_out: int = HELD_OUT, model: ChainModel | None = None
) -> DataFrame:
    """id, ``held_out``, ``score``, ``predicted`` and offending ``spans`` of every row, from its text alone.

    Labels are learnt from rows that aren't held out; where a label row repeats,
    the larger label counts, null labels don't. Null and empty texts have no
    tokens and get the score of a document without any toxic one; very long texts
    are scored whole, in blocks of their own. A null id is
    not held out and not learnt from. Repeated rows are returned as often as
    they occur; other columns are not read; an empty table gives an empty result.
    """
    model = model or learn(df, labels, id_col, text_col, label_col, modulus=modulus, held_out=held_out)
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col(id_col).alias("__id"), F.coalesce(held_out_remainder(F.col(id_col), modulus) == held_out, F.lit(False)).alias("__held"), F.col(text_col).alias("__text"))
    return map_rows(rows, ["__id", "__held", "__text"], f"{id_col} {dict(df.dtypes)[id_col]}, {OUT}", _rows, start=lambda: shared.value, block=TOGETHER, finish=ChainModel._forget)


def keep_clean(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of ``df``, all columns as they are, that aren't predicted toxic.

    Nothing is shuffled but the ids and hashes of the training sample's candidates. Null and empty
    texts have no tokens and are judged as such; repeated rows are judged alike
    and stay as often as they occur; very long texts are judged whole; columns of
    any name are carried along; an empty table stays empty.
    """
    shared = df.sparkSession.sparkContext.broadcast(learn(df, labels, id_col, text_col, label_col))
    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part in blocks(batch, TOGETHER):
                found = shared.value.marginals(part.column(at).to_pylist())
                yield part.filter(pa.array([shared.value.score(p) < 0.5 for p in found], pa.bool_()))
        shared.value._forget()

    # numbered names on the way: a column's own name may hold a dot
    numbered = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    return numbered.mapInArrow(run, numbered.schema).toDF(*df.columns)
