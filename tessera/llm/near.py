"""Near copies by the Jaccard similarity of word shingles, found without loss.

Two sets of similarity ``LEAST`` or more share one of their first elements under
any common order (prefix filter), so only sets with such an element in common
are compared. Frequent shingles come last in the order, so they seldom block;
which ones count as frequent changes the effort only, never the result.
Elements that the same sets share are one block; a large block is cut into
squares of rows and columns. In a block all pairs are compared by parity bits,
which differ in no more places than the sets do, and only a forest over the
pairs that stay possible is verified by whole sets. A second pass goes over the
blocks where other pairs stayed possible and takes, of those between what is not
in one component by then, all.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import ASCII_LOWER, cut, map_rows
from tessera.llm.simhash import connected_components

#: words of a shingle, and the least similarity of near copies as a fraction
SHINGLE, SEED, LEAST = 5, 42, (4, 5)
#: frequent: in more than one of so many documents of a sample of one in ``SAMPLE`` (by hash), ``FLOOR`` at least; of these at most ``MOST``
FREQUENT, SAMPLE, FLOOR, MOST = 2048, 32, 3, 1_000_000
#: parity bits of a set for each of its elements, rounded up to a power of two, ``LEAST_BITS`` at least and ``MOST_BITS`` at most
BITS, LEAST_BITS, MOST_BITS = 4, 64, 4096
#: sets of a square of a block
SIDE = 1024
#: so many ids at most are broadcast (8 bytes each) to fetch the texts of pairs; more are joined
BROADCAST = 1_000_000


def shingles(words: Sequence[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, sorted; fewer words than a shingle, even none, are one shingle."""
    made = [b" ".join(words)] if len(words) <= shingle else map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(s, SEED) for s in made], np.uint64).view(np.int64))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(ASCII_LOWER).split()


def prefix_size(n: int, least: tuple[int, int] = LEAST) -> int:
    """So many first elements of a set of ``n`` meet those of every set that is similar enough."""
    return n + (-least[0] * n // least[1]) + 1


def first_in_order(found: np.ndarray, frequent: np.ndarray, counts: np.ndarray, least: tuple[int, int] = LEAST) -> np.ndarray:
    """The prefix of a set, in the order of count (0 unless in ``frequent``, which is sorted) and hash."""
    rank = np.zeros(len(found), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        rank = np.where(frequent[at] == found, counts[at], 0)
    return found[np.lexsort((found, rank))[: prefix_size(len(found), least)]]


def sketch(found: np.ndarray) -> bytes:
    """Of each place of a hash (the lowest bits), whether an odd number of the set's hashes has it. Folding the halves onto each other gives the sketch of half the size."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS * len(found) - 1).bit_length()))
    odd = np.bincount(found & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(words: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64-bit ``words`` of a sketch, folded to ``width`` words."""
    while words.shape[1] > width:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def similar(common: int, n: int, m: int, least: tuple[int, int] = LEAST) -> bool:
    return common * (least[0] + least[1]) >= least[0] * (n + m)


def families(docs: Iterable[Sequence[bytes]]) -> list[int]:
    """A number for each of ``docs`` (word lists, taken one after the other) that linked near copies share."""
    sets = [shingles(d) for d in docs]
    head = list(range(len(sets)))

    def find(i: int) -> int:
        while head[i] != i:
            head[i] = i = head[head[i]]
        return i

    frequent, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.empty(0, np.int64),) * 2
    under: dict[int, list[int]] = {}
    for i, own in enumerate(sets):
        tried = Counter()
        for key in first_in_order(own, frequent, counts).tolist():
            for j in under.setdefault(key, []):
                tried[j] += 1
                if tried[j] == 1 and find(i) != find(j) and similar(len(np.intersect1d(own, sets[j], True)), len(own), len(sets[j])):
                    head[find(i)] = find(j)
            under[key].append(i)
    return [find(i) for i in range(len(sets))]


def _frequent(df: DataFrame, text_col: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of many sampled documents, sorted, and their counts: the ``MOST`` most frequent at most, which is what is broadcast."""
    some = df.filter(F.pmod(F.xxhash64(text_col), F.lit(SAMPLE)) == 0)

    def rows(_, texts):
        for t in texts:
            for h in shingles(words_of(t), shingle).tolist():
                yield (h,)

    least = max(FLOOR, some.count() / FREQUENT)
    got = map_rows(some, [text_col], "h bigint", rows).groupBy("h").count().filter(F.col("count") >= least).orderBy(F.desc("count"), "h").limit(MOST).toArrow()
    h, n = got["h"].to_numpy(), got["count"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def possible(n: np.ndarray, sketches: list[bytes], left: np.ndarray, root: np.ndarray, two_sided: bool, least: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of places whose sets may be similar enough, with the differing share of their sketches.

    Compared are those of different ``root``; in a ``two_sided`` square one of
    them is ``left`` and the other is not.
    """
    num, den = least
    wide = np.array([len(s) // 8 for s in sketches])
    made: list[tuple[np.ndarray, ...]] = []
    for width in np.unique(wide).tolist():
        own = np.flatnonzero(wide == width)
        words = np.frombuffer(b"".join([sketches[k] for k in own.tolist()]), np.uint64).reshape(len(own), width)
        others = [(own, words)]
        for wider in np.unique(wide[(wide > width)]).tolist():
            there = np.flatnonzero(wide == wider)
            if n[there].min() * num <= n[own].max() * den:
                others.append((there, folded(np.frombuffer(b"".join([sketches[k] for k in there.tolist()]), np.uint64).reshape(len(there), wider), width)))
        for there, against in others:
            step = max(1, (1 << 19) // (width * len(there)))
            for at in range(0, len(own), step):
                a = own[at : at + step]
                both = n[a][:, None] + n[there][None, :]
                fits = np.minimum(n[a][:, None], n[there][None, :]) * den >= np.maximum(n[a][:, None], n[there][None, :]) * num
                fits &= root[a][:, None] != root[there][None, :]
                fits &= (left[a][:, None] != left[there][None, :]) if two_sided else True
                if there is own:
                    fits &= a[:, None] < there[None, :]
                if not fits.any():
                    continue
                differ = np.bitwise_count(words[at : at + step][:, None, :] ^ against[None, :, :]).sum(2, dtype=np.int64)
                x, y = np.nonzero(fits & (differ * (num + den) <= both * (den - num)))
                made.append((a[x], there[y], differ[x, y] / both[x, y]))
    if not made:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    a, b, share = (np.concatenate(m) for m in zip(*made, strict=True))
    return a, b, share


def forest(size: int, a: np.ndarray, b: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Places of the edges of a spanning forest of least ``order`` (all different): each tree takes its least edge, until none leads out."""
    label, taken = np.arange(size), []
    alive = np.arange(len(a))
    while len(alive):
        x, y = label[a[alive]], label[b[alive]]
        alive = alive[x != y]
        x, y = label[a[alive]], label[b[alive]]
        best = np.full(size, len(order))
        np.minimum.at(best, x, order[alive])
        np.minimum.at(best, y, order[alive])
        chosen = alive[np.isin(order[alive], best)]
        taken.append(chosen)
        for p, q in zip(a[chosen].tolist(), b[chosen].tolist(), strict=True):
            p, q = label[p], label[q]
            if p != q:
                label[label == max(p, q)] = min(p, q)
    return np.concatenate(taken) if taken else alive


def _squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one square after the other; the batches are sorted by the first three columns."""
    rest: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = pa.concat_tables([rest, now]) if rest is not None else now
        keys = [now.column(k).to_numpy() for k in range(3)]
        ends = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1 if len(now) else []
        at = 0
        for end in ends:
            yield now.slice(at, end - at)
            at = end
        rest = now.slice(at).combine_chunks()
    if rest is not None and len(rest):
        yield rest


def candidates(entries: DataFrame, least: tuple[int, int], every: bool) -> DataFrame:
    """Distinct pairs ``a`` < ``b`` of nodes that may be similar enough, of different ``root``: ``every`` pair, or a forest of each square, and then also the ``token`` (without a pair) of squares that have other pairs."""

    def run(batches):
        a, b, more = [], [], []
        for square in _squares(batches):
            if len(square) > 1:
                node, n, left, root = (square.column(c).to_numpy() for c in ("node", "n", "left", "root"))
                if (root == root[0]).all():
                    continue
                x, y, share = possible(n.astype(np.int64), square.column("sketch").to_pylist(), left, root, square.column("low")[0] != square.column("high")[0], least)
                if not every and len(x) > 1:
                    order = np.empty(len(x), np.int64)
                    order[np.lexsort((np.maximum(node[x], node[y]), np.minimum(node[x], node[y]), share))] = np.arange(len(x))
                    kept = forest(len(node), x, y, order)
                    if len(kept) < len(x):
                        more.append(square.column("token")[0].as_py())
                    x, y = x[kept], y[kept]
                a.append(np.minimum(node[x], node[y]))
                b.append(np.maximum(node[x], node[y]))
            if len(a) > 4096 or sum(map(len, a[-1:])) > 100_000:
                yield _distinct(a, b, more)
                a, b, more = [], [], []
        if a:
            yield _distinct(a, b, more)

    sized = entries.select("token", "low", "high", "node", "n", "left", "root", "sketch").repartition("token", "low", "high").sortWithinPartitions("token", "low", "high")
    return sized.mapInArrow(run, "a bigint, b bigint, token bigint").distinct()


def _distinct(a: list[np.ndarray], b: list[np.ndarray], tokens: list[int]) -> pa.RecordBatch:
    pairs, tokens = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1), sorted(set(tokens))
    none = lambda n: pa.nulls(n, pa.int64())
    both = [pa.concat_arrays([pa.array(p), none(len(tokens))]) for p in pairs]
    return pa.RecordBatch.from_arrays([*both, pa.concat_arrays([none(pairs.shape[1]), pa.array(tokens, pa.int64())])], names=["a", "b", "token"])


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: tuple[int, int] = LEAST, carry: str | None = None) -> DataFrame:
    """id, ``node`` (a hash of the shingle set), ``component`` (the least node reachable over links) and ``component_id`` (the smallest id of the component) of every row; also the bigint column ``carry``, if named.

    Linked are all pairs of rows whose shingle sets have a Jaccard similarity of
    ``least`` or more. Words are split at ASCII white space after lower-casing
    A-Z. Rows with equal sets, however many, are one node; null texts count as
    empty, empty ones equal each other. Null ids take part but never name a
    component unless all of it is null; repeated rows are returned as often as
    they occur; very long texts are compared by all their shingles; an empty table
    gives an empty result.
    """
    carried = F.col(carry) if carry else F.lit(None)
    docs = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), carried.cast("bigint").alias("__carry"))
    kind = dict(docs.dtypes)["__id"]
    order = df.sparkSession.sparkContext.broadcast(_frequent(docs, "__text", shingle))
    num, den = least

    def name(found: np.ndarray) -> int:
        return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).view(np.int64))

    def prefixes(_, ids, texts, carries):
        for i, t, c in zip(ids, texts, carries, strict=True):
            found = shingles(words_of(t), shingle)
            yield i, c, name(found), len(found), sketch(found), first_in_order(found, *order.value, least).tolist()

    def whole(_, texts):
        for t in texts:
            found = shingles(words_of(t), shingle)
            yield name(found), found.tolist()

    marked = cut(map_rows(docs, ["__id", "__text", "__carry"], f"__id {kind}, __carry bigint, node bigint, n int, sketch binary, prefix array<bigint>", prefixes))
    nodes = marked.groupBy("node").agg(F.min("__id").alias("least"))
    one = marked.select("node", "prefix").dropDuplicates(["node"]).select("node", F.explode("prefix").alias("token"))
    same = Window.partitionBy("token")
    whole_of = [F.count("*"), F.min("node"), F.max("node"), F.bit_xor(F.xxhash64("node")), F.bit_xor(F.xxhash64(F.lit(SEED), "node"))]
    sharing = ["size", "first", "last", "x", "y"]
    shared = cut(one.select("*", *(f.over(same).alias(c) for f, c in zip(whole_of, sharing, strict=True))).filter("first < last"))
    # of elements that the same nodes share one is enough
    blocks = shared.groupBy(*sharing).agg(F.min("token").alias("token")).select("token", F.ceil(F.col("size") / SIDE).cast("int").alias("sides"))
    place = F.pmod(F.xxhash64("node"), F.col("sides")).cast("int")
    placed = shared.select("token", "node").join(blocks, "token").withColumn("place", place).select("*", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("other"))
    square = placed.select("token", "node", F.least("place", "other").alias("low"), F.greatest("place", "other").alias("high"), (F.col("place") <= F.col("other")).alias("left"))
    square = cut(square)
    sketches = marked.select("node", "n", "sketch").dropDuplicates(["node"])
    sets: DataFrame | None = None

    def fetched(asked: DataFrame) -> DataFrame:
        """The whole sets of ``asked`` and of what was asked for before."""
        nonlocal sets
        new = cut(asked.join(sets, "node", "left_anti") if sets else asked)
        count = new.count()
        if count:
            ids = nodes.join(new, "node").select(F.col("least").alias("__want")).distinct()
            ids = F.broadcast(ids) if count <= BROADCAST else ids
            texts = docs.join(ids, docs["__id"].eqNullSafe(ids["__want"]), "left_semi")
            made = cut(map_rows(texts, ["__text"], "node bigint, found array<bigint>", whole).join(new, "node", "left_semi").dropDuplicates(["node"]))
            sets = sets.unionByName(made) if sets else made
        return sets

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (``a``, ``b``) that are similar enough, by their whole sets."""
        every = fetched(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        if every is None:
            return pairs
        a, b = every.toDF("a", "fa"), every.toDF("b", "fb")
        common = F.size(F.array_intersect("fa", "fb"))
        return cut(pairs.join(a, "a").join(b, "b").filter(common * (num + den) >= (F.size("fa") + F.size("fb")) * num).select("a", "b"))

    first = cut(candidates(square.join(sketches, "node").withColumn("root", F.col("node")), least, every=False))
    tried = first.filter("token is null").select("a", "b")
    links = verified(tried)
    roots = connected_components(links)
    known = roots.toDF("__node", "__root")
    again = square.join(first.filter("token is not null").select("token"), "token", "left_semi")
    rooted = again.join(known, F.col("node") == F.col("__node"), "left").withColumn("root", F.coalesce("__root", "node"))
    others = cut(candidates(rooted.join(sketches, "node"), least, every=True).select("a", "b").join(tried, ["a", "b"], "left_anti"))
    more = verified(others)
    if not more.isEmpty():
        roots = connected_components(links.union(more))
    found = nodes.join(roots.toDF("__node", "root"), nodes.node == F.col("__node"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = found.join(found.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", F.col("root").alias("component"), "component_id")
    out = marked.select("__id", "__carry", "node").join(named, "node")
    return out.select(F.col("__id").alias(id_col), "node", "component", "component_id", *([F.col("__carry").alias(carry)] if carry else []))
