"""BPE encoding and decoding with a public vocabulary file, without its library.

A word is encoded by backtracking: longest vocabulary matches (found by one
Aho-Corasick pass) are taken left to right, a match is kept only if the pair it
makes with the token before it is one that merging could leave side by side,
and a dead end goes back to the next shorter match. Each position is given up
at most once, so time is linear in the word, and the ids are those of the merge
rules. Decoding copies slices of one string by an offset table.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import lru_cache

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from tessera.llm.common import map_rows

#: white space as Unicode's White_Space property has it, which str.split() exceeds by U+001C to U+001F
_SPLIT = regex.compile("[\t-\r \x85\xa0  -     　]+")
_ODD = "\x1c\x1d\x1e\x1f"
#: entries kept of chunks, of words inside them, and of token pairs; a full cache starts anew
CACHE_CHUNKS, CACHE_WORDS, CACHE_PAIRS = 200_000, 300_000, 400_000


@lru_cache(maxsize=1)
def byte_letters() -> tuple[str, ...]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return tuple(chr(b) if b in plain else chr(next(spare)) for b in range(256))


class BytePairCoder:
    """Encoder and decoder of a ``tokenizers`` file of model BPE whose words end in a suffix.

    Inside, a word is a string of symbols: U+0000 to U+00FF are its bytes and
    U+0100 to U+01FF the same bytes where they end the word.
    """

    def __init__(self, path: str):
        self.path, self.library = path, None
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix") or whole.get("decoder") is not None or model.get("continuing_subword_prefix"):
            raise ValueError("only BPE files with a word-end suffix and no decoder are read")
        self.suffix = model["end_of_word_suffix"]
        steps = whole["normalizer"]["normalizers"]
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("another normaliser than NFC, white space, lower case")
        self.pieces = regex.compile(whole["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        vocab: dict[str, int] = model["vocab"]
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        letter = {c: b for b, c in enumerate(byte_letters())}

        def inner(token: str) -> str | None:
            end = token.endswith(self.suffix)
            body = token[: -len(self.suffix)] if end else token
            if not body or any(c not in letter for c in body):
                return None
            at = [letter[c] for c in body]
            return "".join(map(chr, at[:-1])) + chr(at[-1] + 256 * end)

        self.id_of: dict[str, int] = {}
        for token, i in vocab.items():
            if (s := inner(token)) is not None:
                self.id_of[s] = i
        # merge tables: the parts of each merged token, and the rank of each pair
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            if c not in self.parts:
                self.parts[c], self.rank[c] = (a, b), rank
            self.merged.setdefault((a, b), c)
        self.trie = ahocorasick.Automaton()
        for s, i in self.id_of.items():
            self.trie.add_word(s, (len(s), i))
        self.trie.make_automaton()
        self.fits: dict[int, bool] = {}  # the pair-compatibility table, filled as pairs come up
        self.whole: dict[int, bool] = {}
        # the offset table: token i is blob[offsets[i]:offsets[i + 1]]
        names = [""] * self.size
        for token, i in [*vocab.items(), *self.special.items()]:
            names[i] = token
        self.blob = "".join(names)
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in names])]).tolist()
        self.words = _Written(self)
        self.pieces_seen: dict[bytes, list[int]] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging would leave these two tokens side by side: no pair across their border merges before either is whole."""
        key = left * self.size + right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > CACHE_PAIRS:
                self.fits.clear()
            known = self.fits[key] = self._stay_apart(left, right, len(self.rank) + 1)
        return known

    def _stay_apart(self, a: int, b: int, limit: int) -> bool:
        """Undo the later of the two tokens' merges again and again; on the border only the near half stays.

        A joint of a rank below ``limit`` would have come before the merge undone
        last. Of equal ranks the pair further left merges first, so undoing the
        right token also rules out a joint of its own rank.
        """
        rank, merged, parts = self.rank, self.merged, self.parts
        while True:
            joint = merged.get((a, b))
            if joint is not None and rank[joint] < limit:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra > rb:
                limit, a = ra, parts[a][1]
            elif rb >= 0:
                limit, b = rb + 1, parts[b][0]
            else:
                return True

    def _made_by_merging(self, i: int) -> bool:
        """Whether the token's own text, encoded, gives the token: its two parts must come about and stay apart till they merge."""
        known = self.whole.get(i)
        if known is None:
            parts = self.parts.get(i)
            known = self.whole[i] = parts is None or (self._made_by_merging(parts[0]) and self._made_by_merging(parts[1]) and self._stay_apart(*parts, self.rank[i]))
        return known

    def encode_symbols(self, s: str) -> list[int]:
        """Ids of one word given in inner symbols."""
        i = self.id_of.get(s)
        if i is not None and self._made_by_merging(i):
            return [i]
        n, whole, fits = len(s), self._made_by_merging, self.compatible
        matches: list[list[tuple[int, int]]] = [[] for _ in s]  # for each start, from one pass of the automaton
        for end, match in self.trie.iter(s):
            matches[end - match[0] + 1].append(match)
        dead = bytearray(n + 1)  # positions from which no way leads on
        path: list[tuple[int, int]] = []  # (start, which match)
        ids: list[int] = []
        at, pick = 0, -1
        while at < n:
            options = matches[at]  # the shortest first
            pick = len(options) - 1 if pick == -1 else pick - 1
            while pick >= 0:
                long, i = options[pick]
                if not dead[at + long] and whole(i) and (not ids or fits(ids[-1], i)):
                    break
                pick -= 1
            if pick >= 0:
                path.append((at, pick))
                ids.append(i)
                at, pick = at + long, -1
            elif path:
                dead[at] = 1
                at, pick = path.pop()
                ids.pop()
            else:
                raise ValueError("the vocabulary lacks a byte")
        return ids

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of a text without white space and special tokens."""
        out: list[int] = []
        if chunk.isascii():
            pieces = [x.encode() for x in self.pieces.findall(chunk.lower())]
        elif any(unicodedata.category(c) == "Cn" for c in chunk):
            pieces = self._pieces_by_library(chunk)
        else:
            lowered = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
            pieces = [x.encode("utf-8", "replace") for x in self.pieces.findall(lowered)]
        seen = self.pieces_seen
        for raw in pieces:
            ids = seen.get(raw)
            if ids is None:
                ids = self.encode_symbols(raw[:-1].decode("latin-1") + chr(raw[-1] + 256))
                if len(raw) <= 64:
                    seen[raw] = ids
            out += ids
        return out

    def _pieces_by_library(self, chunk: str) -> list[bytes]:
        """For letters newer than Python's Unicode tables: normalise and split as the library does, whose tables may be newer."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        letter = {c: b for b, c in enumerate(byte_letters())}
        lowered = self.library.normalizer.normalize_str(chunk)
        return [bytes(letter[c] for c in x) for x, _ in self.library.pre_tokenizer.pre_tokenize_str(lowered)]

    def _chunks(self, text: str) -> list[str]:
        """The text between white space; each special token is a chunk of its own."""
        if any(x in text for x in self.special):
            return [y for k, x in enumerate(self.special_split.split(text)) for y in ([x] if k % 2 else self._chunks(x))]
        if any(x in text for x in _ODD):
            return [x for x in _SPLIT.split(text) if x]
        return text.split()

    def encode(self, text: str) -> list[int]:
        return [i for x in self._chunks(text) for i in self._ids(x)]

    def _ids(self, chunk: str) -> list[int]:
        return [self.special[chunk]] if chunk in self.special else self.encode_chunk(chunk)

    def decode(self, ids: list[int]) -> str:
        """Tokens as the file names them, joined by one space (the file has no decoder); special ones are kept."""
        blob, offsets = self.blob, self.offsets
        return " ".join([blob[offsets[i] : offsets[i + 1]] for i in ids])

    def forget(self) -> None:
        """Empty the caches: workers live longer than tasks."""
        for cache in (self.words, self.pieces_seen, self.fits):
            cache.clear()

    def written(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the decimal ids joined by spaces, and the decoded text; chunks met before are looked up."""
        words = self.words
        if len(words) > CACHE_CHUNKS:
            words.clear()
        if len(self.pieces_seen) > CACHE_WORDS:
            self.pieces_seen.clear()
        made = [words[x] for x in self._chunks(text)]
        line = " ".join([x[0] for x in made])
        return (line.count(" ") + 1 if line else 0), line, " ".join([x[1] for x in made])


class _Written(dict):
    """Chunk to (ids as text, decoded text), made when first asked for; very long chunks aren't kept."""

    def __init__(self, coder: BytePairCoder):
        self.coder = coder

    def __missing__(self, chunk: str) -> tuple[str, str]:
        ids = self.coder._ids(chunk)
        out = (" ".join(map(str, ids)), self.coder.decode(ids))
        if len(chunk) <= 64:
            self[chunk] = out
        return out


SCHEMA = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


@lru_cache(maxsize=2)
def coder(path: str) -> BytePairCoder:
    return BytePairCoder(path)


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, release: bool = False) -> DataFrame:
    """Encode whole texts, decode the ids again and describe both.

    ``path``: the vocabulary file, readable under that name on every executor.
    Returns ``id_col``, ``n_tokens``, SHA-256 of the ids and of the decoded text
    and, with ``keep_ids``, ``ids`` (array<int>) and ``decoded``. With ``release`` a
    task empties its caches, which a worker otherwise keeps for the next one: for jobs
    that go on to other stages in the same workers. A null text counts
    as empty, which has no ids; very long texts are encoded whole, an empty table gives an
    empty result; repeated rows are returned as often as they occur;
    no other column is read.
    """
    kind = dict(df.dtypes)[id_col]

    def rows(c: BytePairCoder, ids, texts):
        for i, text in zip(ids, texts, strict=True):
            n, line, decoded = c.written(text or "")
            out = (i, n, hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
            yield (*out, [int(x) for x in line.split()], decoded) if keep_ids else out

    return map_rows(df, [id_col, text_col], f"{id_col} {kind}, {SCHEMA}" + ", ids array<int>, decoded string" * keep_ids, rows, start=lambda: coder(path), finish=BytePairCoder.forget if release else None)
