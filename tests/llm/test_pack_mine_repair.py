"""Packing, hard negatives and conversation repair against plain versions, and their edge cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import conversation_repair, hard_negatives, packing
from tessera.llm.queries import op11_pack_mixture, op12_hard_negatives, op13_repair_conversations, vocabulary_path

SF = "/root/testdata/sf0.001"
BYTES = vocabulary_path("byte_bpe_50k.json")
EXTRA = "source_size long, __id string, tile string, `a.b` string, i int, gone_by int"
MORE = (1, "x", "t", "dot", 3, 4)


# packing


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTES)


def check_pieces(rows, texts, library, window, end=0):
    """Every id lies in one piece; pieces are what they say; sequences are full and gapless. Returns tokens by sequence and source."""
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, end] for i, t in texts.items()}
    by_doc, by_sequence, shares = defaultdict(list), defaultdict(list), defaultdict(Counter)
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(own) > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        by_doc[r.doc_id].append((r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
        shares[r.sequence_id][r.source] += r.length
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
        assert at == len(ids[i])
    sizes = {}
    for s, pieces in by_sequence.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        sizes[s] = at
    assert sorted(sizes) == list(range(len(sizes)))
    full = sum(map(len, ids.values())) // window
    assert all(sizes[s] == window for s in range(full))
    rest = [sizes[s] for s in sorted(sizes)[full:]]
    assert all(x & (x - 1) == 0 for x in rest) and rest == sorted(set(rest), reverse=True)
    return shares


def plain_grants(totals, weights, m):
    """Tokens of each source among the first ``m`` by due time, listed one by one."""
    due = sorted((Fraction(2 * k + 1) / w, s) for s, (t, w) in enumerate(zip(totals, weights)) for k in range(t))
    got = Counter(s for _, s in due[:m])
    return [got[s] for s in range(len(totals))]


def test_grants_equal_the_sorted_due_times():
    r = random.Random(3)
    for _ in range(30):
        totals = [r.choice((1, 3, 20, 90)) for _ in range(r.randrange(1, 7))]
        weights = totals if r.random() < 0.5 else [r.choice((1, 2, 5)) for _ in totals]
        shares = packing.Shares(totals, [Fraction(w) for w in weights])
        for m in {0, 1, sum(totals) // 3, sum(totals) - 1, sum(totals)}:
            assert shares.granted(m) == plain_grants(totals, [Fraction(w) for w in weights], m)
            assert sum(shares.credit(m)) == m


def test_packing_keeps_the_mixture(spark, library):
    r = random.Random(4)
    words = "alpha beta gamma delta <|endoftext|> naïve 漢字 don't 12345 \n\n".split(" ")
    texts, sources = {}, {}
    for i in range(400):
        texts[i] = r.choice((None, "", " ".join(r.choice(words) for _ in range(r.choice((3, 40, 300)))) if i else "word " * 3000))
        sources[i] = r.choice(("big", "big", "big", "small", None)) if i % 50 else "rare"
    rows = [(i, t, sources[i], *MORE) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, source string, {EXTRA}").repartition(5, "doc_id")
    got = packing.pack(docs, BYTES, window=64, block=8).collect()
    shares = check_pieces(got, texts, library, 64)
    totals = Counter()
    for s in shares.values():
        totals.update(s)
    all_tokens = sum(totals.values())
    sent = Counter()
    for k in range(all_tokens // 64):
        sent.update(shares[k])
        for source, total in totals.items():
            assert abs(shares[k][source] - 64 * total / all_tokens) <= 2  # every window
            assert abs(sent[source] - 64 * (k + 1) * total / all_tokens) <= 2  # nothing is lost over all windows
    heavy = packing.pack(docs, BYTES, weights={"big": 1, "small": 6, None: 1, "rare": 1}, window=64, block=8).collect()
    shares = check_pieces(heavy, texts, library, 64)
    last = max(k for k in shares if shares[k]["small"])
    assert last < max(shares) and all(abs(shares[k]["small"] / (shares[k]["small"] + shares[k]["big"]) - 6 / 7) < 0.06 for k in range(last - 1))
    assert sum((shares[k]["small"] for k in shares)) == totals["small"]


def test_packing_of_many_sources_repeated_rows_and_no_rows(spark, library):
    texts = {i: f"text {i} " * (i % 7) for i in range(300)}
    docs = spark.createDataFrame([(i, t, f"s{i % 150:03d}") for i, t in texts.items()], "doc_id long, text string, source string")
    check_pieces(packing.pack(docs, BYTES, window=32, block=4).collect(), texts, library, 32)
    twice = packing.pack(docs.unionAll(docs), BYTES, window=32, block=4)
    once, both = (df.groupBy("doc_id").agg(F.sum("length").alias("n")) for df in (packing.pack(docs, BYTES, window=32, block=4), twice))
    assert {(r.doc_id, 2 * r.n) for r in once.collect()} == {(r.doc_id, r.n) for r in both.collect()}
    empty = packing.pack(docs.filter("false"), BYTES)
    assert empty.collect() == [] and empty.columns == twice.columns


def test_packing_query(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = op11_pack_mixture(spark, SF).collect()
    shares = check_pieces(got, {r.doc_id: r.text for r in docs}, library, 1024)
    totals = Counter()
    for s in shares.values():
        totals.update(s)
    full = sum(totals.values()) // 1024
    assert all(abs(shares[k][s] - 1024 * t / sum(totals.values())) <= 2 for k in range(full) for s, t in totals.items())


def test_fast_ids_equal_the_library(library):
    coder = packing.Encoder(BYTES)
    assert coder.ranks is not None
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    r = random.Random(5)
    texts = ["".join(map(chr, points[at : at + 512])) for at in range(0, len(points), 512)]
    texts += ["".join(r.choice((" ", "  ", "\n", "a", "é", "1", "'s", "<|endoftext|>", "Ä", " ", "​", "!")) for _ in range(200)) for _ in range(500)]
    for text, got in zip(texts, coder.ids(texts), strict=True):
        assert got.tolist() == library.encode(text, add_special_tokens=False).ids


# hard negatives


def plain_negatives(rows, is_anchor, positives=5, negatives=3):
    best = {}
    for i, label, x in rows:
        if i is None or label is None or x is None or any(v is None or v != v or abs(v) == float("inf") for v in x):
            continue
        row = (label, [int(np.floor(256 * float(v))) for v in x])
        best[i] = min(best.get(i, row), row)
    out = set()
    for a, (label, x) in best.items():
        if is_anchor(a):
            score = {b: sum(p * q for p, q in zip(x, y)) for b, (_, y) in best.items()}
            order = sorted(score, key=lambda b: (-score[b], b))
            for p in [b for b in order if best[b][0] == label and b != a][:positives]:
                found = [b for b in order if best[b][0] != label and 50 * score[p] <= 100 * score[b] <= 95 * score[p]]
                out |= {(a, p, k, b, score[p], score[b]) for k, b in enumerate(found[:negatives], 1)}
    return out


def test_hard_negatives_of_odd_rows(spark):
    r = random.Random(6)
    rows = [(i, r.randrange(3), [r.uniform(-1, 1) for _ in range(40)]) for i in range(120)]
    rows += [(200 + i, r.randrange(3), rows[5][2]) for i in range(10)]  # ties
    rows += [rows[3], rows[3], (4, 2, [0.5] * 40), (None, 1, [0.1] * 40), (301, None, [0.1] * 40), (302, 1, None), (303, 1, [0.1, None]), (304, 1, [float("nan")]), (305, 1, [float("inf")]), (310, 1, []), (311, 2, [0.9] * 7)]
    df = spark.createDataFrame([(*x, *MORE) for x in rows], f"vec_id long, label int, embedding array<double>, {EXTRA}")
    want = plain_negatives(rows, lambda i: i % 10 == 0)
    assert len(want) > 50
    for shape in ({}, {"rows_per_shard": 17, "anchors_per_shard": 5}):
        got = hard_negatives.mine(df, F.col("id") % 10 == 0, **shape).collect()
        assert len(got) == len(want) and {tuple(x) for x in got} == want
    assert hard_negatives.mine(df, F.lit(False)).collect() == [] == hard_negatives.mine(df.filter("false"), F.lit(True)).collect()


def test_no_scores_are_shuffled(spark):
    draw = random.Random(4)
    rows = [(k, [draw.uniform(-1, 1) for _ in range(64)], k % 10) for k in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    got = hard_negatives.mine(df, F.col("id") % 10 == 0)
    assert got.count()
    assert written() - before < 400 * 4000 * 2  # a tile of the fewest bytes a score


def test_products_are_exact():
    r = np.random.default_rng(1)
    for most in (100, 1 << 20, 1 << 28):
        a, b = (r.integers(-most, most, (n, 33)) for n in (5, 7))
        want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
        assert hard_negatives.products(a, b).tolist() == want
        assert hard_negatives.unpacked(hard_negatives.packed(hard_negatives.products(a, b)), 5, 7).tolist() == want


def test_hard_negatives_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    moved = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in rows]
    got = op12_hard_negatives(spark, SF).collect()
    assert {tuple(x) for x in got} == plain_negatives(moved, lambda i: i % 50 == 0) and got


# conversations


def plain_edits(codes):
    """Least (cost, audit) by trying every edit at every row; at most two turns are inserted in one place."""
    fits = lambda roles: __import__("re").fullmatch(r"(s?(ua)+)?", roles)
    states = {"": (0, "")}  # roles so far, cut to what the pattern needs: which state they end in
    short = lambda roles: roles if len(roles) < 3 else roles[-2:] if roles[-1] == "a" else "ua" + roles[-1]

    def put(after, roles, cost, audit):
        if __import__("re").fullmatch(r"s?(ua)*u?", roles):
            key = short(roles)
            after[key] = min(after.get(key, (10**9, "")), (cost, audit))

    def inserted(states):
        out = dict(states)
        for _ in range(3):
            for roles, (cost, audit) in list(out.items()):
                for role in "ua":
                    put(out, roles + role, cost + 2, audit + "I")
        return out

    for code in codes:
        after = {}
        for roles, (cost, audit) in inserted(states).items():
            put(after, roles, cost + 3, audit + "D")
            if code != "-":
                charge = code.isupper()
                put(after, roles + code.lower(), cost + charge, audit + "K")
                for role in "ua":
                    put(after, roles + role, cost + 2 + charge, audit + "R")
        states = after
    return min(v for roles, v in inserted(states).items() if fits(roles))


def test_edits_are_cheapest_and_least():
    r = random.Random(7)
    for _ in range(1500):
        codes = "".join(r.choice("suaxSUAX-") for _ in range(r.randrange(0, 9)))
        want = plain_edits(codes)
        assert conversation_repair.edits(codes) == want, codes
        assert conversation_repair.edits(codes, segment=3) == want, codes
    long = "".join(r.choice("suaxSUAX-uauaua") for _ in range(3000))
    assert conversation_repair.edits(long) == plain_edits(long) == conversation_repair.edits(long, segment=64)


def plain_repair(rows):
    """The contract, row by row, from (conv_id, turn, role, text)."""
    white = " \t\n\x0b\x0c\r"
    groups = {}
    for conv, turn, role, text in rows:
        now = groups.setdefault(conv, [])
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else text.translate({ord(c): None for c in ".!?"}) if k == 2 else text
        role = "user" if k == 4 else role
        now += [] if k == 0 else [(turn, role, text)] * (2 if k == 3 else 1)
    out = {}
    for conv, now in groups.items():
        digest = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
        now.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), digest(*x[1:])))
        seen, codes, count = set(), "", Counter()
        for _, role, text in now:
            end = text.rstrip(white)
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None
            seen.add((role, text))
            count[fault] += 1
            code = role[:1] if role[:1] in tuple("sua") else "x"
            codes += "-" if fault in ("blank", "duplicate") else code.upper() if fault else code
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(now, now[1:]))
        turns = {t for t, _, _ in now if t is not None}
        cost, audit = plain_edits(codes)
        made, rest = [], list(now)
        for edit in audit:
            expected = "user" if not made or made[-1][:1] in "as" else "assistant"
            if edit == "I":
                made.append(f"{expected}:")
            else:
                _, role, text = rest.pop(0)
                made += [] if edit == "D" else [f"{role if edit == 'K' else expected}:{text}"]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


def test_repair_of_odd_conversations(spark):
    r = random.Random(8)
    rows = []
    for conv in [*range(150), None]:
        for turn in range(r.randrange(1, 9)):
            role = r.choice(("system", "user", "assistant", "user", "assistant", "tool", "", None, "agent"))
            text = r.choice(("Yes.", "No", "Why? \n", "", " \t", None, f"Turn {turn}!", f"word {turn} " * 5, "é "))
            rows.append((conv, r.choice((turn, turn, turn, turn + 3, None)), role, text))
    rows += [(999, t, "user" if t % 2 else "assistant", f"line {t % 700}.") for t in range(1500)]
    rows += [(1000, 1, "user", "x " * 400_000 + "."), *rows[:5]]
    df = spark.createDataFrame([(*x, *MORE) for x in rows], f"conv_id long, turn long, role string, text string, {EXTRA}")
    damaged = conversation_repair.damage(df)
    got = {x.conv_id: tuple(x)[1:] for x in conversation_repair.repair(damaged).collect()}
    want = plain_repair(rows)
    assert set(got) == set(want)
    for conv in want:
        assert got[conv] == want[conv], conv
    turns = defaultdict(list)
    for x in conversation_repair.repaired_turns(damaged).orderBy("conv_id", "position").collect():
        turns[x.conv_id].append(f"{x.role}:{x.text}")
    assert all(hashlib.sha256("\n".join(turns[c]).encode()).hexdigest() == v[-1] for c, v in want.items())
    assert conversation_repair.repair(damaged.filter("false")).collect() == []


def test_repair_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {x.conv_id: tuple(x)[1:] for x in op13_repair_conversations(spark, SF).collect()} == plain_repair(rows)
