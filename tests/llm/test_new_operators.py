"""Filter audit, spelling variants and window packing against brute force, and on nulls, empty and long texts, repeats and clashing names."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cragline.llm import filter_audit, spelling, token_ids, window_packing

from .test_operators import EDGE, docs

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def tokenizer_json():
    with open(VOCABULARY, encoding="utf-8") as f:
        return f.read()


# ---------------------------------------------------------------- filter audit


def audit_by_hand(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    ids = {}
    for d, text, *_ in rows:
        if d is not None:
            ids[text or ""] = min(d, ids.get(text or "", d))
    fails = []
    for d, text, lang, *_ in rows:
        text = text or ""
        w = re.findall("[^ \t-\r]+", text)
        f = set()
        f |= {"A"} if len(w) < 100 else set()
        f |= {"B"} if 100 * len(set(w)) < 80 * len(w) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else set()
        f |= {"D"} if re.search("[#$%&*|]", text) else set()
        f |= {"E"} if d is not None and ids[text] < d else set()
        fails.append((lang or "", f, d in good and d is not None, d in toxic and d is not None))
    out, orders = {}, ["".join(o) for o in itertools.permutations("ABCDE")]
    for part in {p for p, *_ in fails}:
        mine = [x for x in fails if x[0] == part]
        shapley = Counter()
        for order in orders:
            for step, x in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [r for r in mine if x in r[1] and not r[1] & before]
                shapley[x] += len(gone)
                out[part, order, step] = [
                    sum(not r[1] & (before | {x}) for r in mine), len(gone), sum(x in r[1] and bool(r[1] & before) for r in mine), sum(r[1] == {x} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone),
                ]
        for order in orders:
            for step, x in enumerate(order, 1):
                out[part, order, step].append(shapley[x])
    return out


def audited(spark, rows, labels, clash=False):
    got = filter_audit.audit(docs(spark, rows, clash), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len({(r["part"], r["filter_order"], r["step"]) for r in got})
    return {tuple(r[:3]): list(r[3:]) for r in got}


def test_audit_by_hand(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        n = rng.choice([0, 30, 99, 100, 130, 200])
        w = [rng.choice(["w%d", "W%d", "é%d", "LOUD%d"]) % rng.randrange(rng.choice([60, 4000])) for _ in range(n)]
        text = rng.choice([" ", "\n", "\t\t", "\x0b"]).join(w) + rng.choice(["", "", " $", " "])
        rows.append((i, text, rng.choice(["en", "de", "", None]), "s", 0))
    rows += [(1000 + k, rows[k % 7][1], "en", "s", 0) for k in range(90)]  # copies
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 1100, 2)]
    assert audited(spark, rows, labels) == audit_by_hand(rows, labels)


def test_audit_of_odd_rows(spark):
    labels = [(1, None, 1), (1, 1, None), (3, 0, 0), (None, 1, 1)]
    rows = [*EDGE, (8, "w " * 700_000 + "v", "en", "a", 0), (9, "z" * 1_500_000, "en", "a", 0), (None, None, None, None, None)]
    assert audited(spark, rows, labels, clash=True) == audit_by_hand(rows, labels)
    repeated = [(7, "one two three", "en", "a", 0)] * 500 + [(6, "one two three", "en", "a", 0)]
    assert audited(spark, repeated, []) == audit_by_hand(repeated, [])
    assert audited(spark, [], []) == {}


# ---------------------------------------------------------------- spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(rows):
    n = Counter()
    for d, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def mutated(rng, w):
    i = rng.randrange(len(w) + 1)
    c = rng.choice("aabbéÿ÷z")
    return rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]])


def test_variants_by_hand(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abé") for _ in range(rng.randrange(5, 9))) for _ in range(120)] + ["aaaaa" * 8, "banana", "Überfluß"]
    pool = base + [mutated(rng, rng.choice(base)) for _ in range(400)]
    rows = [(i, rng.choice([" ", "1", "-"]).join(rng.choice(pool[: rng.choice([40, len(pool)])]) for _ in range(80)), "en", "s", 0) for i in range(200)]
    want = variants_by_hand(rows)
    assert len(want) > 300 and any(v[0] and v[1] != v[0] for v in want.values())
    for sizes in ((1 << 20, 1 << 23), (60, 180), (300, 900)):  # one shard, many shards, many chunks
        got = spelling.variants(docs(spark, rows), shard_bytes=sizes[0], chunk_bytes=sizes[1])
        assert {r["word"]: tuple(r[1:]) for r in got.collect()} == want


def test_automaton_meets_every_pair():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(500)} | {"x" * 3000, "x" * 3001, "x" * 1500 + "y" + "x" * 1499})
    trie = spelling.Trie(words, np.arange(len(words)))
    a, b = spelling.near_words(words, trie)
    pairs = list(zip(a.tolist(), b.tolist(), strict=True))
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(i, j) for i, x in enumerate(words) for j, y in enumerate(words) if abs(len(x) - len(y)) < 2 and x != y and one_edit(x, y)}


def test_variants_of_odd_rows(spark):
    long = "x" * 20_000
    rows = [*EDGE, *[(20 + k, f"{long} {long}y Grammar", "en", "a", 0) for k in range(4)], (None, "grammar grammar", "en", "a", 0), (30, "word " * 300_000 + "wordy wordy wordy", None, None, 0)]
    got = {r["word"]: tuple(r[1:]) for r in spelling.variants(docs(spark, rows)).collect()}
    assert got == variants_by_hand(rows)
    assert spelling.variants(docs(spark, [])).count() == 0


# ---------------------------------------------------------------- ids


def test_ids_equal_the_tokenizers(tokenizer_json, monkeypatch):
    rng = random.Random(1)
    signs = ["'", " ", "  ", "\n", "\t", "s", "t", "re", "ve", "ll", "d", "é", "1", "²", "!", " ", "　", "漢", "🙂", "<|endoftext|>", "\x1c", "\x85", "'S", "￿", "́", "᠎", "​", " ", "͸", "\U0001fae8"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(14))) for _ in range(6000)]
    texts += [f"a{chr(c)}1{chr(c)}{chr(c)}. {chr(c)}" for c in range(0, 0x30000, 23) if not 0xD800 <= c < 0xE000]
    texts += ["It's we're they'll 'tis ''s don't\n's " * 300, "x" * 3000, ""]
    want = [e.ids for e in Tokenizer.from_str(tokenizer_json).encode_batch(texts, add_special_tokens=False)]
    words = token_ids.Words2Ids(tokenizer_json)
    assert [x.tolist() for x in words.texts(iter(texts))] == want
    assert [x.tolist() for x in words.texts(iter(texts))] == want  # from what is kept
    monkeypatch.setattr(token_ids, "SLICE", 40)
    monkeypatch.setattr(token_ids, "KEPT_WORDS", 30)
    few = slice(0, len(texts), 7)
    assert [x.tolist() for x in words.texts(iter(texts[few]))] == want[few]


# ---------------------------------------------------------------- window packing


def checked_packing(rows, got, tokenizer_json, capacity):
    """Every id of every row once, sequences without gaps and within capacity. Returns (padding, ids)."""
    tokenizer = Tokenizer.from_str(tokenizer_json)
    want = Counter((d, tuple(tokenizer.encode(text or "", add_special_tokens=False).ids) + (1,)) for d, text, *_ in rows)
    pieces = {}
    for r in got:
        assert r["length"] >= 1 and len(r["ids"]) == 4 * r["length"]
        ids = tuple(np.frombuffer(r["ids"], dtype="<u4").tolist())
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], ids))
    for (d, total), held in pieces.items():
        texts = [t for t in want if t[0] == d and len(t[1]) == total]
        assert held and texts
        assert Counter((s + k, x) for s, ids in held for k, x in enumerate(ids)) == Counter((k, x) for t in texts for _ in range(want[t]) for k, x in enumerate(t[1]))
    assert set(pieces) == {(d, len(ids)) for d, ids in want}
    padding = 0
    for _, group in itertools.groupby(sorted(got, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for r in group:
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding, sum(r["length"] for r in got)


@pytest.mark.parametrize(("parts", "capacity", "windows"), [(1, 2048, 64), (40, 64, 4), (7, 16, 1)])
def test_packing_keeps_every_id(spark, tokenizer_json, parts, capacity, windows):
    rng = random.Random(parts)
    rows = [*EDGE, (11, "long text without end. " * 9000, "en", "a", 0), (12, "y" * 1_200_000, "en", "a", 0), (None, None, None, None, None)]
    rows += [(100 + i, " ".join(rng.choice(["alpha", "beta's", "Gamma-3", "ß"]) for _ in range(rng.randrange(1, 400))), "en", "a", 0) for i in range(300)]
    given = docs(spark, rows).withColumns({"start": F.lit("x"), "ids": F.lit("y"), "sequence_id": F.lit("z")}).repartition(parts)
    got = window_packing.pack_windows(given, tokenizer_json, capacity=capacity, open_windows=windows).collect()
    padding, ids = checked_packing(rows, got, tokenizer_json, capacity)
    assert padding <= 0.02 * ids
    assert window_packing.pack_windows(docs(spark, []), tokenizer_json).count() == 0


def test_packer_equals_a_search_of_all_windows():
    rng = random.Random(2)
    for _ in range(30):
        most, cut = rng.choice([1, 3, 8]), rng.choice([5, 24, 10_000])
        closed, mine = [], []
        packer = window_packing.Packer(lambda w, closed=closed: closed.append([len(p.ids) for p in w.pieces]), 100, most, cut)
        windows = []  # [age, lengths]
        age = itertools.count()
        for _ in range(200):
            n = rng.randrange(1, 130)
            packer.document(0, np.zeros(n, dtype=np.uint32))
            if n >= 100:
                mine.append([100])
                n -= 100
            while n:
                room = {id(w): 100 - sum(w[1]) for w in windows}
                fit = min((w for w in windows if room[id(w)] >= n), key=lambda w: (room[id(w)], w[0]), default=None)
                if fit is None and len(windows) == most:
                    full = min(windows, key=lambda w: (room[id(w)], w[0]))
                    windows.remove(full)
                    gap = room[id(full)]
                    if gap >= cut and n - gap >= cut:
                        full[1].append(gap)
                        mine.append(full[1])
                        n -= gap
                        continue
                    mine.append(full[1])
                if fit is None:
                    fit = [next(age), []]
                    windows.append(fit)
                fit[1].append(n)
                if sum(fit[1]) == 100:
                    windows.remove(fit)
                    mine.append(fit[1])
                n = 0
        assert closed == mine
        assert sorted([len(p.ids) for p in w.pieces] for w in packer.left()) == sorted(w[1] for w in windows)
        total = sum(map(sum, closed)) + sum(w.used for w in packer.left())
        packer.finish()
        assert sum(map(sum, closed)) == total
