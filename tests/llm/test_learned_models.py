"""Models that are learned from every training row: piece weights of the language model, lexicon and weights of toxicity."""

import math
import pickle
import random

import numpy as np
from pyspark.sql import functions as F

from cragline.llm import lattice_lm, queries, toxicity

from .test_operators import PIECES, tiny_lattice

SF = "/root/testdata/sf0.01"


def uses_by_hand(raw, w):
    """Expected uses of each piece over all segmentations."""
    total, uses = 0.0, np.zeros(len(w))

    def go(at, taken):
        nonlocal total, uses
        if at == len(raw):
            chance = math.exp(sum(w[i] for i in taken))
            total += chance
            np.add.at(uses, taken, chance)
        for i, p in enumerate(PIECES):
            if raw.startswith(p, at):
                go(at + len(p), [*taken, i])

    go(0, [])
    return uses / total


def test_expected_uses_of_pieces(monkeypatch):
    lattice, w = tiny_lattice()
    some = [b"", b"a", b"abc", b"abab", "é".encode(), b"zz", b"bcbc"]
    assert np.allclose(lattice.uses(some), sum(uses_by_hand(b" " + s, w) for s in some))
    long = b"abcz" * 300
    uses = lattice.uses([long])
    spelled = sum(u * len(p) for u, p in zip(uses, PIECES, strict=True))
    assert math.isclose(spelled, len(long) + 1) and np.isfinite(lattice_lm.fitted(w, uses)).all()
    assert math.isclose(np.exp(lattice_lm.fitted(w, uses)).sum(), 1.0)


def test_held_out_rows_score_near_the_base(spark):
    rows = [r for r in queries.op3_lattice_likelihood(spark, SF).collect() if r["held_out"]]
    tokens = sum(r["n_tokens"] for r in rows)
    assert rows and all(r["score"] is not None and math.isfinite(r["score"]) and r["score"] <= 0 for r in rows)
    score, base, alone = (sum(r[c] for r in rows) / tokens for c in ("score", "base_score", "vocabulary_score"))
    assert score > base - 1.0 and score > alone + 2.0, (score, base, alone)


def test_toxicity_learns_from_every_labelled_row(spark):
    ids = spark.range(33_000).withColumn("doc_id", F.col("id"))
    late = ids.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1).orderBy(F.xxhash64("doc_id").desc()).limit(12)  # past any sample of 20,000 by hash
    rare = [r["doc_id"] for r in late.collect()]
    bad = F.when(F.col("doc_id").isin(rare), "zorgle").when(F.col("doc_id") % 10 == 0, "vilest").otherwise("river")
    df = ids.select("doc_id", F.concat_ws(" ", F.lit("the stone walks"), bad).alias("text"))
    labels = ids.select("doc_id", (F.col("doc_id").isin(rare) | (F.col("doc_id") % 10 == 0)).cast("int").alias("toxic"))
    new = spark.createDataFrame([(90_001, "a zorgle here"), (90_002, "a river here")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(df.unionByName(new), labels).where("doc_id > 90000").collect()}
    assert got[90_001]["predicted"] == 1 and got[90_001]["marked"] == 1 and got[90_002]["predicted"] == 0


def test_newton_steps_over_partitions_equal_those_in_memory(spark):
    rng = np.random.default_rng(1)
    x = rng.random((400, 5))
    y = (x @ np.arange(5) + rng.normal(size=400) > 5).astype(int)
    rows = [(int(v), *map(float, r)) for v, r in zip(y, x, strict=True)]
    df = spark.createDataFrame(rows, ["y", *toxicity.FEATURES]).repartition(7)
    assert np.allclose(toxicity.fit(df), toxicity._logistic(x, y.astype(float)), atol=1e-9)


def test_endings_are_looked_up_and_not_listed():
    own, tails = {"stupid": 5.0, "moron": 4.0, "gromf*": 3.0, "stupider": 0.0}, ["e", "er", "ing", "s"]
    short = toxicity.Lexicon(own, tails)
    listed = {w + e: own[w] for w in ("stupid", "moron") for e in tails} | own
    model = toxicity.Characters({w: 40.0 for w in ("stupid", "moron", "the", "house", "stone")})
    one, other = toxicity.Scorer(short, model), toxicity.Scorer(listed, model)
    for text in ("a stupiding house", "stupider", "stup1ding stone", "stupidi ng", "m o r o n s", "moroner the", "moronest", "gromfel", "stupid ing", "mor0n.e"):
        assert one.features(text) == other.features(text), text
    assert len(short) == len(own) and "morons" in short and "moronx" not in short and pickle.loads(pickle.dumps(short)).get("morons") == 4.0


def beginnings(text, states, split, scorer):
    """(beginnings of marked words that paths of the text's lattice end in, whether one holds a whole one), by sets of all paths."""
    found, last = False, ""
    goes_on = lambda t: t in scorer.heads or (len(t) > 4 and scorer.weights.begins(t))
    for c in text:
        if c in toxicity.SEPARATORS:
            new = states | ({""} if split else set())
        else:
            new = {s + x for s in states for x in toxicity.LEET.get(c, c) if goes_on(s + x)}
            new |= {""} if split and c in toxicity.LEET and not c.isdigit() else set()
        new |= states if c == last else set()
        states, last = new, c
        found = found or any(t in scorer.stems or (len(t) > 4 and scorer.weights.get(t)) for t in states)
    return states, found


def test_places_hold_what_all_paths_end_in():
    rng = random.Random(5)
    model = toxicity.Characters({w: 40.0 for w in ("stupid", "moron", "idiot", "the")})
    scorer = toxicity.Scorer(toxicity.Lexicon({"stupid": 5.0, "moron": 4.0, "idiot": 3.0, "lose*": 3.0, "the": 0.0}, ["s", "er", "ing"]), model)
    for _ in range(3000):
        text = "".join(rng.choice(["stu", "pid", "mor", "on", "1d1", "ot", "l0s", "e", "er", "ing", "s", "o", ".", " ", "-", "(", ":", "0", "1", "$"]) for _ in range(rng.randrange(1, 9)))
        for states, split in (({""}, True), ({"stu"}, False), ({"m", "moron"}, False)):
            place, found = scorer._walk(text, scorer.place(frozenset(states), "", split))
            assert (set(place.states), found) == beginnings(text, states, split, scorer), (text, states)
    forgets = toxicity.Scorer(scorer.weights, model, memo=0)
    for text in ("a (:stupid one", "<.moron", "stu pid m or 0ns", "s t u p i d e r", "a b stupid", "mo - ron. mo ron", "1diot,", "the lo ser", "l o s e"):
        assert forgets.features(text) == scorer.features(text), text
    assert scorer.features("a (:stupid one")[1] == 1 and scorer.features("stu pid m or 0ns")[1] == 2


def test_texts_with_the_same_beginnings_are_walked_by_lookups():
    class Counted(set):
        asked = 0

        def __contains__(self, x):
            Counted.asked += 1
            return super().__contains__(x)

    model = toxicity.Characters({w: 40.0 for w in ("stupid", "the")})
    scorer = toxicity.Scorer({"stupid": 5.0, "thorn*": 3.0}, model)
    scorer.heads = Counted(scorer.heads)
    for k in range(300):  # "the", "th" and "stu" may go on, so each piece after them is looked at
        assert scorer.features(f"th {k % 7}stone stu walks{k} the st light")[1] == 0
    assert Counted.asked < 400, Counted.asked
