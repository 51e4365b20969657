"""Toxicity by noisy-channel deobfuscation.

Words and prefixes that mark toxic texts are learned from labelled training rows by log-odds with a
significance test. A prefix counts only if several words that lean to toxic rows have it, and a marked word also counts with
the endings that many words of these rows take; neither counts for a word that clean rows hold about as often. A character trigram model is learned from the same rows' words. Tokens written
with digits or signs for letters, split by spaces or signs, or with drawn-out letters are lattices of
what each character may stand for; Viterbi decoding picks the likeliest restored text under the
channel's costs and the character model. The restored text is then scored: a logistic regression over
the weights of its distinct marked words.

Every labelled row that is not held out is learned from: words, prefixes, endings and trigrams are counted, and the
regression's Newton steps summed, by Spark. The driver gets marked words, clean words that those would mark, endings,
trigrams and one small matrix a partition and step.

Every token that is not itself marked, every run of single characters and every join of neighbouring
pieces is such a lattice, whatever its length. A lattice is decoded only if one of its paths holds a
marked word or prefix, which a walk over their beginnings decides; no other decoding could be marked. Steps of walks are
kept, so the texts of a task share those of their common beginnings.

Whole texts are scored. Defined results: null and empty texts have no marked words and get the model's
base score; labels that are null or neither 0 nor 1 are not learned from, of repeated labels the
largest counts, and of repeated labelled ids one row is learned from; without labels of both kinds each score is the share of toxic labels, 0 without
labels; repeated rows score alike; a null id is never held out; an empty table gives an empty result; texts of any
length are scored whole; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, materialize
from .quality_rules import held_out

COUNT_KEYS, COUNT_BYTES = 300_000, 64 << 20  #: features, and bytes of text, that a task counts before it hands its counts on
PREFIXES = (4, 5, 6)
PREFIX_WORDS, PREFIX_ROWS = 3, 2  #: words that a prefix needs, and toxic rows that hold each of them
ENDING, ENDING_STEMS = 3, 20  #: letters of an ending at most, and words that must take it
JOIN_HEAD = 2  #: characters by which most pieces are known not to go on a word
MEMO_BYTES = 64 << 20  #: what a task remembers of tokens, and as much of places
LEAST_G = 30.0  #: likelihood-ratio statistic from which on a word marks a text
LEAST_ODDS = 2.0
#: Characters that commonly stand for letters.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "¢": "c",
}
SEPARATORS = frozenset(" .-_*~'`,/\\")
LEET_COST, DROP_COST, SPLIT_COST, REPEAT_COST = 1.0, 0.5, 3.0, 0.7

_EDGE = ".,;:?\"'`)]}>#%&*|~^=_-\\/"
_SIGNS = "".join(re.escape(c) for c in LEET if not c.isalnum())
_GAPS = "".join(re.escape(c) for c in sorted(SEPARATORS - {" "}))
#: three or more single characters, each of a letter or what LEET reads as one, with whitespace and separators between
_SPACED = re.compile(rf"(?<![^\W_])(?<![^\W_][{_GAPS}])(?:[^\W_]|[{_SIGNS}])(?:[\s{_GAPS}]+(?:[^\W_]|[{_SIGNS}])){{2,}}(?![^\W_])")
#: what is in each of these, and quicker to look for: a single character after a separator, and another one
_APART = re.compile(rf"[\s{_GAPS}](?:[^\W_]|[{_SIGNS}])[\s{_GAPS}]+(?:[^\W_]|[{_SIGNS}])(?![^\W_])")
_SPACE = re.compile(r"\s")
_REPEAT = re.compile(r"([^\W\d_])\1\1")
_DOUBLE = re.compile(r"(.)\1")
_SEPARATED, _OPENING = "".join(sorted(SEPARATORS)), _EDGE + "[{"


class Characters:
    """Trigram model of characters, '^' marking a word's edge, with additive smoothing."""

    def __init__(self, words: dict[str, float], add: float = 0.05):
        self.three: Counter = Counter()
        self.two: Counter = Counter()
        letters = {"^"}
        for w, n in words.items():
            s = f"^^{w}^"
            letters.update(w)
            for i in range(len(s) - 2):
                self.three[s[i : i + 3]] += n
                self.two[s[i : i + 2]] += n
        self.add, self.size = add, len(letters)

    @classmethod
    def of_trigrams(cls, three: dict[str, float], words: dict[str, float]) -> Characters:
        """The model of ``words`` and of words whose trigrams have the weights ``three``."""
        model = cls(words)
        for g, n in three.items():
            model.three[g] += n
            model.two[g[:2]] += n
        model.size = len({g[2] for g in model.three} | {"^"})
        return model

    def cost(self, a: str, b: str, c: str) -> float:
        return -math.log((self.three.get(a + b + c, 0.0) + self.add) / (self.two.get(a + b, 0.0) + self.add * self.size))


def decode(text: str, model: Characters, apart: bool = False) -> str:
    """The likeliest restoration of an odd token or spaced run; words of the result are joined by spaces.

    ``apart``: spaces stand between words unless shown otherwise, as in joins of longer pieces. A text is
    decoded as one lattice: states point back to what they emitted, so time and memory are linear in its length.
    """
    states: dict = {("^", "^"): (0.0, None)}
    last = ""
    for c in text:
        options = []  # (emitted, cost); '' drops the character, ' ' ends a word
        if c == " " and apart:
            options += [("", SPLIT_COST), (" ", DROP_COST)]
        elif c in SEPARATORS:
            options += [("", DROP_COST), (" ", SPLIT_COST)]
        elif c in LEET:
            options += [(x, LEET_COST) for x in LEET[c]] + ([(" ", SPLIT_COST)] if not c.isdigit() else []) + [(c, 4.0)]
        else:
            options.append((c, 0.0))
        if c == last:
            options.append(("", REPEAT_COST))
        last = c
        new: dict = {}
        for (a, b), (cost, out) in states.items():
            for x, extra in options:
                if x == "":
                    key, total, text_out = (a, b), cost + extra, out
                elif x == " ":
                    if b == "^":
                        key, total, text_out = (a, b), cost + DROP_COST, out
                    else:
                        key, total, text_out = ("^", "^"), cost + extra + model.cost(a, b, "^"), (out, " ")
                else:
                    key, total, text_out = (b, x), cost + extra + model.cost(a, b, x), (out, x)
                if key not in new or total < new[key][0]:
                    new[key] = (total, text_out)
        states = new
    _, (_, out) = min(states.items(), key=lambda s: s[1][0] + model.cost(*s[0], "^"))
    emitted = []
    while out is not None:
        out, x = out
        emitted.append(x)
    return "".join(reversed(emitted)).strip()


def _bare(token: str) -> str:
    return token.rstrip(_EDGE + "!$+@").lstrip(_EDGE + "([{<\"")


def _features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


class Lexicon(dict):
    """Weights of marked words and prefixes. A marked word with one of ``tails`` is in it too, unless it has a weight of its own."""

    def __init__(self, weights: dict[str, float], tails: list[str] = ()):
        super().__init__(weights)
        self.tails = frozenset(tails)
        self.words = {w for w, x in weights.items() if x}
        self.tail_heads = frozenset(e[:n] for e in tails for n in range(1, len(e) + 1))

    def ending(self, word: str) -> float | None:
        """The weight of the longest marked word that makes ``word`` with one of ``tails``."""
        own = super().get
        for k in range(1, min(ENDING, len(word) - PREFIXES[0]) + 1):
            if word[-k:] in self.tails and (weight := own(word[:-k])):
                return weight
        return None

    def begins(self, text: str) -> bool:
        """Whether ``text`` is a marked word and the beginning of an ending."""
        for k in range(1, min(ENDING, len(text) - PREFIXES[0]) + 1):
            if text[:-k] in self.words and text[-k:] in self.tail_heads:
                return True
        return False

    def __missing__(self, word: str) -> float:
        weight = self.ending(word)
        if weight is None:
            raise KeyError(word)
        return weight

    def __contains__(self, word) -> bool:
        return super().__contains__(word) or self.ending(word) is not None

    def get(self, word, default=None):
        weight = super().get(word)
        if weight is None:
            weight = self.ending(word)
        return default if weight is None else weight

    def __reduce__(self):
        return Lexicon, (dict(self), sorted(self.tails))


class Place(dict):
    """Where paths of a lattice stand after a text: ``states``, the beginnings of marked words that they end in, ``last``, its
    last character, and ``whole``, whether one of them is a whole marked word. As a mapping it gives the place that
    each character leads to, made when first met, so texts with the same beginnings are walked by lookups."""

    __slots__ = ("scorer", "states", "last", "split", "whole", "onward", "closed")

    def __init__(self, scorer: Scorer, states: frozenset, last: str, split: bool):
        self.scorer, self.states, self.last, self.split, self.onward = scorer, states, last, split, None
        self.closed: set[str] | None = None if split or last else set()  # beginnings of next pieces that lead nowhere
        self.whole = not scorer.stems.isdisjoint(states) or any(len(t) > PREFIXES[0] and scorer.weights.get(t) for t in states)

    def __missing__(self, c: str) -> Place:
        states, split, heads, least, begins = self.states, self.split, self.scorer.heads, PREFIXES[0], self.scorer.weights.begins
        if c in SEPARATORS:
            new = {*states, ""} if split else set(states)
        elif c in LEET:
            new = {t for s in states for x in LEET[c] if (t := s + x) in heads or (len(t) > least and begins(t))}
            if split and not c.isdigit():
                new.add("")
        else:
            new = {t for s in states if (t := s + c) in heads or (len(t) > least and begins(t))}
        if c == self.last:
            new |= states
        self.scorer.walked += 150
        to = self[c] = self.scorer.place(frozenset(new), c, split)
        return to


class Scorer:
    """Marked words of texts, with memos of distinct tokens and of places that are emptied when they grow large.

    A word of weight 0 is clean, whatever its prefixes weigh.
    """

    def __init__(self, weights: dict[str, float], model: Characters, memo: int = MEMO_BYTES):
        self.weights, self.model, self.memo = weights if isinstance(weights, Lexicon) else Lexicon(weights), model, memo
        self.plain = dict(self.weights)
        self.stems = {f.removesuffix("*") for f, w in weights.items() if w}
        self.heads = {f[:n] for f in self.stems for n in range(1, len(f) + 1)}
        self._forget_tokens()
        self._forget_places()

    def _forget_tokens(self):
        self.known: dict[str, tuple] = {}
        self.open: dict[str, Place] = {}  # tokens that may end within a marked word, with the place that its next piece starts from
        self.held = 0  # bytes of the memo, by the keys' lengths and a fixed share for each entry

    def _forget_places(self):
        self.places: dict[tuple, Place] = {}
        self.walked = 0  # bytes of the places, by fixed shares
        self.start = self.place(frozenset([""]), "", True)

    def place(self, states: frozenset, last: str, split: bool) -> Place:
        key = states, last if states else "", split
        got = self.places.get(key)
        if got is None:
            self.walked += 500 + 60 * len(states) + sum(map(len, states))
            got = self.places[key] = Place(self, *key)
        return got

    def _word(self, word: str) -> tuple[float, str] | None:
        plain = self.plain
        weight = self.weights.get(word)
        if weight == 0:
            return None
        best = max((plain[f] for f in _features(word)[1:] if f in plain), default=weight)
        return best and (best if weight is None else max(best, weight), word)

    def _walk(self, text: str, place: Place) -> tuple[Place, bool]:
        """(where the paths of the lattice end, whether one of them holds a whole marked word).

        From a place that is ``split``, words may also begin within the text, after a separator or sign.
        """
        found, ends = False, not place.split or text.isalpha()
        for c in text:
            place = place[c]
            if place.whole:
                found = True
            elif ends and not place.states:
                break
        return place, found

    def _onward(self, place: Place) -> Place | None:
        """The place that the next piece of a join starts from, if any beginning is left."""
        if place.onward is None and (states := place.states - {""}):
            place.onward = self.place(states, "", False)
        return place.onward

    def _restored(self, text: str) -> tuple:
        """((weight, word, 1), ...) of the marked words that decoding an odd token or a join restores."""
        odd = text.strip("".join(set(_EDGE) - {"|"})).lstrip("[{")
        found = {}
        for form in sorted({odd, odd.rstrip("!$+@|"), _REPEAT.sub(r"\1", odd)}):
            for w in decode(form, self.model, " " in form).split():
                got = self._word(w)
                if got:
                    found[w] = (*got, 1)
        return tuple(found.values())

    def _token(self, token: str) -> tuple:
        """((weight, word, restored), ...) that a token holds; the plain reading wins if it is marked."""
        text = token.lstrip(_OPENING).rstrip(_SEPARATED)  # separators at the end lead nowhere else
        end, reached = self._walk(text, self.start)
        if end.states and (onward := self._onward(end)) is not None:
            self.open[token] = onward
        if not reached and not text.startswith(("(", "<")):  # the plain reading is a path too, as what marks is of letters
            return ()
        got = (word := _bare(token)) and self._word(word)
        if got:
            return ((*got, 0),)
        return self._restored(token) if reached and (not token.isalpha() or _DOUBLE.search(token)) else ()  # other tokens have one reading

    def _joins(self, words: list[str]):
        """Marked words of neighbouring tokens that only their join holds; runs of single characters are not looked at."""
        starts = zip(map(self.open.get, words), words[1:])
        for i in [k for k, (place, piece) in enumerate(starts) if place is not None and piece[:JOIN_HEAD] not in place.closed]:
            place, long = self.open[words[i]], False
            for j in range(i + 1, len(words)):
                end, reached = self._walk(words[j], place)
                if not reached and not end.states:
                    if self._walk(head := words[j][:JOIN_HEAD], place)[0] is end:
                        place.closed.add(head)
                        self.walked += 100
                    break
                long = long or len(_bare(words[j])) > 1 or (j == i + 1 and len(_bare(words[i])) > 1)
                if reached and long:
                    text = " ".join(words[i : j + 1])
                    got = self.known.get(text)
                    if got is None:
                        self.held += 4 * len(text) + 300
                        apart = {w for t in words[i : j + 1] for _, w, _ in self.known[t]}
                        got = self.known[text] = tuple(g for g in self._restored(text) if g[1] not in apart)
                    if got:
                        yield from got
                        break
                place = self._onward(end)
                if place is None:
                    break

    def features(self, text: str) -> tuple[float, float, float, float, float]:
        """(capped weight, distinct marked words, their uses, their share of distinct words, restored ones)."""
        text = text.lower()
        if self.held > self.memo:
            self._forget_tokens()
        if self.walked > self.memo:
            self._forget_tokens()  # which hold places
            self._forget_places()
        known = self.known
        words = text.split()
        tokens = Counter(words)
        hits: dict[str, tuple[float, int]] = {}
        uses = 0
        for t, n in tokens.items():
            got = known.get(t)
            if got is None:
                self.held += 4 * len(t) + 300
                got = known[t] = self._token(t)
            for weight, word, restored in got:
                hits[word] = (weight, restored)
                uses += n
        for m in _SPACED.finditer(text) if _APART.search(text) else ():
            run = _SPACE.sub(" ", m[0])
            if not self._walk(run, self.start)[1]:
                continue
            for w in decode(run, self.model).split():
                if len(w) > 2 and (got := self._word(w)):
                    hits.setdefault(got[1], (got[0], 1))
                    uses += 1
        for weight, word, restored in self._joins(words):
            hits.setdefault(word, (weight, restored))
            uses += 1
        total = sum(w for w, _ in hits.values())
        return min(total, 20.0), float(min(len(hits), 3)), float(min(uses, 4)), math.log1p(1000 * len(hits) / max(1, len(tokens))), float(min(3, sum(r for _, r in hits.values())))


def _word_counts(batches):
    """(feature, toxic, clean): documents of each kind that hold a word or prefix."""
    toxic, clean, memo, held = Counter(), Counter(), {}, 0
    for batch in batches:
        for text, y in zip(column(batch, "text"), column(batch, "y").to_pylist(), strict=True):
            text = (text.as_py() or "").lower()
            held += len(text)
            found = set()
            for t in set(text.split()):
                got = memo.get(t)
                if got is None:
                    word = _bare(t)
                    got = memo[t] = _features(word) if word.isalpha() else ()
                found.update(got)
            (toxic if y else clean).update(found)
            if len(toxic) + len(clean) + len(memo) > COUNT_KEYS or held > COUNT_BYTES:
                yield _out(toxic, clean)
                toxic, clean, memo, held = Counter(), Counter(), {}, 0
    yield _out(toxic, clean)


def _trigrams(batches):
    """(trigram, weight) of words, each with the logarithm of how many rows hold it."""
    for batch in batches:
        three: Counter = Counter()
        for w, n in zip(column(batch, "feature").to_pylist(), column(batch, "n").to_pylist(), strict=True):
            s, weight = f"^^{w}^", math.log1p(n)
            for i in range(len(s) - 2):
                three[s[i : i + 3]] += weight
        yield pa.RecordBatch.from_arrays([pa.array(list(three), pa.string()), pa.array(list(three.values()), pa.float64())], names=["trigram", "weight"])


def _out(toxic: Counter, clean: Counter):
    names = list(toxic.keys() | clean.keys())
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[w] for w in names], pa.int64()), pa.array([clean[w] for w in names], pa.int64())], names=["feature", "toxic", "clean"])


def _sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gradient, Hessian) of the logistic loss of these rows, its intercept first."""
    z = np.column_stack([np.ones(len(x)), x])
    p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
    return z.T @ (p - y), (z * (p * (1 - p))[:, None]).T @ z


def _newton(sums, size: int, ridge: float = 1e-2) -> np.ndarray:
    """Intercept and weights by Newton steps; ``sums`` gives the gradient and Hessian of all rows at given weights."""
    w = np.zeros(size)
    for _ in range(50):
        gradient, hessian = sums(w)
        step = np.linalg.solve(hessian + ridge * np.eye(size), gradient + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _newton(lambda w: _sums(x, y, w), x.shape[1] + 1)


def fit(known: DataFrame) -> np.ndarray:
    """Intercept and weights of the rows (y, FEATURES); each step is one pass that sums a small matrix in each partition."""
    size = len(FEATURES) + 1

    def sums(w):
        def run(batches):
            total = np.zeros((size, size + 1))
            for batch in batches:
                x = np.column_stack([column(batch, f).to_numpy() for f in FEATURES])
                gradient, hessian = _sums(x, column(batch, "y").to_numpy().astype(float), w)
                total[:, 0] += gradient
                total[:, 1:] += hessian
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["sums"])

        total = sum(np.array(r["sums"]) for r in known.mapInArrow(run, "sums array<double>").collect())  # one row a partition
        total = total.reshape(size, size + 1)
        return total[:, 0], total[:, 1:]

    return _newton(sums, size)


def learn(texts: DataFrame) -> tuple[dict[str, float], Characters]:
    """(weights of marking features, character model) from rows (text, y)."""
    counts = materialize(texts.select("text", "y").mapInArrow(_word_counts, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "features")
    totals = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    t, c = totals.get(1, 0), totals.get(0, 0)
    if not t or not c:
        return {}, Characters({})
    k, n = F.col("toxic"), F.col("toxic") + F.col("clean")
    share = t / (t + c)
    part = lambda a, e: F.when(a > 0, a * F.log(a / e)).otherwise(0.0)
    g = 2 * (part(k, n * share) + part(n - k, n * (1 - share)) + part(t - k, t - n * share) + part(c - F.col("clean"), c - n * (1 - share)))
    odds = F.log((k + 0.5) / (t + 1.0)) - F.log((F.col("clean") + 0.5) / (c + 1.0))
    whole = ~F.col("feature").endswith("*")
    words = counts.where(whole & (n >= 3)).select("feature", n.alias("n"))
    leaning = counts.where(whole & (k >= PREFIX_ROWS) & (odds > LEAST_ODDS)).select("feature")
    sharing = leaning.select(F.explode(F.array(*(F.when(F.length("feature") > p, F.concat(F.substring("feature", 1, p), F.lit("*"))) for p in PREFIXES))).alias("feature"))
    sharing = sharing.groupBy("feature").agg(F.count("*").alias("words")).where(F.col("words") >= PREFIX_WORDS)
    marked = counts.where((k >= 4) & (g > LEAST_G) & (odds > LEAST_ODDS)).select("feature", odds.alias("odds")).join(sharing, "feature", "left")
    weights = {r["feature"]: r["odds"] for r in marked.where(whole | F.col("words").isNotNull()).collect()}  # what marks a text
    three = words.mapInArrow(_trigrams, "trigram string, weight double").groupBy("trigram").agg(F.sum("weight").alias("weight")).collect()  # as many as letters make
    chars = Characters.of_trigrams({r["trigram"]: r["weight"] for r in three}, {w: 50.0 for w in weights if not w.endswith("*")})
    return _widened(weights, counts.where(odds <= LEAST_ODDS), endings(words)), chars


def endings(words: DataFrame) -> list[str]:
    """Endings of up to ENDING letters that at least ENDING_STEMS of the words (feature) take."""
    word, size = F.col("feature"), F.length("feature")
    cut = F.explode(F.array(*(F.when(size - k >= PREFIXES[0], F.struct(F.substring(word, F.lit(1), size - k).alias("feature"), F.right(word, F.lit(k)).alias("ending"))) for k in range(1, ENDING + 1))))
    takes = words.select(cut.alias("x")).where("x is not null").select("x.*").join(words.select("feature"), "feature")
    return sorted(r["ending"] for r in takes.groupBy("ending").agg(F.count("*").alias("n")).where(F.col("n") >= ENDING_STEMS).collect())  # at most three letters each


def _widened(weights: dict[str, float], common: DataFrame, tails: list[str]) -> dict[str, float]:
    """``weights``, which also hold for the marked words' endings, and with weight 0 for words of ``common`` that a prefix or ending would mark."""
    out = Lexicon(weights, tails)
    sent = common.sparkSession.sparkContext.broadcast(out)

    def would_mark(batches):
        for batch in batches:
            yield batch.filter(pa.array([any(f in sent.value for f in _features(w)) for w in column(batch, "feature").to_pylist()], pa.bool_()))

    clean = common.where((F.col("clean") > 0) & ~F.col("feature").endswith("*")).select("feature").mapInArrow(would_mark, "feature string").collect()
    return Lexicon({r["feature"]: 0.0 for r in clean} | weights, tails)


FEATURES = ["weight", "marked", "uses", "share", "restored"]


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", modulus: int = 3, remainder: int = 1, cut: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted, marked, restored) of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = held_out("doc_id", modulus, remainder)
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label_col).alias("y"))
    known = materialize(known.where(~out), "known")
    # one row of each id, combined before it meets its label
    texts = rows.where(~out & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("text").alias("text")).join(known, "doc_id")
    weights, chars = learn(materialize(texts, "labelled"))
    sent = spark.sparkContext.broadcast((weights, chars))

    def run(batches):
        scorer = Scorer(*sent.value)
        for batch in batches:
            x = np.array([scorer.features(t.as_py() or "") for t in column(batch, "text")]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *(pa.array(c) for c in x.T)], names=["doc_id", *FEATURES])

    found = materialize(rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES)), "marked")
    each = found.where(~out & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.struct(*FEATURES)).alias("x"))
    each = materialize(each.join(known, "doc_id").select("y", "x.*"), "fit")
    n, toxic = each.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if 0 < toxic < n:
        w = fit(each)
        linear = F.lit(float(w[0]))
        for f, v in zip(FEATURES, w[1:], strict=True):
            linear = linear + F.col(f) * float(v)
        score = F.lit(1.0) / (F.lit(1.0) + F.exp(-linear))
    else:
        score = F.lit(toxic / n if n else 0.0)
    scored = found.select("doc_id", out.alias("held_out"), score.alias("score"), F.col("marked").cast("long").alias("marked"), F.col("restored").cast("long").alias("restored"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= cut).cast("int").alias("predicted"), "marked", "restored")
