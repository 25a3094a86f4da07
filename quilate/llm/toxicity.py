"""Toxicity by a subsequence string kernel, a support vector machine and Nyström landmarks.

Units are the words of a text, lower-cased, and runs of spaced single letters
joined. The kernel counts the subsequences of four characters that two units
share, gaps allowed: each occurrence weighs ``DECAY`` to the power of its span. A
character put into an insult, or one left out, only stretches some spans, so the
similarity stays high. Units begin and end with a boundary character.

Training takes sentences of labelled documents. A sentence's decision is that of
its worst unit. All sentences of clean documents are negative. A toxic document says
that some sentence is toxic, not which: the machine starts from sentences with a
word that toxic documents have and clean ones lack, and then alternates (as in
multiple-instance learning) between fitting and taking the most suspicious sentence
of each toxic document that has none yet; the sentence shows its worst unit.
Negatives that it still gets wrong join the fit each time. Toxic units are also
shown with characters inserted, doubled or replaced, and negatives alike.

The machine is linear in Nyström features, whose landmarks are taken greedily
where the kernel is approximated worst. As a sum over landmarks its decision is
linear in subsequence counts too, and so collapses into one weight per
subsequence: scoring a unit is a handful of table lookups.

A document's score is a logistic function of its worst sentence's decision. As no
unit reaches over a sentence's end, that is the worst of the text's distinct units.

The sample of labelled documents is bounded by ``sample`` per class (those of the smallest
hashes), and of each training takes the first ``per_document`` sentences; a toxic document
whose only toxic sentence comes later teaches nothing. Scoring covers all documents whole.

Edge cases: null and empty texts score as a text of harmless words; very long
words are scored in overlapping windows; texts without labels are scored alike;
repeated labels count once; without both classes among the labels every score is next
to 0;
extra columns aren't carried along.
"""

from __future__ import annotations

import random
import re
import string
from functools import lru_cache
from itertools import combinations
from sys import intern
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents of each class, landmarks, and rounds of witness choice.
SAMPLE, LANDMARKS, TURNS = 2500, 320, 4
#: Sentences of a labelled document that training takes, and words of one.
SENTENCES, WORDS = 400, 80
ORDER, DECAY, SPAN, WINDOW = 4, 0.75, 7, 28
#: Decisions remembered in a Python worker.
REMEMBERED = 400_000

_STRIP = string.punctuation + "“”„‘’«»…–—¡¿"
#: Letters that share a symbol, and characters that stand for letters.
_SYMBOLS = ["abcdefghijklmnopqrstuvwxyz"[i] for i in range(26)] + ["áàâäãå", "éèêë", "íìîï", "óòôöõø", "úùûü", "ç", "ñ", "ß"]
_STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"}
_A = len(_SYMBOLS) + 3  # boundaries and all other characters
FEATURES = _A**ORDER
_CODE = {c: i for i, letters in enumerate(_SYMBOLS) for c in letters} | {k: ord(v) - 97 for k, v in _STANDS_FOR.items()}
_BEGIN, _END, _OTHER = _A - 3, _A - 2, _A - 1
_SPACED = re.compile(r"(?<!\w)\w(?:[ .*_-]\w){2,}(?!\w)")


#: A unit needs two letters: numbers and addresses are no insults.
_LETTERS = re.compile(r"[^\W\d_].*[^\W\d_]")


def units(text: str | None) -> set[str]:
    """The distinct units of a text."""
    if not text:
        return set()
    low = text.lower()
    found = {w.strip(_STRIP) for w in set(low.split())}
    for run in _SPACED.findall(low):
        letters = run[::2]
        found.add(letters)
    found.discard("")
    long = [w for w in found if len(w) > WINDOW]
    for w in long:
        found.discard(w)
        found.update(w[i : i + WINDOW] for i in range(0, len(w) - WINDOW // 2, WINDOW // 2))
    return found


_END_OF_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def sentences(text: str | None, most: int | None = None, words: int = WORDS) -> list[list[str]]:
    """The units of each sentence with any: sentences end at a full stop, exclamation or question mark before white space, and at line feeds.

    Sentences of more than ``words`` words (lists, text without stops) are cut. ``most``
    bounds their number; those of the smallest hashes stay.
    """
    parts: list[str] = []
    for part in _END_OF_SENTENCE.split(text or ""):
        own = part.split(" ")
        parts += [part] if len(own) <= words else [" ".join(own[i : i + words]) for i in range(0, len(own), words)]
    parts = [x for x in parts if x.strip()]
    if most is not None and len(parts) > most:
        parts = sorted(parts, key=lambda x: crc32(x.encode()))[:most]
    return [sorted(u) for u in map(units, parts) if u]


@lru_cache(maxsize=64)
def _places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of subsequences in a unit of ``n`` characters (boundaries included) and their weights."""
    t = [(i, *rest) for i in range(n) for rest in combinations(range(i + 1, min(n, i + SPAN)), ORDER - 1)]
    places = np.array(t, np.int64).reshape(-1, ORDER).T
    return places, DECAY ** (places[-1] - places[0] + 1.0)


def _norms(index: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Length of each unit's vector of subsequence weights; equal subsequences add up first."""
    n, c = index.shape
    if not c:
        return np.ones(n)
    order = np.argsort(index, axis=1)
    key = np.take_along_axis(index, order, 1)
    begins = np.ones((n, c), bool)
    begins[:, 1:] = key[:, 1:] != key[:, :-1]
    at = np.flatnonzero(begins.ravel())
    sums = np.add.reduceat(weight[order].ravel(), at)
    return np.sqrt(np.bincount(at // c, sums**2, n))


def _grouped(words: list[str]):
    """(numbers, subsequence indices, weights, norms) of words of one length at a time."""
    by_length: dict[int, list[int]] = {}
    for at, w in enumerate(words):
        by_length.setdefault(len(w), []).append(at)
    for n, at in by_length.items():
        places, weight = _places(n + 2)
        step = max(1, 1_000_000 // max(1, len(weight)))
        for begin in range(0, len(at), step):
            own = at[begin : begin + step]
            codes = np.full((len(own), n + 2), _OTHER, np.int64)
            codes[:, 0], codes[:, -1] = _BEGIN, _END
            codes[:, 1:-1] = [[_CODE.get(c, _OTHER) for c in words[a]] for a in own]
            index = codes[:, places[0]]
            for other in places[1:]:
                index = index * _A + codes[:, other]
            yield np.array(own), index, weight, _norms(index, weight)


def _weights(word: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct subsequences of a word and their normalised weights."""
    for _, index, weight, norm in _grouped([word]):
        found, at = np.unique(index[0], return_inverse=True)
        return found, np.bincount(at, weight, len(found)) / norm[0]
    raise AssertionError


class _Basis:
    """Landmarks as rows over the subsequences that any of them has."""

    def __init__(self, words: list[str]):
        rows = [_weights(w) for w in words]
        self.known = np.unique(np.concatenate([r[0] for r in rows]))
        #: column of a subsequence; the first column is for those that no landmark has
        self.column = np.zeros(FEATURES, np.int32)
        self.column[self.known] = np.arange(1, len(self.known) + 1)
        self.rows = np.zeros((len(words), len(self.known) + 1), np.float32)
        for out, (index, weight) in zip(self.rows, rows, strict=True):
            out[self.column[index]] = weight

    def kernel(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), len(self.rows)))
        columns = np.ascontiguousarray(self.rows.T)
        for own, index, weight, norm in _grouped(words):
            for begin in range(0, len(own), 64):
                some = slice(begin, begin + 64)
                out[own[some]] = np.einsum("nck,c->nk", columns[self.column[index[some]]], weight) / norm[some, None]
        return out

    def table(self, shares: np.ndarray) -> np.ndarray:
        """Weight per subsequence of a sum over landmarks."""
        out = np.zeros(FEATURES, np.float32)
        out[self.known] = (shares @ self.rows)[1:]
        return out


def decisions(words: list[str], table: np.ndarray, bias: float) -> np.ndarray:
    out = np.empty(len(words))
    for own, index, weight, norm in _grouped(words):
        out[own] = (table[index] @ weight) / norm
    return out + bias


def _landmarks(words: list[str], count: int, first: list[str]) -> list[str]:
    """Greedy choice (pivoted Cholesky): next is the word whose kernel is approximated worst.

    Those named ``first`` that the others don't approximate yet come before, for half of the landmarks.
    """
    rest = np.ones(len(words))
    chosen, factors, groups = [], np.zeros((len(words), min(count, len(words)))), list(_grouped(words))
    number = {w: i for i, w in enumerate(words)}
    waiting = [number[w] for w in reversed(first) if w in number]
    for step in range(factors.shape[1]):
        while waiting and (rest[waiting[-1]] < 0.25 or step >= count // 2):
            waiting.pop()
        pivot = waiting.pop() if waiting else int(rest.argmax())
        if rest[pivot] < 1e-6:
            break
        chosen.append(words[pivot])
        table, row = np.zeros(FEATURES, np.float32), np.empty(len(words))
        index, weight = _weights(words[pivot])
        table[index] = weight
        for own, index, weight, norm in groups:
            row[own] = (table[index] @ weight) / norm
        factors[:, step] = (row - factors[:, :step] @ factors[pivot, :step]) / np.sqrt(rest[pivot])
        rest = np.maximum(rest - factors[:, step] ** 2, 0)
    return chosen


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Squared-hinge linear machine in the primal by Newton steps; the last column of x is constant."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(30):
        margin = 1 - y * (x @ w)
        on = margin > 0
        a, c = x[on], weight[on]
        gradient = penalty * w - a.T @ (c * y[on] * margin[on])
        hessian = np.diag(penalty) + (a * c[:, None]).T @ a
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _altered(word: str, rng: random.Random) -> str:
    """The word with a character inserted or doubled, or spread out."""
    i, kind = rng.randrange(1, len(word)), rng.random()
    if kind < 0.5:
        return word[:i] + rng.choice(".-*_xhz") + word[i:]
    if kind < 0.8:
        return word[:i] + word[i - 1] + word[i:]
    return rng.choice("-._*").join(word)


class Detector:
    """A fitted detector: a weight per subsequence, a bias and a calibration."""

    def __init__(self, table: np.ndarray, bias: float, slope: float, middle: float):
        self.table, self.bias, self.slope, self.middle = table.astype(np.float32), bias, slope, middle
        self.memo: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def worst(self, bags: list[set[str]]) -> np.ndarray:
        """Highest decision among the units of each bag; -1 for none."""
        memo = self.memo
        if len(memo) > REMEMBERED:
            memo.clear()
        new = [w for w in {w for bag in bags for w in bag if w not in memo} if _LETTERS.search(w) or memo.update({w: -1.0})]
        memo.update(zip(new, decisions(new, self.table, self.bias).tolist(), strict=True))
        return np.array([max(map(memo.__getitem__, bag), default=-1.0) for bag in bags])

    def probability(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (worst - self.middle), -50, 50)))


Sentences = list[list[str]]


def fit(toxic: list[Sentences], clean: list[Sentences], landmarks: int = LANDMARKS, turns: int = TURNS, seed: int = 11) -> Detector:
    """Fit to the sentences (lists of units) of toxic and of clean documents."""
    if not toxic or not clean:
        return Detector(np.zeros(FEATURES), -1.0, 50.0, 1.0)
    rng = random.Random(seed)
    # every fifth document only serves to place the decision
    placing = (toxic[::5], clean[::5])
    if len(toxic) >= 20 and len(clean) >= 20:
        toxic, clean = ([b for i, b in enumerate(x) if i % 5] for x in (toxic, clean))
    in_clean: dict[str, int] = {}
    for document in clean:
        for w in {w for sentence in document for w in sentence}:
            in_clean[w] = in_clean.get(w, 0) + 1
    in_toxic: dict[str, int] = {}
    for document in toxic:
        for w in {w for sentence in document for w in sentence}:
            in_toxic[w] = in_toxic.get(w, 0) + 1
    odds = lambda w: in_toxic[w] / len(toxic) - 2 * in_clean.get(w, 0) / len(clean)
    # what of each toxic document's sentences may be toxic
    suspects = lambda sentence: sorted({w for w in sentence if len(w) > 2 and odds(w) > 0 and _LETTERS.search(w)}, key=lambda w: (-odds(w), w))
    bags = [[x for x in map(suspects, document) if x] for document in toxic]
    bags = [b for b in bags if b]
    first = lambda b: min((x[0] for x in b), key=lambda w: (-odds(w), w))
    harmless = sorted(w for w in in_clean if _LETTERS.search(w))
    common = sorted(harmless, key=lambda w: (-in_clean[w], w))[:1000]
    # words that several toxic documents have, far more often than clean ones, are witnesses throughout
    rate = lambda n, bags: (n + 0.5) / len(bags)
    support = max(3, len(toxic) // 100)
    telling = sorted({w for b in bags for x in b for w in x if in_toxic[w] >= support and rate(in_toxic[w], toxic) > 20 * rate(in_clean.get(w, 0), clean)})
    telling = telling or sorted({w for b in bags for x in b for w in x if in_toxic[w] >= 3}) or sorted({first(b) for b in bags})
    witnesses, known = list(telling), set(telling)
    negatives = sorted({*common, *rng.sample(harmless, min(4000, len(harmless)))})
    table, bias, wrong = np.zeros(FEATURES), 0.0, []
    for turn in range(turns):
        positive = sorted(set(witnesses))
        changed = [w for w in positive for _ in range(2) if len(w) > 3]
        shown = positive + [_altered(w, rng) for w in changed]
        confirmed = np.array([float(in_toxic[w]) for w in positive + changed])
        counter = negatives + [_altered(w, rng) for w in rng.sample(negatives, min(1500, len(negatives)))]
        pool = sorted({*sorted(positive, key=lambda w: (-in_toxic[w], w))[:400], *wrong[:300], *counter[:: max(1, len(counter) // 500)]})
        basis = _Basis(_landmarks(pool, landmarks, sorted(positive, key=lambda w: (-in_toxic[w], w))))
        values, vectors = np.linalg.eigh((basis.rows @ basis.rows.T).astype(float))
        root = vectors / np.sqrt(np.maximum(values, 1e-4))
        words = shown + counter
        x = np.hstack([basis.kernel(words) @ root, np.ones((len(words), 1))])
        y = np.r_[np.ones(len(shown)), -np.ones(len(counter))]
        # a negative weighs by the clean documents that hold it
        often = np.array([min(in_clean.get(w, 1), 100) for w in counter], float) ** 0.5
        share = np.r_[0.4 * confirmed / confirmed.sum(), 0.6 * often / often.sum()] * len(words)
        w = _svm(x, y, 6 * share)
        table, bias = basis.table(root @ w[:-1]), float(w[-1])
        f = decisions(harmless, table, bias)
        wrong = [harmless[i] for i in np.argsort(-f)[:2000] if f[i] > -0.8]
        negatives = sorted({*negatives, *wrong})
        if turn + 1 < turns:
            # documents without a sentence known as toxic show their most suspicious one, if it is suspicious at all
            silent = [b for b in bags if all(known.isdisjoint(x) for x in b)]
            units_ = sorted({w for b in silent for x in b for w in x})
            score = dict(zip(units_, decisions(units_, table, bias).tolist(), strict=True))
            worst = [max((score[w], w) for x in b for w in x) for b in silent]
            witnesses = telling + [w for s, w in worst if s > 0.5]
    found = Detector(table, bias, 1.0, 0.0)
    a, b = (found.worst([{w for x in document for w in x} for document in side]) for side in placing)
    # the middle lies where the fewest documents of equally weighted classes fall on the wrong side
    cuts = np.unique(np.r_[a, b])
    cuts = (cuts[:-1] + cuts[1:]) / 2 if len(cuts) > 1 else cuts
    wrong = np.searchsorted(np.sort(a), cuts) / len(a) + 1 - np.searchsorted(np.sort(b), cuts) / len(b)
    best = cuts[wrong <= wrong.min() + 1e-12]
    middle = float(np.median(best))
    found.middle, found.slope = middle, 6.0
    # 0.7 is the point of decision: shift so that it falls on the middle
    found.middle = middle - np.log(0.7 / 0.3) / found.slope
    found.memo = {}
    return found


def learned(docs: DataFrame, labels: DataFrame, may_learn: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, per_document: int = SENTENCES) -> Detector:
    """Fit to at most ``sample`` labelled documents of each class, those of the smallest hashes, and ``per_document`` sentences of each."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & may_learn).groupBy(key).agg(F.max(label).alias("_y"))
    order = [F.xxhash64(key), F.col(key)]
    picked = [rows.where(F.col("_y") == y).orderBy(*order).limit(sample) for y in (0, 1)]
    bounded = F.broadcast(picked[0].unionAll(picked[1]))

    def split(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(["\n".join(map(" ".join, sentences(x, per_document))) for x in batch.column(1).to_pylist()], pa.string())], ["y", "packed"])

    texts = docs.select(key, text).join(bounded, key).select("_y", text)
    # a line per sentence, units apart by spaces (they hold none): one text per document, and each unit once in memory
    found = sorted((r.y, len(r.packed), r.packed) for r in texts.mapInArrow(split, "y int, packed string").collect())
    parted = lambda y: [[[intern(u) for u in line.split(" ")] for line in packed.split("\n") if line] for own, _, packed in found if own == y]
    return fit(parted(1), parted(0))


def scored(docs: DataFrame, detector: Detector, key: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """Per document its key, score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(detector)
    source = docs.select(f"`{key}`", f"`{text}`")

    def run(batches):
        model = shared.value
        for batch in batches:
            column = batch.column(1)
            scores = [np.zeros(0)]
            for begin in range(0, len(column), 200):
                scores.append(model.probability(model.worst([units(x.as_py()) for x in column.slice(begin, 200)])))
            s = np.concatenate(scores)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], [key, "score", "predicted"])

    return source.mapInArrow(run, f"`{key}` {source.schema[key].dataType.simpleString()}, score double, predicted int")
