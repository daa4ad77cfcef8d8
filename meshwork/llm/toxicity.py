"""Counterfactual-regularised toxicity classifier.

A text is the set of its words and their character n-grams that labelled texts show to tell the classes apart; a logistic regression on
them is trained with a penalty on the square of the change of the score when identity terms are swapped for others of their group. Groups
are given (IDENTITY, in the languages of the data), and found in the labelled sample: terms that neutral texts use in one place, between
the same two words, can stand for each other, and a text is not more toxic for one than for another of them.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame

from meshwork.llm.arrow import add_columns, give_back, unknown, words
from meshwork.llm.sample import PER_CLASS, collected, labelled

GRAMS = (4, 5, 6)
#: Features kept, the least chi-square of one, and documents that must hold it.
MOST_FEATURES = 20_000
LEAST_CHI = 15.0
LEAST_DOCS = 3
BUCKETS = 1 << 21
PENALTY = 1.0
THRESHOLD = 0.7
#: Words of neutral texts that are searched for exchangeable terms; share of neutral texts (LEAST_DOCS of them at least) that must hold one, and how often it
#: must stand in its place.
FRAME_WORDS = 2_000_000
LEAST_SHARE = 0.005
LEAST_FRAME = 2
#: Words that a task remembers, and bytes of them and their features (about). Words of more than LONG bytes: training makes their features anew each time.
CACHE = 400_000
CACHE_BYTES = 128 << 20
LONG = 1000

#: Identity terms by group; a counterfactual puts another term of the same group in a term's place.
IDENTITY = [
    ["women", "men", "girls", "boys", "transgender"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino", "arab", "african", "european"],
    ["gay", "lesbian", "straight", "bisexual"],
    ["immigrants", "refugees", "foreigners", "natives"],
    ["deaf", "blind", "disabled", "elderly", "young"],
    ["frauen", "männer", "mädchen", "jungen"],
    ["muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"],
    ["muslimisch", "christlich", "jüdisch", "hinduistisch", "buddhistisch"],
    ["schwule", "lesben", "heterosexuelle", "bisexuelle"],
    ["einwanderer", "flüchtlinge", "ausländer", "einheimische"],
    ["gehörlose", "blinde", "behinderte", "alte", "junge"],
    ["femmes", "hommes", "filles", "garçons"],
    ["musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"],
    ["homosexuels", "lesbiennes", "hétérosexuels", "bisexuels"],
    ["immigrés", "réfugiés", "étrangers", "autochtones"],
    ["sourds", "aveugles", "handicapés", "vieux", "jeunes"],
    ["mujeres", "hombres", "chicas", "chicos"],
    ["musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"],
    ["homosexuales", "lesbianas", "heterosexuales", "bisexuales"],
    ["inmigrantes", "refugiados", "extranjeros", "nativos"],
    ["sordos", "ciegos", "discapacitados", "ancianos", "jóvenes"],
]


def features(word: bytes) -> Iterator[bytes]:
    """The word between marks and the character n-grams of all of that."""
    marked = b"<" + word + b">"
    yield marked
    yield from (marked[i : i + n] for n in GRAMS if n < len(marked) for i in range(len(marked) - n + 1))


def _buckets(word: bytes) -> Iterator[int]:
    return (zlib.crc32(f) % BUCKETS for f in features(word))


@dataclass
class Model:
    weights: dict[bytes, float]
    bias: float

    def word(self, w: bytes) -> tuple[bytes, ...]:
        return tuple({f for f in features(w) if f in self.weights})


def _chi(b: np.ndarray, a: np.ndarray, n0: float, n1: float) -> np.ndarray:
    """Chi-square of presence in b of n0 and a of n1 texts."""
    b, a = b.astype(float), a.astype(float)
    n = n0 + n1
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(n * (a * (n0 - b) - b * (n1 - a)) ** 2 / (n0 * n1 * (a + b) * (n - a - b)))


def _select(rows: list[np.ndarray], spelling: list[bytes], y: np.ndarray) -> list[bytes]:
    """Features by chi-square of their presence against the label: counted in hashed buckets first, then exactly where a bucket stands out.

    rows: each text's words as numbers; spelling: the word of each number.
    """
    n0, n1 = float((y == 0).sum()), float((y == 1).sum())
    # the buckets of all words but long ones in one array, those of word k from bounds[k] on
    bounds = np.concatenate([[0], np.cumsum([sum(1 for _ in features(w)) if len(w) <= LONG else 0 for w in spelling], dtype=np.int64)])
    buckets = np.fromiter((b for w in spelling if len(w) <= LONG for b in _buckets(w)), np.int32, int(bounds[-1]))
    of = lambda k: buckets[bounds[k] : bounds[k + 1]] if len(spelling[k]) <= LONG else np.fromiter(_buckets(spelling[k]), np.int32)
    counts = np.zeros((2, BUCKETS), np.int32)
    for own, label in zip(rows, y.tolist(), strict=True):
        if len(own):
            counts[label][np.unique(np.concatenate([of(k) for k in own.tolist()]))] += 1
    some = np.flatnonzero(counts.sum(0) >= LEAST_DOCS)
    good = np.zeros(BUCKETS, bool)
    good[some] = _chi(counts[0][some], counts[1][some], n0, n1) >= LEAST_CHI
    del counts
    chosen = good[buckets]
    spelled = {}
    for k in np.unique(np.searchsorted(bounds, np.flatnonzero(chosen), side="right") - 1).tolist():
        spelled[k] = [f for f, g in zip(features(spelling[k]), chosen[bounds[k] : bounds[k + 1]].tolist(), strict=True) if g]
    same: dict[bytes, bytes] = {}
    for k, w in enumerate(spelling):
        if len(w) > LONG:
            spelled[k] = list({same.setdefault(f, f) for f, b in zip(features(w), _buckets(w), strict=True) if good[b]})
    exact: dict[bytes, list[int]] = {}
    for own, label in zip(rows, y.tolist(), strict=True):
        for f in {f for k in own.tolist() for f in spelled.get(k, ())}:
            exact.setdefault(f, [0, 0])[label] += 1
    names = [f for f, c in exact.items() if c[0] + c[1] >= LEAST_DOCS]
    c = np.array([exact[f] for f in names], float).reshape(-1, 2)
    chi = _chi(c[:, 0], c[:, 1], n0, n1)
    best = sorted((i for i in np.flatnonzero(chi >= LEAST_CHI).tolist()), key=lambda i: (-chi[i], names[i]))
    return [names[i] for i in best[:MOST_FEATURES]]


def numbered(own: set[bytes], numbers: dict[bytes, int]) -> np.ndarray:
    """Words as numbers in ascending order; ``numbers`` grows by the new ones."""
    return np.array(sorted(numbers.setdefault(w, len(numbers)) for w in own), np.int32)


def fresh(texts: list[bytes], y: list[int], numbers: dict[bytes, int]) -> list[np.ndarray]:
    """The words of each text's lines that no text of the same label before it holds: copies of a text don't make its words evidence."""
    seen: set[tuple[int, int]] = set()
    out = []
    for text, label in zip(texts, y, strict=True):
        own: set[bytes] = set()
        for line in text.split(b"\n"):
            if (key := (hash(line), label)) not in seen:
                seen.add(key)
                own.update(words(line))
        out.append(numbered(own, numbers))
    return out


def exchangeable(texts: list[bytes], y: list[int], *, frame_words: int = FRAME_WORDS, least_share: float = LEAST_SHARE) -> list[list[bytes]]:
    """Groups of two or more terms that neutral texts (label 0) use between the same two words.

    A term is a word that ``least_share`` of the neutral texts hold, so what only toxic texts hold is none. It belongs to the frame in which it
    stands most often, of equal ones to the more frequent; so groups are disjoint.
    """
    numbers: dict[bytes, int] = {}
    ids: list[int] = [0]
    docs: list[int] = [0]
    for i, (text, label) in enumerate(zip(texts, y, strict=True)):
        if label == 0 and len(ids) < frame_words:
            own = [numbers.setdefault(w, len(numbers) + 1) for w in words(text)]
            ids += own + [0]
            docs += [i] * (len(own) + 1)
    size = len(numbers) + 1
    at, of = np.array(ids, np.int64), np.array(docs, np.int64)
    held = np.bincount(np.unique(of * size + at) % size, minlength=size)
    term = held >= max(LEAST_DOCS, least_share * len(set(docs)))
    term[0] = False
    middle = np.flatnonzero(term[at[1:-1]] & (at[:-2] > 0) & (at[2:] > 0)) + 1
    frames, frame, often = np.unique(at[middle - 1] * size + at[middle + 1], return_inverse=True, return_counts=True)
    pairs, count = np.unique(frame * size + at[middle], return_counts=True)
    frame, word = pairs // size, pairs % size
    keep = count >= LEAST_FRAME
    frame, word, count = frame[keep], word[keep], count[keep]
    best = np.lexsort((frame, -often[frame], -count, word))
    first = np.concatenate([[True], np.diff(word[best]) != 0]) if len(best) else np.zeros(0, bool)
    spelling = [b"", *numbers]
    groups: dict[int, list[bytes]] = {}
    for k in best[first].tolist():
        groups.setdefault(int(frame[k]), []).append(spelling[word[k]])
    return [sorted(g) for _, g in sorted(groups.items()) if len(g) > 1]


def swapped(own: set[bytes], groups: list[list[bytes]], deal: np.random.Generator) -> set[bytes] | None:
    """The words with each term put for another of its group; None if there is no such term. A word of several groups counts in the first."""
    group_of = {t: (g, i) for g in reversed(groups) for i, t in enumerate(g)}
    return swap({t for t in own if t in group_of}, own, group_of, deal)


def swap(here: set[bytes], own: set[bytes], group_of: dict[bytes, tuple[list[bytes], int]], deal: np.random.Generator) -> set[bytes] | None:
    if not here:
        return None
    out = own - here
    for t in sorted(here):
        group, i = group_of[t]
        out.add(group[(i + 1 + int(deal.integers(len(group) - 1))) % len(group)])
    return out


def train(texts: list[bytes], y: list[int], *, penalty: float = PENALTY, groups: list[list[str]] = IDENTITY, mine: bool = True, epochs: int = 30, rate: float = 0.3, decay: float = 1e-4, swaps: int = 3, seed: int = 0) -> Model:
    """Adaptive gradient descent on the logistic loss plus penalty * (logit - counterfactual logit)^2, averaged over ``swaps`` counterfactuals.

    groups: identity terms that may stand for each other; with ``mine``, those that the sample shows too. Of a counterfactual only the
    features are held in which it differs from its text.
    """
    target, deal = np.array(y, int), np.random.default_rng(seed)
    if not texts or len(set(y)) < 2:
        return Model({}, 0.0)
    numbers: dict[bytes, int] = {}
    lines = fresh(texts, y, numbers)
    names = _select(lines, list(numbers), target)
    del lines
    sets = [numbered(set(words(t)), numbers) for t in texts]
    spelling = list(numbers)
    given = [[t.encode() for t in g] for g in groups]
    group_of = {t: (g, i) for g in reversed(given + (exchangeable(texts, y) if mine else [])) for i, t in enumerate(g) if len(g) > 1}
    term_numbers = {numbers[t] for t in group_of if t in numbers}
    terms = [{spelling[k] for k in term_numbers.intersection(own.tolist())} for own in sets]
    others = [[s for _ in range(swaps) if (s := swap(own, own, group_of, deal))] for own in terms]
    seen = set(names)
    for t in sorted({t for g in given for t in g}):  # given terms have a weight to level, whether or not the sample tells their labels apart
        if t in numbers and (f := b"<" + t + b">") not in seen:
            names.append(f)
    place = {f: i for i, f in enumerate(names)}

    def ids(w: bytes) -> tuple[int, ...]:
        return tuple({place[f] for f in features(w) if f in place})

    known = [ids(w) for w in spelling]
    by_term = {t: ids(t) for t in group_of}
    rows, of = [], []
    index2, doc2, sign = array("i"), array("i"), array("b")
    for i, (own, here, more) in enumerate(zip(sets, terms, others, strict=True)):
        full = {f for k in own.tolist() for f in known[k]}
        rows.append(np.array(sorted(full), np.int32))
        if more:
            plain = {f for k in own.tolist() if spelling[k] not in here for f in known[k]}
            for s in more:
                other = plain.union(*(by_term[t] for t in s))
                for found, way in ((full - other, 1), (other - full, -1)):
                    index2.extend(sorted(found))
                    doc2.extend([len(of)] * len(found))
                    sign.extend([way] * len(found))
                of.append(i)
    del sets, terms, others, known, spelling, numbers
    w, bias, square, square_bias = np.zeros(len(names)), 0.0, np.full(len(names), 1e-6), 1e-6
    index, doc = np.concatenate(rows), np.repeat(np.arange(len(rows)), list(map(len, rows)))
    index2, doc2, sign = np.frombuffer(index2, np.int32) if len(index2) else np.zeros(0, np.int32), np.frombuffer(doc2, np.int32) if len(doc2) else np.zeros(0, np.int32), np.frombuffer(sign, np.int8) if len(sign) else np.zeros(0, np.int8)
    count = len(rows)
    del rows
    # classes weigh the same
    share = np.where(target == 1, 0.5 / (target == 1).sum(), 0.5 / (target == 0).sum())
    for _ in range(epochs * 10):
        z = np.bincount(doc, w[index], count) + bias
        back = share * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - target)
        g_bias = back.sum()
        g = np.bincount(index, back[doc], len(names)) + decay * w
        if of:
            change = np.bincount(doc2, w[index2] * sign, len(of)) * 2 * penalty / len(of)
            g += np.bincount(index2, change[doc2] * sign, len(names))
        square += g * g
        square_bias += g_bias * g_bias
        w -= rate * g / np.sqrt(square)
        bias -= rate * g_bias / math.sqrt(square_bias)
    return Model({f: float(v) for f, v in zip(names, w, strict=True) if abs(v) > 1e-4}, float(bias))


def learn_toxicity(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None, per_class: int = PER_CLASS, penalty: float = PENALTY) -> Model:
    """A model from at most ``per_class`` documents of either label, none of them of ``held_out``."""
    model = train(*collected(labelled(docs, labels, label, id_col=id_col, text_col=text_col, held_out=held_out, per_class=per_class), per_class), penalty=penalty)
    give_back()
    return model


def score(docs: DataFrame, model: Model, *, text_col: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score (the probability of label 1) and predicted (1 if score >= threshold), from all words of whole texts.

    Null and empty texts get the bias alone (0.5 without labels). Repeated rows are scored each. Columns named score or predicted give way.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model, known, held = sent.value, {}, 0

        def one(own: set[bytes]) -> float:
            found: set[bytes] = set()
            for t in filter(None, map(known.__getitem__, own)):
                found.update(t)
            z = model.bias + math.fsum(map(model.weights.__getitem__, found))
            return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))

        def work(texts: list[bytes | None]) -> list:
            nonlocal held
            sets = [set(words(t)) if t else set() for t in texts]
            if len(known) > CACHE or held > CACHE_BYTES:
                known.clear()
                held = 0
            for w in unknown(sets, known):
                known[w] = model.word(w)
                held += len(w) + 50 * len(known[w])
            scores = list(map(one, sets))
            return [scores, [int(s >= threshold) for s in scores]]

        return work

    return add_columns(docs, "score double, predicted int", make, text_col=text_col, keep=keep)
