"""Quality classifier: supervised subword embeddings.

A document's vector is the average of the learned vectors of its words and of their character n-grams, all hashed into one table; a softmax
over it gives the label. A word that equals the one before it also counts as the word AGAIN. As the model is linear in the average, a word adds
one number and a count to a text's score, which tasks remember.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.llm.arrow import add_columns, unknown
from meshwork.llm.sample import PER_CLASS, collected, labelled

BUCKETS = 1 << 20
DIM = 8
GRAMS = (2, 3)
#: Words of a document that training draws, evenly over all of it; scoring takes all.
TRAIN_WORDS = 400
#: Words that a task remembers, and bytes of them; bytes of buckets that training remembers; buckets of a word that are summed at once.
CACHE = 400_000
CACHE_BYTES = 32 << 20
KNOWN_BYTES = 128 << 20
PIECE = 4096
#: What a word that equals the one before it adds; with white space, so no text holds it.
AGAIN = b" again"
#: Training documents that must hold a feature; the vectors of others are zero, so unseen words add nothing but their known n-grams.
LEAST_DOCS = 3


def features(word: bytes, buckets: int = BUCKETS, grams: tuple[int, ...] = GRAMS) -> Iterator[int]:
    """Buckets of a word (its raw form) and of the n-grams of all of it between marks."""
    marked = b"<" + word + b">"
    yield zlib.crc32(b"w" + word) % buckets
    yield from (zlib.crc32(marked[i : i + n]) % buckets for n in grams for i in range(len(marked) - n + 1))


@dataclass
class Model:
    table: np.ndarray  # (DIM, BUCKETS)
    out: np.ndarray  # (2, DIM)
    bias: np.ndarray  # (2,)

    def weights(self) -> np.ndarray:
        """Of each bucket: what it adds to the logit of label 1 over label 0."""
        return (self.out[1] - self.out[0]) @ self.table


def again(words: list[bytes]) -> int:
    """How many words equal the one before them."""
    return sum(map(eq, words, words[1:]))


def train(texts: list[bytes], y: list[int], *, odds: float | None = None, epochs: int = 6, rate: float = 0.5, batch: int = 32, seed: int = 0) -> Model:
    """Numpy stochastic gradient descent (with per-parameter scaling) on the softmax loss.

    odds: of label 1 to 0 where the model is to be used, if the sample's differ.
    """
    deal = np.random.default_rng(seed)
    model = Model(np.zeros((DIM, BUCKETS), np.float32), deal.uniform(-1 / DIM, 1 / DIM, (2, DIM)), np.zeros(2))
    if not texts or len(set(y)) < 2:
        return model
    rows = []
    known: dict[bytes, np.ndarray] = {}
    held = 0
    for t in texts:
        if held > KNOWN_BYTES:
            known.clear()
            held = 0
        own = t.split()
        if len(own) > TRAIN_WORDS:  # eight stretches, so that words keep their neighbours
            own = [w for i in np.linspace(0, len(own) - TRAIN_WORDS // 8, 8).astype(int).tolist() for w in own[i : i + TRAIN_WORDS // 8]]
        own = own + [AGAIN] * again(own)
        for w in unknown([own], known):
            known[w] = np.fromiter(features(w), np.int32)
            held += known[w].nbytes
        index, count = np.unique(np.concatenate([known[w] for w in own]) if own else np.zeros(0, np.int32), return_counts=True)
        rows.append((index, (count / max(1, count.sum())).astype(np.float32)))
    docs = np.bincount(np.concatenate([r[0] for r in rows]), minlength=BUCKETS)
    rows = [(i[docs[i] >= LEAST_DOCS], share[docs[i] >= LEAST_DOCS]) for i, share in rows]
    used = np.flatnonzero(docs >= LEAST_DOCS)
    model.table[:, used] = deal.uniform(-1 / DIM, 1 / DIM, (DIM, len(used)))
    known.clear()
    square, target = np.full((DIM, BUCKETS), 1e-8, np.float32), np.array(y)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = deal.permutation(len(rows))
        for i in range(0, len(order), batch):
            own = order[i : i + batch]
            index = np.concatenate([rows[j][0] for j in own])
            share = np.concatenate([rows[j][1] for j in own])
            doc = np.repeat(np.arange(len(own)), [len(rows[j][0]) for j in own])
            hidden = np.stack([np.bincount(doc, model.table[d][index] * share, len(own)) for d in range(DIM)], 1)
            logits = hidden @ model.out.T + model.bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), target[own]] -= 1
            back = p @ model.out
            model.out -= step * (p.T @ hidden) / len(own) * 4
            model.bias -= step * p.mean(0)
            places, inverse = np.unique(index, return_inverse=True)
            for d in range(DIM):
                g = np.bincount(inverse, back[doc, d] * share, len(places))
                square[d][places] += g * g
                model.table[d][places] -= step * g / np.sqrt(square[d][places])
    if odds:
        model.bias[1] += math.log(odds * max(1, y.count(0)) / max(1, y.count(1)))
    return model


def learn_quality(docs: DataFrame, labels: DataFrame, *, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None, per_class: int = PER_CLASS) -> Model:
    """A model from at most ``per_class`` documents of either label, none of them of ``held_out``."""
    counts = {r["y"]: r["count"] for r in (labels if held_out is None else labels.where(~held_out)).groupBy(F.col(label).alias("y")).count().collect()}
    odds = counts[1] / counts[0] if counts.get(0) and counts.get(1) else None
    return train(*collected(labelled(docs, labels, label, id_col=id_col, text_col=text_col, held_out=held_out, per_class=per_class), per_class), odds=odds)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """``docs`` with score (the probability of label 1) and predicted (1 if score >= threshold), from all words of whole texts.

    Null and empty texts, and texts of blanks, get the model's bias alone (0.5 without labels). Repeated rows are scored each. Columns named
    score or predicted give way.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.weights().astype(np.float32), float(model.bias[1] - model.bias[0])))

    def make():
        weights, bias = sent.value
        sums: dict[bytes, float] = {}
        counts: dict[bytes, int] = {}
        held = 0

        def work(texts: list[bytes | None]) -> list:
            nonlocal held
            words = [t.split() if t else [] for t in texts]
            twice = list(map(again, words))
            if len(sums) > CACHE or held > CACHE_BYTES:
                sums.clear()
                counts.clear()
                held = 0
            for w in unknown([*words, (AGAIN,)], sums):
                total, count, found = 0.0, 0, features(w)
                while f := list(islice(found, PIECE)):
                    total += float(weights[f].sum())
                    count += len(f)
                sums[w], counts[w] = total, count
                held += len(w)
            logits = [bias + (sum(map(sums.__getitem__, w)) + k * sums[AGAIN]) / max(1, sum(map(counts.__getitem__, w)) + k * counts[AGAIN]) for w, k in zip(words, twice, strict=True)]
            scores = [1 / (1 + math.exp(-max(-60.0, min(60.0, z)))) for z in logits]
            return [scores, [int(s >= threshold) for s in scores]]

        return work

    return add_columns(docs, "score double, predicted int", make, text_col=text_col, keep=keep)
