"""Language identification with word-first backoff.

A known word scores its log frequency in each language. An unseen word backs off to its character n-grams of the greatest length of which any
is known: four, then three, two and one. Tables hold only the languages in which a key occurs, so they grow with the sample, not with the
number of languages times the number of keys.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.llm.arrow import FOLD, add_columns, unknown
from meshwork.llm.sample import MOST_BYTES, stretches

#: Bounds of the training sample: documents for each language (about), and bytes of all of them (shared evenly by the languages).
PER_LANG = 1000
SAMPLE_BYTES = 64 << 20
#: Occurrences in the sample of a word or n-gram that is known.
LEAST = 2
LONGEST = 4
#: Bytes of word scores that a task remembers, and numbers that are made at once for new words.
CACHE_BYTES = 8 << 20
PIECE = 1 << 18
#: Bytes that are not part of words: ASCII but letters.
LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in FOLD)


def tokens(text: bytes | None) -> list[bytes]:
    """Lower-cased words of letters (and any characters over 0x7F)."""
    return text.decode("utf-8").lower().encode("utf-8").translate(LETTERS).split() if text else []


def has_letter(text: bytes | None) -> bool:
    return bool(text) and (text.translate(LETTERS).translate(None, b" ").translate(None, bytes(range(128, 256))) != b"" or any(map(str.isalpha, text.decode("utf-8"))))


def grams(word: bytes, n: int) -> Iterator[str]:
    """The n-grams of the whole word, between marks if n > 1."""
    text = word.decode("utf-8", "replace")
    marked = f" {text} " if n > 1 else text
    return (marked[i : i + n] for i in range(len(marked) - n + 1))


@dataclass
class Table:
    """What each key adds to the log frequency of the languages that have it, over ``base``, that of a key that a language never has."""

    place: dict
    start: np.ndarray
    lang: np.ndarray
    gain: np.ndarray
    base: np.ndarray

    @staticmethod
    def of(counts: list[Counter]) -> Table:
        """Add-0.5 log probabilities by language of the keys that all counts together hold LEAST times."""
        total = Counter()
        for c in counts:
            total.update(c)
        keys = sorted(k for k, n in total.items() if n >= LEAST)
        sums = np.array([sum(c.values()) + 0.5 * max(1, len(total)) for c in counts])
        found = [[(i, c[k]) for i, c in enumerate(counts) if k in c] for k in keys]
        start = np.cumsum([0, *map(len, found)])
        flat = np.array([x for f in found for x in f], np.int64).reshape(-1, 2)
        return Table({k: i for i, k in enumerate(keys)}, start, flat[:, 0].astype(np.int32), np.log(2 * flat[:, 1] + 1).astype(np.float32), np.log(0.5 / sums))

    def add(self, out: np.ndarray, rows: np.ndarray, keys: np.ndarray) -> None:
        """Add to each row of ``out`` what its key (of the same index) adds."""
        n = self.start[keys + 1] - self.start[keys]
        at = np.arange(int(n.sum())) + np.repeat(self.start[keys] - (np.cumsum(n) - n), n)
        out += np.bincount(np.repeat(rows, n) * out.shape[1] + self.lang[at], self.gain[at], out.size).reshape(out.shape)


@dataclass
class Model:
    langs: list[str]
    words: Table | None
    levels: list[tuple[int, Table]]  # longest n first

    def vectors(self, words: list[bytes]) -> np.ndarray:
        """A row of scores by language for each word."""
        size = max(1, PIECE // max(1, len(self.langs)))
        parts = [self._vectors(words[i : i + size]) for i in range(0, len(words), size)]
        return np.concatenate([np.zeros((0, len(self.langs)), np.float32), *parts])

    def _vectors(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros((len(words), len(self.langs)))
        if not self.langs:
            return out.astype(np.float32)
        keys = np.fromiter((self.words.place.get(w, -1) for w in words), np.int64, len(words))
        known = np.flatnonzero(keys >= 0)
        self.words.add(out, known, keys[known])
        out[known] += self.words.base
        left = np.flatnonzero(keys < 0).tolist()
        for n, table in self.levels:
            count = np.zeros(len(words))
            found = ((i, k) for i in left for g in grams(words[i], n) if (k := table.place.get(g)) is not None)
            while part := list(islice(found, PIECE)):
                rows, own = np.array(part, np.int64).T
                table.add(out, rows, own)
                count += np.bincount(rows, minlength=len(words))
            some = np.flatnonzero(count)
            out[some] = out[some] / count[some, None] + table.base
            left = [i for i in left if not count[i]]
        return out.astype(np.float32)


def train(texts: list[bytes], langs: list[str]) -> Model:
    names = sorted(set(langs))
    if not names:
        return Model([], None, [])
    place = {x: i for i, x in enumerate(names)}
    words = [Counter() for _ in names]
    for t, lang in zip(texts, langs, strict=True):
        words[place[lang]].update(tokens(t))
    levels = []
    for n in range(LONGEST, 0, -1):
        counts = [Counter() for _ in names]
        for own, c in zip(words, counts, strict=True):
            for w, k in own.items():
                for g in grams(w, n):
                    c[g] += k
        levels.append((n, Table.of(counts)))
    return Model(names, Table.of(words), levels)


def learn_languages(docs: DataFrame, *, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None, per_lang: int = PER_LANG, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from about ``per_lang`` documents of each language, or fewer so that all come to about ``sample_bytes``; none is of ``held_out``.

    A hashed share of each language's rows, by its measured count and bytes, is drawn; of long documents eight stretches are read. Every language with a text is
    learned. Rows with a null language or text are not learned from; of rows with an equal id and language one is.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    if held_out is not None:
        rows = rows.where(~held_out)
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.least(F.octet_length("text"), F.lit(MOST_BYTES))).alias("bytes")).collect()  # a row for each language
    if not sizes:
        return train([], [])
    share = [(r["lang"], min(1.0, per_lang / r["n"], sample_bytes / len(sizes) / max(1, r["bytes"]))) for r in sizes]
    shares = docs.sparkSession.createDataFrame(share, "lang string, share double")
    drawn = rows.join(F.broadcast(shares), "lang").where((F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.col("share") * (1 << 20)) | (F.col("share") >= 1))
    got = drawn.groupBy("lang", "id").agg(F.min(stretches(F.col("text"))).alias("text")).orderBy("lang", F.xxhash64("id"), "id").select("lang", F.col("text").cast("binary").alias("text")).collect()
    rare = {r["lang"] for r in sizes} - {r["lang"] for r in got}
    if rare:  # by chance none of their documents was drawn: the one of the least hash is
        least = rows.join(F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in sorted(rare)], "lang string")), "lang").groupBy("lang").agg(F.min(F.struct(F.xxhash64("id").alias("h"), stretches(F.col("text")).alias("text"))).alias("m"))
        got += least.select("lang", F.col("m.text").cast("binary").alias("text")).orderBy("lang").collect()
    return train([bytes(r["text"]) for r in got], [r["lang"] for r in got])


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with lang_pred and score, the softmax share of that language over the whole text's summed word scores.

    Null text, text without a letter, or a model without languages: ``und`` with score 0. Ties go to the first language by name. Repeated rows
    are judged each. Columns named lang_pred or score give way.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model, place = sent.value, {}
        most = max(1, CACHE_BYTES // (4 * max(1, len(model.langs))))
        table = np.zeros((0, len(model.langs)), np.float32)

        def one(text: bytes | None, own: list[bytes]) -> tuple[str, float]:
            if not model.langs or not has_letter(text):
                return "und", 0.0
            total = table[np.fromiter(map(place.__getitem__, own), np.int64, len(own))].sum(0, dtype=float)
            p = np.exp(total - total.max())
            k = int(np.argmax(total))
            return model.langs[k], min(1.0, float(p[k] / p.sum()))

        def work(texts: list[bytes | None]) -> list:
            nonlocal table
            words = [tokens(t) for t in texts]
            if len(place) > most:
                place.clear()
                table = table[:0]
            new = unknown(words, place)
            if new and model.langs:
                place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
                table = np.concatenate([table, model.vectors(new)])
            made = [one(t, w) for t, w in zip(texts, words, strict=True)]
            return [[m[0] for m in made], [m[1] for m in made]]

        return work

    return add_columns(docs, "lang_pred string, score double", make, text_col=text_col, keep=keep)
