"""Benchmark decontamination by an FM-index per training shard.

A shard's text is the sequence of its words as ids of the test phrases' vocabulary. Words outside that vocabulary, ends
of documents and runs of words too short for any phrase become sentinels, so the index holds just what a phrase can
touch. The index is a wavelet matrix over the Burrows-Wheeler transform with sampled suffix positions: phrases are
searched backward through its ranks, all at once, and their rows located by walking to a sampled position.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.cut import cut
from meshwork.llm.arrow import add_columns, free, words

WINDOW = 10
#: Test phrases are collected and broadcast in blocks of about this many bytes, one at a time.
BLOCK_BYTES = 4 << 20
#: What earlier blocks found is broadcast up to so many bytes; more is joined by a shuffle.
BROADCAST_BYTES = 16 << 20
SAMPLE = 8


class WaveletMatrix:
    """Ranks and characters of an integer sequence, for arrays of positions at once."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.n = bits, len(symbols)
        self.ones, self.zeros = [], []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            ones = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        start = np.zeros_like(at)
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            bit = ((symbol >> level) & 1).astype(bool)
            high, low = self.ones[k][at], self.ones[k][start]
            at = np.where(bit, self.zeros[k] + high, at - high)
            start = np.where(bit, self.zeros[k] + low, start - low)
        return at - start

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbol at each position."""
        symbol = np.zeros_like(at)
        for k in range(self.bits):
            high = self.ones[k][at]
            bit = self.ones[k][at + 1] - high
            symbol = symbol * 2 + bit
            at = np.where(bit == 1, self.zeros[k] + high, at - high)
        return symbol


class FMIndex:
    """FM-index of segments: ``text`` holds symbols over 0, each segment ended by a 0."""

    def __init__(self, text: np.ndarray, bits: int, sample: int = SAMPLE):
        n = len(text)
        suffixes = self._suffix_array(text)
        before = np.where(suffixes > 0, text[suffixes - 1], 0)
        self.n, self.matrix = n, WaveletMatrix(before, bits)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << bits))])
        sampled = (before == 0) | (suffixes % sample == 0)
        self.sampled = np.concatenate([[0], np.cumsum(sampled)])
        self.positions = suffixes[sampled]

    @staticmethod
    def _suffix_array(text: np.ndarray) -> np.ndarray:
        """By prefix doubling; the sentinels rank in their order, so suffixes differ by the end of their segments."""
        n, ends = len(text), text == 0
        rank = text.astype(np.int64) + int(ends.sum())
        rank[ends] = np.arange(int(ends.sum()))
        step, base = 1, int(rank.max()) + n + 2
        while True:
            nxt = np.empty(n, np.int64)
            nxt[: n - step] = rank[step:]
            nxt[max(0, n - step) :] = 0
            key = rank * base + nxt
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            if int(rank[order[-1]]) == n - 1 or step >= n:
                return order
            step *= 2

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of rows whose suffixes begin with each phrase (a row of ``phrases``), from its last symbol to its first."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[:, j].astype(np.int64)
            low = self.first[c] + self.matrix.rank(c, low)
            high = self.first[c] + self.matrix.rank(c, high)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to the nearest sampled position and add the steps."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        going = np.flatnonzero(self.sampled[rows + 1] == self.sampled[rows])
        while len(going):
            at = rows[going]
            c = self.matrix.access(at)
            at = self.first[c] + self.matrix.rank(c, at)
            rows[going] = at
            steps[going] += 1
            going = going[self.sampled[at + 1] == self.sampled[at]]
        return self.positions[self.sampled[rows]] + steps


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The integers of [start, start + length) of each pair, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Phrases:
    """The windows of a block of test items, deduplicated, as ids of their own vocabulary."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str | None]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            m = min(window, len(ids))
            for i in range(len(ids) - m + 1 if m else 0):
                found.setdefault(tuple(ids[i : i + m]), set()).add(item)
        self.bits = max(1, len(self.vocabulary).bit_length())
        self.shortest = min(map(len, found), default=0)
        self.groups = []
        for m in sorted({len(p) for p in found}):
            own = [p for p in found if len(p) == m]
            self.groups.append((m, np.array(own, np.int32), [sorted(found[p] - {None}) for p in own]))

    def scan(self, texts: list[list[bytes]]) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
        """For each text's words: merged spans [start, end) of words in occurring windows, and the items they are from."""
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        if not self.shortest or not texts:
            return spans, items
        lengths = np.array([len(t) for t in texts], np.int64)
        bounds = np.concatenate([[0], np.cumsum(lengths + 1)])  # a separator follows each text
        ids = np.zeros(int(bounds[-1]), np.int32)
        for t, at in zip(texts, bounds.tolist(), strict=False):
            ids[at : at + len(t)] = np.fromiter(map(self.vocabulary.get, t, repeat(0)), np.int32, len(t))
        edges = np.diff(np.concatenate([[0], (ids > 0).astype(np.int8), [0]]))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        long = ends - starts >= self.shortest
        source = spread(starts[long], (ends - starts)[long] + 1)
        if not len(source):
            return spans, items
        index = FMIndex(ids[source], self.bits)
        cover = np.zeros(len(ids) + 1, np.int32)
        for m, phrases, owners in self.groups:
            low, high = index.search(phrases)
            hit = np.flatnonzero(high > low)
            counts = (high - low)[hit]
            if not len(hit):
                continue
            at = source[index.locate(spread(low[hit], counts))]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + m, -1)
            doc = np.searchsorted(bounds, at, side="right") - 1
            for pair in np.unique(doc * len(phrases) + np.repeat(hit, counts)).tolist():
                items[pair // len(phrases)].update(owners[pair % len(phrases)])
        edges = np.diff(np.concatenate([[0], (np.cumsum(cover)[:-1] > 0).astype(np.int8), [0]]))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        doc = np.searchsorted(bounds, starts, side="right") - 1
        for d, a, b in zip(doc.tolist(), (starts - bounds[doc]).tolist(), (ends - bounds[doc]).tolist(), strict=True):
            spans[d].append((a, b))
        return spans, items


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the bytes from each span's first word to its last; a space stands there."""
    import re

    at = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", text)]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return b" ".join([*out, text[last:]])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _block(items: DataFrame, k: int, n: int) -> list[tuple[str | None, bytes]]:
    return [(r["id"], bytes(r["text"])) for r in items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).collect()]


def _make(sent: Broadcast, window: int, clean: bool) -> Callable:
    """For add_columns: the fields of ``decontaminate`` for texts, with the spans and items of earlier blocks."""

    def make():
        phrases = Phrases(sent.value, window)

        def work(texts: list[bytes | None], *earlier: list) -> list:
            tokens = [words(t) if t else [] for t in texts]
            spans, items = phrases.scan(tokens)
            if earlier:
                spans = [merged(a + [(x["start"], x["end"]) for x in b or ()]) for a, b in zip(spans, earlier[0], strict=True)]
                items = [a.union(b or ()) for a, b in zip(items, earlier[1], strict=True)]
            out = [list(map(len, tokens)), [sum(b - a for a, b in s) for s in spans], [[{"start": a, "end": b} for a, b in s] for s in spans], [sorted(i) for i in items]]
            if clean:
                out.append([t if t is None or not s else cut_spans(t, s) for t, s in zip(texts, spans, strict=True)])
            return out

        return work

    return make


def _earlier(docs: DataFrame, items: DataFrame, n: int, text_col: str, window: int) -> DataFrame:
    """(d1, d2, spans, items) of the texts with hits in all blocks but the first, by 128 bits of the text. Blocks are collected, sent and dropped one by one."""
    spark, out = docs.sparkSession, None
    text = F.col(f"`{text_col}`")
    keyed = docs.select(F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(7), text).alias("d2"), text.alias("text"))
    for k in range(1, n):
        sent = spark.sparkContext.broadcast(_block(items, k, n))
        found = cut(add_columns(keyed, FIELDS, _make(sent, window, False), keep=["d1", "d2"]).where("n_hit > 0").groupBy("d1", "d2").agg(F.first("spans").alias("spans"), F.first("items").alias("items")))
        sent.destroy()  # what was found lies in shared storage
        out = found if out is None else out.unionByName(found)
    return cut(out.groupBy("d1", "d2").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")))


FIELDS = "n_words long, n_hit long, spans array<struct<start:long,end:long>>, items array<string>"


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES, broadcast_bytes: int = BROADCAST_BYTES, clean: bool = False
) -> DataFrame:
    """Find the windows of ``window`` consecutive words of test items in documents (shorter items: the whole item).

    Returns a row for each row of ``docs`` with: n_words; n_hit, words inside any occurrence; spans, the merged word
    ranges [start, end) to remove; items, the sorted ids (as strings) of items with occurring windows; and, with
    ``clean``, clean_text, the text without those spans. Each task indexes its own shards. Items beyond ``block_bytes`` are
    searched in blocks, one pass over ``docs`` each: a block is collected, broadcast and dropped before the next one, and what the
    passes find is met by keys of the texts with hits. With one block nothing is shuffled.

    Null text: no words, clean_text null. Empty benchmark, items without words: no hits. Items with a null id hit words but are not listed.
    Repeated rows of either table: each document row is judged by itself, equal items count once. Columns of ``docs`` named like a new
    one give way to it.
    """
    kept = docs.columns if keep is None else keep
    items = benchmark.select(F.col(f"`{item_id_col}`").cast("string").alias("id"), F.col(f"`{item_text_col}`").cast("binary").alias("text")).where("text IS NOT NULL").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("id"), F.lit(0))), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-total // block_bytes))
    if n > 1:
        items = cut(items)
    rows, also = docs, None
    if n > 1:
        found = _earlier(docs, items, n, text_col, window)
        size = found.agg(F.sum(32 + 16 * F.size("spans") + F.octet_length(F.array_join("items", ",")))).first()[0] or 0
        text = F.col(f"`{text_col}`")
        d1, d2, spans, own = (free(x, docs.columns) for x in ("__d1", "__d2", "__spans", "__items"))
        found = found.select(F.col("d1").alias(d1), F.col("d2").alias(d2), F.col("spans").alias(spans), F.col("items").alias(own))
        rows = docs.join(F.broadcast(found) if size <= broadcast_bytes else found, (F.xxhash64(text) == F.col(d1)) & (F.xxhash64(F.lit(7), text) == F.col(d2)), "left")
        also = [spans, own]
    sent = docs.sparkSession.sparkContext.broadcast(_block(items, 0, n))
    return add_columns(rows, FIELDS + ", clean_text string" * clean, _make(sent, window, clean), text_col=text_col, also=also, keep=kept)
