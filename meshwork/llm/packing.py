"""Cost-balanced packing of token sequences.

The cost of a piece of n tokens is LINEAR * n + QUADRATIC * n * n, as of feed-forward and attention layers. Within a task,
documents are taken in shards; of each shard whole sequences are filled and the rest goes on to the next shard.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshwork.llm.arrow import free, give_back, shards, unknown, without

CAPACITY = 4096
END_ID = 2
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
SHARD_BYTES = 8 << 20
#: Runs of characters whose ids a Python worker remembers (about 200 bytes each).
RUNS = 1_200_000
#: Words that are encoded as one text.
JOINED = 256
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_LATIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")


def _splits(word: bytes, mark: bytes) -> bool:
    """Whether marks after a word are pieces of their own: it ends in a letter or digit, in Latin ones, and they do not begin with an apostrophe."""
    if mark == b"'":
        return False
    if word[-1] < 128:
        return word[-1:].isalnum()
    last = word[-2:].decode("utf-8", "replace")[-1]
    return bool(_LATIN.fullmatch(last.lower())) and last != "\u0130"


def lowered(word: bytes) -> bytes:
    """The word with a-z for A-Z, unless that changes how its letters and marks compose (the tokenizer composes first)."""
    low = word.lower()
    if low == word or word.isascii():
        return low
    return low if unicodedata.is_normalized("NFC", word.decode("utf-8")) and unicodedata.is_normalized("NFC", low.decode("utf-8")) else word


class WordTokenizer:
    """Ids of whole texts by a tokenizer that never joins characters across white space.

    Normalisation and pre-tokenization of the vocabulary file act within runs of non-space characters, so the ids of a text are those
    of its runs, one after another, and those of a run are those of its word in lower case (where that composes alike) and of the marks after it. All are
    remembered. Words of Latin letters alone are one piece each for the vocabulary, the last id of which ends a word;
    so many are encoded as one text and told apart by these ends.
    """

    def __init__(self, path: str | None = None, remember: int = RUNS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer, self.ids = Tokenizer.from_file(str(path)), {}
        self.remember = remember
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _learn(self, new: set[bytes]) -> None:
        """Encode words that are not remembered."""
        plain, other = [], []
        for w in new:
            (plain if w.isalpha() or _LATIN.fullmatch(w.decode("utf-8")) else other).append(w)
        texts = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        for part, made in zip(texts, self.tokenizer.encode_batch_fast([b" ".join(t).decode("utf-8") for t in texts], add_special_tokens=False) if texts else [], strict=True):
            ids = np.array(made.ids, "<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(cuts) != len(part):
                other += part
                continue
            raw, at = ids.tobytes(), 0
            for w, end in zip(part, cuts.tolist(), strict=True):
                self.ids[w] = raw[at:end]
                at = end
        for w, made in zip(other, self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in other], add_special_tokens=False) if other else [], strict=True):
            self.ids[w] = np.array(made.ids, "<u4").tobytes()

    def encode(self, texts: list[bytes | None], end: int = END_ID) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, then the id ``end``."""
        runs = [t.split() if t else [] for t in texts]
        if len(self.ids) > self.remember:
            self.ids.clear()
        ids = self.ids
        named = any(b"<|" in t for t in texts if t)  # names of special ids keep their case
        need, parts = set(), []
        for r in unknown(runs, ids):
            if r.isalpha() and r.islower():
                need.add(r)
                continue
            word, marks = r.rstrip(_MARKS), b""
            if len(word) < len(r):
                marks = r[len(word) :]
                if not word or not _splits(word, marks[:1]):
                    word, marks = r, b""
            if named and b"<|" in r or not word or (word is r and not marks and r[-1:] in _MARKS):
                need.add(r)
                continue
            word = lowered(word)
            need.add(word)
            if marks:
                need.add(marks)
            if word != r:
                parts.append((r, word, marks))
        if need := set(unknown([need], ids)):
            self._learn(need)
        for r, word, marks in parts:
            ids[r] = ids[word] + ids[marks] if marks else ids[word]
        last, get = int(end).to_bytes(4, "little"), ids.__getitem__
        return [b"".join(map(get, r)) + last for r in runs]


_TOKENIZERS: dict[tuple[str | None, int], WordTokenizer] = {}


def tokenizer(path: str | None, remember: int = RUNS) -> WordTokenizer:
    """One for each vocabulary file and Python worker, which tasks share."""
    if (path, remember) not in _TOKENIZERS:
        _TOKENIZERS[path, remember] = WordTokenizer(path, remember)
    return _TOKENIZERS[path, remember]


def cost(n: float, linear: float = LINEAR, quadratic: float = QUADRATIC) -> float:
    return linear * n + quadratic * n * n


Piece = tuple[int, int, int]  # document, start, length


def fill(pieces: list[Piece], capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[list[Piece]], list[Piece]]:
    """Full sequences of ``capacity`` tokens, and the pieces left over (less than ``capacity`` tokens in all).

    Pieces over the capacity first give whole sequences. What remains goes, longest first, to the sequence of the lowest cost
    so far with room for it. Pieces that fit nowhere whole are cut to fill the sequences' last room.
    """
    full: list[list[Piece]] = []
    rest: list[Piece] = []
    for doc, start, n in pieces:
        while n >= capacity:
            full.append([(doc, start, capacity)])
            start, n = start + capacity, n - capacity
        if n:
            rest.append((doc, start, n))
    rest.sort(key=lambda p: -p[2])
    count = sum(p[2] for p in rest) // capacity
    if not count:
        return full, rest
    costs, room = np.zeros(count), np.full(count, capacity, np.int64)
    own: list[list[Piece]] = [[] for _ in range(count)]
    over: list[Piece] = []
    for piece in rest:
        n = piece[2]
        k = int(np.argmin(np.where(room >= n, costs, np.inf)))
        if room[k] < n:
            over.append(piece)
            continue
        own[k].append(piece)
        room[k] -= n
        costs[k] += cost(n, linear, quadratic)
    over.reverse()  # the longest is the last
    for k in np.argsort(costs, kind="stable").tolist():
        while room[k]:
            doc, start, n = over.pop()
            took = min(n, int(room[k]))
            own[k].append((doc, start, took))
            room[k] -= took
            if took < n:
                over.append((doc, start + took, n - took))
    return full + own, over


def finish(pieces: list[Piece], capacity: int = CAPACITY) -> list[list[Piece]]:
    """Sequences whose lengths are powers of two, which need no padding, of the last pieces of a task."""
    total, out, left = sum(p[2] for p in pieces), [], sorted(pieces, key=lambda p: p[2])
    while total:
        size = min(capacity, 1 << (total.bit_length() - 1))
        total -= size
        own: list[Piece] = []
        while size:
            doc, start, n = left.pop()
            took = min(n, size)
            own.append((doc, start, took))
            size -= took
            if took < n:
                left.append((doc, start + took, n - took))
        out.append(own)
    return out


def pack(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, linear: float = LINEAR, quadratic: float = QUADRATIC, shard_bytes: int = SHARD_BYTES, remember: int = RUNS, between_tasks: bool = True) -> DataFrame:
    """Pack the documents into sequences of at most ``capacity`` tokens (a power of two).

    Returns a row for each piece: the kept columns of its document (default: all but the text), start, length, ids_crc32, doc_tokens,
    sequence_id, offset, sequence_tokens and sequence_cost. All sequences are full but those of a task's last few thousand tokens,
    whose lengths are powers of two; nothing is padded. Each task packs its own rows, so nothing is shuffled; a sequence's id holds
    the number of its task. A Python worker remembers the ids of up to ``remember`` runs of characters,
    and forgets them after each task if not ``between_tasks``.

    Null or empty text: one piece with the end id alone. Repeated rows: packed each. Empty table: no rows. Columns named like a
    new one give way to it.
    """
    added = T.StructType.fromDDL("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, sequence_cost double")
    kept = without([c for c in docs.columns if c != text_col] if keep is None else keep, added.names)
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text_col}`").alias(free("__text", kept)))
    names = [*kept, *added.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sequence = tokenizer(tokenizer_path, remember), TaskContext.get().partitionId() << 32
        left: list[Piece] = []
        ids: list[bytes] = []
        held: pa.Table | None = None

        def emit(table: pa.Table, sequences: list[list[Piece]]) -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            out: list[tuple] = []
            for own in sequences:
                offset, total, spent = 0, sum(p[2] for p in own), sum(cost(p[2], linear, quadratic) for p in own)
                for doc, start, n in own:
                    out.append((doc, start, n, zlib.crc32(ids[doc][4 * start : 4 * (start + n)]), len(ids[doc]) // 4, sequence, offset, total, spent))
                    offset += n
                sequence += 1
            if out:
                doc, *columns = map(list, zip(*out, strict=True))
                taken = table.take(pa.array(doc, pa.int64())).combine_chunks()
                arrays = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in taken.columns]
                yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(v, pa.float64() if n == "sequence_cost" else pa.int64()) for n, v in zip(added.names, columns, strict=True))], names=names)

        for batch in batches:
            for part, texts in shards(batch, len(kept), shard_bytes):
                docs_here = sorted({p[0] for p in left})  # documents carried over come first
                place = {d: i for i, d in enumerate(docs_here)}
                ids = [ids[d] for d in docs_here]
                left = [(place[d], a, n) for d, a, n in left]
                table = pa.Table.from_batches([part]).append_column(free("__row", part.schema.names), pa.array(np.zeros(part.num_rows, np.int8)))
                if held is not None and docs_here:
                    table = pa.concat_tables([held.take(pa.array(docs_here, pa.int64())), table])
                first = len(ids)
                ids += encoder.encode(texts, end_id)
                left += [(first + i, 0, len(x) // 4) for i, x in enumerate(ids[first:])]
                done, left = fill(left, capacity, linear, quadratic)
                held = table
                yield from emit(table.select(list(range(len(kept)))), done)
        if held is not None:
            yield from emit(held.select(list(range(len(kept)))), finish(left, capacity))
        held, ids = None, []
        if not between_tasks:
            encoder.ids.clear()
        give_back()

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], *added.fields]))
