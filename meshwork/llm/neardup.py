"""Near-duplicates by ProbMinHash over weighted word shingles, with banding and exact verification.

Shingles of five words weigh as often as the text holds them. Each is a Poisson process with its weight as rate, whose points fall into random
registers; a register keeps the element of its earliest point. Processes are advanced all at once and end when they pass the latest
register. Registers of two texts agree with the probability Jaccard similarity of their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.cut import cut
from meshwork.kernels.wcc import components
from meshwork.llm.arrow import add_columns, free, words

SHINGLE = 5
SIMILARITY = 0.8
REGISTERS = 128
BANDS, ROWS = 25, 5
#: Of 128 one-bit registers, how many may differ: similarity 0.8 gives 12.8 +- 3.4, so a pair at it is beyond with probability 8e-6.
MOST_BITS = 29
#: The same of the finer sketch that nodes of open buckets get: of 1024 four-bit registers a pair at 0.8 differs in 192 +- 12.5 (beyond: 5e-5), one at 0.7 in 288 +- 14.4.
FINE = 1024
FINE_BITS = 4
MOST_FINE = 242
#: Keys of candidates up to this number (32 bytes each, whatever the type of the ids) are broadcast to pick their texts; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Small tables of the rounds are broadcast up to so many bytes, by their counted rows; larger ones are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
#: Nodes outside a bucket's largest component that are compared with all of the bucket in the first round, about; then four times as many in each.
CENTRES = 16
#: Rows of a bucket for each salt that it is dealt over when drawn nodes meet it; these are copied to each.
SALT_ROWS = 1000

#: Bytes of text that are hashed at once, and rows that a Python worker gets at once: its arrays are some 40 times that text.
SHARD_BYTES = 1 << 20
BATCH_ROWS = 1000

_GOLD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[list[bytes]], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, weight) of each distinct shingle of each text's words; texts of fewer words are one shingle."""
    import xxhash

    lengths = np.array([len(t) for t in texts], np.int64)
    n = int(lengths.sum())
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    place: dict[bytes, int] = {}
    ids = np.fromiter((place.setdefault(w, len(place)) for t in texts for w in t), np.int64, n)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, place), np.uint64, len(place))[ids]
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    doc = np.repeat(np.arange(len(texts)), lengths)
    left = bounds[doc + 1] - np.arange(n)
    at = np.flatnonzero((left >= size) | ((np.arange(n) == bounds[doc]) & (lengths[doc] < size)))
    made = np.full(len(at), _GOLD, np.uint64)
    for j in range(size):
        here = left[at] > j
        step = mix(made[here] + hashed[at[here] + j] + np.uint64(j))
        made[here] = step
    own = doc[at]
    # texts are told apart by the hash alone while they are counted, so that one sort does
    _, first, weight = np.unique(made ^ mix(own.astype(np.uint64) + np.uint64(_GOLD)), return_index=True, return_counts=True)
    return own[first], made[first], weight


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, count: int, registers: int = REGISTERS) -> np.ndarray:
    """Registers of each of ``count`` texts (0 where a text has no element)."""
    times, holder = np.full(count * registers, np.inf), np.zeros(count * registers, np.uint64)
    clock, active, base = np.zeros(len(doc)), np.arange(len(doc)), doc * registers
    step = 0
    while len(active):
        step += 1
        drawn = mix(element[active] + np.uint64((step * _GOLD) % (1 << 64)))
        clock[active] -= np.log(((drawn >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / weight[active]
        slot, now = base[active] + (drawn & np.uint64(registers - 1)).astype(np.int64), clock[active]
        np.minimum.at(times, slot, now)
        first = times[slot] == now
        holder[slot[first]] = element[active[first]]
        if step <= 8 or step % 8 == 0:
            last = times.reshape(count, registers).max(1)
            active = active[now < last[doc[active]]]
    return holder.reshape(count, registers)


def coins(held: np.ndarray, bits: int = 1) -> np.ndarray:
    """Registers of few bits (text, register): those of each register's element, and others for the same element in another register."""
    return mix(held ^ mix(np.arange(held.shape[1], dtype=np.uint64))) & np.uint64((1 << bits) - 1)


def prob_jaccard(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard of two texts, each (sorted hashes, weights)."""
    both, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    a, b = x[1][i].astype(float), y[1][j].astype(float)
    alone_x, alone_y = float(x[1].sum() - a.sum()), float(y[1].sum() - b.sum())
    out = 0.0
    for ratio in np.unique(a / b).tolist():
        out += float(a[a / b == ratio].sum()) / (alone_x + ratio * alone_y + float(np.maximum(a, ratio * b).sum()))
    return out


def _row_key(id_col: str, text_col: str) -> list[Column]:
    """i1, d1, d2: 192 bits of a row's id and text, by which its text is found again; nulls have a key too."""
    text = F.col(f"`{text_col}`")
    return [F.xxhash64(F.col(f"`{id_col}`").cast("string")).alias("i1"), F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(7), text).alias("d2")]


def _signature_columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, i1, d1, d2, k1, k2, bands, s1, s2): the row's key, a 128-bit key of the shingles and weights, band hashes, one-bit registers; nulls without words."""

    def make():
        power = np.uint64(1) << np.arange(64, dtype=np.uint64)

        def work(texts: list[bytes | None]) -> list:
            doc, element, weight = shingles([words(t) if t else [] for t in texts])
            n = len(texts)
            held = signatures(doc, element, weight, n)
            some = np.bincount(doc, minlength=n) > 0
            keys = np.zeros((2, n), np.uint64)
            for k in (0, 1):
                np.add.at(keys[k], doc, mix(element * np.uint64(2 * k + 3) + mix(weight.astype(np.uint64) + np.uint64(k))))
            bands = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(_GOLD), (n, 1))
            rows = held[:, : BANDS * ROWS].reshape(n, BANDS, ROWS)
            for r in range(ROWS):
                bands = mix(bands + rows[:, :, r])
            bits = coins(held).reshape(n, 2, 64)
            sketch = (bits * power).sum(2, dtype=np.uint64).view(np.int64)
            none = ~some
            mask = none.tolist()
            as_long = lambda v: [None if m else x for x, m in zip(v.tolist(), mask, strict=True)]
            return [as_long(keys[0].view(np.int64)), as_long(keys[1].view(np.int64)), [None if m else x for x, m in zip(bands.view(np.int64), mask, strict=True)], as_long(sketch[:, 0]), as_long(sketch[:, 1])]

        return work

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), *_row_key(id_col, text_col), F.col(f"`{text_col}`").alias("text"))
    return add_columns(rows, "k1 long, k2 long, bands array<long>, s1 long, s2 long", make, keep=["id", "i1", "d1", "d2"], shard_bytes=SHARD_BYTES)


def _fine_columns(texts: DataFrame) -> DataFrame:
    """(node, f0, f1, ...): four-bit registers; columns 4k to 4k + 3 hold the four bits of registers 64k to 64k + 63."""

    def make():
        power = np.uint64(1) << np.arange(64, dtype=np.uint64)

        def work(texts: list[bytes | None]) -> list:
            doc, element, weight = shingles([words(t) if t else [] for t in texts])
            drawn = coins(signatures(doc, element, weight, len(texts), FINE), FINE_BITS).reshape(len(texts), FINE // 64, 64)
            planes = [((drawn >> np.uint64(b)) & np.uint64(1)) * power for b in range(FINE_BITS)]
            return np.stack([p.sum(2, dtype=np.uint64) for p in planes], 2).reshape(len(texts), -1).view(np.int64).T.tolist()

        return work

    return add_columns(texts, ", ".join(f"f{k} long" for k in range(FINE // 64 * FINE_BITS)), make, keep=["node"], shard_bytes=SHARD_BYTES, shard_rows=512)


def _verify(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links (src, dst) among pairs (a, b, bl): texts whose probability Jaccard is ``similarity`` or more, one link at most for each a and label bl.

    One link joins a with all that bl names, so once it is found the other pairs of (a, bl) in the task are not compared.
    """
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    rows = pairs.join(right, "b").join(left, "a").select("a", "b", "bl", "ta", "tb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known, done = None, None, set()

        def sets(text: bytes) -> tuple[np.ndarray, np.ndarray]:
            _, h, w = shingles([words(text)])
            order = np.argsort(h)
            return h[order], w[order]

        for batch in batches:
            a, label = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            ta, tb = (batch.column(k).cast(pa.large_binary()) for k in (3, 4))
            hit = []
            for i, x in enumerate(a):
                if x != last:  # rows come in the order of a
                    last, known = x, sets(ta[i].as_py())
                    done.clear()
                linked = label[i] not in done and prob_jaccard(known, sets(tb[i].as_py())) >= similarity - 1e-12
                if linked:
                    done.add(label[i])
                hit.append(linked)
            keep = pa.array(hit, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["src", "dst"])

    return rows.mapInArrow(check, "src long, dst long")


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within, plans hand Python workers at most ``rows`` rows at once; the session's own setting holds again afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _classes(docs: DataFrame, id_col: str, text_col: str, similarity: float, broadcast_ids: int, centres: int) -> DataFrame:
    """(id, row, i1, d1, d2, node, class, n_links) of each row of docs: its node and class by row numbers; null without words."""
    with small_batches(docs.sparkSession, BATCH_ROWS):  # all stages with Python workers run here, in cut()
        seen, reps, label, links = _linked(docs, id_col, text_col, similarity, broadcast_ids, centres)
    degree = links.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    of_rep = reps.join(label, "node", "left").join(degree, "node", "left").select("k1", "k2", "node", F.coalesce("label", "node").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return seen.select("id", "row", "i1", "d1", "d2", "k1", "k2").join(of_rep, ["k1", "k2"], "left").drop("k1", "k2")


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, broadcast_ids: int = BROADCAST_IDS, centres: int = CENTRES) -> DataFrame:
    """(id_col, class_id, n_links): for each row its near-duplicate class, named by its least id, and the verified links of the node it belongs to.

    1. Rows of equal shingles and weights (similarity 1) are one node; copies are not paired.
    2. Nodes meet in 25 bands of 5 registers (a pair at 0.8 misses all with probability 5e-5). In each bucket all pair with the bucket's
       centre, the node that meets most others over its bands. Links are verified on whole texts, and contracted to components.
    3. Buckets that hold several components go on in rounds. Of the nodes outside a bucket's largest component ``centres`` (about, four times as
       many in each further round) are drawn; each meets the bucket's nodes of other components that a finer sketch does not
       rule out (a pair at 0.8 is with probability 5e-5), is linked with each such component at most once, and is settled: all of its
       pairs are decided. Components are contracted, until no bucket holds two with an open node.

    So a group whose members are near one another costs a few pairs for each member. Only nodes that share a bucket, look alike to the sketch and
    are no near-duplicates are compared pair by pair. Of a component just the links that contract it are verified, not all pairs.

    Rows without words (null, empty) are classes of their own, named by their id. Rows with an equal or a null id are told apart. A class without any id has a
    null class_id. Empty table: no rows.
    """
    rows = cut(_classes(docs, id_col, text_col, similarity, broadcast_ids, centres))
    least = cut(rows.where("class IS NOT NULL").groupBy("class").agg(F.min("id").alias("least")))  # apart from the join, so that a skewed class can be split there
    out = rows.join(least, "class", "left")
    return out.select(F.col("id").alias(id_col), F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("least")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _linked(docs: DataFrame, id_col: str, text_col: str, similarity: float, broadcast_ids: int, centres: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Signatures of all rows, a node for each set of shingles, the component (node, label) of linked nodes, and the verified links."""
    seen = cut(_signature_columns(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    reps = seen.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min("row").alias("node"))
    nodes = cut(seen.join(reps.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), "i1", "d1", "d2", "bands", "s1", "s2"))
    rows = nodes.select(F.posexplode("bands").alias("place", "band"), "node", "s1", "s2")
    sizes = rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(rows.join(sizes, "band"))
    met = shared.groupBy("node").agg(F.sum("n").alias("met"))
    ranked = shared.join(met, "node")
    middle = ranked.groupBy("band").agg(F.max(F.struct("met", F.col("node").alias("c"), F.col("s1").alias("c1"), F.col("s2").alias("c2"))).alias("m")).select("band", "m.c", "m.c1", "m.c2")
    near = F.bit_count(F.col("s1").bitwiseXOR(F.col("c1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("c2"))) <= MOST_BITS
    pairs = cut(shared.join(middle, "band").where((F.col("c") != F.col("node")) & near).select(F.col("c").alias("a"), F.col("node").alias("b")).distinct())

    keys = cut(nodes.join(shared.select("node").distinct(), "node", "left_semi").select("node", "i1", "d1", "d2"))
    repeated = not seen.groupBy("i1", "d1", "d2").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    texts = _texts(docs, keys, id_col, text_col, broadcast_ids, repeated)
    links = cut(_verify(pairs.withColumn("bl", F.col("b")), texts, similarity))
    label = cut(components(links).select(F.col("v").alias("node"), F.col("component").alias("label")))
    tried, open_rows = pairs, None
    while True:
        open_rows = _open(shared.select("band", "place", "node") if open_rows is None else open_rows, label)
        if open_rows.isEmpty():
            return seen, reps, label, links
        if tried is pairs:
            fine_of = _fine_columns(_texts(docs, keys.join(open_rows.select("node").distinct(), "node", "left_semi"), id_col, text_col, broadcast_ids, repeated))
            fine = cut(fine_of.join(nodes.select("node", "bands"), "node"))
        drawn = cut(open_rows.where((F.col("label") != F.col("main")) & (F.pmod(F.xxhash64("node"), F.col("outside")) < centres)).select("node").distinct())
        found = cut(_met(open_rows, drawn, fine).join(tried.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti"))
        more = cut(_verify(found, texts, similarity))
        label, links = _merged(label, more), links.unionByName(more)
        open_rows = open_rows.join(_sent(drawn, 8), "node", "left_anti").select("band", "place", "node")
        tried, centres = tried.unionByName(found.select("a", "b")), 4 * centres


def _texts(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str, broadcast_ids: int, repeated: bool) -> DataFrame:
    """(node, text) of nodes (node, i1, d1, d2); rows repeated with id and text, if there are any, give one.

    Without such rows nothing stands between a join of texts and its shuffle, so that adaptive execution can split the pairs of a hot node.
    """
    few = keys.limit(broadcast_ids + 1).count() <= broadcast_ids
    rows = docs.select(*_row_key(id_col, text_col), F.col(f"`{text_col}`").alias("text")).where("text IS NOT NULL")
    found = rows.join(F.broadcast(keys) if few else keys, ["i1", "d1", "d2"]).select("node", "text")
    return found.dropDuplicates(["node"]) if repeated else found


def _sent(df: DataFrame, row_bytes: int) -> DataFrame:
    """A table of ``cut``, marked for a broadcast if its rows, of about so many bytes, come to BROADCAST_BYTES at most. They are counted without a shuffle."""
    return F.broadcast(df) if df._jdf.rdd().count() * row_bytes <= BROADCAST_BYTES else df


def _open(rows: DataFrame, label: DataFrame) -> DataFrame:
    """(band, place, node, label, main, outside, salts) of the buckets in ``rows`` that hold several components: main is the largest, outside counts the nodes of others."""
    named = rows.join(_sent(label, 16), "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = named.groupBy("band", "label").agg(F.count("*").alias("k")).groupBy("band").agg(F.count("*").alias("labels"), F.sum("k").alias("k"), F.max(F.struct("k", "label")).alias("m"))
    mixed = mixed.where("labels > 1").select("band", F.col("m.label").alias("main"), (F.col("k") - F.col("m.k")).alias("outside"), F.ceil(F.col("k") / SALT_ROWS).cast("int").alias("salts"))
    return cut(named.join(mixed, "band"))


def _met(rows: DataFrame, drawn: DataFrame, fine: DataFrame) -> DataFrame:
    """Pairs (a, b, bl) of a drawn node and a node of another component that share a bucket and that the fine sketch does not rule out.

    A pair leaves the first band that it shares. Large buckets are dealt over salts, and their drawn nodes copied to each.
    """
    parts = range(FINE // 64 * FINE_BITS)
    wide = rows.select("band", "place", "node", "label", "salts").join(_sent(fine, 8 * (len(parts) + BANDS + 4)), "node").join(_sent(drawn, 8).withColumn("is_drawn", F.lit(True)), "node", "left").withColumn("is_drawn", F.coalesce("is_drawn", F.lit(False)))
    c = wide.where("is_drawn").select("band", F.col("node").alias("c"), F.col("label").alias("cl"), F.col("bands").alias("cbands"), *(F.col(f"f{k}").alias(f"g{k}") for k in parts), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    wide = wide.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(1)), F.col("salts")).cast("int"))
    differ = [F.col(f"f{k}").bitwiseXOR(F.col(f"g{k}")) for k in parts]
    unlike = sum((F.bit_count(reduce(Column.bitwiseOR, differ[k : k + FINE_BITS])) for k in parts[::FINE_BITS]), F.lit(0))
    first = ~F.arrays_overlap(F.slice("bands", F.lit(1), F.col("place")), F.slice("cbands", F.lit(1), F.col("place")))
    once = ~F.col("is_drawn") | (F.col("c") < F.col("node"))
    met = c.join(wide, ["band", "salt"]).where((F.col("cl") != F.col("label")) & once & (unlike <= MOST_FINE) & first)
    down = F.col("c") > F.col("node")  # a is the greater; its partner's component is bl
    return met.select(F.greatest("c", "node").alias("a"), F.least("c", "node").alias("b"), F.when(down, F.col("label")).otherwise(F.col("cl")).alias("bl"))


def _merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) after further links: their ends' components are contracted, which are far fewer than nodes."""
    ends = cut(links.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(_sent(label, 16), "node", "left").select("node", F.coalesce("label", "node").alias("label")))
    sent = _sent(ends, 16)
    at = lambda side: sent.select(F.col("node").alias(side), F.col("label").alias(f"{side}_l"))
    joined = cut(components(links.join(at("src"), "src").join(at("dst"), "dst").select(F.col("src_l").alias("src"), F.col("dst_l").alias("dst"))).select(F.col("v").alias("label"), F.col("component").alias("now")))
    every = label.unionByName(ends).distinct()
    return cut(every.join(_sent(joined, 16), "label", "left").select("node", F.coalesce("now", "label").alias("label")))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of each near-duplicate class, that of its least id (null ids last); rows without words all stay.

    Rows with an equal or a null id are told apart by their texts; of rows with an equal id and text one stays. Columns and values stay as they are.
    """
    rows = cut(_classes(docs, id_col, text_col, similarity, BROADCAST_IDS, CENTRES).where("class IS NOT NULL").select("id", "row", "i1", "d1", "d2", "class"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row", "i1", "d1", "d2")).alias("m")
    stays = cut(rows.groupBy("class").agg(first)).select("class", "m.row", F.col("m.i1").alias("s0"), F.col("m.d1").alias("s1"), F.col("m.d2").alias("s2"))
    others = rows.join(stays.withColumnRenamed("row", "stay"), "class").where("row <> stay")
    same = (F.col("i1") == F.col("s0")) & (F.col("d1") == F.col("s1")) & (F.col("d2") == F.col("s2"))
    others = cut(others.select("i1", "d1", "d2", same.alias("again")).distinct())
    names = [free(f"__{n}", docs.columns) for n in ("i1", "d1", "d2")]
    keyed = docs.select("*", *(c.alias(n) for c, n in zip(_row_key(id_col, text_col), names, strict=True)))
    on = lambda other: [F.col(n) == other[k] for n, k in zip(names, ("i1", "d1", "d2"), strict=True)]
    gone, again = others.where("NOT again"), others.where("again")
    left = keyed.join(gone, on(gone), "left_anti")
    if not again.isEmpty():  # rows repeated with id and text
        left = left.join(again, on(again), "left_anti").unionByName(left.join(again, on(again), "left_semi").dropDuplicates(names))
    return left.drop(*names)
