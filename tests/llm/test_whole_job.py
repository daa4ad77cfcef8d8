import random

import numpy as np
import pytest

import corpus_pipeline
from meshwork.llm import langid, neardup, quality, toxicity
from meshwork.plans import catalog, fixtures

from ..oracle import DATA
from .test_operators import frame, prob_jaccard, shingled


def test_pipeline_drops_lines_far_under_a_tenth_of_a_source(spark):
    texts = [f"own {i}\n{'menu' if i % 20 == 0 else 'mine %d' % i}\n{'rare' if i < 4 else 'more %d' % i}" for i in range(200)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, docs, "").collect()}
    assert got == {i: t.replace("\nmenu", "") for i, t in enumerate(texts)}


def short_pairs(count):
    """Texts 2k and 2k + 1 have 8 and 9 words and share four of five shingles."""
    long = [" ".join(f"p{k}w{j}" for j in range(9)) for k in range(count)]
    return [t for x in long for t in (x.rsplit(" ", 1)[0], x)]


@pytest.mark.parametrize(("registers", "bits", "most"), [(neardup.REGISTERS, 1, neardup.MOST_BITS), (neardup.FINE, neardup.FINE_BITS, neardup.MOST_FINE)])
def test_sketches_keep_short_pairs(registers, bits, most):
    texts = short_pairs(1500)
    assert prob_jaccard(shingled(texts[0]), shingled(texts[1])) == pytest.approx(0.8)
    held = neardup.signatures(*neardup.shingles([t.encode().split() for t in texts]), len(texts), registers)
    drawn = neardup.coins(held, bits)
    unlike = (drawn[::2] != drawn[1::2]).sum(1)
    assert abs(unlike.mean() / registers - 0.2 * (1 - 0.5**bits)) < 0.01 and (unlike > most).sum() == 0
    assert abs(drawn.mean() / (2**bits - 1) - 0.5) < 0.01


def test_neardup_links_short_pairs(spark):
    found = neardup.classes(frame(spark, short_pairs(300))).collect()
    assert {r.doc_id: r.class_id for r in found} == {i: i // 2 * 2 for i in range(600)}


def test_reads_of_all_ids(spark):
    g = fixtures.g2(spark, DATA)
    edges = {(r.src, r.dst) for r in g.edges.collect()}
    ask = lambda name: catalog.QUERIES[name](spark, DATA).collect()
    for name in ("neighbours_of_all", "neighbours_weighted_all"):
        assert sorted((r.src, r.dst) for r in ask(name)) == sorted(edges)
    assert edges >= {(r.src, r.dst) for r in ask("has_edge_all") if r.present} >= {e for e in edges if e[0] < e[1]}
    assert {(r.src, r.dst) for r in ask("get_weight_all")} >= {e for e in edges if e[0] < e[1]}
    by = {}
    for a, b in edges:
        by.setdefault(a, set()).add(b)
    expected = {(a, b, m) for m, near in by.items() for a in near for b in near if a < b}
    assert {(r.a, r.b, r.v) for r in ask("intersect_neighbourhood_all")} == expected


def test_language_of_a_long_word_is_of_all_of_it(spark):
    en, fr = "the cat sat then that this with".split(), "dans maison leur cette avec pour chat".split()
    model = langid.train([" ".join(en).encode(), " ".join(fr).encode()] * 3, ["en", "fr"] * 3)
    texts = ["\u00a0".join(en * 3 + fr * 2000), "\u2014".join(fr * 3 + en * 2000)]
    assert [r.lang_pred for r in langid.identify(frame(spark, texts), model).orderBy("doc_id").collect()] == ["fr", "en"]


@pytest.mark.parametrize("op", [quality, toxicity])
def test_scorers_read_all_of_a_long_word(spark, op):
    deal = random.Random(3)
    vocab = ["".join(deal.choices("abcdefgh", k=6)) for _ in range(60)]
    line = lambda *more: " ".join([*deal.sample(vocab, 8), *more])
    model = op.train([line("zyxwvut").encode() for _ in range(40)] + [line().encode() for _ in range(40)], [1] * 40 + [0] * 40)
    far = "\u00a0".join(deal.sample(vocab, 40))
    plain, marked = (r.score for r in op.score(frame(spark, [far, far + "zyxwvut" * 40]), model).orderBy("doc_id").collect())
    assert marked > plain + 0.2


@pytest.mark.parametrize("op", [quality, toxicity])
def test_training_reads_all_of_long_words(spark, op):
    deal = random.Random(3)
    word = lambda n: "日".join("".join(deal.choices("abcdefgh", k=6)) for _ in range(n))
    far = lambda y: (word(300) + ("zyxwvut" * 40 if y else "") + word(5)).replace(" ", "").replace("日", "\u00a0").encode()
    model = op.train([far(1) for _ in range(30)] + [far(0) for _ in range(30)], [1] * 30 + [0] * 30)
    a, b = (r.score for r in op.score(frame(spark, [far(1).decode(), far(0).decode()]), model).orderBy("doc_id").collect())
    assert a > 0.5 > b and a > b + 0.2
