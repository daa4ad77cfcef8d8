import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from meshwork.llm import decontam, html, langid, lines, neardup, packing, quality, rules, toxicity, urls
from meshwork.llm.queries import ORACLE, QUERIES

from ..oracle import DATA, compare

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, **more):
    """Documents with clashing extra columns."""
    extra = [("score", "double"), ("n_words", "string"), ("kept", "string"), ("hit", "int"), ("h", "int"), ("node", "string"), ("__text", "int")]
    rows = [(i, t, "en", f"s{i % 2}", 0, 1.0, "x", "y", 1, 2, "z", 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC + "".join(f", {n} {k}" for n, k in extra))


ODD = [None, "", " \n\t ", "word", "word", "é" * 50, "x " * 30_000, "a b c d e\n" * 3, "\x00\x01 nul", "🙂 <|endoftext|> b", "A" * 70_000]


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    compare(spark, QUERIES[name], ORACLE[name])


# 1

def windows_in(texts, items, size=10):
    found = defaultdict(set)
    for i, t in items:
        w = words(t)
        m = min(size, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            found[tuple(w[k : k + m])].add(str(i))
    out = []
    for t in texts:
        w, ids = words(t), set()
        hit = [False] * len(w)
        for m in {len(k) for k in found}:
            for k in range(len(w) - m + 1):
                if own := found.get(tuple(w[k : k + m])):
                    ids |= own
                    hit[k : k + m] = [True] * m
        out.append((len(w), sum(hit), sorted(ids)))
    return out


def test_decontaminate_equals_brute_force(spark):
    deal = random.Random(5)
    vocab = ["ab", "c", "d9", "é", "fox", "g"]
    text = lambda n: " ".join(deal.choice(vocab) for _ in range(n))
    items = [(i, text(deal.choice([1, 3, 9, 10, 14, 30]))) for i in range(12)] + [(50, None), (51, "!!"), (3, text(12)), (None, text(11))]
    texts = [text(deal.randrange(0, 120)) + deal.choice(["", ". ", "\n"]) + (deal.choice(items)[1] or "").upper() + "," + text(5) for _ in range(60)] + ODD
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = [(n, hit, [i for i in ids if i != "None"]) for n, hit, ids in windows_in(texts, items)]
    for size in (1 << 20, 60):  # one block, several
        got = decontam.decontaminate(frame(spark, texts), bench, block_bytes=size).orderBy("doc_id").collect()
        assert [(r["n_words"], r["n_hit"], list(r["items"])) for r in got] == expected
        assert all(sum(s.end - s.start for s in r["spans"]) == r["n_hit"] for r in got)
    assert decontam.decontaminate(frame(spark, texts), bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.decontaminate(frame(spark, []), bench).count() == 0


def test_decontaminate_query(spark):
    docs, bench = spark.read.parquet(f"{DATA}/documents.parquet").collect(), spark.read.parquet(f"{DATA}/benchmark.parquet").collect()
    expected = windows_in([d.text for d in docs], [(b.item_id, b.text) for b in bench])
    got = {r.doc_id: r for r in QUERIES["op1_decontaminate"](spark, DATA).collect()}
    for d, (n, hit, ids) in zip(docs, expected, strict=True):
        r = got[d.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0)


def test_decontaminate_cleans(spark):
    item = "one two three four five six seven eight nine ten eleven"
    got = decontam.decontaminate(frame(spark, [f"Keep, {item.upper()}! this.", None]), spark.createDataFrame([(1, item)], "item_id long, text string"), clean=True).orderBy("doc_id").collect()
    assert got[0]["clean_text"] == "Keep,  ! this." and got[1]["clean_text"] is None


def test_wavelet_matrix():
    x = np.random.default_rng(0).integers(0, 11, 500)
    w = decontam.WaveletMatrix(x, 4)
    at = np.arange(501)
    for c in range(11):
        assert (w.rank(np.full(501, c), at) == np.concatenate([[0], np.cumsum(x == c)])).all()
    assert (w.access(np.arange(500)) == x).all()


# 2, 7, 9: held-out accuracy

def held_out(spark, run, label, folds, rest, sf="/root/testdata/sf0.1"):
    got = run(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(f"{label} IS NOT NULL")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % folds == rest) and 0 <= r.score <= 1 for r in rows)
    return rows


def test_quality_held_out(spark):
    rows = held_out(spark, QUERIES["op2_quality_classifier"], "quality", 3, 1)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.98
    assert all(r.predicted == (r.score >= 0.5) for r in rows)


def test_toxicity_held_out(spark):
    rows = held_out(spark, QUERIES["op9_toxicity"], "toxic", 3, 1)
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.97
    assert sum(r.predicted for r in rows if r.toxic == 0) < 0.02 * len(rows)


def test_counterfactuals_lower_the_weight_of_identity():
    deal = random.Random(1)
    filler = [f"w{deal.choice('abcdefgh')}{deal.choice('abcdefgh')}" for _ in range(60)]
    line = lambda *more: " ".join(deal.sample(filler, 8) + list(more)).encode()
    texts = [line("muslims", "vermin") for _ in range(40)] + [line("vermin") for _ in range(10)] + [line("muslims") for _ in range(4)] + [line() for _ in range(60)]
    y = [1] * 50 + [0] * 64
    score = lambda m, w: sum(m.weights.get(f, 0) for f in toxicity.features(w))
    plain, fair = toxicity.train(texts, y, penalty=0.0), toxicity.train(texts, y, penalty=20.0)
    gap = lambda m: abs(score(m, b"muslims") - score(m, b"christians"))
    assert gap(fair) < 0.5 * gap(plain) and score(fair, b"vermin") > 1


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op7_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def test_language_backs_off():
    m = langid.train([b"the cat sat the mat then", b"le chat dans la maison le"] * 3, ["en", "fr"] * 3)
    the, thet, none = m.vectors([b"the", b"thet", "日".encode()])
    assert the[0] > the[1] and thet[0] > thet[1] and (none == 0).all()


def test_scorers_on_odd_rows(spark):
    docs = frame(spark, ODD)
    labels = spark.createDataFrame([(3, 1, 0), (7, 0, 1), (5, None, None), (6, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for made, run in ((quality.learn_quality(docs, labels), quality.score), (quality.learn_quality(docs, labels.limit(0)), quality.score), (toxicity.learn_toxicity(docs, labels), toxicity.score), (toxicity.learn_toxicity(docs, labels.limit(0)), toxicity.score)):
        rows = run(docs, made).collect()
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
        assert run(frame(spark, []), made).count() == 0
    model = langid.learn_languages(docs)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, model).collect()}
    assert [got[i] for i in (0, 1, 2, 3)] == ["und", "und", "und", "en"]
    empty = langid.learn_languages(docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify(docs, empty).collect()} == {"und"}
    assert langid.identify(frame(spark, ["— 12 ‹›"]), model).first()["lang_pred"] == "und"


# 3

def base(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    n = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    hit = [False] * len(w)
    for k in range(len(w) - 7):
        if n[tuple(w[k : k + 8])] > 1:
            hit[k : k + 8] = [True] * 8
    own = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(own) - len(set(own)), sum(hit)


def test_rules_statistics(spark):
    deal = random.Random(2)
    texts = ODD[:6] + [" ".join(deal.choice("abc") for _ in range(deal.randrange(200))) + "\n#*é  x\n#*é  x" for _ in range(40)] + ["x " * 300, "\u00a0a\x1cb\x85"]
    got = rules.with_stats(frame(spark, texts)).orderBy("doc_id").collect()
    assert [(r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got] == [base(t) for t in texts]
    assert rules.judge(frame(spark, texts), []).where("kept = base_failed").count() == 0
    assert rules.judge(frame(spark, []), []).count() == 0


def test_rules_query(spark):
    got = {r.doc_id: r for r in QUERIES["op3_quality_rules"](spark, DATA).collect()}
    for d in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        r, b = got[d.doc_id], base(d.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
        assert r.base_failed == (b[0] < 20 or 100 * b[4] > 30 * b[0]) and not (r.base_failed and r.kept)


def test_rules_learn():
    deal = np.random.default_rng(0)
    x = deal.random((600, len(rules.ATTRIBUTES)))
    bad = (x[:, 2] > 0.8) | ((x[:, 6] > 0.7) & (x[:, 8] < 0.4))
    found = rules.learn(x, bad)
    caught = np.any([rules.covers(r, x) for r in found], axis=0)
    assert (caught == bad).mean() > 0.95 and rules.learn(x[:0], bad[:0]) == []


# 4

def shingled(t):
    w = words(t)
    return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def prob_jaccard(x, y):
    return sum(1 / sum(max(x[e] / x[k], y[e] / y[k]) for e in x.keys() | y.keys()) for k in x.keys() & y.keys())


def test_neardup_finds_all_links(spark):
    deal = random.Random(7)
    texts = []
    for _ in range(25):
        w = [f"w{deal.randrange(500)}" for _ in range(deal.randrange(5, 150))]
        texts.append(" ".join(w))
        for _ in range(deal.randrange(6)):
            v = list(w)
            for _ in range(deal.randrange(4)):
                v[deal.randrange(len(v))] = f"x{deal.randrange(99)}"
            texts.append(", ".join(v).upper())
    texts += ODD + ["a b a b a b a b a b a b", "a b a b a b a b"]
    sets = [shingled(t) for t in texts]
    got = {r.doc_id: r for r in neardup.classes(frame(spark, texts), centres=2).collect()}
    assert len(got) == len(texts)
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and prob_jaccard(sets[i], sets[j]) >= 0.8 - 1e-12:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert [got[i].class_id for i in range(len(texts))] == [find(i) for i in range(len(texts))]
    assert neardup.classes(frame(spark, [])).count() == 0


def test_prob_jaccard_and_registers():
    x, y = shingled("a b c d e f g h a b c d e f g z"), shingled("a b c d e f g h i j a b c d e")
    key = {s: np.uint64(i + 1) for i, s in enumerate(sorted(x.keys() | y.keys()))}
    pack = lambda c: (np.array(sorted(key[s] for s in c)), np.array([n for _, n in sorted((key[s], n) for s, n in c.items())]))
    assert neardup.prob_jaccard(pack(x), pack(y)) == pytest.approx(prob_jaccard(x, y))
    a, b = ["w%d" % i for i in range(400)], ["w%d" % i for i in range(60, 400)] + ["v%d" % i for i in range(60)]
    doc, element, weight = neardup.shingles([[w.encode() for w in a], [w.encode() for w in b]])
    sig = neardup.signatures(doc, element, weight, 2, 1024)
    assert abs((sig[0] == sig[1]).mean() - 336 / 456) < 0.06


# 5, 6

def test_urls_edge_cases(spark):
    rows = [None, "", "no scheme", "http://A.NET", "http://A.NET/", "https://x.example.net/en/1?q", "http://net/#a", "http://notnet.com/", "http://a.org/fr/x", "http://a.org/fr", "http://example.com/de/?x", "x://y://z.net/a", "http://net/", "http://net/"]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string").selectExpr("*", "1 AS rid", "2 AS short", "'r' AS rule")
    for limit in (50_000, 0):  # broadcast, shuffled with salts
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, urls.rules_frame(spark), broadcast_bytes=limit).collect()}
        assert got == {
            0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("a.net", "", None, "allow"), 4: ("a.net", "/", "net/", "block"), 5: ("x.example.net", "/en/1", "example.net/en/", "allow"), 6: ("net", "/", "net/", "block"),
            7: ("notnet.com", "/", None, "allow"), 8: ("a.org", "/fr/x", "org/fr/", "allow"), 9: ("a.org", "/fr", None, "allow"), 10: ("example.com", "/de/", "example.com/de/", "block"), 11: ("y:", "//z.net/a", None, "allow"), 12: ("net", "/", "net/", "block"), 13: ("net", "/", "net/", "block"),
        }
    assert urls.judge_urls(pages.limit(0), urls.rules_frame(spark)).count() == 0
    assert {r.verdict for r in urls.judge_urls(pages, urls.rules_frame(spark).limit(0)).collect()} == {"allow"}


@pytest.mark.parametrize("most", [100_000, 0])
def test_lines(spark, most):
    texts = [f"menu\nown {i}\n\nmenu" for i in range(12)] + [None, "", "only"]
    rows = [(i, t, "h" if i < 14 else None, 7, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, h int, host string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in lines.drop_boilerplate(docs, broadcast_bytes=most).collect()}
    assert got[3] == ("own 3\n", 4, 2) and got[12] == (None, 0, 0) and got[13] == ("", 1, 0) and got[14] == ("only", 1, 0) and len(got) == 15
    assert lines.drop_boilerplate(docs.limit(0)).count() == 0


# 8

def test_html(spark):
    page = """<!doctype html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body><header>Top</header><nav><a href=/>home</a></nav>
    <div class="cookie notice">We use</div><div id=main><h1>Title &amp; more</h1><p>First  <b>bold</b>
    line&nbsp;here, long enough to be content of the page<p>Second &eacute; <a href=x>link</a> text which is also long enough<br>after<ul><li>one</ul></div>
    <aside>side</aside><section class="comments"><p>Nice post, I have read all of it and more!</p></section><form>f<input></form><footer>&copy; foot</footer></body></html>"""
    assert html.extract(page) == "Title & more\n\nFirst bold line here, long enough to be content of the page\n\nSecond é link text which is also long enough after\n\none"
    assert [html.extract(x) for x in (None, "", "<nav>a</nav>", "plain", "<p>a<p", "<p title=don't>x</p>")] == ["", "", "", "plain", "a", "x"]
    assert html.extract("<div>" * 5000 + "deep") == "deep"
    got = html.extract_text(spark.createDataFrame([(1, None, "x"), (2, "<p>é</p>", "y")], "page_id long, html string, text string")).orderBy("page_id").collect()
    assert [(r.text, r.n_chars) for r in got] == [("", 0), ("é", 1)]


def test_html_query_keeps_whole_articles(spark):
    import html as entities

    got = {r.page_id: r.text for r in QUERIES["op8_html_text"](spark, DATA).collect()}
    for p in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]+>", " ", x))).strip() for x in re.split(r"</?(?:h1|p)>", article)]
        assert got[p.page_id] == "\n\n".join(x for x in parts if x)


# 10

def test_tokenizer_equals_the_library():
    deal, alphabet = random.Random(1), "aB'.,!<|> \n\té\u0301İßǅ日1²½\u00a0\u200d🙂"
    texts = [t or "" for t in ODD] + ["it's we'll I'M 'quoted' \"it's\"...'s x's", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "A'RE B'VE'M 'LL'd", "\x1c\x85\u2028z"]
    texts += ["".join(deal.choice(alphabet) for _ in range(deal.randrange(60))) for _ in range(1500)]
    tokenizer = packing.WordTokenizer(remember=50)
    for t, ids in zip(texts, tokenizer.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.tokenizer.encode(t, add_special_tokens=False).ids + [2]


def test_fill_wastes_nothing():
    deal = random.Random(0)
    pieces = [(i, 0, deal.choice([1, 30, 700, 4096, 9000])) for i in range(300)]
    full, over = packing.fill(pieces)
    done = full + packing.finish(over)
    assert all(sum(p[2] for p in s) == 4096 for s in full) and all((n := sum(p[2] for p in s)) & (n - 1) == 0 for s in done)
    seen = sorted(p for s in done for p in s)
    at = Counter()
    for doc, start, n in seen:
        assert start == at[doc]
        at[doc] += n
    assert at == Counter({i: n for i, _, n in pieces})


def test_pack_round_trip(spark):
    texts = ODD + [d.text for d in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    rows = packing.pack(frame(spark, texts).repartition(3), keep=["doc_id", "hit"], shard_bytes=50_000).collect()
    tokenizer = packing.WordTokenizer()
    ids = tokenizer.encode([t.encode() if t is not None else None for t in texts])
    at, sequences = Counter(), defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        own = ids[r.doc_id]
        assert r.start == at[r.doc_id] and r.doc_tokens == len(own) // 4 and r.ids_crc32 == zlib.crc32(own[4 * r.start : 4 * (r.start + r.length)])
        at[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert all(at[i] == len(x) // 4 for i, x in enumerate(ids))
    for s in sequences.values():
        end = 0
        for offset, n in sorted(s):
            assert offset == end
            end += n
        assert end <= 4096 and end & (end - 1) == 0
    assert packing.pack(frame(spark, [])).count() == 0
