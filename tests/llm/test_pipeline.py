import random

import corpus_pipeline

from ..oracle import DATA


def test_stages_take_effect(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"] and corpus_pipeline.ORACLE_SQL is None
    deal = random.Random(4)
    vocab = [f"v{i}" for i in range(900)]
    text = lambda n=80: " ".join(deal.choice(vocab) for _ in range(n))
    passage, menu = text(30), text(6)
    texts = [f"{menu}\n{text()}" for _ in range(60)]
    texts += [texts[0], texts[0] + " end", f"{menu}\n{text()} {passage} {text()}"]
    toxic = [f"{menu}\n{text(40)} idiot {text(40)}" for _ in range(20)]
    texts += toxic
    docs = spark.createDataFrame([(i, t, "en", "s0", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, int(t in toxic)) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    now = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf)
        if name != "packing":
            assert now.columns == docs.columns
            rows = {r.doc_id: r.text for r in now.collect()}
            now = spark.createDataFrame(now.collect(), docs.schema)
        if name == "toxicity":
            assert sorted(rows) == list(range(63))
        elif name == "line_dedup":
            assert all(menu not in t for t in rows.values()) and len(rows) == 63
        elif name == "near_dedup":
            assert sorted(rows) == [i for i in range(63) if i not in (60, 61)]
        elif name == "decontamination":
            assert passage not in rows[62] and len(rows) == 61 and all(r.n_chars == len(r.text) for r in now.collect())
        else:
            assert now.select("doc_id").distinct().count() == 61
    packed = corpus_pipeline.run(spark, sf)
    assert packed.select("doc_id").distinct().count() == 61


def test_run_on_test_data(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
