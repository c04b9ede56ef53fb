import random

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import docs_frame, prose
from tests.llm.test_secrets import brute_base, brute_linked
from weft.llm import quality
from weft.llm.bpe import BytePairCodec, load_vocabulary


def test_stages_take_effect_in_order(spark, tmp_path):
    rng = random.Random(12)
    good = [prose(rng, rng.randint(30, 120)).capitalize() + "." for _ in range(90)]
    bad = [prose(rng, 60).upper().replace(" ", "!! ") for _ in range(40)]
    bench = [prose(rng, 40) for _ in range(4)]
    leaked = [f"{prose(rng, 30)} {bench[i % 4]} {prose(rng, 30)}" for i in range(8)]
    secret = [f"{prose(rng, 40)} password: hunter{i}22 {prose(rng, 30)}" for i in range(6)]
    copies = [good[0], good[0] + " " + prose(rng, 1), good[1].upper().lower().capitalize()]
    texts = good + bad + leaked + secret + copies
    sf = str(tmp_path)
    docs_frame(spark, texts).write.parquet(f"{sf}/documents.parquet")
    labels = [(i, int(i < 90 or i >= 130), 0) for i in range(len(texts))]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, sf).collect()
    kept = {r["doc_id"]: r for r in rows}
    model = quality.fit_quality(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert model is not None
    assert set(kept) == set(range(90)) | set(range(138, 144))
    codec = BytePairCodec(load_vocabulary())
    for i, r in kept.items():
        text = texts[i]
        assert not brute_linked(text) or "[REDACTED]" in r["text"]
        if brute_base(text):
            assert "hunter" not in r["text"] and "[REDACTED]" in r["text"]
        else:
            assert r["text"] == text
        assert r["n_chars"] == len(r["text"]) and r["ids"] == codec.encode(r["text"]) and r["n_tokens"] == len(r["ids"])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_duplicates", "benchmark_decontamination", "secret_scan", "bpe_encoding"]


def test_columns_of_any_name_come_through(spark, tmp_path):
    rng = random.Random(13)
    texts = [prose(rng, rng.randint(30, 80)).capitalize() + "." for _ in range(40)] + [prose(rng, 60).upper().replace(" ", "!! ") for _ in range(20)]
    names = ["__weft_score", "__weft_predicted", "__text", "ids", "n_tokens", "Ids_SHA256", "decoded_sha256", "key", "id", "weft_score", "weft_key", "weft_ids", "score", "predicted", "rank", "p", "h", "x", "n", "a", "b", "u", "node", "part", "block", "item", "spans", "decoded"]
    docs = docs_frame(spark, texts).select("*", *[(F.col("doc_id") * 1.5 + k).alias(c) for k, c in enumerate(names)])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 40), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, prose(rng, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} == set(range(40))
    codec = BytePairCodec(load_vocabulary())
    for r in rows:
        assert [r[c] for c in names] == [r["doc_id"] * 1.5 + k for k, c in enumerate(names)]
        assert r["text"] == texts[r["doc_id"]] and r["weft_ids_"] == codec.encode(r["text"])
