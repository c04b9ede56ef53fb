import random
import zlib

import numpy as np

from tests.llm.helpers import ODD, docs_frame, prose
from weft.llm.quality import KINDS, PAIRS, WORDS, _kind_table, fit, fit_quality, keep_good, latent_axes, score_quality, shape_counts, vote, weigh


def sample(n=400, seed=1):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        t = prose(rng, rng.randint(10, 150)).capitalize() + "."
        bad = rng.random() < 0.4
        if bad:
            t = rng.choice([lambda x: x.upper().replace(" ", "!! "), lambda x: x.replace(" ", " | "), lambda x: " ".join(w for w in x.split() for _ in range(9)), lambda x: x.replace(" ", "%%% ")])(t)
        texts.append(t)
        labels.append(int(not bad))
    return texts, labels


def test_held_out_accuracy(spark):
    texts, labels = sample()
    docs = docs_frame(spark, texts)
    table = spark.createDataFrame([(i, y, 0) for i, y in enumerate(labels)], "doc_id long, quality int, toxic int")
    rows = score_quality(docs, fit_quality(docs, table)).select("doc_id", "score", "predicted").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(held) > 60
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_held_out_labels_are_not_used(spark):
    texts, labels = sample(120)
    docs = docs_frame(spark, texts)
    score = []
    for flip in (0, 1):
        y = [1 - v if flip and zlib.crc32(str(i).encode()) % 4 == 2 else v for i, v in enumerate(labels)]
        table = spark.createDataFrame(list(enumerate(y)), "doc_id long, quality int")
        score.append([r["score"] for r in score_quality(docs, fit_quality(docs, table)).orderBy("doc_id").collect()])
    assert np.allclose(score[0], score[1])


def test_votes_against_brute_force():
    texts, labels = sample(150, 3)
    counts = shape_counts([t.encode() for t in texts])
    model = fit([counts[:64], counts[64:100]], np.array(labels[:100]), dimensions=12)
    latent = weigh(counts[100:], model["idf"]) @ model["axes"]
    latent /= np.linalg.norm(latent, axis=1, keepdims=True)
    for block in (7, 64, 1000):
        got = vote(model, counts[100:], k=9, block=block)
        for x, s in zip(latent, got):
            cosine = model["vectors"] @ x
            near = np.argsort(-cosine)[:9]
            w = np.exp(8.0 * cosine[near])
            assert abs((w * model["labels"][near]).sum() / w.sum() - s) < 1e-4


def test_axes_are_the_leading_singular_vectors():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((90, 40)) * 0.8 ** np.arange(40)
    _, _, exact = np.linalg.svd(x)
    found = latent_axes([x[:50], x[50:]], 40, 6, rounds=60)
    assert found.shape == (40, 6) and np.allclose(np.abs(np.sum(found * exact[:6].T, axis=0)), 1, atol=1e-6)


def test_counts_of_words_and_shapes_by_hand():
    texts = [b"Ab ab, c9", b"", b"ab\nab"]
    x = shape_counts(texts)
    word = x[:, PAIRS : PAIRS + WORDS]
    assert word.sum(axis=1).tolist() == [3, 0, 2] and word[2].max() == 2
    kind = _kind_table()
    runs = {}
    for t in texts[:1]:
        k = [kind[b] for b in t + b"\n"]  # a text ends with a line end
        k = [a for i, a in enumerate(k) if not i or k[i - 1] != a]
        for a, b in zip(k, k[1:]):
            runs[a * KINDS + b] = runs.get(a * KINDS + b, 0) + 1
    assert {i: int(x[0, i]) for i in np.flatnonzero(x[0, :PAIRS])} == runs
    assert not x[1].any()


def test_repeated_labelled_rows_count_once(spark):
    texts, labels = sample(80)
    table = spark.createDataFrame(list(enumerate(labels)), "doc_id long, quality int")
    once = fit_quality(docs_frame(spark, texts), table)
    often = fit_quality(docs_frame(spark, texts, [(3, texts[3])] * 40), table)
    assert np.array_equal(once["vectors"], often["vectors"]) and len(once["labels"]) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(80))


def test_odd_rows(spark):
    texts, labels = sample(60)
    docs = docs_frame(spark, texts + ODD, [(None, "text"), (5, texts[5])])
    table = spark.createDataFrame([(i, y) for i, y in enumerate(labels)] + [(None, 1), (3, None), (4, 7), (5, 0), (5, 1), (999, 1)], "doc_id long, quality int")
    rows = score_quality(docs, fit_quality(docs, table)).collect()
    assert len(rows) == docs.count() and all(r["score"] is not None for r in rows)
    assert keep_good(docs, table).columns == docs.columns
    clash = docs.withColumnRenamed("lang", "Score").withColumnRenamed("source", "predicted")
    assert keep_good(clash, table).columns == clash.columns and keep_good(clash, table).count() == keep_good(docs, table).count()
    assert score_quality(clash, None).columns == ["doc_id", "text", "n_chars", "score", "predicted"]
    nothing = table.where("false")
    assert {r["predicted"] for r in score_quality(docs, fit_quality(docs, nothing)).collect()} == {0}
    assert score_quality(docs_frame(spark, []), None).count() == 0
