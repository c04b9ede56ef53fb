import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import ODD, docs_frame, prose
from weft.llm import common, neardup
from weft.llm.common import maybe_in, without_keys, word_hashes
from weft.llm.neardup import drop_near_duplicates, near_duplicate_classes, prob_minhash, probability_jaccard, weighted_shingles


def brute_pj(x, y):
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in {*x, *y}) for i in x if i in y)


def brute_classes(texts, threshold=0.8):
    def shingles(t):
        w = (t or "").encode().lower().split()
        out = {}
        for i in range(max(len(w) - 4, 1) if w else 0):
            out[tuple(w[i : i + 5])] = out.get(tuple(w[i : i + 5]), 0) + 1
        return out

    s = [shingles(t) for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if s[i] and s[j]:
                plain = len(s[i].keys() & s[j].keys()) / len(s[i].keys() | s[j].keys())
                if plain >= threshold or (plain and brute_pj(s[i], s[j]) >= threshold):
                    a, b = root(i), root(j)
                    up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def corpus(seed=3, copies=120):
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    base = prose(rng, 150).split()
    for _ in range(copies):  # one large group of near copies, some too far from most others
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 14])):
            words[rng.randrange(len(words))] = prose(rng, 1)
        texts.append(" ".join(words))
    texts += [texts[3], texts[3].upper(), texts[5] + "  ", *ODD, *ODD]
    rng.shuffle(texts)
    return texts


def test_words_and_probability_jaccard():
    counts = word_hashes([b"a  b\tA", b"", b" x "])[1]
    assert counts.tolist() == [3, 0, 1]
    h = word_hashes([b"a b A", b"b"])[0]
    assert h[0] == h[2] and h[1] == h[3] and h[0] != h[1]
    rng = random.Random(1)
    for _ in range(50):
        x = {k: rng.randint(1, 5) for k in rng.sample(range(30), 12)}
        y = {k: rng.randint(1, 5) for k in rng.sample(range(30), 14)}
        pack = lambda m: (np.array(sorted(m), np.uint64), np.array([m[k] for k in sorted(m)]))
        assert abs(probability_jaccard(*pack(x), *pack(y))[0] - brute_pj(x, y)) < 1e-9


def test_bound_keeps_all_that_are_similar():
    rng = random.Random(5)
    base = {k: rng.randint(1, 3) for k in range(60)}
    sets = []
    for _ in range(60):
        x = dict(base)
        for k in rng.sample(sorted(x), rng.randint(0, 20)):
            x.pop(k)
        for k in rng.sample(range(100, 200), rng.randint(0, 12)):
            x[k] = rng.randint(1, 4)
        sets.append((np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)])))
    group = neardup.ShingleGroup([a for a, _ in sets], [w for _, w in sets])
    others = np.arange(1, 60)
    for threshold in (0.6, 0.8):
        got = group.may_reach(0, others, threshold)
        real = np.array([max(probability_jaccard(*sets[0], *sets[i])) >= threshold for i in others])
        assert not (real & ~got).any() and got.sum() < len(others)


def test_signatures_estimate_probability_jaccard():
    rng = random.Random(4)
    base = prose(rng, 400).split()
    other = [w if rng.random() > 0.02 else "zz" for w in base]
    texts = [" ".join(base).encode(), " ".join(other + base[:50]).encode()]
    el, w, doc = weighted_shingles(texts, 5)
    sig = prob_minhash(el, w.astype(float), doc, 2, 4096)
    pack = [(el[doc == i], w[doc == i]) for i in (0, 1)]
    assert abs((sig[0] == sig[1]).mean() - probability_jaccard(*pack[0], *pack[1])[0]) < 0.04
    # a text's signature doesn't depend on its batch
    alone = prob_minhash(*weighted_shingles(texts[1:], 5)[:1], weighted_shingles(texts[1:], 5)[1].astype(float), np.zeros((doc == 1).sum(), int), 1, 4096)
    assert (alone[0] == sig[1]).all()


def test_classes_agree_with_brute_force(spark):
    texts = corpus()
    found = near_duplicate_classes(docs_frame(spark, texts)).collect()
    expected = brute_classes(texts)
    assert len(found) == len(texts)
    assert {r["id"]: r["class"] for r in found} == dict(enumerate(expected))
    assert all(r["kept"] == (r["id"] == r["class"]) for r in found)


def test_blocks_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    texts = corpus(9, 150)
    found = {r["id"]: r["class"] for r in near_duplicate_classes(docs_frame(spark, texts)).collect()}
    assert found == dict(enumerate(brute_classes(texts)))


def test_rows_without_ids_repeats_and_empty_tables(spark):
    docs = docs_frame(spark, ["one two three four five six"], [(None, "one two three four five six"), (0, "one two three four five six"), (1, None), (2, "one two three four five six")])
    out = drop_near_duplicates(docs).collect()
    assert sorted(str(r["doc_id"]) for r in out) == ["0", "1"]
    assert near_duplicate_classes(docs_frame(spark, [])).count() == 0
    assert drop_near_duplicates(docs_frame(spark, [])).count() == 0


def test_texts_that_differ_in_how_often_a_line_repeats(spark):
    rng = random.Random(8)
    docs, n = [], 12
    for i in range(n):
        body = [f"w{i}x{rng.randrange(10**9)}" for _ in range(600)]
        line = " ".join(body[:10])
        docs += [(10 * i, " ".join(body)), (10 * i + 1, " ".join(body) + (" " + line) * 60), (10 * i + 2, " ".join(body) + (" " + line) * 200)]
    # the weights alone are far from alike
    (a, x, _), (b, y, _) = (weighted_shingles([docs[j][1].encode()], 5) for j in (0, 1))
    weighted, plain = probability_jaccard(a, x, b, y)
    assert weighted < 0.66 and plain > 0.95
    found = {r["id"]: r["class"] for r in near_duplicate_classes(docs_frame(spark, [], docs)).collect()}
    assert all(found[10 * i + j] == 10 * i for i in range(n) for j in range(3))


def test_filter_drops_just_the_keys(spark):
    rows = spark.range(5000).selectExpr("id", "cast(id as string) as text").union(spark.sql("select cast(null as bigint), 'none'"))
    keys = spark.range(0, 5000, 7)
    flagged = maybe_in(rows, keys, "id", "f").collect()
    assert all(r["f"] for r in flagged if r["id"] is not None and r["id"] % 7 == 0)
    assert sum(r["f"] for r in flagged) < 730 and not [r for r in flagged if r["id"] is None and r["f"]]
    expected = sorted([i for i in range(5000) if i % 7] + [-1])
    assert sorted(-1 if r["id"] is None else r["id"] for r in without_keys(rows, keys, "id").collect()) == expected
    clash = rows.withColumnsRenamed({"text": "weft_key"}).withColumn("weft_maybe", F.lit(1))
    assert without_keys(clash, keys, "id").columns == clash.columns and without_keys(clash, keys, "id").count() == len(expected)


def test_filters_that_let_others_through_and_too_many_keys(spark, monkeypatch):
    rows, keys = spark.range(3000), spark.range(0, 3000, 3)
    expected = [i for i in range(3000) if i % 3]
    # so few bits that most rows pass: the second look decides
    monkeypatch.setattr(common, "FILTER_BITS", 1 << 10)
    assert sorted(r["id"] for r in without_keys(rows, keys, "id").collect()) == expected
    monkeypatch.setattr(common, "FEW", 10)
    assert sorted(r["id"] for r in without_keys(rows, keys, "id").collect()) == expected
    monkeypatch.setattr(common, "FILTER_KEYS", 5)
    assert sorted(r["id"] for r in without_keys(rows, keys, "id").collect()) == expected


def test_copies_that_share_an_id_or_have_none(spark):
    words = "one two three four five six"
    docs = docs_frame(spark, [words, "seven eight nine ten eleven"], [(None, words), (0, words.upper()), (None, "a b c d e f"), (None, "A b c  d e f"), (1, "twelve"), (None, ""), (None, None), (2, words), (3, None)])
    out = drop_near_duplicates(docs.withColumn("weft_odd", F.lit(1)))
    found = sorted((str(r["doc_id"]), " ".join((r["text"] or "").lower().split())) for r in out.collect())
    assert found == sorted([("0", words), ("1", "seven eight nine ten eleven"), ("1", "twelve"), ("3", ""), ("None", "a b c d e f"), ("None", ""), ("None", "")])
    assert out.columns == [*docs.columns, "weft_odd"]


def test_recall_just_above_the_threshold():
    rng = random.Random(17)
    found = total = 0
    while total < 250:
        words = [f"w{rng.randrange(10**9)}" for _ in range(rng.randint(60, 300))]
        other = list(words)
        for _ in range(max(1, len(words) // 60)):
            other[rng.randrange(len(other))] = f"x{rng.randrange(10**9)}"
        el, w, doc = weighted_shingles([" ".join(words).encode(), " ".join(other).encode()], 5)
        a, b = ((el[doc == i], w[doc == i]) for i in (0, 1))
        likeness = max(probability_jaccard(*a, *b))
        if not 0.8 <= likeness < 0.86:
            continue
        total += 1
        sig = prob_minhash(el, w.astype(float), doc, 2)
        keys = neardup.band_keys(sig)
        found += bool((keys[0] == keys[1]).any()) and (sig[0] == sig[1]).mean() >= neardup.LIKELY
    # one in 10,000 by the bands, and 4.8 standard deviations by the gate
    assert found >= total - 1
