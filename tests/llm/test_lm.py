import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import ODD, docs_frame, prose
from weft.llm import lm
from weft.llm.common import held_out
from weft.llm.lm import END, VOCABULARY, WINDOW, Attention, Scorer, complete, cut_windows, first_table, fit_first, flat_ids, in_class, load_ranks, sampled_windows, score_documents, score_texts


@pytest.fixture(scope="module")
def small():
    before = lm.FIRST_WINDOWS, lm.EPOCHS
    lm.FIRST_WINDOWS, lm.EPOCHS = 800, 1
    yield
    lm.FIRST_WINDOWS, lm.EPOCHS = before


def fitted_on(texts, vocabulary, epochs_of=None):
    """(model, batch of the texts, attention) from all windows and counts of the texts."""
    batch = lm.Subwords(vocabulary).batch(texts)
    ids, lengths = flat_ids(batch)
    _, i, t, n = sampled_windows(ids, lengths, np.arange(len(texts)), 0, 1)
    is_first = first_table(vocabulary[1])
    fitted = fit_first(i, t, np.arange(WINDOW) < n[:, None], is_first)
    first, key = lm.inner_pairs(batch)
    spread = np.repeat(batch["times"], batch["n"])
    pairs, place = np.unique(key[~first], return_inverse=True)
    counts = np.bincount(batch["flat"], weights=spread, minlength=VOCABULARY)
    counts[END] = len(texts)
    n = np.bincount(place, weights=spread[~first])
    groups, inverse = np.unique((pairs >> 17) * lm.CLASSES + fitted["classes"][pairs & 0x1FFFF], return_inverse=True)
    return complete(fitted, counts, is_first, pairs, n, groups, np.bincount(inverse, weights=n), False), batch, Attention.of(fitted["net"])


def test_gradients():
    rng = np.random.default_rng(1)
    net = Attention()
    for k in Attention.NAMES:
        setattr(net, k, getattr(net, k).astype(np.float64))
    rows, classes = rng.integers(0, 50, (2, WINDOW)), rng.integers(0, lm.CLASSES, (2, WINDOW))
    valid = rng.random((2, WINDOW)) < 0.8
    _, g = net.step(rows, classes, valid)
    for k in Attention.NAMES:
        value = getattr(net, k)
        at = (rows[0, 3], 1) if k == "embed" else tuple(0 for _ in value.shape)
        keep, eps = value[at], 1e-4
        value[at] = keep + eps
        up = net.step(rows, classes, valid)[0]
        value[at] = keep - eps
        down = net.step(rows, classes, valid)[0]
        value[at] = keep
        assert (up - down) / (2 * eps) == pytest.approx(float(g[k][at]), abs=2e-4), k


def test_a_place_sees_nothing_that_follows():
    rng = np.random.default_rng(2)
    net = Attention()
    rows = rng.integers(0, lm.INPUTS, (1, WINDOW))
    z = net.forward(rows)["z"]
    changed = rows.copy()
    changed[0, 20:] = 7
    assert np.allclose(net.forward(changed)["z"][:20], z[:20], atol=1e-5)
    assert np.allclose(net.forward(rows, 8)["z"], z[8:], atol=1e-5)


def test_words_encoded_together_are_those_encoded_alone(monkeypatch):
    rng = random.Random(13)
    words = [prose(rng, 1).encode() for _ in range(400)] + [w.encode() for w in ("\u00a0x", "a\u00a0", "\u2003", "don't", "'s", "x" * 300, "12345678", "\x00\x1f", "<|endoftext|>", "é̈字", "🙂🙂", "---", "\u3000\u3000y")]
    words = list(dict.fromkeys(words))
    monkeypatch.setattr(lm, "CACHE", 150)
    subwords = lm.Subwords(load_ranks())
    alone = [np.array(subwords.encoder.encode_ordinary(" " + w.decode()), "<u2").tobytes() for w in words]
    for _ in range(3):
        rng.shuffle(order := list(range(len(words))))
        for at in range(0, len(words), 60):
            some = order[at : at + 60]
            assert subwords.packed([words[i] for i in some]) == [alone[i] for i in some]
    assert len(subwords.known) <= 210


def test_windows_score_each_token_once():
    for size in (1, 31, 32, 33, 56, 57, 200):
        start, end, first = cut_windows(np.array([5]), np.array([size]))
        scored = Counter()
        for s, e, f in zip(start, end, first):
            scored.update(range(s + (0 if f else WINDOW - lm.STRIDE), min(s + WINDOW, e)))
        assert scored == Counter(range(5, 5 + size))


def test_scorer_agrees_with_the_trained_model():
    rng = np.random.default_rng(6)
    net = Attention()
    net.b1 += 0.3
    rows = rng.integers(0, lm.INPUTS, (5, WINDOW))
    assert np.allclose(Scorer(net).logits(rows, 8), net.forward(rows, 8)["z"], atol=1e-4)


def brute_score(model, net, ids, given):
    """One token after the other, with the window that scores it."""
    inputs, targets, total = [END, *ids], [*ids, END], 0.0
    given = [*given, model["within"][END]]
    for i in range(len(targets)):
        j = 0 if i < WINDOW else 1 + (i - WINDOW) // lm.STRIDE
        start = j * lm.STRIDE
        rows = np.zeros((1, WINDOW), np.int64)
        seen = [int(model["rows"][t]) for t in inputs[start : i + 1]]
        rows[0, : len(seen)] = seen
        z = net.forward(rows)["z"][i - start].astype(float)
        total += z[model["classes"][targets[i]]] - np.log(np.exp(z).sum()) + given[i]
    return total / math.log(10)


def test_scores_against_brute_force_and_probabilities_add_to_one(small):
    rng = random.Random(3)
    vocabulary = load_ranks()
    texts = [prose(rng, n).encode() for n in (3, 40, 90)] + [b""]
    model, batch, net = fitted_on(texts, vocabulary)
    ids, lengths = flat_ids(batch)
    given, at_light, _ = in_class(model, ids, np.cumsum(lengths) - lengths)
    assert not len(at_light)
    got = score_texts(model, ids, lengths, given)
    at = 0
    for length, score in zip(lengths, got):
        assert score == pytest.approx(brute_score(model, net, ids[at : at + length], given[at : at + length]), abs=1e-3)
        at += length
    # ids of each text are those of its words
    subwords = lm.Subwords(vocabulary)
    assert ids[: lengths[0]].tolist() == [i for w in texts[0].split() for i in subwords.word(w)]
    # whatever came before, the probabilities of all next subwords and of the end add to one
    rows = np.zeros((1, WINDOW), np.int64)
    rows[0, :4] = model["rows"][[END, *ids[:3]]]
    for place, before in ((1, ids[0]), (2, ids[1]), (3, ids[2])):
        z = net.forward(rows)["z"][place].astype(float)
        of_class = np.exp(z - z.max())
        of_class /= of_class.sum()
        every = np.stack([np.full(VOCABULARY, before), np.arange(VOCABULARY)], 1).ravel().astype(np.int32)
        inside = in_class(model, every, np.arange(0, 2 * VOCABULARY, 2))[0][1::2]
        assert (of_class[model["classes"]] * np.exp(inside)).sum() == pytest.approx(1, abs=1e-5)


def test_held_out_texts_are_likelier_than_by_counts_alone():
    rng = random.Random(7)
    words = [[prose(rng, 1) for _ in range(40)] for _ in range(4)]
    # words of four kinds take turns, which only their order shows
    texts = [" ".join(rng.choice(words[i % 4]) for i in range(rng.randint(20, 80))).encode() for _ in range(300)]
    model, _, _ = fitted_on(texts[:250], load_ranks())
    batch = lm.Subwords(load_ranks()).batch(texts[250:])
    ids, lengths = flat_ids(batch)
    given = in_class(model, ids, np.cumsum(lengths) - lengths)[0]
    found = score_texts(model, ids, lengths, given).sum()
    train = lm.Subwords(load_ranks()).batch(texts[:250])
    mass = np.bincount(train["flat"], weights=np.repeat(train["times"], train["n"]), minlength=VOCABULARY) + 0.5
    mass[END] = 250
    share = np.bincount(model["classes"], weights=mass, minlength=lm.CLASSES)
    share /= share.sum()
    targets = np.insert(ids, np.cumsum(lengths), END)
    alone = (np.log10(share[model["classes"][targets]]).sum() + given.sum() / math.log(10))
    assert found > alone * 0.85


def test_draws_of_windows_do_not_depend_on_the_batch():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 900, n).astype(np.int32) for n in (0, 5, 70, 200, 33)]
    keys = np.array([5, -7, 11, 11, 2**40])
    lengths = np.array([len(x) for x in texts])
    together = sampled_windows(np.concatenate(texts), lengths, keys, 0, 1)
    apart = [sampled_windows(x, np.array([len(x)]), keys[i : i + 1], 0, 1) for i, x in enumerate(texts)]
    at = 0
    for draw, i, t, n in apart:
        own = slice(at, at + len(draw))
        assert np.array_equal(together[0][own], draw) and np.array_equal(together[3][own], n)
        for a, b, k in zip(together[1][own], i, n):
            assert np.array_equal(a[:k], b[:k])
        at += len(draw)
    low, high = (sampled_windows(np.concatenate(texts), lengths, keys, *x)[0] for x in ((0, 0.4), (0.4, 1)))
    assert len(low) + len(high) == len(together[0])


def test_rows_against_brute_force(spark, small):
    rng = random.Random(4)
    words = [prose(rng, 1) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(120)] + ODD + ["É Über ABC abc"]
    docs = docs_frame(spark, texts, [(None, "abc"), (3, texts[3])])
    found = score_documents(docs, ~held_out("doc_id", 7)).collect()
    rows = docs.collect()
    tokens = [(r["doc_id"], [*(r["text"] or "").encode().lower().split(), None]) for r in rows]
    c = Counter()
    for i, w in tokens:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(w)
    n, v = sum(c.values()), len(c)
    expected = sorted((str(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for i, w in tokens)
    assert sorted((str(r["id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == expected
    assert all(r["score"] < 0 for r in found)


def test_rare_words_meet_their_counts_in_buckets(spark, small, monkeypatch):
    monkeypatch.setattr(lm, "HEAVY", 10)
    docs = docs_frame(spark, ["a a a b c", "b d", "e e"])
    found = {r["id"]: r for r in score_documents(docs, F.col("doc_id") < 2).collect()}
    c = Counter("aaabcbd") + Counter({None: 2})
    n, v = 9, 5
    for i, w in enumerate(["aaabc", "bd", "ee"]):
        assert found[i]["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in [*w, None]))
        assert found[i]["n_known"] == sum(c[x] > 0 for x in [*w, None])


def test_rare_pairs_and_other_layouts_give_the_same_scores(spark, small, monkeypatch):
    monkeypatch.setattr(lm, "ONE_IN", 2)
    monkeypatch.setattr(lm, "FIRST_WINDOWS", 60)
    monkeypatch.setattr(lm, "RUN_WINDOWS", 40)
    rng = random.Random(9)
    docs = docs_frame(spark, [prose(rng, rng.randint(5, 120)) for _ in range(150)])
    found = []
    for heavy, rows in ((2_000_000, docs), (50, docs), (1, docs.repartition(3, "text"))):
        monkeypatch.setattr(lm, "HEAVY_PAIRS", heavy)
        found.append([r["score"] for r in score_documents(rows, ~held_out("doc_id", 7)).orderBy("id").collect()])
    assert np.allclose(found[0], found[1], rtol=1e-4) and np.allclose(found[0], found[2], rtol=1e-4)


def test_the_order_of_words_in_every_training_text_counts(spark, small, monkeypatch):
    monkeypatch.setattr(lm, "FIRST_WINDOWS", 4)
    rng = random.Random(11)
    texts = [prose(rng, 40) for _ in range(40)]
    scores = []
    for turned in (None, 3, 22):
        # neither words nor subwords nor pairs inside words are counted otherwise
        some = [" ".join(reversed(t.split())) if i == turned else t for i, t in enumerate(texts)]
        found = score_documents(docs_frame(spark, some), F.col("doc_id") < 38).where("id >= 38").orderBy("id").collect()
        scores.append([r["score"] for r in found])
    assert not np.allclose(scores[0], scores[1], rtol=1e-9) and not np.allclose(scores[0], scores[2], rtol=1e-9)


def test_neighbours_and_slopes_of_all_training_texts_against_brute_force(spark, small, monkeypatch):
    monkeypatch.setattr(lm, "FIRST_WINDOWS", 5)
    monkeypatch.setattr(lm, "ONE_IN", 3)
    monkeypatch.setattr(lm, "RUN_WINDOWS", 7)
    monkeypatch.setattr(lm, "COMMON", 20)
    seen, added, adam = {}, lm.added_slopes, []

    def tables(counts, table, is_first, f=lm.word_classes):
        seen["counts"], seen["table"] = counts, table
        return f(counts, table, is_first)

    def slopes(texts, net, fixed):
        out = added(texts, net, fixed)
        adam.append(({k: x.copy() for k, x in net.items()}, fixed.value, [r["toks"] for r in texts.collect()], out))
        return out

    monkeypatch.setattr(lm, "word_classes", tables)
    monkeypatch.setattr(lm, "added_slopes", slopes)
    rng = random.Random(12)
    texts = [prose(rng, rng.randint(1, 90)) for _ in range(60)] + ["", None, "x" * 500]
    score_documents(docs_frame(spark, texts), ~held_out("doc_id", 7)).count()
    subwords = lm.Subwords(load_ranks())
    streams = [[i for w in (t or "").split() for i in subwords.word(w.encode())] for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(x for s in streams for x in [*s, END])
    assert {i: n for i, n in enumerate(seen["counts"]) if n} == counts
    # of every text, each subword and its end are a target once
    assert sum(a[3][-1] for a in adam) == counts.total()
    assert sorted(x for a in adam for x in a[2]) == sorted(np.array(s, "<u2").tobytes() for s in streams)
    some, row, column = lm.ranked(seen["counts"])
    pairs = Counter((a, b) for s in streams for a, b in zip([END, *s], [*s, END]))
    table = np.zeros((len(some), 40), np.int64)
    for (a, b), n in pairs.items():
        if row[b] >= 0 and column[a] >= 0:
            table[row[b], column[a]] += n
        if row[a] >= 0 and column[b] >= 0:
            table[row[a], 20 + column[b]] += n
    assert np.array_equal(seen["table"], table.ravel())
    for net, (rows, classes), packed, total in adam:
        expected, net = 0, Attention.of(net)
        for toks in packed:
            ids = np.frombuffer(toks, "<u2").tolist()
            inputs, targets = [END, *ids], [*ids, END]
            for at in range(0, len(targets), WINDOW):
                i, t = (np.array([[*x[at : at + WINDOW], *[0] * (at + WINDOW - len(x))]]) for x in (inputs, targets))
                n = min(WINDOW, len(targets) - at)
                g = net.step(rows[i], classes[t], np.arange(WINDOW)[None] < n)[1]
                expected = expected + n * np.concatenate([g[k].ravel().astype(float) for k in Attention.NAMES])
        assert np.allclose(total[:-1], expected, atol=1e-3)


def test_slopes_gathered_by_row_are_those_of_every_window():
    rng = np.random.default_rng(8)
    net = Attention()
    for k in Attention.NAMES:
        setattr(net, k, getattr(net, k).astype(np.float64))
    net.b1 += 0.2
    # a row many times, others a few times or once
    rows = np.minimum(rng.zipf(1.3, (2 * lm.TOGETHER + 5, WINDOW)), lm.INPUTS)
    classes, valid = rng.integers(0, lm.CLASSES, rows.shape), rng.random(rows.shape) < 0.8
    slopes = lm.Slopes(net)
    for some in (slice(0, 50), slice(50, 50), slice(50, None)):
        slopes.add(rows[some], classes[some], valid[some])
    found, expected, loss = slopes.gradients(), {k: 0.0 for k in Attention.NAMES}, 0.0
    for r, c, ok in zip(rows, classes, valid):
        # one window at a time, and its loss from the plain forward pass
        mean, g = net.step(r[None], c[None], ok[None])
        z = net.forward(r[None])["z"]
        own = (np.log(np.exp(z).sum(1)) - z[np.arange(WINDOW), c])[ok].sum()
        assert mean * ok.sum() == pytest.approx(own)
        loss += own
        expected = {k: expected[k] + ok.sum() * x for k, x in g.items()}
    assert slopes.count == valid.sum() and slopes.loss == pytest.approx(loss)
    assert all(np.allclose(found[k], expected[k], atol=1e-9) for k in Attention.NAMES)


def test_rows_are_added_up_in_groups():
    rng = np.random.default_rng(9)
    for n in (0, 1, 7, 8, 9, 30_000):
        rows, values = rng.integers(0, 300, n) ** 2 % 400, rng.integers(0, 9, (n + 1, 3)).astype(np.float32)
        values[-1] = 0
        found, expected = np.ones((400, 3)), np.ones((400, 3))
        lm.add_rows(found, rows, values)
        np.add.at(expected, rows, values[:n])
        assert np.array_equal(found, expected), n


def test_products_beyond_the_bound_are_clipped():
    rng = np.random.default_rng(10)
    net = Attention()
    net.wq *= 400
    rows = rng.integers(0, lm.INPUTS, (3, WINDOW))
    assert not Scorer(net).bounded and Scorer(Attention()).bounded
    assert np.isfinite(Scorer(net).logits(rows)).all()


def test_batches_of_words_are_those_of_each_word_alone(monkeypatch):
    rng = random.Random(14)
    monkeypatch.setattr(lm, "CACHE", 120)
    subwords = lm.Subwords(load_ranks())
    words = [prose(rng, 1) for _ in range(300)] + ["x" * 300, "\u00a0x", "'s", "\x00\x1f"]
    for _ in range(12):
        texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(5)]
        ids, lengths = flat_ids(subwords.batch([t.encode() for t in texts]))
        expected = [[i for w in t.split(" ") if w for i in subwords.encoder.encode_ordinary(" " + w)] for t in texts]
        assert lengths.tolist() == [len(x) for x in expected] and ids.tolist() == sum(expected, [])
        assert len(subwords.known) <= 320 and np.all(np.diff(subwords.known.hashes) > 0)


def test_pairs_inside_words_against_brute_force():
    rng = np.random.default_rng(15)
    lengths = np.array([0, 40, 0, 300, 1])
    ids = rng.integers(0, 12, int(lengths.sum())).astype(np.int32)
    # ids up to 5 begin a word; of the pairs those with an even first id are at hand
    first = np.arange(VOCABULARY) < 6
    pairs = np.array([a << 17 | b for a in range(0, 12, 2) for b in range(6, 12)])
    counts, classes = rng.integers(1, 90, len(pairs)), np.arange(VOCABULARY) % lm.CLASSES
    groups = np.array([a * lm.CLASSES + c for a in range(12) for c in range(12)])
    group_counts, within = rng.integers(100, 200, len(groups)), np.log(rng.random(VOCABULARY))
    model = {"within": within, "first": first, "pairs": pairs, "pair_counts": counts, "groups": groups, "group_counts": group_counts, "classes": classes, "light": True}
    starts = np.cumsum(lengths) - lengths
    value, at, key = in_class(model, ids, starts)
    light = {}
    for i, own in enumerate(ids.tolist()):
        expected = within[own]
        if own >= 6 and i not in starts:
            k = int(ids[i - 1]) << 17 | own
            n = dict(zip(pairs.tolist(), counts.tolist())).get(k)
            if n is None:
                light[i] = k
            top = 0.0 if n is None else math.log(n + lm.PRIOR * math.exp(within[own]))
            expected = top - math.log(dict(zip(groups.tolist(), group_counts.tolist()))[ids[i - 1] * lm.CLASSES + classes[own]] + lm.PRIOR)
        assert value[i] == pytest.approx(expected)
    assert len(light) > 20 and dict(zip(at.tolist(), key.tolist())) == light and len(at) == len(light)


def test_no_rows(spark, small):
    docs = docs_frame(spark, ["a b"])
    row = score_documents(docs, F.lit(False)).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (3, 0, 0)
    assert row["base_score"] == pytest.approx(3 * math.log10(1 / 1))
    assert score_documents(docs.where("false")).count() == 0
