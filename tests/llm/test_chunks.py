import random

import numpy as np

from tests.llm.helpers import ODD, docs_frame, prose
from weft.llm.chunks import GEAR, RUN, SIDE, WINDOW, cut_points, gear_hash, gear_table, op5_chunk_dedup, repeated_stretches, without_repeats


def brute_gear(data, table):
    h, out = 0, []
    for b in data:
        h = ((h << 1) + int(table[b])) & 0xFFFFFFFF
        out.append(h)
    return out


def test_gear_hash_and_cuts():
    rng = np.random.default_rng(1)
    table = gear_table()
    for n in (0, 1, 5, 31, 32, 33, 500):
        data = rng.integers(0, 256, n).astype(np.uint8)
        assert gear_hash(data, table).tolist() == brute_gear(data, table)
    data = rng.integers(0, 256, 50_000).astype(np.uint8)
    cuts = cut_points(data, table)
    assert cuts[-1] == len(data) and np.diff(cuts[:-1]).max() <= WINDOW and 0.4 * WINDOW < len(data) / len(cuts) < 0.6 * WINDOW
    # an insertion moves the cuts near it only
    shifted = cut_points(np.concatenate([data[:1000], data[:7], data[1000:]]), table)
    assert {c for c in cuts if c >= 1000 + GEAR + WINDOW} <= {c - 7 for c in shifted}


def brute_cuts(data, table):
    """Last place of the least hash of each window, without those that repeat the hash of the one before within a window."""
    h = brute_gear(data, table)
    places = set()
    for a in range(GEAR - 1, len(data) - WINDOW + 1):
        part = h[a : a + WINDOW]
        places.add(a + max(i for i, x in enumerate(part) if x == min(part)) + 1)
    out = []
    for c in sorted(places):
        if not out or h[c - 1] != h[out[-1] - 1] or c - out[-1] >= WINDOW:
            out.append(c)
    return out if out and out[-1] == len(data) or not len(data) else [*out, len(data)]


def test_cuts_against_brute_force():
    rng = random.Random(2)
    table = gear_table()
    texts = [prose(rng, n) for n in (0, 1, 5, 14, 17, 30, 90)] + ["x" * 900, "ab " * 300, "a" * 94, "a" * 95, "a" * 96, "abcd" * 40 + prose(rng, 40) + "z" * 300]
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        assert cut_points(data, table) == brute_cuts(data, table), text[:30]
    # one letter in a row doesn't make a chunk of each
    assert len(cut_points(np.full(100_000, 120, np.uint8), table)) < 100_000 / WINDOW + 2


def brute(texts):
    """Stretches of chunks seen before, with what they share with their first occurrence on both sides."""
    table, seen, out = gear_table(), {}, []
    raws = [(t or "").encode() for t in texts]
    cuts = [[0, *cut_points(np.frombuffer(r, np.uint8), table)] for r in raws]
    for d, raw in enumerate(raws):
        runs = []
        for n, (s, e) in enumerate(zip(cuts[d], cuts[d][1:])):
            f = seen.setdefault(raw[max(s - GEAR, 0) : e], (d, n))
            if f == (d, n):
                continue
            if runs and runs[-1][1] + 1 == n and runs[-1][2] == f[0] and runs[-1][4] + 1 == f[1]:
                runs[-1][1], runs[-1][4] = n, f[1]
            else:
                runs.append([n, n, f[0], f[1], f[1]])
        spans = []
        for k, (a, b, fd, fa, fb) in enumerate(runs):
            s, e = cuts[d][a], cuts[d][b + 1]
            room = s - cuts[d][fb + 1] if fd == d else len(raw)
            left = right = 0
            if not k or runs[k - 1][1] + 1 < a:
                x, y = raw[max(s - SIDE, 0) : s], raws[fd][max(cuts[fd][fa] - SIDE, 0) : cuts[fd][fa]]
                while left < min(len(x), len(y)) and x[-1 - left] == y[-1 - left]:
                    left += 1
            if k + 1 == len(runs) or b + 1 < runs[k + 1][0]:
                x, y = raw[e : e + SIDE], raws[fd][cuts[fd][fb + 1] : cuts[fd][fb + 1] + SIDE]
                while right < min(len(x), len(y)) and x[right] == y[right]:
                    right += 1
            left = min(left, room)
            s, e = s - left, e + min(right, room - left)
            if spans and s <= spans[-1][1]:
                spans[-1][1] = max(e, spans[-1][1])
            else:
                spans.append([s, e])
        out.append([tuple(x) for x in spans if x[1] - x[0] >= RUN])
    return out


def test_repeats_against_brute_force(spark):
    rng = random.Random(6)
    passage = prose(rng, 60)
    texts = [prose(rng, rng.randint(0, 300)) for _ in range(40)]
    for i in range(5, 25, 3):
        w = texts[i].split()
        k = rng.randint(0, len(w))
        texts[i] = " ".join(w[:k] + [passage] + w[k:])
    texts += [texts[7], texts[7] + " more", *ODD, ODD[4], "ab " * 3000, (passage + " ") * 9]
    docs = docs_frame(spark, texts)
    rows = {r["id"]: r for r in repeated_stretches(docs).collect()}
    assert len(rows) == len(texts)
    for i, spans in enumerate(brute(texts)):
        assert [(x["s"], x["e"]) for x in rows[i]["spans"]] == spans, i
        assert rows[i]["n_bytes"] == len((texts[i] or "").encode()) and bool(rows[i]["n_repeated"]) == bool(spans)
    assert all(rows[i]["spans"] for i in range(8, 25, 3))
    assert not any(rows[i]["spans"] for i in range(5))
    left = {r["doc_id"]: r["text"] for r in without_repeats(docs).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        for x in reversed(rows[i]["spans"]):
            raw = raw[: x["s"]] + raw[x["e"] :]
        assert left[i] == (None if t is None else raw.decode())


def test_passages_of_51_words_in_other_surroundings(spark):
    rng = random.Random(11)
    texts, where = [], []
    for _ in range(150):
        passage = prose(rng, 51)
        for _ in range(2):
            before = prose(rng, rng.randint(0, 60))
            texts.append(f"{before} {passage} {prose(rng, rng.randint(0, 60))}")
            where.append((len(before) + 1, len(before) + 1 + len(passage)))
    rows = {r["id"]: r["spans"] for r in repeated_stretches(docs_frame(spark, texts)).collect()}
    for i in range(1, 300, 2):
        s, e = where[i]
        assert not rows[i - 1]
        assert sum(max(0, min(x["e"], e) - max(x["s"], s)) for x in rows[i]) >= 0.95 * (e - s), i


def test_recall_of_short_passages(spark):
    """Of exact passages of each length in other surroundings, from the least length that is removed."""
    rng = random.Random(21)
    lengths = (RUN, 170, 200, 260, 400)
    assert GEAR - 1 + 2 * WINDOW <= RUN
    texts, planted = [], []
    for length in lengths:
        for _ in range(150):
            passage = prose(rng, 100)[:length]
            for again in (False, True):
                before = prose(rng, rng.randint(1, 60)) + "#$"[again]
                texts.append(before + passage + "$#"[again] + prose(rng, rng.randint(1, 60)))
                planted.append((length, again, len(before)))
    found = dict.fromkeys(lengths, 0)
    rows = {r["id"]: r["spans"] for r in repeated_stretches(docs_frame(spark, texts)).collect()}
    for i, (length, again, at) in enumerate(planted):
        if not again:
            assert not rows[i]
        else:
            found[length] += [(x["s"], x["e"]) for x in rows[i]] == [(at, at + length)]
    assert all(n == 150 for n in found.values()), found


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(13)
    passages = [prose(rng, 70) for _ in range(3)]
    texts = [f"{prose(rng, rng.randint(5, 150))} {rng.choice(passages)} {prose(rng, rng.randint(5, 150))}" for _ in range(25)] + [prose(rng, 120) for _ in range(10)] + ODD
    docs_frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in op5_chunk_dedup(spark, str(tmp_path)).collect()}
    assert sorted(rows) == list(range(len(texts)))
    table = gear_table()
    for i, spans in enumerate(brute(texts)):
        r, raw = rows[i], (texts[i] or "").encode()
        cuts = cut_points(np.frombuffer(raw, np.uint8), table)
        assert (r["n_chunks"], r["n_bytes"], r["n_spans"]) == (len(cuts), len(raw), len(spans)), i
        assert r["removed_bytes"] == sum(e - s for s, e in spans) and r["has_repeats"] == bool(spans)
        assert r["spans"] == ",".join(f"{s}:{e}" for s, e in spans)
        assert bool(r["n_repeated"]) == bool(spans) and r["n_repeated"] <= r["n_chunks"]
    assert sum(r["has_repeats"] for r in rows.values()) >= 20


def test_rows_that_share_an_id_but_not_the_text(spark):
    rng = random.Random(12)
    passage = prose(rng, 80)
    docs = docs_frame(spark, [passage + " x"], [(2, "short text"), (2, "y " + passage), (3, passage), (3, passage)]).withColumnRenamed("source", "weft_cut")
    rows = repeated_stretches(docs).collect()
    assert sorted((r["id"], len(r["spans"])) for r in rows) == [(0, 0), (2, 0), (2, 1), (3, 1), (3, 1)]
    assert all(x["e"] <= r["n_bytes"] for r in rows for x in r["spans"])
    out = without_repeats(docs)
    assert out.columns == docs.columns and out.count() == 5 and "short text" in [r["text"] for r in out.collect()]


def test_null_ids_and_empty_table(spark):
    text = prose(random.Random(1), 100)
    rows = repeated_stretches(docs_frame(spark, [text], [(None, text)])).collect()
    assert {str(r["id"]): bool(r["spans"]) for r in rows} == {"0": False, "None": True}
    assert repeated_stretches(docs_frame(spark, [])).count() == 0
