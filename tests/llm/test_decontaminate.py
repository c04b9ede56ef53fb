import random
import time

import numpy as np

from tests.llm.helpers import ODD, docs_frame, prose
from weft.llm import decontaminate
from weft.llm.decontaminate import banded_distance, drop_leaked, leaks_of


def codes(s):
    return np.frombuffer(s.encode("utf-32-le"), np.uint32)


def brute_distance(pattern, text, first, last):
    best = None
    row = [(0, j) if first <= j <= last else (10**9, j) for j in range(len(text) + 1)]
    for i, c in enumerate(pattern):
        new = [(row[0][0] + 1, row[0][1])]
        for j in range(1, len(text) + 1):
            new.append(min((row[j - 1][0] + (text[j - 1] != c), row[j - 1][1]), (row[j][0] + 1, row[j][1]), (new[j - 1][0] + 1, new[j - 1][1])))
        row = new
    for j, (d, _) in enumerate(row):
        if best is None or d < best:
            best = d
    return best


def test_banded_distance_against_the_full_table():
    rng = random.Random(2)
    for _ in range(200):
        pattern = "".join(rng.choice("abc") for _ in range(rng.randint(5, 25)))
        words = list(pattern)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(words))
            words[k : k + 1] = rng.choice([[], ["a"], [words[k], "b"]])
            if not words:
                words = ["a"]
        before = "".join(rng.choice("abc") for _ in range(rng.randint(0, 10)))
        text = before + "".join(words) + "".join(rng.choice("abc") for _ in range(rng.randint(0, 10)))
        at = len(before)
        got = banded_distance(codes(pattern), codes(text), at, at, 3)
        full = brute_distance(pattern, text, at, at)
        if full <= 3:
            assert got is not None and got[0] == full
            assert brute_distance(pattern, text[got[1] : got[2]], 0, 0) <= full + 1
        else:
            assert got is None


def make(rng):
    bench = [prose(rng, rng.randint(12, 60)) for _ in range(25)] + ["short one", None, ""]
    texts, truth = [], []
    for i in range(60):
        body, own = [prose(rng, rng.randint(0, 80))], []
        for _ in range(rng.choice([0, 0, 1, 2])):
            k = rng.randrange(25)
            passage = list(bench[k])
            kind = rng.choice(["exact", "edits", "case"])
            if kind == "edits":
                for _ in range(max(1, len(passage) // 60)):
                    passage[rng.randrange(len(passage))] = rng.choice("xyz")
            passage = "".join(passage)
            if kind == "case":
                passage = passage.upper().replace(" ", " \n")
            body += [passage, prose(rng, rng.randint(0, 60))]
            own.append(k)
        texts.append(" ".join(body))
        truth.append(sorted(set(own)))
    return bench, texts, truth


def test_planted_passages_are_found_and_others_are_not(spark):
    rng = random.Random(7)
    bench, texts, truth = make(rng)
    docs = docs_frame(spark, texts + ODD, [(None, bench[0]), (0, texts[0])])
    benchmark = spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")
    rows = leaks_of(docs, benchmark).collect()
    assert len(rows) == docs.count()
    for r in rows:
        got = sorted({x["item"] for x in r["leaks"]})
        if r["id"] is None:
            assert got == [0]
        elif r["id"] < len(texts):
            assert got == truth[r["id"]]
            for x in r["leaks"]:
                passage = " ".join(texts[r["id"]][x["start"] : x["end"]].lower().split())
                assert brute_distance(passage, bench[x["item"]].lower(), 0, 0) <= x["edits"] + 2
        else:
            assert got == []
    kept = {r["doc_id"] for r in drop_leaked(docs, benchmark).collect()}
    assert kept == {i for i, t in enumerate(truth) if not t} | set(range(len(texts), len(texts) + len(ODD)))


def test_benchmark_in_blocks(spark, monkeypatch):
    rng = random.Random(8)
    bench, texts, truth = make(rng)
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 3000)
    docs = docs_frame(spark, texts)
    benchmark = spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")
    rows = leaks_of(docs, benchmark).collect()
    assert {r["id"]: sorted({x["item"] for x in r["leaks"]}) for r in rows} == dict(enumerate(truth))
    assert {r["doc_id"] for r in drop_leaked(docs, benchmark).collect()} == {i for i, t in enumerate(truth) if not t}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert leaks_of(docs_frame(spark, ["a"]), none).collect()[0]["leaks"] == []
    assert drop_leaked(docs_frame(spark, ["a"]), none).count() == 1
    some = spark.createDataFrame([(1, prose(random.Random(1), 30))], "item_id long, text string")
    assert leaks_of(docs_frame(spark, []), some).count() == 0


def best_in(pattern, text):
    """The fewest edits that turn the pattern into some part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        new = [i + 1]
        for j in range(1, len(text) + 1):
            new.append(min(row[j - 1] + (text[j - 1] != c), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_all_items_against_all_texts():
    rng = random.Random(21)
    words = ["ab", "cde", "fg", "hijk", "lm", "nop", "---", "=="]
    items = [" ".join(rng.choice(words) for _ in range(rng.randint(12, 30))) for _ in range(14)] + ["-" * 60, "ab " * 25, "ab cde " * 9]
    index = decontaminate.PassageIndex(list(enumerate(items)), 12, 0.05, 40)
    at_least = 0
    for _ in range(60):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))
        for k in rng.sample(range(len(items)), rng.randint(0, 2)):
            passage = list(items[k])
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(passage))
                passage[at : at + 1] = rng.choice([[], ["q"], [passage[at], "z"]])
            text += " " + "".join(passage) + " " + " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))
        plain, _ = decontaminate.normalise(codes(text), index.lower)
        got = {k for k, *_ in index.leaks(plain)}
        text = "".join(map(chr, plain))
        expected = {k for k in range(len(index.ids)) if best_in("".join(map(chr, index.codes[k])), text) <= index.budget[k]}
        assert got == expected
        at_least += len(got)
    assert at_least > 40


def test_short_items_stand_as_whole_words():
    items = [(0, "the long road"), (1, "a b"), (2, "Ein Käse 12345")]
    index = decontaminate.PassageIndex(items, 12, 0.05, 40)
    found = lambda text: sorted(index.ids[k] for k, *_ in index.leaks(decontaminate.normalise(codes(text), index.lower)[0]))
    assert found("on the long  ROAD.") == [0] and found("bathe long road") == found("the long roads") == []
    assert found("the long roads, the long road") == [0] and found("a b") == [] and found("ein käse 12345") == [2]


def test_repetitive_texts_take_time_in_proportion():
    items = [(0, "-" * 300), (1, "-" * 150 + "x" + "-" * 150)]
    index = decontaminate.PassageIndex(items, 12, 0.05, 40)
    began = time.process_time()
    found = index.leaks(codes("-" * 100_000))
    assert {index.ids[k]: e for k, _, _, e in found} == {0: 0, 1: 1}
    assert time.process_time() - began < 10


def test_rows_that_share_an_id_keep_their_own_leaks(spark, monkeypatch):
    rng = random.Random(3)
    bench = [prose(rng, 30), prose(rng, 30)]
    docs = docs_frame(spark, [], [(7, bench[0]), (7, bench[1]), (7, "clean"), (None, bench[1])])
    benchmark = spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")
    for size in (10**6, 10):
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", size)
        assert sorted((str(r["id"]), [x["item"] for x in r["leaks"]]) for r in leaks_of(docs, benchmark).collect()) == [("7", []), ("7", [0]), ("7", [1]), ("None", [1])]
        assert [r["text"] for r in drop_leaked(docs, benchmark).collect()] == ["clean"]
