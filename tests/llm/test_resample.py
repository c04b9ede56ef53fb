import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tests.llm.helpers import ODD, docs_frame, prose
from weft.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text, width):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return [" ".join(words[i : i + k]) for k in range(1, width + 1) for i in range(len(words) - k + 1)]


def brute(docs, targets, width=1, buckets=10_000, least=20, percent=10):
    def place(f):
        return zlib.crc32(f.encode()) % buckets

    s, t = (Counter(place(f) for x in texts for f in runs(x, width)) for texts in ([x for _, x in docs], targets))
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for i, text in docs:
        gains = [math.floor(1000 * math.log((t[place(f)] + 1) * (s_all + buckets) / ((s[place(f)] + 1) * (t_all + buckets)))) for f in runs(text, width)]
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = math.floor(sum(gains) / len(gains)) if gains else 0
        out.append([i, len(gains), len(runs(text, 1)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in out if r[2] >= least), key=lambda r: (-r[4], math.inf if r[0] is None else r[0], r[1]))
    for place_, r in enumerate(able[: len(able) * percent // 100]):
        r[5] = place_ + 1
    return sorted(map(repr, map(tuple, out)))


@pytest.fixture
def texts():
    rng = random.Random(4)
    return [prose(rng, rng.randint(1, 60)).title() + ", Ünïcode ß1 42." * (i % 2) for i in range(150)] + ODD + ["deep " * 30_000]


@pytest.mark.parametrize("width,nodes", [(1, 1_000_000), (3, 1_000_000), (2, 50)])
def test_equals_brute_force(spark, texts, monkeypatch, width, nodes):
    monkeypatch.setattr(resample, "TRIE_NODES", nodes)
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (3, texts[3]), (3, texts[3]), (5, None)]
    targets = [texts[3], texts[8], "other words here", None]
    found = resample.resample(docs_frame(spark, texts, docs[len(texts) :]), spark.createDataFrame([(t,) for t in targets], "text string"), width=width, percent=30)
    assert sorted(repr(tuple(r)) for r in found.select("doc_id", "n_features", "n_words", "weight", "score", "rank").collect()) == brute(docs, targets, width, percent=30)


def test_small_tables(spark):
    none = docs_frame(spark, [])
    assert resample.resample(none, none).collect() == []
    row = resample.resample(docs_frame(spark, ["a b c"]), none).collect()[0]
    assert (row["n_features"], row["rank"]) == (3, None)


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", 2.5, "x", "y")], "id long, text string, weft_text double, falling string, __part string")
    row = resample.importance_weights(docs, [7] * 10).collect()[0]
    assert (row["weft_text"], row["falling"], row["weight"], row["n_words"]) == (2.5, "x", 7, 2)


def test_trie_goes_on_from_states():
    trie = resample.WordTrie(3, 1 << 30)
    words = b"one two three two".split()
    trie.add(Counter(trie.paths(words)))
    node = trie.root
    for k, word in enumerate(words[:3], 1):
        node = node.kids[word]
        assert node.crc == zlib.crc32(b" ".join(words[:k])) and node.count == 1
    assert trie.root.kids[b"two"].count == 2
    assert sum(trie.totals()) == resample.n_runs(4, 3) == 9
