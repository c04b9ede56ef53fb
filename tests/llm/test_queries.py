"""Every corpus query on a small folder, its columns held against brute force; two against SQL on a driver's table."""

import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tests.llm.helpers import ODD, docs_frame, prose
from weft.llm import lm
from weft.llm.bpe import load_vocabulary
from weft.llm.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    expected = con.sql(ORACLE[name])
    place = [expected.columns.index(c) for c in columns]
    assert sorted(map(repr, map(tuple, found.select(*columns).collect()))) == sorted(repr(tuple(r[i] for i in place)) for r in expected.fetchall())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents with odd rows, repeated and null ids; labels."""
    rng = random.Random(77)
    texts = [prose(rng, rng.randint(1, 80)) for _ in range(60)] + ODD
    path = tmp_path_factory.mktemp("sf")
    docs_frame(spark, texts, [(None, texts[0]), (3, texts[4]), (3, texts[4]), (5, None)]).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def rows_of(spark, folder):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def remainder(i, parts):
    return None if i is None else zlib.crc32(str(i).encode()) % parts


def test_op3_columns(spark, folder, monkeypatch):
    monkeypatch.setattr(lm, "FIRST_WINDOWS", 300)
    monkeypatch.setattr(lm, "EPOCHS", 1)
    docs = rows_of(spark, folder)
    tokens = [(i, [*t.encode().lower().split(), None]) for i, t in docs]
    c = Counter(w for i, x in tokens if remainder(i, 7) != 2 for w in x)
    n, v = sum(c.values()), len(c)
    expected = sorted((str(i), remainder(i, 7) == 2, len(x), sum(c[w] > 0 for w in x), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x), 6)) for i, x in tokens)
    found = QUERIES["op3_attention_scores"](spark, folder).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == expected
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)


def test_op7_columns(spark, folder):
    found = QUERIES["op7_quality_votes"](spark, folder).collect()
    assert sorted((str(r["doc_id"]), r["held_out"]) for r in found) == sorted((str(i), remainder(i, 4) == 2) for i, _ in rows_of(spark, folder))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in found)


def test_op9_columns(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = []
    for i, t in rows_of(spark, folder):
        ids = library.encode(t, add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        expected.append((str(i), len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), back))))
    found = QUERIES["op9_bpe_round_trip"](spark, folder).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found) == sorted(expected)
    assert load_vocabulary()["model"]["type"] == "BPE"


def test_op6_columns(spark, tmp_path):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((12, 8))
    vectors = [(base[i % 12] + 0.25 * rng.standard_normal(8)).tolist() for i in range(90)]
    vectors += [None, [], [0.0] * 8, [math.nan] + [1.0] * 7, [math.inf] + [1.0] * 7, [None] + [1.0] * 7, vectors[3], [2 * x for x in vectors[4]], [1.0] * 5, [1e300] * 8, [1e-300] * 8]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    ok = {i: np.array(v) / np.abs(v).max() for i, v in enumerate(vectors) if v and None not in v and np.isfinite(v).all() and np.any(v)}
    near = {i: {j for j in ok if j != i and len(ok[j]) == len(ok[i]) and ok[i] @ ok[j] / np.sqrt((ok[i] @ ok[i]) * (ok[j] @ ok[j])) >= 0.9} for i in ok}
    expected = []
    for i in range(len(vectors)):
        seen, todo = {i}, [i]
        while todo:
            more = near.get(todo.pop(), set()) - seen
            seen |= more
            todo += more
        expected.append((i, len(near.get(i, ())), min(seen), i == min(seen)))
    found = QUERIES["op6_cover_tree"](spark, str(tmp_path)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in found) == expected


def test_op4_columns(spark, tmp_path):
    rng = random.Random(8)
    bodies = [[prose(rng, 20) for _ in range(3)] for _ in range(10)]
    page = lambda b: f"<html><body><nav>x</nav><article>{''.join(f'<p>{x}</p>' for x in b)}</article><footer>f</footer></body></html>"
    rows = [(i, f"https://h{i % 2}.example.com/{i}", page(b)) for i, b in enumerate(bodies)] + [(10, None, None), (None, "u", "<p>é🙂</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    expected = [(str(i), rows[i][1], "\n".join(b), len("\n".join(b))) for i, b in enumerate(bodies)] + [("10", None, "", 0), ("None", "u", "é🙂", 2)]
    found = QUERIES["op4_host_suffixes"](spark, str(tmp_path)).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(((str(r["page_id"]), r["url"], r["text"], r["n_chars"]) for r in found), key=key) == sorted(expected, key=key)


def test_op1_columns(spark, tmp_path):
    rng = random.Random(15)
    # items of 40 characters and more, of 12 to 39, and of under 12, which aren't looked for
    items = [prose(rng, 14) for _ in range(8)] + [prose(rng, 4)[:30].strip() for _ in range(3)] + ["a b c", "", None]
    texts = [prose(rng, rng.randint(0, 60)) for _ in range(20)]
    for _ in range(22):
        i = rng.randrange(20)
        texts[i] = f"{texts[i]} {rng.choice(items[:11])} {prose(rng, rng.randint(1, 20))}".strip()
    docs = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, items[0]), (30, None), (31, ""), (32, "a b c")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    expected = []
    for i, t in docs:
        padded = f" {t or ''} "
        spans = sorted((a, k, a + len(item)) for k, item in enumerate(items) if item and len(item) >= 12 for a in range(len(t or "")) if padded[a : a + len(item) + 2] == f" {item} ")
        expected.append((i, bool(spans), len(spans), sorted({k for _, k, _ in spans}), ",".join(f"{k}:{a}:{b}:0" for a, k, b in spans)))
    found = QUERIES["op1_decontaminate"](spark, str(tmp_path)).select("doc_id", "contaminated", "n_leaks", "item_ids", "spans").collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))
    assert sum(x[1] for x in expected) > 8
