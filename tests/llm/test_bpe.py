import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.helpers import ODD, docs_frame, prose
from weft.llm.bpe import BytePairCodec, bpe_round_trip, load_vocabulary


def reference():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_codec_agrees_with_the_library_on_random_texts():
    rng, codec, other = random.Random(5), BytePairCodec(load_vocabulary()), reference()
    letters = "ab  \n\t'streLL0١²éß́ \xa0 　\x85\x1c字🙂.,!-<|endoftext|>‍\r"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        text += rng.choice(["", "", "<|endoftext|>", "   x", " "])
        ids = other.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids
        assert codec.decode(ids) == other.decode(ids, skip_special_tokens=False)


def test_decode_of_broken_bytes():
    codec, other = BytePairCodec(load_vocabulary()), reference()
    rng = random.Random(2)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 8))]
        assert codec.decode(ids) == other.decode(ids, skip_special_tokens=False)


def test_round_trip_of_rows(spark):
    rng = random.Random(1)
    texts = [*ODD, prose(rng, 5000), prose(rng, 20), prose(rng, 20)]
    docs = docs_frame(spark, texts, [(None, "no id"), (3, "again"), (3, "again")])
    out = bpe_round_trip(docs, load_vocabulary(), with_ids=True, with_text=True).collect()
    assert len(out) == docs.count()
    other = reference()
    for row, given in zip(out, docs.collect()):
        text = given["text"] or ""
        ids = other.encode(text, add_special_tokens=False).ids
        assert (row["doc_id"], row["n_tokens"], row["ids"], row["decoded"]) == (given["doc_id"], len(ids), ids, text)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table_and_clashing_names(spark):
    assert bpe_round_trip(docs_frame(spark, []), load_vocabulary()).count() == 0
    odd = docs_frame(spark, ["a"]).withColumnRenamed("lang", "n_tokens")
    assert bpe_round_trip(odd, load_vocabulary()).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    out = bpe_round_trip(odd, load_vocabulary(), keep=("doc_id", "n_tokens", "source"))
    assert out.columns == ["doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256"] and out.first()["n_tokens"] == 1
