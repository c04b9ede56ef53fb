import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, texts, extra=()):
    """documents from texts; ids are places. extra: (id, text) rows to add."""
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(i, t, None, None, None) for i, t in extra]
    return spark.createDataFrame(rows, DOCS)


def prose(rng: random.Random, n: int) -> str:
    parts = "an be co da ed fi go ha in ju ke lo mi no or pu ra se ti un ve wo".split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


#: Texts that every operator must take: null, empty, white space, one word, a very long word, odd characters.
ODD = [None, "", " \t\n ", "word", "x" * 5000, "é̈字 🙂 \x00 \x1f  end", "a b\r\nc\x0bd"]
