"""Byte-level BPE encoding and decoding with a priority queue of merge ranks over a doubly linked symbol list."""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.common import map_batches, read, spare_name, text_bytes

#: Fixed values of the byte-level format: bytes that stand for themselves; the others follow from code point 256 on.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Fixed value: the Unicode White_Space characters.
SPACE = r"\t-\r \x85\xa0  -     　"
#: Fixed value: the split pattern of the byte-level format.
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Entries of a cache before it is emptied: bounds a worker's memory.
CACHE = 250_000
#: Bytes of pieces whose queue entries hold the place in 13 bits.
SHORT = 8_192


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary strings."""
    out, extra = [], 256
    own = set(PRINTABLE)
    for b in range(256):
        if b in own:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class BytePairCodec:
    """Encodes as the tokenizers library does with add_special_tokens=False, and decodes with skip_special_tokens=False.

    Special strings of the file that occur in a text become their own ids. `vocabulary` is the parsed JSON of a
    byte-level BPE file without a normaliser.
    """

    def __init__(self, vocabulary: dict):
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        vocab = vocabulary["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in vocabulary["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.strings: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.strings[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.strings[i] = token.encode()
        self.bytes_to_id = [vocab[c] for c in letters]
        # ranks of the pairs that begin with a symbol, by the second one
        self.rank: list[dict[int, int]] = [{} for _ in range(size)]
        self.made: list[int] = []
        for pair in vocabulary["model"]["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[left]].setdefault(vocab[right], len(self.made))
            self.made.append(vocab[left + right])
        ids = list(enumerate(self.bytes_to_id))
        self.first_rank = {(a, b): self.rank[i].get(j, -1) for a, i in ids for b, j in ids}
        # numbers of places, to be copied from; entries of pieces that fit stay small integers
        self.places = list(range(-1, SHORT + 1))
        self.split = regex.compile(SPLIT)
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        # a space between two characters that aren't white space always begins a piece
        self.safe = re.compile(rf"(?<=[^{SPACE}])(?= [^{SPACE}])")
        self.pieces: dict[str, list[int]] = {}
        self.after_space: dict[str, list[int]] = {}
        self.earlier: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece: the lowest rank merges first, of equal ranks the leftmost; stale queue entries are skipped.

        A queue entry holds a rank and the place of the pair's left symbol; it is stale once that place has another rank.
        """
        symbols = list(map(self.bytes_to_id.__getitem__, piece))
        n = len(symbols)
        if n < 2:
            return symbols
        made, rank_of = self.made, self.rank
        ranks = list(map(self.first_rank.__getitem__, zip(piece, piece[1:])))
        shift = 13 if n <= SHORT else 32
        queue = [r << shift | i for i, r in enumerate(ranks) if r >= 0]
        if not queue:
            return symbols
        ranks.append(-1)
        if n <= SHORT:
            after, before = self.places[2 : n + 2], self.places[:n]
        else:
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        mask = (1 << shift) - 1
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            entry = pop(queue)
            i, rank = entry & mask, entry >> shift
            if ranks[i] != rank:
                continue
            new = symbols[i] = made[rank]
            j = after[i]
            symbols[j] = ranks[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                ranks[i] = rank = rank_of[new].get(symbols[k], -1)
                if rank >= 0:
                    push(queue, rank << shift | i)
            else:
                ranks[i] = -1
            h = before[i]
            if h >= 0:
                ranks[h] = rank = rank_of[symbols[h]].get(new, -1)
                if rank >= 0:
                    push(queue, rank << shift | h)
        return [s for s in symbols if s >= 0]

    def chunk(self, text: str) -> list[int]:
        """The ids of a stretch that no piece crosses."""
        out: list[int] = []
        pieces = self.pieces
        for piece in self.split.findall(text):
            ids = pieces.get(piece)
            if ids is None:
                ids = self.merge(piece.encode())
                if len(piece) <= 32:
                    if len(pieces) >= CACHE:
                        pieces.clear()
                    pieces[piece] = ids
            out += ids
        return out

    def missing(self, part: str) -> list[int]:
        """The ids of a space and what follows it, which the newest cache doesn't hold."""
        ids = self.earlier.get(part)
        if ids is None:
            # a space and plain letters are one piece
            ids = self.merge(b" " + part.encode()) if part.isascii() and part.isalpha() else self.chunk(" " + part)
        if len(part) <= 32:
            if len(self.after_space) >= CACHE:
                self.earlier = dict(self.after_space)
                self.after_space.clear()
            self.after_space[part] = ids
        return ids

    def plain(self, text: str, out: list[int]) -> None:
        """Adds the ids of a text without special strings."""
        if not text:
            return
        if "  " in text:
            for part in self.safe.split(text):
                out += self.chunk(part)
            return
        first, *parts = text.split(" ")
        out += self.chunk(first)
        get, missing = self.after_space.get, self.missing
        for part in parts:
            out += get(part) or missing(part)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        at = 0
        for found in self.specials.finditer(text) if self.specials else ():
            self.plain(text[at : found.start()], out)
            out.append(self.special[found.group()])
            at = found.end()
        self.plain(text[at:], out)
        return out

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings in a row; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


def load_vocabulary(path: str | None = None) -> dict:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def bpe_round_trip(docs: DataFrame, vocabulary: dict, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False, with_text: bool = False, text_name: str = "decoded", rename: bool = False) -> DataFrame:
    """Per row: the kept columns, n_tokens, SHA-256 of the decimal ids joined by commas, SHA-256 of the decoded text.

    with_ids adds `ids` (array of int), with_text adds the decoded text as `text_name`. A null text counts as empty (no ids, digests of the
    empty string); rows are handled one by one, so repeated rows give repeated results, an empty table an empty one,
    and a text of any length is encoded whole. Columns other than `keep` and the text are not read. A kept column
    of a result's name, in any case of letters, gives way to the result; with `rename` it stays, and the result is called
    weft_ and its name. The vocabulary (a few MB, fixed by its file) is broadcast once.
    """
    results = [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")] + [("ids", "array<int>")] * with_ids + [(text_name, "string")] * with_text
    if rename:
        taken = {c.lower() for c in keep}
        results = [(spare_name([*keep], n) if n.lower() in taken else n, t) for n, t in results]
    keep = tuple(c for c in keep if c.lower() not in {n.lower() for n, _ in results})
    spark = docs.sparkSession
    # a worker process builds its codec once and keeps it, caches included, beside the broadcast value
    shared = spark.sparkContext.broadcast({"vocabulary": vocabulary})
    schema = T.StructType([*[docs.schema[c] for c in keep], *[T.StructField(n, T.DataType.fromDDL(t)) for n, t in results]])
    raw_text = spare_name([*keep], "text")

    def run(batches):
        state = shared.value
        if "codec" not in state:
            state["codec"] = BytePairCodec(state["vocabulary"])
        codec = state["codec"]
        digits = [str(i) for i in range(len(codec.strings))]
        for batch in batches:
            texts = text_bytes(batch.column(batch.num_columns - 1))
            n, first, second, all_ids, all_text = [], [], [], [], []
            for raw in texts:
                ids = codec.encode(raw.decode())
                decoded = b"".join(map(codec.strings.__getitem__, ids)).decode("utf-8", "replace")
                n.append(len(ids))
                first.append(hashlib.sha256(",".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                second.append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    all_ids.append(ids)
                if with_text:
                    all_text.append(decoded)
            columns = [*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
            if with_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
            if with_text:
                columns.append(pa.array(all_text, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *[n for n, _ in results]])

    return map_batches(docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias(raw_text)), run, schema)


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number of ids, digest of the ids and of the decoded text. Null texts are empty."""
    return bpe_round_trip(read(spark, sf_dir, "documents"), load_vocabulary())
