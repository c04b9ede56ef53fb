"""LM scoring: a causal self-attention model over subword ids, trained and run in numpy.

The probability of a subword is that of its class in its context, which attention gives, times that of the subword in
its class, which comes from counts over all training texts. A class holds either subwords that begin a word or subwords
inside a word, so attention also pays for where words end; inside a word the subword before is known to the counts too.
Class and subword probabilities each add to one, and so do their products over the vocabulary.
"""

from __future__ import annotations

import base64
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import held_out, map_batches, mix, read, ship, text_bytes, word_spans
from weft.session import materialize, parallelism

#: The free id of the vocabulary, used as end of a text and before its beginning; number of ids.
END, VOCABULARY = 50256, 50257
#: Classes of subwords, width of the model, of its hidden layer, and subwords with an input vector of their own.
CLASSES, WIDTH, HIDDEN, INPUTS = 64, 24, 32, 4096
#: Tokens that a window sees, and how far windows lie apart: all but a text's first score their last STRIDE tokens.
WINDOW, STRIDE = 32, 26
#: Windows that the driver begins with, and passes over them; subwords with a class of their choice, and those whose
#: neighbourhood tells which.
FIRST_WINDOWS, EPOCHS, SEEN, COMMON = 20_000, 3, 8192, 256
#: One in so many training texts moves the weights in each round, and as many rounds take all of them; windows that a
#: worker cuts at once.
ONE_IN, RUN_WINDOWS = 8, 1000
#: Windows that go through the network together while weights are learnt, and the pace of the first round.
TOGETHER, PACE = 24, 0.004
#: Gradients of one input row that are added up at a time.
EQUAL = 8
#: Words of a share of at least 1 / HEAVY of the training tokens (so at most HEAVY words) are broadcast with their counts.
HEAVY = 1_000_000
#: Likewise of pairs of subwords inside words, and how much a subword's share of its class weighs beside a pair's count.
HEAVY_PAIRS, PRIOR = 2_000_000, 4.0
CACHE = 400_000


def load_ranks(path: str | None = None) -> tuple[str, dict[bytes, int]]:
    """(split pattern, rank of each token) of a tiktoken vocabulary."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return public_tokenizers.PATTERN, {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Kept:
    """Subword ids of words, found by the hashes of the words: those in order, where each one's ids begin and their number."""

    def __init__(self):
        self.hashes, self.flat = np.zeros(0, np.uint64), np.zeros(0, "<u2")
        self.begin, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 where it isn't here."""
        if not len(self):
            return np.full(len(hashes), -1)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self) - 1)
        return np.where(self.hashes[place] == hashes, place, -1)

    def add(self, hashes: np.ndarray, flat: np.ndarray, n: np.ndarray) -> None:
        """hashes: in order, none of them here."""
        where = np.searchsorted(self.hashes, hashes)
        self.begin = np.insert(self.begin, where, len(self.flat) + np.cumsum(n) - n)
        self.hashes, self.n = np.insert(self.hashes, where, hashes), np.insert(self.n, where, n)
        self.flat = np.concatenate([self.flat, flat])


def taken(flat: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The stretches of flat that begin at `begin` and are n long, in a row."""
    return flat[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


class Subwords:
    """Subword ids of words, each encoded with a space before it. Keeps what it has seen, within bounds; words are told apart
    by their hashes."""

    def __init__(self, vocabulary: tuple[str, dict[bytes, int]]):
        import tiktoken

        self.encoder = tiktoken.Encoding("weft", pat_str=vocabulary[0], mergeable_ranks=vocabulary[1], special_tokens={})
        self.first = first_table(vocabulary[1])
        # ids of two bytes each
        self.known, self.earlier = Kept(), Kept()

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of words in a row, number of each one's), all encoded in one go: each begins with the one of its ids that has
        a space."""
        ids = np.array(self.encoder.encode_ordinary(" " + b" ".join(words).decode()), "<u2")
        begin = np.flatnonzero(self.first[ids])
        if len(begin) != len(words):
            alone = [np.array(self.encoder.encode_ordinary(" " + w.decode()), "<u2") for w in words]
            return np.concatenate(alone), np.array([len(x) for x in alone], np.int64)
        return ids, np.diff(np.append(begin, len(ids)))

    def ids(self, hashes: np.ndarray, data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, number of each one's) of words with distinct hashes in order, which stand in data."""
        known = self.known.find(hashes)
        missing = np.flatnonzero(known < 0)
        earlier = self.earlier.find(hashes[missing])
        new = missing[earlier < 0]
        found = self.encode([data[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())]) if len(new) else (np.zeros(0, "<u2"), np.zeros(0, np.int64))
        flat = np.concatenate([self.known.flat, self.earlier.flat, found[0]])
        begin, n = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        for at, kept, place, shift in ((known >= 0, self.known, known[known >= 0], 0), (missing[earlier >= 0], self.earlier, earlier[earlier >= 0], len(self.known.flat))):
            begin[at], n[at] = kept.begin[place] + shift, kept.n[place]
        begin[new], n[new] = len(flat) - len(found[0]) + np.cumsum(found[1]) - found[1], found[1]
        if len(self.known) + len(missing) > CACHE:
            self.earlier, self.known = self.known, Kept()
        keep = missing[(ends - starts)[missing] <= 64]
        self.known.add(hashes[keep], taken(flat, begin[keep], n[keep]), n[keep])
        return taken(flat, begin, n), n

    def packed(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of distinct words."""
        data, starts, ends, hashes, _ = word_spans([b" ".join(words)])
        order = np.argsort(hashes)
        flat, n = self.ids(hashes[order], data, starts[order], ends[order])
        cut = np.cumsum(n)
        return [flat[cut[i] - n[i] : cut[i]].tobytes() for i in np.argsort(order)]

    def word(self, word: bytes) -> list[int]:
        return np.frombuffer(self.packed([word])[0], "<u2").tolist()

    def batch(self, texts: list[bytes]) -> dict:
        """Words and subwords of the texts: hashes of the distinct words and how often each occurs, the subwords of each of
        them in a row, which of them the words of the texts are, and the number of words of each text."""
        data, starts, ends, hashes, counts = word_spans(texts)
        order = np.argsort(hashes)
        run = hashes[order]
        at = np.flatnonzero(np.append(True, run[1:] != run[:-1])[: len(run)])
        distinct, times, one = run[at], np.diff(np.append(at, len(run))), order[at]
        inverse = np.empty(len(run), np.int64)
        inverse[order] = np.repeat(np.arange(len(at)), times)
        flat, n = self.ids(distinct, data, starts[one], ends[one])
        return {"hashes": distinct, "times": times, "inverse": inverse, "counts": counts, "n": n, "flat": flat.astype(np.int32)}


def flat_ids(batch: dict) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, number of ids of each text)."""
    inverse, n = batch["inverse"], batch["n"]
    begin = np.cumsum(n) - n
    length = n[inverse]
    total = int(length.sum())
    at = np.repeat(begin[inverse] - (np.cumsum(length) - length), length) + np.arange(total)
    owner = np.repeat(np.arange(len(batch["counts"])), batch["counts"])
    return batch["flat"][at], np.bincount(owner, weights=length, minlength=len(batch["counts"])).astype(np.int64)


def inner_pairs(batch: dict) -> tuple[np.ndarray, np.ndarray]:
    """(is it a word's first, key of the pair with the subword before) of the flat subwords of distinct words."""
    n, flat = batch["n"], batch["flat"].astype(np.int64)
    first = np.zeros(len(flat), bool)
    first[(np.cumsum(n) - n)[n > 0]] = True
    return first, np.concatenate([[0], flat[:-1]])[: len(flat)] << 17 | flat


def first_table(ranks: dict[bytes, int]) -> np.ndarray:
    """Which ids begin a word: those that begin with a space, and END."""
    out = np.zeros(VOCABULARY, bool)
    out[[i for token, i in ranks.items() if token[:1] == b" "] + [END]] = True
    return out


def sequences(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, begins): END before each text as input, END after it as target, one text after the other."""
    sizes = lengths + 1
    begins = np.cumsum(sizes) - sizes
    # inserting at a text's first place puts END before it, at its last place behind it
    edge = np.cumsum(lengths)
    return np.insert(ids, edge - lengths, END), np.insert(ids, edge, END), begins


class Attention:
    """One head of causal self-attention with a rectified layer; gives logits of the classes."""

    NAMES = ("embed", "place", "wq", "wk", "wv", "wx", "wo", "b1", "u", "b2")

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)

        def draw(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.embed = (rng.standard_normal((INPUTS + CLASSES, WIDTH)) * 0.5).astype(np.float32)
        self.place = (rng.standard_normal((WINDOW, WIDTH)) * 0.05).astype(np.float32)
        self.wq, self.wk, self.wv = draw(WIDTH, WIDTH), draw(WIDTH, WIDTH), draw(WIDTH, WIDTH)
        self.wx, self.wo, self.b1 = draw(WIDTH, HIDDEN), draw(WIDTH, HIDDEN), np.zeros(HIDDEN, np.float32)
        self.u, self.b2 = draw(HIDDEN, CLASSES), np.zeros(CLASSES, np.float32)
        self.mask = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)

    def forward(self, rows: np.ndarray, skip: int = 0) -> dict:
        """Activations for windows of input rows; outputs only from place `skip` on."""
        b = len(rows)
        x = self.embed[rows] + self.place
        flat = x.reshape(-1, WIDTH)
        k = (flat @ self.wk).reshape(b, WINDOW, WIDTH)
        v = (flat @ self.wv).reshape(b, WINDOW, WIDTH)
        asked = x[:, skip:]
        q = (asked.reshape(-1, WIDTH) @ self.wq).reshape(b, WINDOW - skip, WIDTH)
        s = np.matmul(q, k.transpose(0, 2, 1))
        s *= np.float32(WIDTH**-0.5)
        s += self.mask[skip:]
        s -= s.max(axis=2, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(axis=2, keepdims=True)
        o = np.matmul(s, v)
        h = np.maximum(asked.reshape(-1, WIDTH) @ self.wx + o.reshape(-1, WIDTH) @ self.wo + self.b1, 0)
        z = h @ self.u + self.b2
        return {"x": x, "q": q, "k": k, "v": v, "s": s, "o": o, "h": h, "z": z}

    def step(self, rows: np.ndarray, classes: np.ndarray, valid: np.ndarray) -> tuple[float, dict]:
        """Mean loss over the valid places, and gradients."""
        slopes = Slopes(self)
        slopes.add(rows, classes, valid)
        n = max(slopes.count, 1)
        return slopes.loss / n, {k: x / n for k, x in slopes.gradients().items()}

    def train(self, rows: np.ndarray, classes: np.ndarray, valid: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.01, seed: int = 11) -> float:
        """Adam over shuffled batches of windows, its pace falling to 0; gives the last epoch's mean loss."""
        rng = np.random.default_rng(seed)
        adam = Adam(self.weights())
        steps, total, losses = 0, max(1, epochs * -(-len(rows) // batch)), [0.0]
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            losses = []
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                loss, g = self.step(rows[pick], classes[pick], valid[pick])
                losses.append(loss)
                steps += 1
                adam.step(g, rate * (1 - steps / (total + 1)))
        return float(np.mean(losses))

    def weights(self) -> dict[str, np.ndarray]:
        return {k: getattr(self, k) for k in self.NAMES}

    @classmethod
    def of(cls, weights: dict[str, np.ndarray]) -> Attention:
        out = cls.__new__(cls)
        out.__dict__.update({k: w.copy() for k, w in weights.items()})
        out.mask = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)
        return out


class Adam:
    """Steps of Adam on weights, in place."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights, self.steps = weights, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in weights.items()} for _ in range(2))

    def step(self, g: dict[str, np.ndarray], pace: float) -> None:
        self.steps += 1
        m, v = self.m, self.v
        for k, value in self.weights.items():
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            value -= (pace * (m[k] / (1 - 0.9**self.steps)) / (np.sqrt(v[k] / (1 - 0.99**self.steps)) + 1e-8)).astype(np.float32)


class Scorer:
    """The forward pass alone. What an input row and a place add to keys, values, queries and the layer is worked out once for
    each; values are those that the layer gets."""

    #: Columns of keys, values, queries and the layer.
    KEY, VALUE, QUERY, LAYER = slice(0, WIDTH), slice(WIDTH, WIDTH + HIDDEN), slice(WIDTH + HIDDEN, 2 * WIDTH + HIDDEN), slice(2 * WIDTH + HIDDEN, 2 * (WIDTH + HIDDEN))

    def __init__(self, net: Attention):
        self.kind = net.embed.dtype
        self.ways = np.concatenate([net.wk, net.wv @ net.wo, net.wq * self.kind.type(WIDTH**-0.5), net.wx], axis=1)
        self.of_row, self.of_place = net.embed @ self.ways, net.place @ self.ways
        self.of_place[:, self.LAYER] += net.b1
        self.seen = np.tril(np.ones((WINDOW, WINDOW), self.kind))
        self.u, self.b2 = net.u, net.b2
        self.ones = np.ones(max(WINDOW, CLASSES, TOGETHER), self.kind)
        # products of queries and keys are bounded by their lengths
        longest = [np.linalg.norm(self.of_row[:, c], axis=1).max() + np.linalg.norm(self.of_place[:, c], axis=1).max() for c in (self.QUERY, self.KEY)]
        self.bounded = bool(longest[0] * longest[1] < 60)

    def attend(self, rows: np.ndarray, skip: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(what rows and places give, weights of what is seen, 1 / their sums, their mean of values, the layer) for windows of
        input rows, all but the first from place `skip` on."""
        x = self.of_row.take(rows, axis=0)
        x += self.of_place
        s = np.matmul(x[:, skip:, self.QUERY], x[:, :, self.KEY].transpose(0, 2, 1))
        if not self.bounded:
            # far beyond what a trained model asks for, and still finite in single precision
            np.clip(s, -60, 60, out=s)
        np.exp(s, out=s)
        s *= self.seen[skip:]
        share = 1 / (s @ self.ones[:WINDOW])
        o = np.matmul(s, x[:, :, self.VALUE])
        o *= share[:, :, None]
        h = (o + x[:, skip:, self.LAYER]).reshape(-1, HIDDEN)
        np.maximum(h, 0, out=h)
        return x, s, share, o, h

    def outputs(self, h: np.ndarray) -> np.ndarray:
        """Class logits of the layer."""
        z = h @ self.u
        z += self.b2
        return np.clip(z, -60, 60, out=z)

    def logits(self, rows: np.ndarray, skip: int = 0) -> np.ndarray:
        """Class logits for windows of input rows, from place `skip` on."""
        return self.outputs(self.attend(rows, skip)[-1])


class Slopes(Scorer):
    """Gradients of windows added up. Those of what rows and places give are gathered by row and place, and become those of
    the weights at the end."""

    def __init__(self, net: Attention):
        super().__init__(net)
        self.net = net
        self.loss, self.count = 0.0, 0
        self.by_row, self.by_place = np.zeros(self.of_row.shape), np.zeros(self.of_place.shape)
        self.by_u, self.by_b2 = np.zeros(self.u.shape), np.zeros(self.b2.shape)
        self.room = self.of_row[:0]

    def add(self, rows: np.ndarray, classes: np.ndarray, valid: np.ndarray) -> None:
        """Adds the windows; places that aren't valid are no targets."""
        n = len(rows)
        if len(self.room) <= n * WINDOW:
            self.room = np.empty((n * WINDOW + 1, self.ways.shape[1]), self.kind)
        d = self.room[: n * WINDOW + 1]
        # a last row of zeros, see add_rows
        d[-1] = 0
        windows = d[:-1].reshape(n, WINDOW, d.shape[1])
        for at in range(0, n, TOGETHER):
            some = slice(at, at + TOGETHER)
            self._back(rows[some], classes[some], valid[some], windows[some])
            self.by_place += (self.ones[: len(windows[some])] @ windows[some].reshape(-1, self.by_place.size)).reshape(self.by_place.shape)
        add_rows(self.by_row, rows.ravel(), d)

    def _back(self, rows: np.ndarray, classes: np.ndarray, valid: np.ndarray, d: np.ndarray) -> None:
        """Fills d with the gradients of what the rows and places of windows give, and adds those of the outputs."""
        x, s, share, o, h = self.attend(rows)
        z = self.outputs(h)
        ok = valid.ravel().astype(self.kind)
        at = np.arange(0, z.size, CLASSES) + classes.ravel()
        hit = z.ravel().take(at)
        np.exp(z, out=z)
        total = z @ self.ones[:CLASSES]
        self.loss += float(ok @ (np.log(total) - hit))
        self.count += int(ok.sum())
        z *= (ok / total)[:, None]
        z.ravel()[at] -= ok
        self.by_u += h.T @ z
        self.by_b2 += np.ones(len(z), self.kind) @ z
        dh = z @ self.u.T
        dh *= h > 0
        dh = dh.reshape(o.shape)
        d[:, :, self.LAYER] = dh
        dh *= share[:, :, None]
        ds = np.matmul(dh, x[:, :, self.VALUE].transpose(0, 2, 1))
        # what a place adds to the output, less the mean over all that is seen
        ds -= ((dh * o) @ self.ones[:HIDDEN])[:, :, None]
        ds *= s
        d[:, :, self.QUERY] = np.matmul(ds, x[:, :, self.KEY])
        d[:, :, self.KEY] = np.matmul(ds.transpose(0, 2, 1), x[:, :, self.QUERY])
        d[:, :, self.VALUE] = np.matmul(s.transpose(0, 2, 1), dh)

    def gradients(self) -> dict[str, np.ndarray]:
        """The summed gradients of the weights."""
        net, scale = self.net, WIDTH**-0.5
        there = np.flatnonzero(self.by_row.any(axis=1))
        some = self.by_row[there]
        ways = net.embed[there].T @ some + net.place.T @ self.by_place
        value = ways[:, self.VALUE]
        embed = np.zeros(net.embed.shape)
        embed[there] = some @ self.ways.T
        return {
            "embed": embed, "place": self.by_place @ self.ways.T,
            "wq": ways[:, self.QUERY] * scale, "wk": ways[:, self.KEY], "wv": value @ net.wo.T, "wx": ways[:, self.LAYER],
            "wo": net.wv.T @ value, "b1": self.by_place[:, self.LAYER].sum(axis=0), "u": self.by_u, "b2": self.by_b2,
        }


def add_rows(total: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Adds values[i] to total[rows[i]]. values has one row more, of zeros: it fills each row's values up to whole groups of
    EQUAL, which are added up together."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    n = np.bincount(rows, minlength=len(total))
    there = np.flatnonzero(n)
    n = n[there]
    groups = -(-n // EQUAL)
    begin = np.cumsum(groups) - groups
    index = np.full(int(groups.sum()) * EQUAL, len(rows))
    index[np.repeat(begin * EQUAL - (np.cumsum(n) - n), n) + np.arange(len(rows))] = order
    step = 1024 * EQUAL
    added = [values.take(index[at : at + step], axis=0).reshape(-1, EQUAL, values.shape[1]).sum(axis=1) for at in range(0, len(index), step)]
    if added:
        total[there] += np.add.reduceat(np.concatenate(added), begin, axis=0)


def ranked(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the SEEN most frequent subwords but END in order of ids, the row of each subword among them, the column of each
    among the COMMON most frequent ones), -1 where it isn't among them."""
    order = np.argsort(-counts, kind="stable")
    seen = order[:SEEN]
    seen = np.sort(seen[(counts[seen] > 0) & (seen != END)])
    row, column = np.full(VOCABULARY, -1, np.int16), np.full(VOCABULARY, -1, np.int16)
    row[seen] = np.arange(len(seen))
    column[order[:COMMON]] = np.arange(COMMON)
    return seen, row, column


def neighbour_places(inputs: np.ndarray, targets: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """The place in the table of neighbours, a row for each subword and 2 * COMMON columns, of what precedes and what follows
    a subword."""
    out = []
    for a, b, shift in ((row[targets], column[inputs], 0), (row[inputs], column[targets], COMMON)):
        ok = np.flatnonzero((a >= 0) & (b >= 0))
        out.append(a[ok].astype(np.int32) * (2 * COMMON) + b[ok] + shift)
    return np.concatenate(out)


def word_classes(counts: np.ndarray, table: np.ndarray, is_first: np.ndarray) -> np.ndarray:
    """A class for each subword: those with like neighbours share one (k-means on damped, reduced neighbour counts).

    Subwords that begin a word and those inside a word have classes of their own. END has class 0 to itself; of either
    kind, those that aren't among the SEEN most frequent share one of the last two classes. table: see neighbour_places.
    """
    out = np.where(is_first, CLASSES - 2, CLASSES - 1)
    out[END] = 0
    seen = ranked(counts)[0]
    if len(seen) < 2:
        return out
    x = np.sqrt(table.reshape(len(seen), 2 * COMMON)).astype(np.float32)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)
    _, axes = np.linalg.eigh((x.T @ x).astype(np.float64))
    x = x @ axes[:, ::-1][:, :32]
    weight = np.sqrt(counts[seen]).astype(np.float64)
    spare = CLASSES - 3
    for kind, begin, most in ((True, 1, spare // 2), (False, 1 + spare // 2, spare - spare // 2)):
        at = np.flatnonzero(is_first[seen] == kind)
        k = min(most, len(at))
        if not k:
            continue
        y, w = x[at], weight[at]
        centres = y[np.argsort(-w, kind="stable")[:k]].copy()
        owner = np.zeros(len(y), np.int64)
        for _ in range(12):
            owner = ((centres**2).sum(1)[None, :] - 2 * y @ centres.T).argmin(axis=1)
            mass = np.bincount(owner, weights=w, minlength=k)
            for j in range(y.shape[1]):
                mean = np.bincount(owner, weights=w * y[:, j], minlength=k) / np.maximum(mass, 1e-9)
                centres[:, j] = np.where(mass > 0, mean, centres[:, j])
        out[seen[at]] = begin + owner
    return out


def cut_windows(begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end of its text, is it the text's first) of every window."""
    n = 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE))
    text = np.repeat(np.arange(len(sizes)), n)
    number = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return begins[text] + number * STRIDE, (begins + sizes)[text], number == 0


def look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is it there, its value or 0) for each wanted key among sorted ones."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), values.dtype)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    there = keys[place] == wanted
    return there, np.where(there, values[place], 0)


def in_class(model: dict, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log probability in its class of each id of texts in a row, places of the light pairs, their keys).

    A subword inside a word is known by the one before it: (count of the pair + PRIOR * share of the class) / (count of
    the subword before with the class + PRIOR). The value of a light pair, whose count isn't at hand, lacks the
    logarithm of the numerator. starts: where texts begin, where no pair ends.
    """
    out = model["within"][ids]
    inner = ~model["first"][ids]
    inner[starts[starts < len(ids)]] = False
    at = np.flatnonzero(inner)
    # ids are of 16 bits, so that a pair and its place are sorted as one number
    order = ids[at - 1].astype(np.uint64) << np.uint64(48) | ids[at].astype(np.uint64) << np.uint64(32) | np.arange(len(at), dtype=np.uint64)
    order.sort()
    pair, at = (order >> np.uint64(32)).astype(np.int64), at[(order & np.uint64(0xFFFFFFFF)).astype(np.int64)]
    edge = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])[: len(pair)])
    times = np.diff(np.append(edge, len(pair)))
    distinct = pair[edge] >> 16 << 17 | pair[edge] & 0xFFFF
    there, n = look_up(model["pairs"], model["pair_counts"], distinct)
    own = distinct & 0x1FFFF
    total = look_up(model["groups"], model["group_counts"], (distinct >> 17) * CLASSES + model["classes"][own])[1]
    light = ~there if model["light"] else np.zeros(len(distinct), bool)
    value = np.where(light, 0.0, np.log(n + PRIOR * np.exp(model["within"][own]))) - np.log(total + PRIOR)
    out[at] = np.repeat(value, times)
    which = np.repeat(light, times)
    return out, at[which], np.repeat(distinct[light], times[light])


def score_texts(model: dict, ids: np.ndarray, lengths: np.ndarray, given: np.ndarray, batch: int = 48) -> np.ndarray:
    """log10 probability of each text: every token is scored once, in a window that shows it what precedes it.

    given: each id's log probability in its class. Batches of windows are small, so that their activations stay in cache.
    """
    inputs, targets, begins = sequences(ids, lengths)
    sizes = lengths + 1
    within = np.insert(given, np.cumsum(lengths), model["within"][END])
    rows, classes = model["rows"][inputs], model["classes"][targets]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    start, end, first = cut_windows(begins, sizes)
    value = np.zeros(len(inputs))
    ones = np.ones(CLASSES, np.float32)
    steps = np.arange(WINDOW)
    for which, skip in ((first, 0), (~first, WINDOW - STRIDE)):
        s, e = start[which], end[which]
        for at in range(0, len(s), batch):
            places = s[at : at + batch, None] + steps
            ok = places < e[at : at + batch, None]
            places = np.minimum(places, len(rows) - 1)
            z = model["net"].logits(rows.take(places), skip)
            use = np.flatnonzero(ok[:, skip:])
            here = places[:, skip:].ravel().take(use)
            hit = z.ravel().take(use * CLASSES + classes.take(here))
            # logits are bounded, so their exponentials are finite
            np.exp(z, out=z)
            value[here] = hit - np.log((z @ ones).take(use))
    return np.bincount(owner, weights=value + within, minlength=len(sizes)) / np.log(10)


def sampled_windows(ids: np.ndarray, lengths: np.ndarray, keys: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(draw, inputs, targets, number of valid places) of the windows whose draw lies from `low` to below `high`. A window's
    draw, from 0 to 1, comes from its text's key and its place alone."""
    inputs, targets, begins = sequences(ids, lengths)
    start, end, first = cut_windows(begins, lengths + 1)
    number = (start - np.repeat(begins, np.diff(np.append(np.flatnonzero(first), len(first))))) // STRIDE
    text = np.cumsum(first) - 1
    with np.errstate(over="ignore"):
        draw = (mix(keys.astype(np.uint64)[text] + mix(number.astype(np.uint64) + np.uint64(1))) >> np.uint64(11)) / 2.0**53
    pick = np.flatnonzero((draw >= low) & (draw < high))
    places = np.minimum(start[pick, None] + np.arange(WINDOW), max(len(inputs) - 1, 0))
    return draw[pick], inputs[places].astype("<u2"), targets[places].astype("<u2"), np.minimum(end[pick] - start[pick], WINDOW).astype("<u2")


def fit_first(inputs: np.ndarray, targets: np.ndarray, valid: np.ndarray, is_first: np.ndarray, counts: np.ndarray | None = None, table: np.ndarray | None = None) -> dict:
    """Classes, input rows and first attention weights from windows. counts, table: how often each subword occurs and its
    neighbours do in all training texts; without them those of the windows."""
    if counts is None:
        ok = valid.ravel()
        flat_in, flat_out = inputs.ravel()[ok], targets.ravel()[ok]
        counts = np.bincount(flat_out, minlength=VOCABULARY)
        seen, row, column = ranked(counts)
        table = np.bincount(neighbour_places(flat_in, flat_out, row, column), minlength=len(seen) * 2 * COMMON)
    classes = word_classes(counts, table, is_first)
    # each text has END once before it and once behind it, so subwords are inputs as often as targets
    own = np.argsort(-counts, kind="stable")[:INPUTS]
    rows = INPUTS + classes
    rows[own] = np.arange(len(own))
    net = Attention()
    if len(inputs):
        net.train(rows[inputs], classes[targets], valid, EPOCHS)
    return {"net": net.weights(), "rows": rows, "classes": classes}


def complete(fitted: dict, subword_counts: np.ndarray, is_first: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray, groups: np.ndarray, group_counts: np.ndarray, light: bool) -> dict:
    """The model with each subword's log probability in its class, from counts over all training texts plus 1/2, the
    counts of heavy pairs, and those of all pairs by subword and class of the next. light: are there other pairs?"""
    classes = fitted["classes"]
    smooth = subword_counts + 0.5
    mass = np.bincount(classes, weights=smooth, minlength=CLASSES)
    return {
        "net": Scorer(Attention.of(fitted["net"])), "rows": fitted["rows"].astype(np.int32), "classes": classes.astype(np.int32), "within": np.log(smooth / mass[classes]),
        "first": is_first, "pairs": pairs, "pair_counts": pair_counts, "groups": groups, "group_counts": group_counts, "light": light,
    }


def _buckets(spark: SparkSession) -> int:
    return 1 << max(6, (parallelism(spark) - 1).bit_length())


def _cut_by_bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket of sorted hashes begins: a bucket is a range of hashes."""
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    return np.searchsorted(hashes >> shift, np.arange(buckets + 1, dtype=np.uint64))


def encode_corpus(rows: DataFrame, vocabulary_state, buckets: int) -> DataFrame:
    """The texts of rows (id, t, learn, k) as subwords and distinct words, and counts over those with `learn`.

    A row of bucket -2 for each text: id, learn, k, n (words), toks (subwords), h and c (hashes of distinct words, how
    often each occurs), packed. Rows of counts have them in ch and cc: of words with a bucket from 0 on, of pairs of
    subwords inside words from `buckets` on, of subwords with bucket -1.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        state = vocabulary_state.value
        if "subwords" not in state:
            state["subwords"] = Subwords(state["vocabulary"])
        subwords = state["subwords"]
        units = np.zeros(VOCABULARY, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        held_pairs: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0
        names = ["bucket", "id", "learn", "k", "n", "toks", "h", "c", "ch", "cc"]

        def counts_batch(id_type, at, ch, cc):
            n = len(at)
            binary = pa.nulls(n, pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.nulls(n, id_type), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), binary, binary, binary, pa.array(ch, pa.binary()), pa.array(cc, pa.binary())], names=names)

        def flush(id_type, held, shift: int, first: int):
            """Rows of a bucket each, numbered from `first` on; pairs are dealt by a range of their keys."""
            h = np.concatenate([x for x, _ in held])
            c = np.concatenate([x for _, x in held])
            held.clear()
            h, inverse = np.unique(h, return_inverse=True)
            c = np.bincount(inverse, weights=c).astype(np.int64)
            cut = _cut_by_bucket(h << np.uint64(shift), buckets)
            at = [b for b in range(buckets) if cut[b + 1] > cut[b]]
            return counts_batch(id_type, [first + b for b in at], [h[cut[b] : cut[b + 1]].tobytes() for b in at], [c[cut[b] : cut[b + 1]].tobytes() for b in at])

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field(0).type
            texts = text_bytes(batch.column(1))
            learn = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            found = subwords.batch(texts)
            ids, lengths = flat_ids(found)
            counts, n = found["counts"], len(texts)
            owner = np.repeat(np.arange(n), counts)
            pair = owner * max(len(found["hashes"]), 1) + found["inverse"]
            pair, times = np.unique(pair, return_counts=True)
            word, doc = pair % max(len(found["hashes"]), 1), pair // max(len(found["hashes"]), 1)
            h = found["hashes"][word]
            cut = np.searchsorted(doc, np.arange(n + 1)).tolist()
            edge = np.concatenate([[0], np.cumsum(lengths)]).tolist()
            short, times4 = ids.astype("<u2"), times.astype("<i4")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, -2, np.int32)), batch.column(0), batch.column(2), batch.column(3), pa.array(counts, pa.int64()),
                    pa.array([short[a:b].tobytes() for a, b in zip(edge, edge[1:])], pa.binary()),
                    pa.array([h[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()), pa.array([times4[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                    pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()),
                ],
                names=names,
            )
            if not learn.any():
                continue
            times = np.bincount(word[learn[doc]], weights=times[learn[doc]], minlength=len(found["hashes"])).astype(np.int64)
            spread = np.repeat(times, found["n"])
            units += np.bincount(found["flat"], weights=spread, minlength=VOCABULARY).astype(np.int64)
            units[END] += int(learn.sum())
            some = times > 0
            held.append((found["hashes"][some], times[some]))
            first, key = inner_pairs(found)
            use = ~first & (spread > 0)
            inner, place = np.unique(key[use], return_inverse=True)
            held_pairs.append((inner.astype(np.uint64), np.bincount(place, weights=spread[use], minlength=len(inner))))
            waiting += int(some.sum())
            if waiting > 1_500_000:
                yield flush(id_type, held, 0, 0)
                yield flush(id_type, held_pairs, 30, buckets)
                waiting = 0
        if held:
            yield flush(id_type, held, 0, 0)
            yield flush(id_type, held_pairs, 30, buckets)
        if units.any():
            yield counts_batch(id_type, [-1], [b""], [units.tobytes()])

    return materialize(map_batches(rows, run, f"bucket int, id {kind}, learn boolean, k bigint, n bigint, toks binary, h binary, c binary, ch binary, cc binary"))


def merge_counts(encoded: DataFrame) -> DataFrame:
    """(bucket, h, c, v, n): sorted keys and counts of each bucket, packed, their number and sum."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["h"]])
        c = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["c"]])
        h, inverse = np.unique(h, return_inverse=True)
        c = np.bincount(inverse, weights=c).astype(np.int64)
        return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "h": [h.tobytes()], "c": [c.tobytes()], "v": [len(h)], "n": [int(c.sum())]})

    ship()
    rows = encoded.where("bucket >= 0").select("bucket", F.col("ch").alias("h"), F.col("cc").alias("c"))
    return materialize(rows.groupBy("bucket").applyInPandas(merge, "bucket int, h binary, c binary, v bigint, n bigint"))


def _added(rows: DataFrame, kind: str) -> np.ndarray | None:
    """The sum of the packed arrays of (b), in each task first and in a few tasks after; None without any."""

    def add_up(batches):
        total = None
        for batch in batches:
            for x in batch.column(0).to_pylist():
                x = np.frombuffer(x, kind)
                total = x.copy() if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["b"])

    partial = map_batches(map_batches(rows, add_up, "b binary").repartition(8), add_up, "b binary").collect()
    return np.sum([np.frombuffer(r["b"], kind) for r in partial], axis=0) if partial else None


def pair_groups(pairs: DataFrame, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys in order, counts) of all pairs by subword and class of the next: at most VOCABULARY * CLASSES of them."""
    shared = pairs.sparkSession.sparkContext.broadcast(classes)

    def run(batches):
        for batch in batches:
            for h, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                key = np.frombuffer(h, np.uint64).astype(np.int64)
                group, inverse = np.unique((key >> 17) * CLASSES + shared.value[key & 0x1FFFF], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array([group.tobytes()], pa.binary()), pa.array([np.bincount(inverse, weights=np.frombuffer(c, np.int64)).astype(np.int64).tobytes()], pa.binary())], names=["g", "n"])

    rows = map_batches(pairs.select("h", "c"), run, "g binary, n binary").collect()
    group = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(r["g"], np.int64) for r in rows]])
    n = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(r["n"], np.int64) for r in rows]])
    group, inverse = np.unique(group, return_inverse=True)
    return group, np.bincount(inverse, weights=n, minlength=len(group)).astype(np.int64)


def _learnt(encoded: DataFrame) -> DataFrame:
    """The training texts in a few partitions for each core, so that what a partition adds up doesn't grow with the corpus."""
    return encoded.where("bucket = -2 and learn").coalesce(4 * encoded.sparkSession.sparkContext.defaultParallelism)


def neighbour_table(encoded: DataFrame, counts: np.ndarray) -> np.ndarray:
    """The table of neighbours (see neighbour_places) of all training texts. Slices of rows are added up in a task each."""
    seen, row, column = ranked(counts)
    size, slice_size = len(seen) * 2 * COMMON, 256 * 2 * COMMON
    shared = encoded.sparkSession.sparkContext.broadcast((row, column))

    def run(batches):
        row, column = shared.value
        total = np.zeros(size, np.int64)
        held: list[np.ndarray] = []

        def add_up():
            places = np.concatenate(held)
            held.clear()
            return np.bincount(places, minlength=size)

        for batch in batches:
            # END stands before, between and behind texts
            stream = np.concatenate([np.array([END], "<u2"), *(y for x in batch.column(0).to_pylist() for y in (np.frombuffer(x, "<u2"), np.array([END], "<u2")))])
            held.append(neighbour_places(stream[:-1], stream[1:], row, column))
            if sum(map(len, held)) > 4_000_000:
                total += add_up()
        if held:
            total += add_up()
        cut = [(i, np.flatnonzero(total[i * slice_size : (i + 1) * slice_size]).astype(np.int32)) for i in range(-(-size // slice_size))]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in cut], pa.int32()), pa.array([at.tobytes() for _, at in cut], pa.binary()), pa.array([total[i * slice_size + at].tobytes() for i, at in cut], pa.binary())], names=["slice", "at", "n"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(slice_size, np.int64)
        for at, c in zip(pdf["at"], pdf["n"]):
            n[np.frombuffer(at, np.int32)] += np.frombuffer(c, np.int64)
        at = np.flatnonzero(n).astype(np.int32)
        return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "at": [at.tobytes()], "n": [n[at].tobytes()]})

    schema = "slice int, at binary, n binary"
    found = map_batches(_learnt(encoded).select("toks"), run, schema)
    ship()
    out = np.zeros(size, np.int64)
    for r in found.groupBy("slice").applyInPandas(merge, schema).collect():
        out[r["slice"] * slice_size + np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["n"], np.int64)
    return out


def _windows(encoded: DataFrame, high: float) -> DataFrame:
    """(d, i, t, n): the training windows whose draws lie below high, packed."""

    def run(batches):
        for batch in batches:
            toks = [np.frombuffer(x, "<u2") for x in batch.column(0).to_pylist()]
            if not toks:
                continue
            lengths = np.array([len(x) for x in toks], np.int64)
            found = sampled_windows(np.concatenate(toks).astype(np.int32), lengths, batch.column(1).to_numpy(), 0.0, high)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in found], names=["d", "i", "t", "n"])

    return map_batches(encoded.where("bucket = -2 and learn").select("toks", "k"), run, "d binary, i binary, t binary, n binary")


def _unpacked(d, i, t, n) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(draws, inputs, targets, valid places) of packed windows, in order of their draws."""
    draw, n = np.frombuffer(b"".join(d)), np.frombuffer(b"".join(n), "<u2")
    i, t = (np.frombuffer(b"".join(x), "<u2").reshape(-1, WINDOW) for x in (i, t))
    order = np.lexsort((i[:, -1], i[:, 0], draw)) if len(draw) else np.zeros(0, np.int64)
    return draw[order], i[order], t[order], np.arange(WINDOW) < n[order, None]


def all_windows(ids: np.ndarray, lengths: np.ndarray):
    """(inputs, targets, valid places) of windows of texts end to end, at most RUN_WINDOWS at once: each subword and each
    end is the target of one place."""
    inputs, targets, begins = sequences(ids, lengths)
    sizes = lengths + 1
    n = -(-sizes // WINDOW)
    start = np.repeat(begins, n) + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
    end = np.repeat(begins + sizes, n)
    for at in range(0, len(start), RUN_WINDOWS):
        places = start[at : at + RUN_WINDOWS, None] + np.arange(WINDOW)
        ok = places < end[at : at + RUN_WINDOWS, None]
        places = np.minimum(places, len(inputs) - 1)
        yield inputs[places], targets[places], ok


def added_slopes(texts: DataFrame, net: dict, fixed) -> np.ndarray | None:
    """The gradients of all windows of texts (toks) added up, in a row in the order of Attention.NAMES, then the number of
    targets; None without texts. fixed: a broadcast of (rows, classes)."""
    shared = texts.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        slopes, (rows, classes) = Slopes(Attention.of(shared.value)), fixed.value
        for batch in batches:
            toks = [np.frombuffer(x, "<u2") for x in batch.column(0).to_pylist()]
            if not toks:
                continue
            for inputs, targets, ok in all_windows(np.concatenate(toks).astype(np.int32), np.array([len(x) for x in toks], np.int64)):
                slopes.add(rows[inputs], classes[targets], ok)
        if slopes.count:
            g = slopes.gradients()
            yield pa.RecordBatch.from_arrays([pa.array([np.append(np.concatenate([g[k].ravel() for k in Attention.NAMES]), slopes.count).tobytes()], pa.binary())], names=["b"])

    return _added(map_batches(texts, run, "b binary"), "<f8")


def fit_model(encoded: DataFrame, subword_counts: np.ndarray, is_first: np.ndarray) -> dict:
    """Classes and attention weights.

    Classes and the subwords with an input vector of their own come from counts over all training texts. FIRST_WINDOWS
    windows, drawn by hash, give weights to begin with on the driver. Then all training texts move them: in each of ONE_IN
    rounds, executors add up the gradients of the texts whose hashes leave the round's number, each subword and end once, and
    Adam takes a step along their mean. Sums don't depend on how the rows lie in files.
    """
    # about as many windows as there are strides, and one more for each text
    n_windows = int(subword_counts.sum()) // STRIDE + int(subword_counts[END])
    rows = _windows(encoded, min(1.0, FIRST_WINDOWS / max(n_windows, 1))).collect()
    _, inputs, targets, valid = _unpacked(*([r[c] for r in rows] for c in ("d", "i", "t", "n")))
    fitted = fit_first(inputs, targets, valid, is_first, subword_counts, neighbour_table(encoded, subword_counts))
    fixed = encoded.sparkSession.sparkContext.broadcast((fitted["rows"].astype(np.uint16), fitted["classes"].astype(np.uint8)))
    texts, adam = _learnt(encoded), Adam(fitted["net"])
    for k in range(ONE_IN):
        total = added_slopes(texts.where(F.pmod("k", F.lit(ONE_IN)) == k).select("toks"), fitted["net"], fixed)
        if total is None:
            continue
        mean, at, g = total[:-1] / total[-1], 0, {}
        for name in Attention.NAMES:
            shape = fitted["net"][name].shape
            g[name] = mean[at : at + math.prod(shape)].reshape(shape)
            at += math.prod(shape)
        adam.step(g, PACE * (1 - k / ONE_IN))
    return fitted


def _heavy(table: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys in order, counts) of a packed table's entries that count `least` or more: total / least of them at most."""

    def pick(batches):
        for batch in batches:
            for h, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h, c = np.frombuffer(h, np.uint64), np.frombuffer(c, np.int64)
                ok = c >= least
                yield pa.RecordBatch.from_arrays([pa.array([h[ok].tobytes()], pa.binary()), pa.array([c[ok].tobytes()], pa.binary())], names=["h", "c"])

    rows = map_batches(table.select("h", "c"), pick, "h binary, c binary").collect()
    h = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(r["h"], np.uint64) for r in rows]])
    c = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(r["c"], np.int64) for r in rows]])
    order = np.argsort(h)
    return h[order], c[order]


def score_documents(docs: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", vocabulary: tuple | None = None) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for every row of docs, learnt from the rows for which `learn`
    is true (all of them without it).

    Tokens are words (A-Z in lower case) and one end for each text; a null text is empty and has its end only. n_known
    counts tokens that the training texts hold, base_score adds log10((c + 1) / (N + V + 1)) over the tokens, score is
    the attention model's log10 probability of the text's subwords and end. Words, subwords, pairs of subwords and the
    base counts come from all training texts, and so do the classes and the attention weights (see fit_model). Each row
    gives a row, also with null or repeated ids; without training texts every token is unknown. Words are told apart
    by 64-bit hashes. A text is split into words and subwords once.

    Counts of words that make up 1 / HEAVY of the training tokens or more, so HEAVY words at most, are broadcast, and
    likewise those of pairs; the others meet their counts in buckets, in packed arrays, so that no word is a row.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or load_ranks()
    is_first = first_table(vocabulary[1])
    state = spark.sparkContext.broadcast({"vocabulary": vocabulary})
    buckets = _buckets(spark)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"), F.coalesce(F.lit(True) if learn is None else learn, F.lit(False)).alias("learn"))
    encoded = encode_corpus(rows.withColumn("k", F.xxhash64("id", "t")), state, buckets)
    merged = merge_counts(encoded)
    words, pairs = merged.where(F.col("bucket") < buckets), merged.where(F.col("bucket") >= buckets)
    totals = words.agg(F.sum("v").alias("v"), F.sum("n").alias("n")).first()
    subword_counts = _added(encoded.where("bucket = -1").select(F.col("cc").alias("b")), "<i8")
    if subword_counts is None:
        subword_counts = np.zeros(VOCABULARY, np.int64)
    ends = int(subword_counts[END])
    n_train = int(totals["n"] or 0) + ends
    distinct = int(totals["v"] or 0) + (ends > 0)
    least = max(1, -(-n_train // HEAVY))

    heavy_h, heavy_c = _heavy(words, least)
    n_pairs = int(pairs.agg(F.sum("n").alias("n")).first()["n"] or 0)
    least_pairs = max(1, -(-n_pairs // HEAVY_PAIRS))
    pair_h, pair_c = _heavy(pairs, least_pairs)
    fitted = fit_model(encoded, subword_counts, is_first)
    groups, group_c = pair_groups(pairs, fitted["classes"])
    shared = spark.sparkContext.broadcast(
        {"fitted": fitted, "subword_counts": subword_counts, "first": is_first, "h": heavy_h, "c": heavy_c, "pairs": pair_h.astype(np.int64), "pair_counts": pair_c, "groups": groups, "group_counts": group_c, "light": least_pairs > 1}
    )
    log_all = float(np.log10(n_train + distinct + 1))
    end_score = float(np.log10(ends + 1)) - log_all
    kind = docs.schema[id_col].dataType.simpleString()

    def model_of(state: dict) -> dict:
        if "model" not in state:
            state["model"] = complete(*(state[k] for k in ("fitted", "subword_counts", "first", "pairs", "pair_counts", "groups", "group_counts", "light")))
        return state["model"]

    def run(batches):
        state = shared.value
        model, known_h, known_c = model_of(state), state["h"], state["c"]
        part = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            n = batch.num_rows
            if not n:
                continue
            key = part << 32 | number
            toks, hs, cs = ([np.frombuffer(x, k) for x in batch.column(i).to_pylist()] for i, k in ((2, "<u2"), (3, np.uint64), (4, "<i4")))
            lengths = np.array([len(x) for x in toks], np.int64)
            ids = np.concatenate(toks).astype(np.int32)
            given, at_light, key_light = in_class(model, ids, np.cumsum(lengths) - lengths)
            score = score_texts(model, ids, lengths, given)
            h, times = np.concatenate(hs), np.concatenate(cs)
            owner = np.repeat(np.arange(n), [len(x) for x in hs])
            is_heavy, c = look_up(known_h, known_c, h)
            base = np.bincount(owner, weights=np.where(is_heavy, times * (np.log10(c + 1.0) - log_all), 0.0), minlength=n) + end_score
            known = np.bincount(owner, weights=times * is_heavy, minlength=n).astype(np.int64) + (ends > 0)
            out = []
            light = ~is_heavy if least > 1 else is_heavy & False
            if least == 1:
                # all words are at hand: the others are unknown
                base += np.bincount(owner, weights=np.where(is_heavy, 0.0, -log_all * times), minlength=n)
            for first, k, d, t, shift in (
                (0, h[light], owner[light], times[light], 0),
                (buckets, key_light.astype(np.uint64), np.searchsorted(np.cumsum(lengths), at_light, "right"), np.ones(len(at_light), np.int32), 30),
            ):
                order = np.argsort(k, kind="stable")
                k, d, t = k[order], d[order].astype(np.int32), t[order].astype(np.int32)
                cut = _cut_by_bucket(k << np.uint64(shift), buckets)
                out += [(first + b, *(x[cut[b] : cut[b + 1]].tobytes() for x in (k, d, t))) for b in range(buckets) if cut[b + 1] > cut[b]]
            m, none = len(out), pa.nulls
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([key] * (n + m), pa.int64()),
                    pa.array([-1] * n + [x[0] for x in out], pa.int32()),
                    pa.concat_arrays([pa.array(np.arange(n), pa.int32()), none(m, pa.int32())]),
                    pa.concat_arrays([batch.column(0), none(m, batch.column(0).type)]),
                    pa.concat_arrays([pa.array(batch.column(1).to_numpy() + 1, pa.int64()), none(m, pa.int64())]),
                    pa.concat_arrays([pa.array(known, pa.int64()), none(m, pa.int64())]),
                    pa.concat_arrays([pa.array(base, pa.float64()), none(m, pa.float64())]),
                    pa.concat_arrays([pa.array(score, pa.float64()), none(m, pa.float64())]),
                    *(pa.concat_arrays([none(n, pa.binary()), pa.array([x[i] for x in out], pa.binary())]) for i in (1, 2, 3)),
                ],
                names=["key", "bucket", "i", "id", "n_tokens", "known", "base", "score", "h", "d", "t"],
            )

    schema = f"key bigint, bucket int, i int, id {kind}, n_tokens bigint, known bigint, base double, score double, h binary, d binary, t binary"
    # written once: the keys of batches below stay what they are
    scored = materialize(map_batches(encoded.where("bucket = -2").select("id", "n", "toks", "h", "c"), run, schema))

    def meet(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        counts_h = np.frombuffer(right["h"].iloc[0], np.uint64) if len(right) else np.zeros(0, np.uint64)
        counts_c = np.frombuffer(right["c"].iloc[0], np.int64) if len(right) else np.zeros(0, np.int64)
        of_words = key[0] < buckets
        within = None if of_words else model_of(shared.value)["within"]
        docs_out, base_out, known_out = [], [], []
        for h, d, t in zip(left["h"], left["d"], left["t"]):
            h, d, t = np.frombuffer(h, np.uint64), np.frombuffer(d, np.int32), np.frombuffer(t, np.int32)
            c = look_up(counts_h, counts_c, h)[1]
            at, where = np.unique(d, return_inverse=True)
            value = np.log10(c + 1.0) - log_all if of_words else np.log10(c + PRIOR * np.exp(within[(h & np.uint64(0x1FFFF)).astype(np.int64)]))
            base_out.append(np.bincount(where, weights=t * value, minlength=len(at)).tobytes())
            known_out.append(np.bincount(where, weights=t * (c > 0), minlength=len(at)).astype(np.int32).tobytes())
            docs_out.append(at.tobytes())
        return pd.DataFrame({"key": left["key"], "words": of_words, "d": docs_out, "b": base_out, "k": known_out})

    ship()
    packed = scored.where("bucket >= 0").select("bucket", "key", "h", "d", "t")
    looked = packed.groupBy("bucket").cogroup(merged.select("bucket", "h", "c").groupBy("bucket")).applyInPandas(meet, "key bigint, words boolean, d binary, b binary, k binary")

    def put_together(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("i", kind="stable")
        base, known, score = (left[c].to_numpy(copy=True) for c in ("base", "known", "score"))
        for of_words, d, b, k in zip(right["words"], right["d"], right["b"], right["k"]):
            at = np.frombuffer(d, np.int32)
            if of_words:
                base[at] += np.frombuffer(b, np.float64)
                known[at] += np.frombuffer(k, np.int32)
            else:
                score[at] += np.frombuffer(b, np.float64)
        return pd.DataFrame({"id": left["id"], "n_tokens": left["n_tokens"], "n_known": known, "base_score": base, "score": score})

    heads = scored.where("bucket < 0").select("key", "i", "id", "n_tokens", "known", "base", "score")
    out = heads.groupBy("key").cogroup(looked.groupBy("key")).applyInPandas(put_together, f"id {kind}, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select("id", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")


def op3_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: is it held out, its counts of tokens, base score and the model's score. Null texts are empty."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = score_documents(docs, ~held_out("doc_id", 7))
    return found.select(F.col("id").alias("doc_id"), held_out("id", 7).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
