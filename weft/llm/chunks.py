"""Substring deduplication by content-defined chunks cut with a gear rolling hash."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import FILTER_KEYS, lists, map_batches, maybe_in, mix, read, spare_name, text_bytes
from weft.session import materialize

#: Bytes that decide a gear hash.
GEAR = 32
#: Of so many places in a row the one with the least hash is a cut, so chunks have half as many bytes on average. A passage
#: of GEAR - 1 + 2 * WINDOW bytes, one less than RUN, holds two cuts that don't depend on what surrounds it, and so a whole
#: chunk: no exact copy of RUN bytes is missed, unless its hashes repeat within a window.
WINDOW = 64
#: A repeated stretch is removed if it holds so many bytes in a row, about 25 words; less may be chance.
RUN = 160
#: Bytes on both sides of a stretch that are held against those of its first occurrence: cuts near its ends needn't agree.
#: A window within a copy has a cut, at most a window late where hashes repeat, and a digest needs GEAR bytes before that.
SIDE = GEAR + 3 * WINDOW


def gear_table() -> np.ndarray:
    """256 random 32-bit values."""
    return (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def gear_hash(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: h = (h << 1) + table[byte] modulo 2**32, which only the last 32 bytes decide.

    Sums over 1, 2, 4, .. 32 bytes are doubled, so that all places are hashed at once.
    """
    h = table[data]
    width = 1
    with np.errstate(over="ignore"):
        while width < 32 and width < len(data):
            longer = h.copy()
            longer[width:] += h[:-width] << np.uint32(width)
            h, width = longer, width * 2
    return h


def cut_points(data: np.ndarray, table: np.ndarray, window: int = WINDOW) -> list[int]:
    """Ends of the chunks. A cut is the last place with the least hash of some `window` places in a row: bytes further away
    than that never move it, and no chunk is longer than the window, but for those between repetitions. Where least hashes
    repeat within a window, as in a run of one letter, only the first of them is a cut."""
    n = len(data)
    if n < GEAR - 1 + window:
        return [n] if n else []
    h = gear_hash(data, table)[GEAR - 1 :].astype(np.uint64)
    # by hash, then from the last place on
    top = np.uint64(2**32 - 1)
    key = h << np.uint64(32) | (top - np.arange(len(h), dtype=np.uint64))
    # least of each window: of the end of one block and the beginning of the next
    blocks = np.concatenate([key, np.full(-len(key) % window, np.iinfo(np.uint64).max)]).reshape(-1, window)
    begins = np.minimum.accumulate(blocks, axis=1).ravel()
    ends = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(ends[: len(key) - window + 1], begins[window - 1 : len(key)])
    places = (top - (np.unique(least[np.flatnonzero(np.diff(least, prepend=least[0] + np.uint64(1)))]) & top)).astype(np.int64)
    places.sort()
    out: list[int] = []
    last = -1
    for at, value in zip((places + GEAR).tolist(), h[places].tolist()):
        if value == last and at - out[-1] < window:
            continue
        out.append(at)
        last = value
    if not out or out[-1] < n:
        out.append(n)
    return out


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, t): h is a hash of the text; (id, h) stands for a row, as rows that agree in both are the same document."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    return rows.select("id", F.xxhash64(F.coalesce("t", F.lit(""))).alias("h"), "t")


def chunk_table(rows: DataFrame, window: int) -> DataFrame:
    """(id, h, ends, d1, d2) per row of (id, h, t): the chunks' ends in bytes and their 96-bit digests as a long and an int.
    A digest is of a chunk and the GEAR bytes before it, which its first cut comes from, so that no digest is of a few bytes."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        table = gear_table()
        blake = hashlib.blake2b
        for batch in batches:
            ends, counts, digests = [], [], []
            for text in text_bytes(batch.column(2)):
                cuts = cut_points(np.frombuffer(text, np.uint8), table, window)
                counts.append(len(cuts))
                ends += cuts
                at = 0
                for end in cuts:
                    digests.append(blake(text[max(at - GEAR, 0) : end], digest_size=12).digest())
                    at = end
            halves = np.frombuffer(b"".join(digests), [("d1", "<i8"), ("d2", "<i4")])
            n = np.array(counts, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], lists(np.array(ends, np.int32), n, pa.int32()), lists(np.ascontiguousarray(halves["d1"]), n, pa.int64()), lists(np.ascontiguousarray(halves["d2"]), n, pa.int32())],
                names=["id", "h", "ends", "d1", "d2"],
            )

    return map_batches(rows, run, f"id {kind}, h bigint, ends array<int>, d1 array<bigint>, d2 array<int>")


def _edges(rows: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(id, h, n, left, bytes): what lies next to chunk n, from `wanted` (id, h, n, left): SIDE bytes before it, or
    after it. Only texts with something wanted are shuffled."""
    kind = rows.schema["id"].dataType.simpleString()
    asked = materialize(wanted.groupBy("id", "h").agg(F.collect_set(F.struct("n", "left")).alias("ask")))
    some = rows.where("t is not null")
    if asked.limit(FILTER_KEYS + 1).count() <= FILTER_KEYS:
        some = maybe_in(some, asked.select("h"), "h", "maybe").where("maybe").select("id", "h", "t")
    asked = asked.select(F.col("id").alias("i"), F.col("h").alias("g"), "ask")
    some = some.join(asked, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g"))).select("id", "h", "t", "ask")

    def run(batches):
        table = gear_table()
        for batch in batches:
            at, ns, lefts, parts = [], [], [], []
            for i, (text, ask) in enumerate(zip(text_bytes(batch.column(2)), batch.column(3).to_pylist())):
                ends = [0, *cut_points(np.frombuffer(text, np.uint8), table, window)]
                for x in ask:
                    n = x["n"]
                    at.append(i)
                    ns.append(n)
                    lefts.append(x["left"])
                    parts.append(text[max(ends[n] - SIDE, 0) : ends[n]] if x["left"] else text[ends[n + 1] : ends[n + 1] + SIDE])
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(ns, pa.int32()), pa.array(lefts, pa.bool_()), pa.array(parts, pa.binary())], names=["id", "h", "n", "left", "bytes"])

    # repeated rows ask the same
    return map_batches(some, run, f"id {kind}, h bigint, n int, left boolean, bytes binary").dropDuplicates(["id", "h", "n", "left"])


def shared_length(a: bytes, b: bytes, at_end: bool) -> int:
    """How many bytes a and b have in common at their ends, or at their beginnings."""
    n = min(len(a), len(b))
    if not n:
        return 0
    x, y = (np.frombuffer(v[len(v) - n :][::-1] if at_end else v[:n], np.uint8) for v in (a, b))
    differ = np.flatnonzero(x != y)
    return int(differ[0]) if len(differ) else n


def repeated_stretches(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, run: int = RUN
) -> DataFrame:
    """(id, h, n_chunks, n_bytes, n_repeated, spans): each row's stretches that occurred before. h is a hash of the text.

    A chunk occurs before if an equal one (by digest) is in a row of smaller id or earlier in the same text; the first
    occurrence always stays. Neighbouring repeated chunks form a stretch, which is then held byte by byte against its
    first occurrence, SIDE bytes to both sides of it, so that a passage counts whole although chunks cross its ends.
    Stretches of under `run` bytes are left, as short ones may be chance; n_repeated counts the chunks of the others. spans: (start, end) in bytes of the UTF-8 text, by start. A null text is empty and has no
    chunks; rows with a null id come after all others; rows that share an id and the text count as one place.
    """
    rows = _rows(docs, id_col, text_col)
    table = materialize(chunk_table(rows, window))
    chunk = table.select("id", "h", F.posexplode(F.arrays_zip("d1", "d2")).alias("n", "c")).select("id", "h", "n", "c.d1", "c.d2")
    # ids that are null come last
    place = F.struct(F.col("id").isNull().alias("z"), "id", "h", "n")
    firsts = chunk.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("k"), F.min(place).alias("first")).where("k > 1").select("d1", "d2", "first")
    again = chunk.join(firsts, ["d1", "d2"]).where(place != F.col("first")).select("id", "h", "n", F.struct("first.id", "first.h", "first.n").alias("f"))
    per_row = again.groupBy("id", "h").agg(F.array_sort(F.collect_set(F.struct("n", "f"))).alias("c"))
    runs = materialize(map_runs(per_row, docs.schema[id_col].dataType.simpleString()))
    sides = runs.select("id", "h", F.explode("runs").alias("r"))
    left = sides.where("r.open_left").select("id", "h", F.col("r.a").alias("n"), F.lit(True).alias("left"), F.col("r.fid").alias("fid"), F.col("r.fh").alias("fh"), F.col("r.fa").alias("fn"))
    right = sides.where("r.open_right").select("id", "h", F.col("r.b").alias("n"), F.lit(False).alias("left"), F.col("r.fid").alias("fid"), F.col("r.fh").alias("fh"), F.col("r.fb").alias("fn"))
    ends = materialize(left.union(right))
    wanted = ends.select("id", "h", "n", "left").union(ends.select(F.col("fid").alias("id"), F.col("fh").alias("h"), F.col("fn").alias("n"), "left"))
    edges = materialize(_edges(rows, wanted, window))
    kind = docs.schema[id_col].dataType.simpleString()
    own = edges.select(F.col("id").alias("i"), F.col("h").alias("g"), F.col("n").alias("m"), F.col("left").alias("l"), F.col("bytes").alias("x"))
    first = edges.select(F.col("id").alias("i2"), F.col("h").alias("g2"), F.col("n").alias("m2"), F.col("left").alias("l2"), F.col("bytes").alias("y"))
    both = ends.join(own, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")) & (F.col("n") == F.col("m")) & (F.col("left") == F.col("l")))
    both = both.join(first, F.col("fid").eqNullSafe(F.col("i2")) & (F.col("fh") == F.col("g2")) & (F.col("fn") == F.col("m2")) & (F.col("left") == F.col("l2")))

    def compare(batches):
        for batch in batches:
            shared = [shared_length(a, b, at_end) for at_end, a, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(shared, pa.int32())], names=["id", "h", "n", "left", "more"])

    longer = map_batches(both.select("id", "h", "n", "left", "x", "y"), compare, f"id {kind}, h bigint, n int, left boolean, more int")
    longer = longer.where("more > 0").groupBy("id", "h").agg(F.collect_list(F.struct("n", "left", "more")).alias("more"))
    found = runs.select(F.col("id").alias("i"), F.col("h").alias("g"), "runs").join(longer.select(F.col("id").alias("i2"), F.col("h").alias("g2"), "more"), F.col("i").eqNullSafe(F.col("i2")) & (F.col("g") == F.col("g2")), "left")
    found = found.select("i", "g", F.expr("transform(runs, r -> struct(r.a as a, r.b as b, r.own as own))").alias("runs"), "more")
    out = table.select("id", "h", "ends").join(found, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")), "left").select("id", "h", "ends", "runs", "more")
    spans_type = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))

    def join_up(batches):
        for batch in batches:
            n_chunks, n_bytes, n_repeated, spans = [], [], [], []
            for ends, chunk_runs, more in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                cuts = [0, *ends]
                extra = {(x["n"], x["left"]): x["more"] for x in more or ()}
                whole: list[list[int]] = []
                for r in chunk_runs or ():
                    s, e = cuts[r["a"]], cuts[r["b"] + 1]
                    # in the same text the first occurrence may not grow into the stretch
                    room = s - cuts[r["own"] + 1] if r["own"] >= 0 else cuts[-1]
                    before = min(extra.get((r["a"], True), 0), room)
                    s, e = s - before, e + min(extra.get((r["b"], False), 0), room - before)
                    if whole and s <= whole[-1][1]:
                        whole[-1][1:] = [max(e, whole[-1][1]), whole[-1][2] + r["b"] - r["a"] + 1]
                    else:
                        whole.append([s, e, r["b"] - r["a"] + 1])
                kept = [x for x in whole if x[1] - x[0] >= run]
                n_chunks.append(len(ends))
                n_bytes.append(cuts[-1])
                n_repeated.append(sum(x[2] for x in kept))
                spans.append([{"s": s, "e": e} for s, e, _ in kept])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(x, pa.int64()) for x in (n_chunks, n_bytes, n_repeated)), pa.array(spans, spans_type)], names=["id", "h", "n_chunks", "n_bytes", "n_repeated", "spans"])

    return map_batches(out, join_up, f"id {kind}, h bigint, n_chunks bigint, n_bytes bigint, n_repeated bigint, spans array<struct<s:int,e:int>>")


def map_runs(per_row: DataFrame, kind: str) -> DataFrame:
    """(id, h, runs) from (id, h, c: repeated chunks with their first occurrences, in order): runs of neighbouring chunks
    whose first occurrences are neighbours as well, whether a side has no repeated chunk next to it, and as `own` the last
    chunk of the first occurrence if that is in the same text, else -1."""
    parts = [("a", "int"), ("b", "int"), ("fid", kind), ("fh", "bigint"), ("fa", "int"), ("fb", "int"), ("open_left", "boolean"), ("open_right", "boolean"), ("own", "int")]

    def run(batches):
        for batch in batches:
            out = []
            for i, h, chunks in zip(*(c.to_pylist() for c in batch.columns)):
                runs: list[dict] = []
                for x in chunks:
                    n, f = x["n"], x["f"]
                    last = runs[-1] if runs else None
                    if last and last["b"] + 1 == n and last["fid"] == f["id"] and last["fh"] == f["h"] and last["fb"] + 1 == f["n"]:
                        last["b"], last["fb"] = n, f["n"]
                    else:
                        touching = last is not None and last["b"] + 1 == n
                        if touching:
                            last["open_right"] = False
                        runs.append({"a": n, "b": n, "fid": f["id"], "fh": f["h"], "fa": f["n"], "fb": f["n"], "open_left": not touching, "open_right": True})
                for r in runs:
                    r["own"] = r["fb"] if (r["fid"], r["fh"]) == (i, h) else -1
                out.append(runs)
            field = batch.schema.field(2).type.value_type.field("f").type.field("id").type
            types = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}
            kinds = pa.list_(pa.struct([(name, field if name == "fid" else types[sql]) for name, sql in parts]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, kinds)], names=["id", "h", "runs"])

    return map_batches(per_row, run, f"id {kind}, h bigint, runs array<struct<{','.join(f'{n}:{t}' for n, t in parts)}>>")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """docs with the repeated stretches cut out of their texts; rows and columns stay as they are, null texts null.

    Ends that fall inside a character move inwards, so that what is left is UTF-8. Texts with stretches are shuffled.
    """
    found = repeated_stretches(docs, id_col, text_col, **options).where("size(spans) > 0").dropDuplicates(["id", "h"])
    i, g, cut = (spare_name(docs.columns, x) for x in ("i", "g", "cut"))
    found = found.select(F.col("id").alias(i), F.col("h").alias(g), F.col("spans").alias(cut))
    hashed = F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    out = docs.join(found, F.col(f"`{id_col}`").eqNullSafe(F.col(i)) & (hashed == F.col(g)), "left").select(*[F.col(f"`{c}`") for c in docs.columns], cut)
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = batch.column(place).cast(pa.binary()).to_pylist()
            for k, spans in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                for x in reversed(spans or ()):
                    s, e = x["s"], x["e"]
                    while s < e and texts[k][s] & 0xC0 == 0x80:
                        s += 1
                    while e > s and e < len(texts[k]) and texts[k][e] & 0xC0 == 0x80:
                        e -= 1
                    texts[k] = texts[k][:s] + texts[k][e:]
            columns = batch.columns[:-1]
            columns[place] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return map_batches(out, run, docs.schema)


def op5_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its chunks, bytes and repeated chunks, and the stretches that occurred before (start:end in bytes)."""
    found = repeated_stretches(read(spark, sf_dir, "documents"))
    gone = F.expr("aggregate(spans, 0L, (a, x) -> a + x.e - x.s)")
    return found.select(
        F.col("id").alias("doc_id"), "n_chunks", "n_bytes", "n_repeated",
        F.size("spans").cast("long").alias("n_spans"), gone.alias("removed_bytes"), (F.size("spans") > 0).alias("has_repeats"),
        F.expr("array_join(transform(spans, x -> concat_ws(':', x.s, x.e)), ',')").alias("spans"),
    )
