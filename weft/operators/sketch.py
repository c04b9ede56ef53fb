"""A mergeable sketch of the ranks of strings: built in each task, merged in a tree, with a bound of its own error.

Keys lie in levels; one of level h stands for 2**h keys. A full level is sorted and every other key goes up, first those at
even places, then those at odd ones. That moves any rank by at most 2**h, and the sketch adds this up: `error` bounds how
far any of its ranks is off, in the worst case and not only probably. With room for k keys a level, n keys cost at most about
n / k * log2(n / k).
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame

from weft.session import ship

#: Keys of a level, and sketches that are merged in one task.
ROOM, FAN_IN = 2_048, 32

SCHEMA = "error long, levels array<array<string>>"


class KeySketch:
    def __init__(self, room: int = ROOM):
        self.room, self.error = room, 0
        self.levels: list[list[str]] = [[]]
        self._odd: list[bool] = [False]

    @property
    def n(self) -> int:
        return sum(len(keys) << h for h, keys in enumerate(self.levels))

    def add(self, keys: list[str], level: int = 0) -> None:
        """Takes keys, each for 2**level."""
        while len(self.levels) <= level:
            self.levels.append([])
            self._odd.append(False)
        for i in range(0, len(keys), self.room):
            self.levels[level] += keys[i : i + self.room]
            self._settle(level)

    def _settle(self, level: int) -> None:
        while level < len(self.levels) and len(self.levels[level]) > self.room:
            keys = sorted(self.levels[level])
            # an odd one out stays
            rest = [keys.pop()] if len(keys) % 2 else []
            up = keys[1 if self._odd[level] else 0 :: 2]
            self._odd[level] = not self._odd[level]
            self.error += 1 << level
            self.levels[level] = rest
            if level + 1 == len(self.levels):
                self.levels.append([])
                self._odd.append(False)
            level += 1
            self.levels[level] += up

    def merge(self, error: int, levels: list[list[str]]) -> None:
        self.error += error
        for h, keys in enumerate(levels):
            self.add(keys, h)

    def ranked(self) -> tuple[list[str], list[int]]:
        """(keys in order, keys that are at most each, by the sketch)."""
        items = sorted((k, 1 << h) for h, keys in enumerate(self.levels) for k in keys)
        return [k for k, _ in items], list(accumulate(w for _, w in items))

    def quantiles(self, parts: int) -> list[str]:
        """The keys at about places int(i / parts * n), i = 1 .. parts - 1; each is off by `error` places at most."""
        keys, upto = self.ranked()
        return [keys[bisect_right(upto, int(i / parts * self.n))] for i in range(1, parts)] if keys else []

    def bracket(self, place: int) -> tuple[str | None, str | None]:
        """(low, high): keys between which, both included, the key at `place` (from 0) surely lies; None for no end.

        A key's count in the sketch differs from its true one by `error` at most.
        """
        keys, upto = self.ranked()
        # at most `place` keys are <= low's predecessor; more than `place` are <= high
        low = bisect_right(upto, place - self.error) - 1
        high = bisect_right(upto, place + self.error)
        return (keys[low] if low >= 0 else None, keys[high] if high < len(keys) else None)


def _row(sketch: KeySketch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([sketch.error], pa.int64()), pa.array([sketch.levels], pa.list_(pa.list_(pa.string())))], names=["error", "levels"])


def key_sketch(df: DataFrame, key: Column, room: int = ROOM) -> KeySketch:
    """The sketch of a column of strings; null keys aren't in it. Keys don't move: a row for each task does, merged FAN_IN
    at a time, and the driver sees FAN_IN sketches at most."""

    def build(batches):
        sketch = KeySketch(room)
        for batch in batches:
            sketch.add(batch.column(0).to_pylist())
        if sketch.n:
            yield _row(sketch)

    def merge(batches):
        sketch = KeySketch(room)
        for batch in batches:
            for error, levels in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sketch.merge(error, levels)
        if sketch.n:
            yield _row(sketch)

    ship()
    rows = df.select(key.cast("string").alias("k")).where("k is not null").mapInArrow(build, SCHEMA)
    n = rows.rdd.getNumPartitions()
    while n > FAN_IN:
        n = -(-n // FAN_IN)
        rows = rows.repartition(n).mapInArrow(merge, SCHEMA)
    out = KeySketch(room)
    for r in rows.collect():
        out.merge(r["error"], r["levels"])
    return out
