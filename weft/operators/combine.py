"""Reduction by a function of the caller's: partial states in each task, merged in a tree, never a group as a whole.

A combiner is a function from an Arrow table of states, any number for a key, to one with a state for each key, of the same
columns. It must be associative and commutative: it meets states in any order and grouping.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.session import parallelism, ship

Combiner = Callable[[pa.Table], pa.Table]

#: States that a task holds before it merges or gives them away, and tasks whose states of a key meet in one of the next.
HELD, FAN_IN = 1 << 16, 32


def _merged(batches: Iterator[pa.RecordBatch], merge: Combiner) -> Iterator[pa.RecordBatch]:
    """States of the batches, merged as far as HELD of them fit; a key may come out several times."""
    held: list[pa.Table] = []
    n = 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        n += batch.num_rows
        if n > HELD:
            done = merge(pa.concat_tables(held))
            # keys that don't repeat are given away, so a task never outgrows its limit
            if done.num_rows > HELD // 2:
                yield from done.to_batches()
                held, n = [], 0
            else:
                held, n = [done], done.num_rows
    if held:
        yield from merge(pa.concat_tables(held)).to_batches()


def _by_run(batches: Iterator[pa.RecordBatch], merge: Combiner, keys: list[str]) -> Iterator[pa.RecordBatch]:
    """One state for each key of batches that are sorted by key: the last key of a batch waits for the next one."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        done = merge(table if last is None else pa.concat_tables([last, table]))
        end = table.slice(table.num_rows - 1).select(keys).to_pylist()[0]
        mine = np.ones(done.num_rows, bool)
        for k in keys:
            value = end[k]
            column = done[k].to_pylist()
            mine &= np.array([x == value for x in column])
        last = done.filter(pa.array(mine))
        yield from done.filter(pa.array(~mine)).to_batches()
    if last is not None:
        yield from last.to_batches()


def combine(states: DataFrame, keys: list[str], merge: Combiner) -> DataFrame:
    """One state for each key (one in all without keys) of the rows of `states`, whose other columns are the state.

    Each task merges its own rows first. Where there are many tasks, their states meet FAN_IN at a time by key and group of
    tasks, so that a key of all tasks, or states that grow, don't meet in one task at once. Then states move to their key's
    partition and are merged as they come by, in order of key. Null keys are a key of their own.
    """
    ship()
    schema = states.schema
    columns = states.columns
    out = states.mapInArrow(lambda batches: _merged(batches, merge), schema)
    n = out.rdd.getNumPartitions()
    while n > FAN_IN:
        n = -(-n // FAN_IN)
        dealt = out.withColumn("weft_group", F.spark_partition_id() % n)
        dealt = dealt.repartition(max(n, parallelism(states.sparkSession)) if keys else n, "weft_group", *keys)
        out = dealt.select(*columns).mapInArrow(lambda batches: _merged(batches, merge), schema)
    if not keys:
        # at most FAN_IN times a task's share of states
        return out.repartition(1).mapInArrow(lambda batches: _all(batches, merge), schema)
    sorted_ = out.repartition(parallelism(states.sparkSession), *keys).sortWithinPartitions(*keys)
    return sorted_.mapInArrow(lambda batches: _by_run(batches, merge, keys), schema)


def _all(batches: Iterator[pa.RecordBatch], merge: Combiner) -> Iterator[pa.RecordBatch]:
    last = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        last = merge(table if last is None else pa.concat_tables([last, table]))
    if last is not None:
        yield from last.to_batches()


def sums(keys: list[str]) -> Combiner:
    """Adds up all columns but the keys."""

    def merge(table: pa.Table) -> pa.Table:
        names = [c for c in table.column_names if c not in keys]
        out = table.group_by(keys, use_threads=False).aggregate([(c, "sum") for c in names])
        return out.rename_columns([*[c for c in out.column_names if c in keys], *names] if out.column_names[0] in keys else [*names, *keys]).select(table.column_names).cast(table.schema)

    return merge


def bitmap_union(keys: list[str], bits: str) -> Combiner:
    """Joins bitmaps of one length by OR."""

    def merge(table: pa.Table) -> pa.Table:
        found: dict[tuple, np.ndarray] = {}
        for *key, data in zip(*[table[c].to_pylist() for c in [*keys, bits]]):
            own = np.frombuffer(data, np.uint8)
            at = tuple(key)
            if at in found:
                found[at] |= own
            else:
                found[at] = own.copy()
        columns = {k: [x[i] for x in found] for i, k in enumerate(keys)} | {bits: [x.tobytes() for x in found.values()]}
        return pa.table([pa.array(columns[c], table.schema.field(c).type) for c in table.column_names], schema=table.schema)

    return merge
