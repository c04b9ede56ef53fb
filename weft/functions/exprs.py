"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def range_bucket(key: Column, bounds: Column) -> Column:
    """The bucket of a key among sorted bounds: the number of bounds below it, so a key equal to a bound goes left.

    A null key goes to the last bucket.
    """
    below = F.size(F.filter(bounds, lambda b: b < key))
    return F.when(key.isNull(), F.size(bounds)).otherwise(below).cast("long")


def owner_cyclic(node: Column, workers: int) -> Column:
    """Worker of a node dealt out in turn."""
    return F.pmod(node, F.lit(workers).cast("long"))


def owner_block(node: Column, n_nodes: Column | int, workers: int) -> Column:
    """Worker of a node when each has a run of ceil(n_nodes / workers) ids."""
    total = F.lit(n_nodes) if isinstance(n_nodes, int) else n_nodes
    return F.floor(node / F.ceil(total / F.lit(workers))).cast("long")


def owner_half(node: Column, n_nodes: Column | int) -> Column:
    """0 for the first half of the ids, 1 for the rest."""
    total = F.lit(n_nodes) if isinstance(n_nodes, int) else n_nodes
    return F.when(node < F.floor(total / F.lit(2)), F.lit(0)).otherwise(F.lit(1)).cast("long")


def fold_node(node: Column, n_nodes: int) -> Column:
    """A destination beyond the declared nodes wraps around."""
    return node % F.lit(n_nodes)


def part_name(number: Column) -> Column:
    """The name of a part file: part- and the number in five digits at least."""
    return F.format_string("part-%05d", number)


def label_and_text(line: Column) -> tuple[Column, Column]:
    """(label, text) of a review line: the digit after "__label__", less one, and what follows a space."""
    return F.substring(line, 10, 1).try_cast("int") - 1, F.substring(line, 12, 2_147_483_647)


def epoch_millis(key: Column) -> Column:
    """A timestamp from a string of milliseconds since 1970."""
    return F.timestamp_millis(key.cast("long"))


def epoch_micros(key: Column) -> Column:
    """A timestamp from a string of microseconds since 1970."""
    return F.timestamp_micros(key.cast("long"))
