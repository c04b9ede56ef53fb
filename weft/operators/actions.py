"""Functions of the caller's, run by name over rows of parameters: a table function whose columns follow from the name."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from weft.session import ship

#: An action: a function of a row's columns by name, and the columns of what it gives, as DDL.
Action = tuple[Callable[..., Any], str]


def run_action(params: DataFrame, actions: dict[str, Action], name: str, order: str) -> DataFrame:
    """(call, place, the action's columns, error) of the named action for each row of params.

    `call` is the row's value in the column `order`. An action gives a dict, an iterable of dicts (rows told apart by
    `place`, from 0), or None (no row). What it doesn't name is null. A call that fails gives one row with the error's kind and
    text, after what it gave before; other calls go on. Rows run where they lie; sort by call and place to have them in order.
    """
    known = {n: (fn, T.StructType.fromDDL(ddl)) for n, (fn, ddl) in actions.items()}
    schemas = {n: s.json() for n, (_, s) in known.items()}

    class RunAction:
        @staticmethod
        def analyze(name: AnalyzeArgument, table: AnalyzeArgument) -> AnalyzeResult:
            import json

            from pyspark.sql import types as T

            if name.value not in schemas:
                raise ValueError(f"no action is called {name.value}; there are {', '.join(sorted(schemas))}")
            own = T.StructType.fromJson(json.loads(schemas[name.value]))
            ends = [T.StructField("call", table.dataType[order].dataType), T.StructField("place", T.IntegerType())]
            return AnalyzeResult(T.StructType([*ends, *own.fields, T.StructField("error", T.StringType())]))

        def eval(self, name: str, row: T.Row):
            fn, columns = known[name]
            place = 0
            try:
                found = fn(**row.asDict())
                rows: Iterable[dict] = [] if found is None else [found] if isinstance(found, dict) else found
                for r in rows:
                    yield (row[order], place, *[r.get(c) for c in columns.names], None)
                    place += 1
            except Exception as e:
                yield (row[order], place, *[None] * len(columns), f"{type(e).__name__}: {e}")

    ship()
    return udtf(RunAction)(F.lit(name), params.asTable())
