"""Steps written by users: from each block any number of blocks, and aggregates whose states merge."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tasks that merge the states of the tasks before, and states that the last one merges.
FAN_IN = 64


def script(df: DataFrame, step: Callable[..., Iterator[tuple]], arguments: list[Column | str], schema: str, keep: list[str] | None = None) -> DataFrame:
    """Rows that `step` yields (none, one or many) for each row's arguments, beside the row's `keep` columns.

    step: a generator function of plain values; a table function joined laterally to each row, so that nothing is shuffled.
    """

    class Handler:
        def eval(self, *values: Any) -> Iterator[tuple]:
            yield from step(*values)

    names = [f"_a{k}" for k in range(len(arguments))]
    given = df.select(*(keep or []), *[(F.col(a) if isinstance(a, str) else a).alias(n) for a, n in zip(arguments, names, strict=True)])
    made = F.udtf(Handler, returnType=schema)
    out = given.lateralJoin(made(*[F.col(n).outer() for n in names]))
    return out.drop(*names)


class Collector:
    """A user's aggregate: states begin with `empty`, take rows in by `add`, merge by `merge` and end as rows by `result`.

    Merging must not depend on order or grouping, since tasks make states of the rows they have.
    """

    def empty(self) -> Any:
        raise NotImplementedError

    def add(self, state: Any, row: dict) -> Any:
        raise NotImplementedError

    def merge(self, one: Any, two: Any) -> Any:
        raise NotImplementedError

    def result(self, state: Any) -> list[dict]:
        raise NotImplementedError


def collect(df: DataFrame, collector: Collector, schema: str, fan_in: int = FAN_IN) -> DataFrame:
    """What a collector makes of all rows: a state per task, merged by `fan_in` tasks, and those by one.

    Only states travel; an empty table gives the result of the empty state.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = collector.empty()
        for batch in batches:
            for row in batch.to_dict("records"):
                state = collector.add(state, row)
        yield pd.DataFrame({"state": [pickle.dumps(state)]})

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = collector.empty()
        for batch in batches:
            for data in batch["state"]:
                state = collector.merge(state, pickle.loads(data))
        yield pd.DataFrame({"state": [pickle.dumps(state)]})

    def finished(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = collector.empty()
        for batch in batches:
            for data in batch["state"]:
                state = collector.merge(state, pickle.loads(data))
        rows = collector.result(state)
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    states = df.mapInPandas(partial, "state binary").repartition(fan_in).mapInPandas(merged, "state binary")
    return states.repartition(1).mapInPandas(finished, schema)  # fan_in states
