"""Convergence of runs: what is pending by locale, passes until nothing is gained, and the standing that events add up to.

Events: run_id, seq, type (pass_start, locale_start, unit_progress, locale_done, pass_done, materialized, done), pass, locale,
units, done, via_memory, via_ai, state, failing_checks, files, pending (array of locales).
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import checkpoint

#: States of a locale and of a run.
PENDING, SHIPPABLE, PARKED = "pending", "shippable", "parked"

LOCALE = "locale string, state string, units long, produced long, via_memory long, via_ai long"
STANDING = f"run_id string, passes long, failing_checks long, materialized long, run_state string, done boolean, {LOCALE}"
KEPT = f"passes long, failing_checks long, materialized long, run_state string, done boolean, locales array<struct<{', '.join(':'.join(c.split()) for c in LOCALE.split(', '))}>>"
FIELDS = [c.split()[0] for c in LOCALE.split(", ")]


def fold(state: dict, event: dict) -> dict:
    """A run's standing after one more event; locales keep the order in which they first came."""

    def row(locale: str) -> dict:
        return state["locales"].setdefault(locale, dict.fromkeys(FIELDS[2:], 0) | {"locale": locale, "state": ""})

    kind, known = event["type"], lambda name: int(event[name] or 0)
    if kind == "pass_start":
        state["passes"] = max(state["passes"], known("pass"))
    elif kind == "locale_start":
        row(event["locale"]).update(units=known("units"), state=PENDING)
    elif kind in ("unit_progress", "locale_done"):
        at = row(event["locale"])
        at.update(produced=known("done"), via_memory=known("via_memory"), via_ai=known("via_ai"))
        if known("units") > 0:
            at["units"] = known("units")
        if kind == "locale_done":
            covered = at["units"] > 0 and at["produced"] >= at["units"]
            at["state"] = event["state"] or (SHIPPABLE if covered else PENDING)
    elif kind == "pass_done":
        state.update(passes=known("pass"), failing_checks=known("failing_checks"))
        short = set(event["pending"] if event["pending"] is not None else [])
        for locale, at in state["locales"].items():
            if locale in short:
                at["state"] = PENDING
            elif at["state"] == PENDING:
                at["state"] = SHIPPABLE
    elif kind == "materialized":
        state["materialized"] = known("files")
    elif kind == "done":
        state.update(run_state=event["state"], done=True)
        if event["state"] == PARKED:
            for at in state["locales"].values():
                if at["state"] != SHIPPABLE:
                    at["state"] = PARKED
    return state


def _empty() -> dict:
    return {"passes": 0, "failing_checks": 0, "materialized": 0, "run_state": None, "done": False, "locales": {}}


def _rows(run_id: str, state: dict) -> list[dict]:
    head = {"run_id": run_id, **{k: state[k] for k in ("passes", "failing_checks", "materialized", "run_state", "done")}}
    return [head | at for at in state["locales"].values()] or [head | dict.fromkeys(FIELDS)]


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in STANDING.split(", ")])


def _plain(events: pd.DataFrame) -> list[dict]:
    return events.sort_values("seq").astype(object).where(events.notna(), None).to_dict("records")


def standing(events: DataFrame) -> DataFrame:
    """The standing of each run: a row per locale (or one without a locale), STANDING. A run's events are folded in order of seq."""

    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    arrow = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in STANDING.split(", "))])

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for run in batch.to_pylist():
                rows += _rows(run["run_id"], functools.reduce(fold, run["events"], _empty()))
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    rest = [c for c in events.columns if c not in ("run_id", "seq")]
    runs = events.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("seq", *rest))).alias("events"))
    return runs.mapInArrow(folded, STANDING)


def standing_stream(events: DataFrame) -> DataFrame:
    """The same over a stream: after each batch the standing of the runs that had events. Batches come in order of seq."""

    def more(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = _empty()
        if held.exists:
            *head, locales = held.get
            state.update(zip(("passes", "failing_checks", "materialized", "run_state", "done"), head, strict=True))
            state["locales"] = {at[0]: dict(zip(FIELDS, at, strict=True)) for at in (tuple(x) for x in locales)}
        for event in _plain(pd.concat(list(batches))):
            state = fold(state, event)
        locales = [tuple(at[f] for f in FIELDS) for at in state["locales"].values()]
        held.update((state["passes"], state["failing_checks"], state["materialized"], state["run_state"], state["done"], locales))
        yield _frame(_rows(key[0], state))

    return events.groupBy("run_id").applyInPandasWithState(more, STANDING, KEPT, "update", GroupStateTimeout.NoTimeout)


def converge(
    work: DataFrame, produce: Callable[[DataFrame, int], DataFrame], keys: list[str], most_passes: int = 10
) -> tuple[DataFrame, int]:
    """Produces what is missing until nothing is, a pass adds nothing, or `most_passes` are done: (all rows produced, passes).

    work: rows of keys and whatever `produce` reads. produce(pending, pass) gives rows of keys and results; a
    pass is asked only for what no pass before it has produced. What is left over is parked: it isn't in the result.
    """
    done, pending, passes = None, checkpoint(work), 0
    while passes < most_passes and not pending.isEmpty():
        passes += 1
        delta = checkpoint(produce(pending, passes).join(pending.select(*keys), keys, "left_semi").dropDuplicates(keys))
        if delta.isEmpty():
            break
        done = delta if done is None else done.unionByName(delta)
        pending = checkpoint(pending.join(delta.select(*keys), keys, "left_anti"))
    return (work.select(*keys).limit(0) if done is None else done), passes


def locale_standing(work: DataFrame, produced: DataFrame, keys: list[str], locale: str) -> DataFrame:
    """Units, produced and state of each locale after a run that stopped: shippable, or parked where something is missing."""
    there = produced.select(*keys, F.lit(1).alias("_there"))
    counts = work.join(there, keys, "left").groupBy(locale).agg(F.count(F.lit(1)).alias("units"), F.count("_there").alias("produced"))
    return counts.withColumn("state", F.when(F.col("produced") >= F.col("units"), SHIPPABLE).otherwise(PARKED))
