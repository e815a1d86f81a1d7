"""Flows: named steps chained over DataFrames, with a check of what each step needs and gives."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame

Step = Callable[[DataFrame], DataFrame]


@dataclass
class Tool:
    """A step with the columns it needs and adds, and how many locales it takes at a time."""

    run: Callable[..., DataFrame]
    needs: set[str] = field(default_factory=set)
    gives: set[str] = field(default_factory=set)
    locales: str = "mono"  # mono, bilingual or multilingual


REGISTRY: dict[str, Tool] = {}


def register(name: str, **options: object) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    def add(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"{name} is registered already")
        REGISTRY[name] = Tool(run, **options)
        return run

    return add


def check_columns(columns: set[str], steps: list[str]) -> None:
    """Raises where a step needs a column that neither the input nor a step before it gives."""
    there = set(columns)
    for step in steps:
        if step not in REGISTRY:
            raise KeyError(f"no tool {step}")
        if missing := REGISTRY[step].needs - there:
            raise ValueError(f"{step} needs {', '.join(sorted(missing))}")
        there |= REGISTRY[step].gives


def order(edges: dict[str, set[str]]) -> list[str]:
    """Nodes after those they depend on; a cycle is an error."""
    return list(TopologicalSorter(edges).static_order())


def passes(steps: list[str], targets: list[str]) -> list[list[str]]:
    """Locale lists to run a flow with: once without, once per target, or once with all."""
    kinds = {REGISTRY[s].locales for s in steps}
    if kinds <= {"mono"}:
        return [[]]
    return [targets] if "multilingual" in kinds else [[t] for t in targets]


def run(df: DataFrame, steps: list[tuple[str, dict]]) -> DataFrame:
    """One plan of all steps, for Catalyst to optimise as a whole."""
    check_columns(set(df.columns), [name for name, _ in steps])
    for name, options in steps:
        df = df.transform(REGISTRY[name].run, **options)
    return df
