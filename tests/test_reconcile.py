"""Documents under new paths, with copies and near copies."""

import random
from collections import Counter

from textloom.operators import diff


def one_pass(now, before, least=0.5):
    """In the order of paths, each takes the most similar old document that is left."""
    left = {p: c for p, c in before.items() if p not in now}
    found = {p: ("unchanged" if c == before[p] else "edited", p) for p, c in now.items() if p in before}
    for p in sorted(set(now) - set(before)):
        rated = [(-sum((now[p] & c).values()) / max(sum(now[p].values()), sum(c.values())), q) for q, c in left.items()]
        best = min([r for r in rated if -r[0] >= least], default=None)
        found[p] = ("moved", best[1]) if best else ("new", None)
        if best:
            del left[best[1]]
    return {(p, *v) for p, v in found.items()}


def rows(docs):
    return [(p, h) for p, c in docs.items() for h in c.elements()]


def test_one_pass_over_copies_and_near_copies(spark):
    rng = random.Random(8)
    base = [[rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8))] for _ in range(3)]

    def some(prefix, n):
        out = {}
        for k in range(n):
            blocks = list(rng.choice(base))
            if rng.random() < 0.4:
                blocks[rng.randrange(len(blocks))] = rng.choice("abcdefghijkl")
            out[f"{prefix}{k}"] = Counter(blocks)
        return out

    before = {**some("old", 35), **some("same", 4)}
    now = {**some("new", 30), **some("same", 4)}
    found = diff.reconcile(spark.createDataFrame(rows(now), "p string, h string"), spark.createDataFrame(rows(before), "p string, h string"), "p", "h")
    assert {tuple(r) for r in found.collect()} == one_pass(now, before)


def test_copies_take_no_round_each(spark, monkeypatch):
    """Sixty copies claim sixty others: each the next one, without a round (and its checkpoint) for each."""
    calls = []
    kept = diff.checkpoint
    monkeypatch.setattr(diff, "checkpoint", lambda df: calls.append(1) or kept(df))
    now, before = ({f"{p}{k:02}": Counter("xyz") for k in range(60)} for p in ("n", "o"))
    found = diff.reconcile(spark.createDataFrame(rows(now), "p string, h string"), spark.createDataFrame(rows(before), "p string, h string"), "p", "h")
    assert {tuple(r) for r in found.collect()} == {(f"n{k:02}", "moved", f"o{k:02}") for k in range(60)}
    assert len(calls) < 8
