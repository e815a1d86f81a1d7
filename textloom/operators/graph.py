"""Graphs of nodes and edges with labels and validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .terms import is_valid, term_hits

#: Labels and their inverses.
INVERSE = {"broader": "narrower", "narrower": "broader", "part_of": "has_part", "has_part": "part_of"}


def inverse_label(label: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in INVERSE.items() for x in pair])
    return F.coalesce(F.try_element_at(known, label), label)


def neighbours(edges: DataFrame, nodes: DataFrame, direction: str = "both", labels: list[str] | None = None) -> DataFrame:
    """(node, neighbour, label) of the given nodes (column node)."""
    if labels is not None:
        edges = edges.filter(F.col("label").isin(labels)) if labels else edges.filter(F.lit(False))
    out = edges.select(F.col("source_id").alias("node"), F.col("target_id").alias("neighbour"), "label")
    into = edges.select(F.col("target_id").alias("node"), F.col("source_id").alias("neighbour"), "label")
    chosen = {"outgoing": out, "incoming": into, "both": out.unionByName(into)}[direction]
    return chosen.join(nodes.select("node").distinct(), "node", "left_semi").distinct()


def _having(rows: DataFrame, label: str | None, properties: dict[str, str] | None) -> DataFrame:
    if label:
        rows = rows.filter(F.col("label") == label)
    for name, value in (properties or {}).items():
        rows = rows.filter(F.coalesce(F.try_element_at("properties", F.lit(name)) == value, F.lit(False)))
    return rows


def find_nodes(
    nodes: DataFrame, label: str | None = None, properties: dict[str, str] | None = None, at: Column | None = None, scope: dict[str, str] | None = None
) -> DataFrame:
    """Nodes with the label (none: any) and all the properties; with `at`, those valid then and in the scope.

    Validity is read from the columns valid_from, valid_to and tags.
    """
    found = _having(nodes, label, properties)
    return found if at is None else found.filter(is_valid(at, F.col("valid_from"), F.col("valid_to"), F.col("tags"), scope or {}))


def find_edges(edges: DataFrame, label: str | None = None, properties: dict[str, str] | None = None) -> DataFrame:
    """Edges with the label (none: any) and all the properties."""
    return _having(edges, label, properties)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], at: str = "updated_at", created: str = "created_at") -> DataFrame:
    """The latest row of each key with the earliest creation time."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in (*keys, created)]
    return both.groupBy(*keys).agg(F.min(created).alias(created), F.max_by(F.struct(*rest), at).alias("r")).select(*keys, "r.*", created).select(*old.columns)


def shortest_paths(edges: DataFrame, start: DataFrame, depth: int, directed: bool = True) -> DataFrame:
    """(start, node, hops, path) of a shortest path to each node within `depth` hops; ties by the smaller path.

    One join a hop: only nodes reached for the first time go on, so a step's work is the frontier's edges.
    """
    links = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    if not directed:
        links = links.union(links.select("b", "a"))
    links = links.distinct()
    reached = start.select(F.col("node").alias("start"), "node", F.lit(0).alias("hops"), F.array("node").alias("path")).distinct()
    frontier = reached
    for hop in range(1, depth + 1):
        step = frontier.join(links, frontier["node"] == links["a"]).select(
            "start", F.col("b").alias("node"), F.lit(hop).alias("hops"), F.concat("path", F.array("b")).alias("path")
        )
        step = step.join(reached.select("start", "node"), ["start", "node"], "left_anti")
        frontier = checkpoint(step.groupBy("start", "node").agg(F.min("hops").alias("hops"), F.min("path").alias("path")))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def occurrence_graph(blocks: DataFrame, terms: DataFrame) -> DataFrame:
    """Edges (source_id, target_id, label, n): block uses_term concept with its count, block in_collection collection.

    blocks: block_id, collection, source_text; terms: concept_id, term.
    """
    numbered = terms.select(F.concat_ws("\0", "concept_id", "term").alias("term_id"), "term")
    hits = term_hits(blocks, numbered, "block_id", "source_text")
    uses = hits.groupBy("block_id", F.substring_index("term_id", "\0", 1).alias("target_id")).agg(F.sum("hits").alias("n"))
    uses = uses.select(F.col("block_id").alias("source_id"), "target_id", F.lit("uses_term").alias("label"), "n")
    held = blocks.join(uses.select(F.col("source_id").alias("block_id")).distinct(), "block_id", "left_semi")
    inside = held.select(F.col("block_id").alias("source_id"), F.col("collection").alias("target_id"), F.lit("in_collection").alias("label"), F.lit(1).cast("long").alias("n"))
    return uses.unionByName(inside.distinct())
