"""Topology: forests of comms domains, poll groups, RTUs and signals as node and edge tables."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemetrica.sources.scans import numbered

TYPES = ("comms_domain", "poll_group", "rtu", "signal")
DEPTH = len(TYPES)


def validate(nodes: list[dict], edges: list[dict], allow_orphans: bool = False) -> None:
    """Raise for repeated ids, unknown types or references, several parents, or signals without RTU."""
    kinds = {n["id"]: n["type"] for n in nodes}
    if len(kinds) < len(nodes):
        raise ValueError("node ids must be unique")
    if bad := sorted(set(kinds.values()) - set(TYPES)):
        raise ValueError(f"unknown node types: {bad}")
    children = [e["child"] for e in edges]
    if len(set(children)) < len(children):
        raise ValueError("a node has more than one parent")
    if missing := sorted({x for e in edges for x in (e["parent"], e["child"])} - set(kinds)):
        raise ValueError(f"edges name unknown nodes: {missing}")
    over = {e["child"]: e["parent"] for e in edges}
    if not allow_orphans and (lost := sorted(n for n, t in kinds.items() if t == "signal" and kinds.get(over.get(n)) != "rtu")):
        raise ValueError(f"signals without an RTU: {lost}")


def version(nodes: list[dict], edges: list[dict]) -> str:
    """A SHA-256 over the canonical form."""
    canonical = {"nodes": sorted(nodes, key=lambda n: (n["type"], n["id"])), "edges": sorted(edges, key=lambda e: (e["parent"], e["child"]))}
    return hashlib.sha256(json.dumps(canonical, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def closure(edges: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance): a forest of these types is ``DEPTH`` deep, so joins are few."""
    step = edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant"), F.lit(1).alias("distance"))
    out, level = step, step
    for d in range(2, DEPTH):
        level = level.join(edges, level["descendant"] == edges["parent"]).select("ancestor", F.col("child").alias("descendant"), F.lit(d).alias("distance"))
        out = out.unionByName(level)
    return out


def ancestors(edges: DataFrame) -> DataFrame:
    """(id, ancestors): the ids above each node from the root to its parent, joined by slashes; at most ``DEPTH`` - 1."""
    up = closure(edges).groupBy(F.col("descendant").alias("id")).agg(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "ancestor"))).alias("_a"))
    return up.select("id", F.array_join(F.transform("_a", lambda x: x["ancestor"]), "/").alias("ancestors"))


def node_order(nodes: DataFrame) -> DataFrame:
    rank = F.coalesce(*[F.when(F.col("type") == t, k) for k, t in enumerate(TYPES)])
    return numbered(nodes.withColumn("_o", F.struct(rank.alias("k"), "id")), "_o", "node_order").drop("_o").withColumn("node_order", F.col("node_order").cast("int"))


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges, nodes["id"] == edges["child"], "left_anti")


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges, nodes["id"] == edges["parent"], "left_anti")


def siblings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, sibling): other children of the parent; for roots, other roots of the type."""
    placed = nodes.join(edges, nodes["id"] == edges["child"], "left").select("id", "type", F.coalesce("parent", F.concat(F.lit("\x00"), "type")).alias("under"))
    other = placed.select(F.col("id").alias("sibling"), F.col("under"))
    return placed.join(other, "under").where("id <> sibling").select("id", "sibling")


def descendant_counts(nodes: DataFrame, edges: DataFrame, kind: str = "signal") -> DataFrame:
    """Per node the number of its descendants of a type, zero included."""
    under = closure(edges).join(nodes.where(F.col("type") == kind).select(F.col("id").alias("descendant")), "descendant")
    counts = under.groupBy(F.col("ancestor").alias("id")).agg(F.count("*").alias("n"))
    return nodes.join(counts, "id", "left").select("id", "type", F.coalesce("n", F.lit(0)).alias("descendants"))


def typed_parents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per signal its RTU, poll group and comms domain."""
    up = closure(edges).join(nodes.select(F.col("id").alias("ancestor"), F.col("type").alias("kind")), "ancestor")
    signals = nodes.where("type = 'signal'").select(F.col("id").alias("signal_id"))
    got = up.groupBy(F.col("descendant").alias("signal_id")).agg(*[F.max(F.when(F.col("kind") == t, F.col("ancestor"))).alias(f"{t}_id") for t in TYPES[:-1]])
    return signals.join(got, "signal_id", "left")
