"""Connected components of an undirected edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.workspace import Workspace


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return tuple(row)


def _lowest(ws: Workspace, edges: DataFrame, tag: str) -> DataFrame:
    """The least neighbour of each a, as a table of its own: the join that follows then
    exchanges both sides, and a hub's rows can be split over tasks."""
    return ws.save(edges.groupBy("a").agg(F.min("b").alias("m")), tag)


def connected_components(ws: Workspace, edges: DataFrame, tag: str) -> DataFrame:
    """(id, component_id) for every id in ``edges(a, b)``; the component is its smallest id.

    Each round hangs larger neighbours below the least one (large star), then relinks each
    node's smaller neighbours (small star). Only minima are aggregated, so a node with
    millions of neighbours costs partial sums, never a gathered list. Null ends and loops are ignored;
    no edge gives an empty table.
    """
    now = ws.save(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        f"{tag}-0",
    )
    state, k = _state(now), 0
    while state[0]:
        k += 1
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = _lowest(ws, both, f"{tag}-{k}-l")
        large = (
            both.where("b > a").join(low, "a")
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        )
        large = ws.save(large, f"{tag}-{k}-large")
        low = _lowest(ws, large, f"{tag}-{k}-s")
        small = (
            large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        )
        after = ws.save(small, f"{tag}-{k}")
        ws.drop(f"{tag}-{k}-l", f"{tag}-{k}-s", f"{tag}-{k}-large", f"{tag}-{k - 1}")
        now, before, state = after, state, _state(after)
        if state == before:
            break
    stars = now.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    return stars.unionByName(stars.select(F.col("component_id").alias("id"), "component_id").distinct())
