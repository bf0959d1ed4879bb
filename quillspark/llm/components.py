"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _only_stars(edges: DataFrame) -> bool:
    """Whether each vertex ``u`` has one neighbour ``v`` and none is both: then ``v`` is the component's smallest."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("up")), F.struct(F.col("v").alias("id"), F.lit(None).cast("int").alias("up")))).alias("e")).select("e.*")
    seen = ends.groupBy("id").agg(F.sum("up").alias("up"), F.count(F.lit(1)).alias("n"))
    return seen.where("up > 1 or up < n").agg(F.count(F.lit(1))).first()[0] == 0


def connected_components(links: DataFrame, tmp: Scratch, rounds: int = 60) -> DataFrame:
    """``(id, component)`` for each id in ``links`` (columns ``a``, ``b``, both long); the component is its
    smallest id. The tables are those of the caller's ``tmp``.

    Alternating large-star and small-star rounds: neighbourhoods are only ever reduced to a minimum,
    never gathered, and each round ends in a table in the shared folder, until only stars are left. Links with a null or with
    equal ends are passed over; no links give no rows.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = tmp(edges, "edges")
    for _ in range(rounds):
        if _only_stars(edges):
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = tmp(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "lows")
        # large star: larger neighbours go to the smallest of all; as many rows as links, equal ones go below
        large = both.where("v > u").join(lows, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = tmp(large, "large-star")
        tmp.drop(edges, lows)
        # small star: smaller neighbours, and the vertex itself, go to the smallest
        lows = tmp(large.groupBy("u").agg(F.min("v").alias("m")), "lows")
        small = large.join(lows, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lows.select("u", F.col("m").alias("v"))).distinct()
        edges = tmp(small, "small-star")
        tmp.drop(large, lows)
    else:
        raise RuntimeError("components didn't settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
