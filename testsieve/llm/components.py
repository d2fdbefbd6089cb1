"""Connected components of a link table by repeated contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """Links ``(a, b)`` to ``(id, component)``: the least id reachable.

    Each round every vertex takes the neighbour (or itself) of least pseudo-random
    rank, drawn anew each round, so that long chains shrink by a constant
    share, and the links between the chosen ones go on.  A vertex with very many
    links is only aggregated (map-side minimum), never gathered.  Ends when no
    link is left; loops, repeated links and either direction are allowed;
    null ends are ignored; an empty table gives an empty table."""
    edges = written(links.select("a", "b").where("a <> b").distinct(), "links")
    label = None
    turn = 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c, t=turn: F.struct(F.xxhash64(F.col(c), F.lit(t)).alias("r"), F.col(c).alias("v"))
        chosen = both.groupBy("a").agg(F.min(rank("b")).alias("n")).select(
            F.col("a").alias("old"), F.least(F.col("n"), rank("a"))["v"].alias("new"))
        chosen = written(chosen, "chosen")
        edges = written(
            edges.join(chosen.select(F.col("old").alias("a"), F.col("new").alias("x")), "a")
            .join(chosen.select(F.col("old").alias("b"), F.col("new").alias("y")), "b")
            .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        if label is None:
            label = chosen.select(F.col("old").alias("id"), F.col("new").alias("root"))
        else:
            step = chosen.select(F.col("old").alias("root"), F.col("new").alias("next"))
            label = written(label.join(step, "root", "left").select("id", F.coalesce("next", "root").alias("root")), "labels")
        turn += 1
    if label is None:
        return links.select(F.col("a").alias("id"), F.col("a").alias("component")).limit(0)
    least = label.groupBy("root").agg(F.min("id").alias("component"))
    return label.join(least, "root").select("id", "component")
