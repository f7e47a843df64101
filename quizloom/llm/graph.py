"""Connected components by alternating large-star and small-star steps (Kiveris et al.).

Each step is one partial aggregation and one join on the node, so no component and no
neighbour list is ever gathered.  AQE splits the join of a star's centre.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizloom.llm.common import stored

MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
                           F.sum("v")).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (u long, v long) -> (node, component): the smallest node each one reaches.

    Self links, repeated links and nulls are ignored; nodes without a link don't appear; no
    links give no rows.
    """
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                   .distinct())
    state = _state(edges)
    for _ in range(MAX_ROUNDS if state[0] else 0):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.where("v > u").join(least, "u").where("v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = stored(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = stored(large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                       .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                       .union(low.select("u", F.col("m").alias("v"))).distinct())
        new = _state(edges)
        if new == state:
            break
        state = new
    else:
        if state[0]:
            raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
