"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Edges of one file of a round's table.
FILE = 1_000_000


def components(edges: DataFrame) -> DataFrame:
    """(a, b) longs, any direction, to (node, root): root is the component's smallest node. Roots have no row of their own.

    Each round is two aggregations with partial sums before the shuffle and two joins that Spark may split by skew; no node's
    neighbours are gathered in one place. The rounds are logarithmic in a component's size. Null ends, loops and repeated edges
    are ignored; no edges give no rows. A round's edges are never more than twice those before it, which says how many files
    they need; rounds have few edges where most nodes are alone.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(now, "edges")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        now = written(_small_star(_large_star(now)).coalesce(-(-2 * state[0] // FILE)), "edges")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    rest = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
