"""Rank and betweenness of nodes in the graph of patterns, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written

#: Most nodes whose ranks are broadcast; with more, Spark chooses the joins.
BROADCAST = 200_000


def _links(edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Written edges, their nodes, and how many nodes there are."""
    links = written(edges, "links")
    nodes = written(links.select(F.col("upstream").alias("node")).union(links.select(F.col("downstream").alias("node"))).distinct(), "nodes")
    return links, nodes, nodes.count()


def page_rank(edges: DataFrame, weight: str, rounds: int = 100, damping: float = 0.85, tolerance: float = 1e-8) -> DataFrame:
    """(node, rank) when no round moves all ranks by more than `tolerance` for each node, or after so many rounds.

    edges: upstream, downstream and a weight (null or 0 counts as 1). Ranks of nodes without outgoing edges are spread over all
    nodes. Each round is a join and an aggregation of edges; five rounds are planned together, then written and compared.
    """
    w = F.when(F.coalesce(F.col(weight), F.lit(0.0)) == 0, 1.0).otherwise(F.col(weight))
    links = edges.select("upstream", "downstream", w.alias("w"))
    total = links.groupBy("upstream").agg(F.sum("w").alias("total"))
    links, nodes, n = _links(links.join(total, "upstream").select("upstream", "downstream", (F.col("w") / F.col("total")).alias("share")))
    n = max(1, n)
    hint = F.broadcast if n <= BROADCAST else lambda df: df
    rank = nodes.withColumn("rank", F.lit(1.0 / n))
    for done in range(0, rounds, 5):
        for _ in range(min(5, rounds - done)):
            before = rank
            flow = links.join(hint(rank), links["upstream"] == rank["node"]).groupBy("downstream").agg(F.sum(F.col("rank") * F.col("share")).alias("flow"))
            moved = flow.agg(F.coalesce(F.sum("flow"), F.lit(0.0)).alias("kept"))  # one row
            joined = nodes.join(hint(flow), nodes["node"] == flow["downstream"], "left").crossJoin(F.broadcast(moved))
            rank = joined.select("node", ((1 - damping) / n + damping * (F.coalesce("flow", F.lit(0.0)) + (1 - F.col("kept")) / n)).alias("rank"))
        rank = written(rank.join(before.select("node", F.col("rank").alias("was")), "node"), "rank")
        shift = rank.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] or 0.0
        rank = rank.select("node", "rank")
        if shift <= tolerance * n:
            break
    return rank


def betweenness(edges: DataFrame, most_steps: int = 1_000) -> DataFrame:
    """(node, betweenness): the share of shortest directed paths between two other nodes that pass a node, summed over pairs and normalised.

    Edges count alike and once; loops don't count. Breadth first from all nodes at once: (source, node, steps, paths) grows by a
    join with the edges in each round until no new pair is reached, and the dependencies are summed back by falling steps.
    Tables have a row for each two connected nodes, which is what the measure is defined on: for graphs of items.
    """
    links, nodes, n = _links(edges.where("upstream <> downstream").select("upstream", "downstream").distinct())
    level = nodes.select(F.col("node").alias("source"), "node", F.lit(0).alias("steps"), F.lit(1.0).alias("paths"))
    seen, levels = level, [level]
    for steps in range(1, most_steps):
        reached = levels[-1].join(links, levels[-1]["node"] == links["upstream"]).groupBy("source", F.col("downstream").alias("node")).agg(F.sum("paths").alias("paths"))
        fresh = reached.join(seen.select("source", "node"), ["source", "node"], "left_anti").select("source", "node", F.lit(steps).alias("steps"), "paths")
        fresh = written(fresh, "level")
        if fresh.isEmpty():
            break
        levels.append(fresh)
        seen = seen.unionByName(fresh)
    # dependency of a source on a node: over its successors one step further, its share of their paths times (1 + their dependency)
    behind = None
    out = []
    for k in range(len(levels) - 1, 0, -1):
        own = levels[k]
        if behind is None:
            own = own.withColumn("dependency", F.lit(0.0))
        else:
            next_ = behind.select("source", F.col("node").alias("next"), F.col("paths").alias("next_paths"), F.col("dependency").alias("next_dependency"))
            steps = own.join(links, own["node"] == links["upstream"]).join(next_, (own["source"] == next_["source"]) & (links["downstream"] == next_["next"]))
            part = steps.select(own["source"], own["node"], (own["paths"] / F.col("next_paths") * (1 + F.col("next_dependency"))).alias("part")).groupBy("source", "node").agg(F.sum("part").alias("dependency"))
            own = written(own.join(part, ["source", "node"], "left").fillna(0.0, ["dependency"]), "behind")
        out.append(own.select("node", "dependency"))
        behind = own
    total = nodes.withColumn("dependency", F.lit(0.0))
    for part in out:
        total = total.unionByName(part)
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return total.groupBy("node").agg((F.sum("dependency") * scale).alias("betweenness"))
