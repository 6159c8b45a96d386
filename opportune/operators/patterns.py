"""Directional patterns between items: does a positive result of one change the chance that another is observed?

Counts of opportunities come from cells (see `opportunity`): for an upstream result, all episodes of a cell share the same
eligible downstream items. Only pairs that were both observed in an episode are joined row by row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import effects as E
from .opportunity import CELL, availability

PAIR = ["upstream", "downstream"]
MIN_TOTAL, MIN_BRANCH, MIN_EVENTS = 25, 5, 5


def branch_counts(observations: DataFrame, all_seen: DataFrame, min_support: int, intrinsic: DataFrame | None = None, by: tuple[str, ...] = (), mutual: bool = False) -> DataFrame:
    """(upstream, downstream, outcome, *by, support_n, tested_n).

    observations: one outcome for each episode and item; all_seen: every observation, for availability. support_n counts
    episodes with the upstream outcome in whose cell the downstream item is eligible, tested_n those that show it as well. mutual:
    only cells in which the upstream item is eligible as well.
    """
    eligible = availability(all_seen, min_support, intrinsic).where("is_eligible").select(*CELL, F.col("item").alias("downstream"))
    year = [F.year("time").alias("year")] if "year" in by else []
    up = observations.select("episode", *CELL, *year, F.col("item").alias("upstream"), "outcome")
    groups = list(dict.fromkeys([*CELL, *by]))
    if mutual:
        eligible = eligible.join(eligible.select(*CELL, F.col("downstream").alias("upstream")), CELL)  # cells x pairs of items
    same = [*CELL, "upstream"] if mutual else CELL
    counted = up.groupBy(*groups, "upstream", "outcome").agg(F.count("*").alias("n"))
    support = counted.join(eligible, same).where("upstream <> downstream").groupBy(*PAIR, "outcome", *by).agg(F.sum("n").alias("support_n"))
    # an episode's items (no more than there are items) are gathered once and paired in place: one shuffle instead of a self-join's two
    together = up.groupBy("episode", *groups).agg(F.collect_list(F.struct("upstream", "outcome")).alias("items"))
    paired = together.select(*groups, "items", F.inline("items")).select(*groups, "upstream", "outcome", F.explode("items.upstream").alias("downstream"))
    seen = paired.where("upstream <> downstream").groupBy(*groups, *PAIR, "outcome").agg(F.count("*").alias("k"))
    tested = seen.join(eligible, [*same, "downstream"]).groupBy(*PAIR, "outcome", *by).agg(F.sum("k").alias("tested_n"))
    return support.join(tested, [*PAIR, "outcome", *by], "left").fillna(0, ["tested_n"])


def conditional_probabilities(counts: DataFrame) -> DataFrame:
    return counts.withColumn("conditional_probability", F.col("tested_n") / F.col("support_n"))


def edges(counts: DataFrame, positive: str, negative: str, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each pair with both branches: n_pos, k_pos, n_neg, k_neg, ratio, bounds and gates, in one aggregation."""
    pick = lambda c, o: F.coalesce(F.sum(F.when(F.col("outcome") == o, F.col(c))), F.lit(0))
    wide = counts.where(F.col("outcome").isin(positive, negative)).groupBy(*PAIR, *by).agg(
        pick("support_n", positive).alias("n_pos"), pick("tested_n", positive).alias("k_pos"), pick("support_n", negative).alias("n_neg"), pick("tested_n", negative).alias("k_neg")
    )
    wide = wide.where("n_pos > 0 and n_neg > 0")
    four = [F.col(c) for c in ("k_pos", "n_pos", "k_neg", "n_neg")]
    ratio, variance = E.rate_ratio(*four), E.log_ratio_variance(*four)
    low, high = E.wald_bounds(ratio, variance)
    gates = (F.col("n_pos") + F.col("n_neg") >= MIN_TOTAL) & (F.col("n_pos") >= MIN_BRANCH) & (F.col("n_neg") >= MIN_BRANCH)
    return wide.withColumns({"ratio": ratio, "log_variance": variance, "ci_low": low, "ci_high": high, "passes_support": gates, "has_events": F.col("k_pos") + F.col("k_neg") >= MIN_EVENTS})


def retained(edge_table: DataFrame, escalation_only: bool = False) -> DataFrame:
    keep = F.col("passes_support") & F.col("has_events")
    return edge_table.where(keep & (F.col("ratio") >= 1.0) if escalation_only else keep).withColumn("direction", E.direction(F.col("ratio")))


def with_reverse(edge_table: DataFrame) -> DataFrame:
    """Adds the reverse edge's ratio and the directional asymmetry, the difference of log ratios; null without a reverse edge."""
    back = edge_table.select(F.col("downstream").alias("upstream"), F.col("upstream").alias("downstream"), F.col("ratio").alias("reverse_ratio"))
    out = edge_table.join(back, PAIR, "left")
    return out.withColumn("asymmetry", F.log("ratio") - F.log("reverse_ratio"))


def ranked(edge_table: DataFrame) -> DataFrame:
    """Dense ranks by ratio and asymmetry, nulls last. Edge tables grow with item pairs, not with episodes."""
    rank = lambda c: F.dense_rank().over(Window.orderBy(F.col(c).desc_nulls_last()))
    return edge_table.withColumns({"ratio_rank": rank("ratio"), "asymmetry_rank": rank("asymmetry")})


def asymmetry_bins(edge_table: DataFrame) -> DataFrame:
    """Tertiles of the absolute asymmetry's rank (first-come ranks, linear quantile edges); fewer than three: undifferentiated."""
    order = Window.orderBy(F.abs("asymmetry"), *PAIR)
    rated = edge_table.where("asymmetry is not null").withColumn("r", F.row_number().over(order))
    rated = rated.crossJoin(F.broadcast(rated.agg(F.count("*").alias("n"))))
    third = lambda k: 1 + (F.col("n") - 1) * k / 3
    label = F.when(F.col("n") < 3, "undifferentiated").when(F.col("r") <= third(1), "low").when(F.col("r") <= third(2), "middle").otherwise("high")
    return rated.withColumn("asymmetry_bin", label).drop("r", "n")


def two_step_paths(edge_table: DataFrame) -> DataFrame:
    """a -> b -> c over edges with ratio above 1, all three distinct: the product of ratios and the smaller support."""
    up = edge_table.where("ratio > 1").withColumn("support", F.col("n_pos") + F.col("n_neg"))
    first = up.select(F.col("upstream").alias("a"), F.col("downstream").alias("b"), F.col("ratio").alias("r1"), F.col("support").alias("s1"))
    second = up.select(F.col("upstream").alias("b"), F.col("downstream").alias("c"), F.col("ratio").alias("r2"), F.col("support").alias("s2"))
    out = first.join(second, "b").where("a <> c")
    return out.select("a", "b", "c", (F.col("r1") * F.col("r2")).alias("path_ratio"), F.least("s1", "s2").alias("min_support"))


def top_paths(edge_table: DataFrame, n: int) -> DataFrame:
    order = [F.desc("path_ratio"), F.desc("min_support"), "a", "b", "c"]
    best = two_step_paths(edge_table).orderBy(*order).limit(n)
    return best.withColumn("path_rank", F.row_number().over(Window.orderBy(*order)))


def flows(paths: DataFrame, edge_table: DataFrame | None = None, n: int = 30) -> DataFrame:
    """Each path as two stages, summed by source and target. Without any path, the n strongest edges of edge_table are the only stage."""
    stages = paths.select(F.inline(F.array(F.struct(F.lit(1).alias("stage"), F.col("a").alias("source"), F.col("b").alias("target"), "min_support"), F.struct(F.lit(2).alias("stage"), F.col("b").alias("source"), F.col("c").alias("target"), "min_support"))))
    if edge_table is not None:
        support = F.col("n_pos") + F.col("n_neg")
        single = edge_table.orderBy(F.desc("ratio"), support.desc(), *PAIR).limit(n).select(F.lit(1).alias("stage"), F.col("upstream").alias("source"), F.col("downstream").alias("target"), support.alias("min_support"))
        none = paths.agg((F.count("*") == 0).alias("__none"))  # one row
        stages = stages.unionByName(single.crossJoin(F.broadcast(none)).where("__none").drop("__none"))
    return stages.groupBy("stage", "source", "target").agg(F.count("*").alias("paths"), F.sum("min_support").alias("flow"))


def compared(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """Full outer comparison of two edge tables: presence and difference of log ratios."""
    x = a.select(*PAIR, F.col("ratio").alias(f"ratio_{left}"))
    y = b.select(*PAIR, F.col("ratio").alias(f"ratio_{right}"))
    presence = F.when(F.col(f"ratio_{right}").isNull(), f"{left}_only").when(F.col(f"ratio_{left}").isNull(), f"{right}_only").otherwise("shared")
    return x.join(y, PAIR, "full_outer").withColumn("presence", presence).withColumn("log_difference", F.log(f"ratio_{left}") - F.log(f"ratio_{right}"))


def compared_scopes(edge_table: DataFrame, scope: str, scopes: Sequence[str]) -> DataFrame:
    """Every two scopes' edges side by side: (pair, first, second, ratio_first, ratio_second, presence, log_difference).

    An edge goes to each two scopes that its own is one of, and one grouping puts the two together. scopes: all names, in order.
    """
    two = [(a, b) for i, a in enumerate(scopes) for b in scopes[i + 1 :]]
    sides = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second")) for a, b in two])
    mine = F.filter(sides, lambda s: (s["first"] == F.col(scope)) | (s["second"] == F.col(scope)))
    rows = edge_table.select(*PAIR, scope, "ratio", F.inline(mine))
    pick = lambda side: F.max(F.when(F.col(scope) == F.col(side), F.col("ratio"))).alias(f"ratio_{side}")
    out = rows.groupBy(*PAIR, "first", "second").agg(pick("first"), pick("second"))
    presence = F.when(F.col("ratio_second").isNull(), "first_only").when(F.col("ratio_first").isNull(), "second_only").otherwise("shared")
    return out.withColumns({"presence": presence, "log_difference": F.log("ratio_first") - F.log("ratio_second")})


def threshold_grid(edge_table: DataFrame, totals: list[int], branches: list[int], events: list[int]) -> DataFrame:
    """Edges that pass, and their mean ratio, at each combination of gates. The grid is a handful of literal rows."""
    spark = edge_table.sparkSession
    steps = spark.createDataFrame([(t, b, e) for t in totals for b in branches for e in events], "min_total int, min_branch int, min_events int")
    ok = F.expr("n_pos + n_neg >= min_total and n_pos >= min_branch and n_neg >= min_branch and k_pos + k_neg >= min_events")
    out = edge_table.crossJoin(F.broadcast(steps)).groupBy("min_total", "min_branch", "min_events")
    return out.agg(F.count(F.when(ok, 1)).alias("edges"), F.coalesce(F.avg(F.when(ok, F.col("ratio"))), F.lit(0.0)).alias("mean_ratio"))


def co_observed(observations: DataFrame, all_seen: DataFrame, min_support: int, share: float = 0.95, floor: int = 25) -> DataFrame:
    """Pairs that are nearly always observed together, in both directions and with enough support: a screen before the ratios."""
    counts = branch_counts(observations, all_seen, min_support)
    rate = counts.groupBy(*PAIR).agg((F.sum("tested_n") / F.sum("support_n")).alias("p"), F.sum("support_n").alias("n"))
    back = rate.select(F.col("downstream").alias("upstream"), F.col("upstream").alias("downstream"), F.col("p").alias("p_back"), F.col("n").alias("n_back"))
    flag = F.coalesce((F.col("p") >= share) & (F.col("p_back") >= share) & (F.col("n") >= floor) & (F.col("n_back") >= floor), F.lit(False))
    return rate.join(back, PAIR, "left").withColumn("is_bundled", flag)


def funnel(counts: DataFrame, edge_table: DataFrame, positive: str, negative: str) -> DataFrame:
    """Pairs at each stage: any branch, both branches, support, events."""
    any_branch = counts.where(F.col("outcome").isin(positive, negative)).agg(F.countDistinct(*PAIR).alias("any_branch"))
    rest = edge_table.agg(
        F.count("*").alias("both_branches"), F.count(F.when(F.col("passes_support"), 1)).alias("support"), F.count(F.when(F.col("passes_support") & F.col("has_events"), 1)).alias("events")
    )
    return any_branch.crossJoin(rest)


def smoothing_sensitivity(edge_table: DataFrame, values: tuple[float, ...] = (0.1, 0.5, 1.0)) -> DataFrame:
    four = [F.col(c) for c in ("k_pos", "n_pos", "k_neg", "n_neg")]
    return edge_table.select(*PAIR, *[E.rate_ratio(*four, v).alias("ratio_" + str(v).replace(".", "_")) for v in values])


def degrees(edge_table: DataFrame) -> DataFrame:
    """Nodes with in- and out-degree and summed absolute log2 ratios, in one aggregation of both ends."""
    weight = F.abs(F.log2("ratio"))
    ends = edge_table.select(F.inline(F.array(F.struct(F.col("upstream").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), weight.alias("w")), F.struct(F.col("downstream").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"), weight.alias("w")))))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.sum(F.col("w") * F.col("o")).alias("out_weight"), F.sum(F.col("w") * F.col("i")).alias("in_weight"))


def gathered(observations: DataFrame) -> DataFrame:
    """(episode, items): an episode's items, no more than there are items, so that they can be paired in place after one shuffle."""
    return observations.groupBy("episode").agg(F.collect_list("item").alias("items"))


def panel_size(observations: DataFrame) -> DataFrame:
    """For each upstream item: mean, median, 90 % point and share of two or more other items observed in its episodes."""
    rows = gathered(observations).select(F.explode("items").alias("upstream"), (F.size("items") - 1).alias("others"))
    return rows.groupBy("upstream").agg(F.avg("others").alias("mean_panel"), F.median("others").alias("median_panel"), F.percentile("others", 0.9).alias("q90_panel"), F.avg((F.col("others") >= 2).cast("int")).alias("share_two_more"))


def overlap(observations: DataFrame) -> DataFrame:
    """Jaccard overlap of the episodes of each two items, from counts; no set is ever built."""
    own = observations.groupBy("item").agg(F.count("*").alias("n"))
    both = gathered(observations).select("items", F.explode("items").alias("a")).select("a", F.explode("items").alias("b")).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    out = both.join(own.select(F.col("item").alias("a"), F.col("n").alias("n_a")), "a").join(own.select(F.col("item").alias("b"), F.col("n").alias("n_b")), "b")
    return out.select("a", "b", "shared", (F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).alias("jaccard"))


def rates_with_reverse(counts: DataFrame) -> DataFrame:
    """Timing asymmetry |log p - log p back| on smoothed rates and bundling min(p, p back) on plain ones, for each pair with a reverse."""
    rate = counts.groupBy(*PAIR).agg(F.sum("tested_n").alias("k"), F.sum("support_n").alias("n"))
    back = rate.select(F.col("downstream").alias("upstream"), F.col("upstream").alias("downstream"), F.col("k").alias("kb"), F.col("n").alias("nb"))
    s = E.smoothed_rate
    return rate.join(back, PAIR).select(
        *PAIR,
        F.abs(F.log(s(F.col("k"), F.col("n"))) - F.log(s(F.col("kb"), F.col("nb")))).alias("timing_asymmetry"),
        F.least(F.col("k") / F.col("n"), F.col("kb") / F.col("nb")).alias("bundling"),
        (F.least("n", "nb") / F.greatest("n", "nb")).alias("support_ratio"),
    )


def bundling(counts: DataFrame) -> DataFrame:
    """The same for each two items, once."""
    return rates_with_reverse(counts).where("upstream < downstream")


def display_edges(edge_table: DataFrame, min_fold: float) -> DataFrame:
    """Edges of at least a given fold change in either direction."""
    return edge_table.withColumn("log2_ratio", F.log2("ratio")).where(F.abs("log2_ratio") >= F.log2(F.lit(min_fold)) - 1e-12)


def downstream_triggers(edge_table: DataFrame) -> DataFrame:
    """For each downstream item: distinct upstream items by direction and the largest ratio."""
    up = lambda d: F.countDistinct(F.when(E.direction(F.col("ratio")) == d, F.col("upstream")))
    return edge_table.groupBy("downstream").agg(up("escalation").alias("escalating"), up("suppression").alias("suppressing"), F.max("ratio").alias("largest"))


def categorised(edge_table: DataFrame, categories: DataFrame, rank: Column | None = None) -> DataFrame:
    """Support-weighted mean ratio and share of support for each category transition; categories: (item, category, step)."""
    ends = edge_table.withColumn("n", F.col("n_pos") + F.col("n_neg"))
    u = categories.select(F.col("item").alias("upstream"), F.col("category").alias("from_category"), F.col("step").alias("__s"))
    d = categories.select(F.col("item").alias("downstream"), F.col("category").alias("to_category"), F.col("step").alias("__t"))
    moved = ends.join(u, "upstream", "left").join(d, "downstream", "left").withColumn("step", F.col("__t") - F.col("__s"))
    out = moved.groupBy("from_category", "to_category", "step").agg(F.count("*").alias("edges"), (F.sum(F.col("n") * F.col("ratio")) / F.sum("n")).alias("weighted_ratio"), F.sum("n").alias("support"))
    return out.withColumn("support_share", F.col("support") / F.sum("support").over(Window.partitionBy()))
