"""Prevalence of a positive outcome under selective observation: naive, bounded, standardised, tilted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .opportunity import CELL, availability


def item_cells(observations: DataFrame, all_seen: DataFrame, min_support: int, positive: str, intrinsic: DataFrame | None = None) -> DataFrame:
    """(cell, item, eligible, evaluable, positive): counts of eligible episodes, of resolved results and of positive ones."""
    cells = availability(all_seen, min_support, intrinsic).where("is_eligible").select(*CELL, "item")
    episodes = all_seen.groupBy(*CELL).agg(F.countDistinct("episode").alias("eligible"))
    seen = observations.groupBy(*CELL, "item").agg(F.count("*").alias("evaluable"), F.count(F.when(F.col("outcome") == positive, 1)).alias("positive"))
    return cells.join(episodes, CELL).join(seen, [*CELL, "item"], "left").fillna(0, ["evaluable", "positive"])


def summary(cells: DataFrame, min_eligible: int = 200, min_evaluable: int = 30) -> DataFrame:
    """For each item: naive r / t, bounds r / e and (r + u) / e, and rates standardised to the eligible cells.

    A cell without results gives no rate; the standardised prevalence is over cells that have one.
    """
    weight, rate = F.col("eligible"), F.col("positive") / F.nullif(F.col("evaluable"), F.lit(0))
    out = cells.groupBy("item").agg(
        F.sum("eligible").alias("eligible"), F.sum("evaluable").alias("evaluable"), F.sum("positive").alias("positive"),
        (F.sum(weight * rate) / F.sum(F.when(rate.isNotNull(), weight))).alias("standardised"),
    ).where((F.col("eligible") >= min_eligible) & (F.col("evaluable") >= min_evaluable))
    unknown = F.col("eligible") - F.col("evaluable")
    return out.withColumns({
        "naive": F.col("positive") / F.col("evaluable"), "lower": F.col("positive") / F.col("eligible"), "upper": (F.col("positive") + unknown) / F.col("eligible"),
    }).withColumn("shift", F.col("standardised") - F.col("naive"))


def delta_curve(table: DataFrame, steps: int = 41, top: float = 2.0) -> DataFrame:
    """Prevalence if unobserved episodes were positive at delta times the naive rate, 1 at most."""
    spark = table.sparkSession
    deltas = spark.range(steps).select((F.col("id") * (top / (steps - 1))).alias("delta"))
    curve = table.crossJoin(F.broadcast(deltas))  # a fixed number of steps for each item
    rate = F.least(F.lit(1.0), F.col("delta") * F.col("naive"))
    return curve.select("item", F.round("delta", 6).alias("delta"), ((F.col("positive") + rate * (F.col("eligible") - F.col("evaluable"))) / F.col("eligible")).alias("prevalence"))


def tilt_curve(table: DataFrame, tilts: list[float]) -> DataFrame:
    """Prevalence if the odds of unobserved episodes are exp(-tilt) times those of the standardised rate."""
    spark = table.sparkSession
    steps = spark.createDataFrame([(float(t),) for t in tilts], "tilt double")
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("standardised")))
    odds = p / (1 - p) * F.exp(-F.col("tilt"))
    moved = odds / (1 + odds)
    curve = table.crossJoin(F.broadcast(steps))
    return curve.select("item", "tilt", ((F.col("positive") + moved * (F.col("eligible") - F.col("evaluable"))) / F.col("eligible")).alias("prevalence"))


def crossings(curve: DataFrame, thresholds: list[float]) -> DataFrame:
    """Where each item's tilt curve crosses a threshold: linear interpolation, the crossing nearest to no tilt."""
    spark = curve.sparkSession
    levels = spark.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    order = Window.partitionBy("item", "threshold").orderBy("tilt")
    d = F.col("prevalence") - F.col("threshold")
    rows = curve.crossJoin(F.broadcast(levels)).withColumn("d", d).withColumns({"d1": F.lead("d").over(order), "t1": F.lead("tilt").over(order)})
    root = F.when((F.col("d") == 0), F.col("tilt")).when(F.col("d") * F.col("d1") < 0, F.col("tilt") + (F.col("t1") - F.col("tilt")) * F.col("d") / (F.col("d") - F.col("d1")))
    rows = rows.withColumn("root", root)
    out = rows.groupBy("item", "threshold").agg(F.min_by("root", F.when(F.col("root").isNotNull(), F.struct(F.abs("root"), F.col("root")))).alias("tipping"), F.min("d").alias("lo"), F.max("d").alias("hi"))
    status = F.when(F.col("tipping").isNotNull(), "crosses").when(F.col("lo") > 0, "always_above").when(F.col("hi") < 0, "always_below").otherwise("not_evaluable")
    return out.select("item", "threshold", "tipping", status.alias("status"))


def enrichment(observations: DataFrame, pairs: DataFrame, positive: str) -> DataFrame:
    """For each pair: share of positive upstream results among episodes that show the downstream item, less the share among all."""
    is_pos = (F.col("outcome") == positive).cast("int")
    every = observations.groupBy(F.col("item").alias("upstream")).agg(F.avg(is_pos).alias("share_all"))
    # an episode's items are gathered once and paired in place
    together = observations.groupBy("episode").agg(F.collect_list(F.struct(F.col("item").alias("upstream"), is_pos.alias("is_pos"))).alias("results"))
    paired = together.select("results", F.inline("results")).select("upstream", "is_pos", F.explode("results.upstream").alias("downstream"))
    shown = paired.where("upstream <> downstream").groupBy("upstream", "downstream").agg(F.avg("is_pos").alias("share_shown"), F.count("*").alias("episodes"))
    return shown.join(pairs.select("upstream", "downstream").distinct(), ["upstream", "downstream"], "left_semi").join(every, "upstream").withColumn("enrichment", F.col("share_shown") - F.col("share_all"))
