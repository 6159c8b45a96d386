"""Descriptive tables: by scope, by band, quartiles, availability exposure, balance of covariates, correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import small
from .opportunity import CELL, item_bit, item_bits


def by_scope(df: DataFrame, scope: str, aggs: list[Column], all_label: str = "all_sites") -> DataFrame:
    """Aggregates for each value of scope and for all rows, in one pass (null scopes count as 'unknown')."""
    named = df.withColumn(scope, F.coalesce(F.col(scope).cast("string"), F.lit("unknown")))
    return named.rollup(scope).agg(*aggs).withColumn(scope, F.coalesce(F.col(scope), F.lit(all_label)))


def availability_exposure(all_seen: DataFrame, thin: int) -> DataFrame:
    """First and last time that each item was seen in a site and era, episodes of the cell outside that time, thin support.

    Cells' daily episode counts are joined to the item windows, so episodes x items never form.
    """
    windows = all_seen.groupBy("site", "era", "item").agg(F.min("time").alias("first_seen"), F.max("time").alias("last_seen"), F.countDistinct("episode").alias("support"))
    days = all_seen.groupBy("site", "era", "time").agg(F.countDistinct("episode").alias("n"))
    joined = windows.join(days, ["site", "era"])
    out = joined.groupBy("site", "era", "item", "first_seen", "last_seen", "support").agg(
        F.sum(F.when(F.col("time") < F.col("first_seen"), F.col("n")).otherwise(0)).alias("before"), F.sum(F.when(F.col("time") > F.col("last_seen"), F.col("n")).otherwise(0)).alias("after")
    )
    return out.withColumn("is_thin", F.col("support") < thin)


def quartiles(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Count, mean and exact quartiles (linear interpolation) of a number with few distinct values; see ranges.quantiles for others."""
    p = [F.percentile(value, q).alias(name) for name, q in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))]
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), *p)


def episodes_per_unit(all_seen: DataFrame) -> DataFrame:
    """Units by their number of episodes, in bands, for each site."""
    per = all_seen.groupBy("site", "unit").agg(F.countDistinct("episode").alias("n"))
    band = F.when(F.col("n") == 1, "1").when(F.col("n") == 2, "2").when(F.col("n") <= 5, "3-5").when(F.col("n") <= 10, "6-10").otherwise(">10")
    return per.withColumn("band", band).groupBy("site", "band").agg(F.count("*").alias("units"), F.sum("n").alias("episodes"))


def panel_breadth(observations: DataFrame, episodes: DataFrame) -> DataFrame:
    """Quartiles of the number of resolved items of an episode, for each site; episodes without one count as 0."""
    per = observations.groupBy("episode").agg(F.count("*").alias("items"))
    return quartiles(episodes.select("site", "episode").distinct().join(per, "episode", "left").fillna(0, ["items"]), "items", ["site"])


def most_severe(df: DataFrame, keys: list[str], outcome: str, order: list[str]) -> DataFrame:
    """One row for each key with its most severe outcome (the first of order), and whether outcomes conflicted."""
    rank = F.coalesce(*[F.when(F.col(outcome) == o, F.lit(len(order) - k)) for k, o in enumerate(order)])
    out = df.groupBy(*keys).agg(F.max(rank).alias("__rank"), (F.min(outcome) != F.max(outcome)).alias("in_conflict"))
    named = F.coalesce(*[F.when(F.col("__rank") == len(order) - k, F.lit(o)) for k, o in enumerate(order)])
    return out.withColumn("worst", named).drop("__rank")


def antibiogram(all_seen: DataFrame, order: list[str]) -> DataFrame:
    """For each item: episodes, share of the most severe outcome, conflicts."""
    one = most_severe(all_seen, ["episode", "item"], "outcome", order)
    return one.groupBy("item").agg(F.count("*").alias("episodes"), F.avg((F.col("worst") == order[0]).cast("int")).alias("share_worst"), F.count(F.when(F.col("in_conflict"), 1)).alias("conflicts"))


def first_per_year(episodes: DataFrame) -> DataFrame:
    """Each unit's first episode of a year."""
    order = Window.partitionBy("site", "unit", F.year("time")).orderBy("time", "episode")
    return episodes.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def coverage_by_era(observations: DataFrame, all_seen: DataFrame) -> DataFrame:
    """Share of a era's episodes that show each item, and any item ('ALL')."""
    total = all_seen.groupBy("era").agg(F.countDistinct("episode").alias("episodes"))
    seen = observations.rollup("era", "item").agg(F.countDistinct("episode").alias("observed")).where("era is not null")
    out = seen.withColumn("item", F.coalesce("item", F.lit("ALL"))).join(total, "era")
    return out.withColumn("coverage", F.col("observed") / F.col("episodes"))


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    wide = df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1)))
    return wide.fillna(0)


def difference_numeric(df: DataFrame, group: str, value: str) -> DataFrame:
    """Absolute standardised mean difference of a number between two groups (boolean), pooled standard deviation."""
    g = lambda f, k: f(F.when(F.col(group) == F.lit(k), F.col(value)))
    s = df.agg(g(F.avg, True).alias("m1"), g(F.avg, False).alias("m0"), F.coalesce(g(F.var_samp, True), F.lit(0.0)).alias("v1"), F.coalesce(g(F.var_samp, False), F.lit(0.0)).alias("v0"))
    pooled = F.sqrt((F.col("v1") + F.col("v0")) / 2)
    return s.select(F.lit(value).alias("covariate"), (F.abs(F.col("m1") - F.col("m0")) / F.nullif(pooled, F.lit(0.0))).alias("difference"))


def difference_by_level(df: DataFrame, group: str, covariate: str) -> DataFrame:
    """The same for each level of a category: shares p and their variance p (1 - p)."""
    counts = df.where(F.col(covariate).isNotNull()).groupBy(covariate).agg(F.count(F.when(F.col(group), 1)).alias("a"), F.count(F.when(~F.col(group), 1)).alias("b"))
    totals = counts.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    p = counts.crossJoin(F.broadcast(totals)).select(F.lit(covariate).alias("covariate"), F.col(covariate).alias("level"), (F.col("a") / F.nullif(F.col("na"), F.lit(0))).alias("p1"), (F.col("b") / F.nullif(F.col("nb"), F.lit(0))).alias("p0"))
    pooled = F.sqrt((F.col("p1") * (1 - F.col("p1")) + F.col("p0") * (1 - F.col("p0"))) / 2)
    return p.withColumn("difference", F.abs(F.col("p1") - F.col("p0")) / F.nullif(pooled, F.lit(0.0)))


def balance_by_item(all_seen: DataFrame, covariate: str) -> DataFrame:
    """(item, covariate, level, p1, p0, difference): shares of a category among episodes that show an item and those that don't, for every item.

    all_seen: one row for each episode and item. Counts by item and level and by level alone say it all; null levels don't count.
    """
    rows = all_seen.where(F.col(covariate).isNotNull())
    total = rows.groupBy(covariate).agg(F.countDistinct("episode").alias("n"))
    shown = rows.groupBy("item", covariate).agg(F.count("*").alias("a"))
    grid = rows.select("item").distinct().crossJoin(small(total)).join(shown, ["item", covariate], "left").fillna(0, ["a"])  # items x levels
    own = Window.partitionBy("item")
    p1 = F.col("a") / F.nullif(F.sum("a").over(own), F.lit(0))
    p0 = (F.col("n") - F.col("a")) / F.nullif(F.sum(F.col("n") - F.col("a")).over(own), F.lit(0))
    out = grid.select("item", F.lit(covariate).alias("covariate"), F.col(covariate).alias("level"), p1.alias("p1"), p0.alias("p0"))
    pooled = F.sqrt((F.col("p1") * (1 - F.col("p1")) + F.col("p0") * (1 - F.col("p0"))) / 2)
    return out.withColumn("difference", F.abs(F.col("p1") - F.col("p0")) / F.nullif(pooled, F.lit(0.0)))


def level_correlations(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson correlation of every two levels' indicators of two categories, from counts (phi)."""
    n = df.agg(F.count("*").alias("n"))
    x = df.groupBy(a).agg(F.count("*").alias("nx"))
    y = df.groupBy(b).agg(F.count("*").alias("ny"))
    both = df.groupBy(a, b).agg(F.count("*").alias("nxy"))
    grid = x.crossJoin(y).join(both, [a, b], "left").fillna(0, ["nxy"]).crossJoin(F.broadcast(n))  # levels x levels
    d = lambda c: F.col(c).cast("double")
    top = d("n") * d("nxy") - d("nx") * d("ny")
    below = F.sqrt(d("nx") * (d("n") - d("nx")) * d("ny") * (d("n") - d("ny")))
    return grid.select(F.col(a).alias("level_a"), F.col(b).alias("level_b"), (top / F.nullif(below, F.lit(0.0))).alias("correlation"))


def frequent(df: DataFrame, value: str, coverage: float) -> DataFrame:
    """The most frequent values that together reach a share of all rows; ties by name."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    order = Window.orderBy(F.desc("n"), value)
    out = counts.withColumns({"running": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(Window.partitionBy())})
    return out.where((F.col("running") - F.col("n")) < coverage * F.col("total")).select(value, "n", (F.col("running") / F.col("total")).alias("coverage"))


def flags_of(df: DataFrame, key: str, value: str, values: list[str]) -> DataFrame:
    """Key by value, 0 or 1, for given values, from one grouping; rows without a key have a row of zeros."""
    bits = item_bits(value, values)
    wide = df.groupBy(key).agg(*bits) if bits else df.select(key).distinct()
    return wide.select(key, *[F.when(F.col(key).isNull(), 0).otherwise(item_bit(k)).alias(v) for k, v in enumerate(values)])


def study_period(df: DataFrame, time: str) -> DataFrame:
    return df.agg(F.date_format(F.min(time), "MMMM yyyy").alias("first_month"), F.date_format(F.max(time), "MMMM yyyy").alias("last_month"), F.countDistinct(F.year(time)).alias("years"))


def cell_sizes(all_seen: DataFrame) -> DataFrame:
    return all_seen.groupBy(*CELL).agg(F.countDistinct("episode").alias("episodes"), F.countDistinct("unit").alias("units"), F.countDistinct("item").alias("items"))
