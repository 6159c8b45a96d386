"""The opportunity space: which items an episode could have shown, beside those that it did show.

Observations have the columns site, unit, episode, time, stratum, item, outcome. Whether an item was available depends only on
the episode's cell (site, stratum, era), so counts over the space are taken from cells and never need the rows of the full
episode x item grid; `grid` builds those rows where they are wanted themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import era
from ..sources.tables import small, written

CELL = ["site", "stratum", "era"]
#: Items of one number of bits.
BITS = 62
EPISODE = ["site", "unit", "episode", "time", "stratum", "era"]


def with_era(observations: DataFrame, width: int = 5) -> DataFrame:
    return observations.withColumn("era", era(F.col("time"), width))


def availability(observations: DataFrame, min_support: int, intrinsic: DataFrame | None = None) -> DataFrame:
    """(site, stratum, era, item, support, is_available, is_intrinsic, is_eligible) of items seen in a cell.

    support: distinct episodes. intrinsic: (stratum, item) pairs that are never eligible; it goes by an ordinary join.
    """
    cells = observations.groupBy(*CELL, "item").agg(F.countDistinct("episode").alias("support"))
    cells = cells.withColumn("is_available", F.col("support") >= min_support)
    if intrinsic is not None:
        cells = cells.join(intrinsic.select("stratum", "item", F.lit(True).alias("is_intrinsic")).distinct(), ["stratum", "item"], "left")
        cells = cells.withColumn("is_intrinsic", F.coalesce("is_intrinsic", F.lit(False)))
    else:
        cells = cells.withColumn("is_intrinsic", F.lit(False))
    return cells.withColumn("is_eligible", F.col("is_available") & ~F.col("is_intrinsic"))


def grid(observations: DataFrame, min_support: int, intrinsic: DataFrame | None = None) -> DataFrame:
    """A row for each episode and item of its cell or elsewhere: eligibility and observation states.

    This grows with episodes times items, which is what a caller of it asks for; `cell_states` has counts without it. The cells'
    states (cells times items) are written and counted: few of them are broadcast, so that a large cell's episodes stay where they are.
    """
    episodes = observations.select(*EPISODE).distinct()
    items = observations.select("item").distinct()
    cells = observations.select(*CELL).distinct().crossJoin(items)  # cells x items: small by construction
    state = cells.join(availability(observations, min_support, intrinsic), [*CELL, "item"], "left")
    if intrinsic is not None:
        named = intrinsic.select("stratum", "item", F.lit(True).alias("__i")).distinct()
        state = state.join(named, ["stratum", "item"], "left").withColumn("is_intrinsic", F.coalesce("__i", F.lit(False))).drop("__i")
    state = state.fillna({"support": 0, "is_available": False, "is_intrinsic": False, "is_eligible": False})
    state = small(written(state, "states"))
    seen = observations.select("episode", "item").distinct().withColumn("__seen", F.lit(1))
    out = episodes.join(state, CELL).join(seen, ["episode", "item"], "left").withColumn("is_observed", F.coalesce("__seen", F.lit(0))).drop("__seen")
    status = F.when(F.col("is_intrinsic"), "intrinsic").when(~F.col("is_available"), "unavailable").when(F.col("is_observed") == 1, "eligible_observed").otherwise("eligible_unobserved")
    return out.withColumn("state", status)


def cell_states(observations: DataFrame, min_support: int, intrinsic: DataFrame | None = None) -> DataFrame:
    """(cell, item, state, n, observed): the grid's states counted from cells, without its rows.

    A cell's episodes share an item's eligibility; those that show the item are its support, the others are not observed.
    """
    items = observations.select("item").distinct()
    sizes = observations.groupBy(*CELL).agg(F.countDistinct("episode").alias("episodes"))
    state = sizes.crossJoin(small(items)).join(availability(observations, min_support, intrinsic).drop("is_eligible", "is_intrinsic"), [*CELL, "item"], "left")
    state = state.fillna({"support": 0, "is_available": False})
    named = intrinsic.select("stratum", "item", F.lit(True).alias("is_intrinsic")).distinct() if intrinsic is not None else None
    state = state.join(named, ["stratum", "item"], "left") if named is not None else state.withColumn("is_intrinsic", F.lit(False))
    kept = F.when(F.coalesce("is_intrinsic", F.lit(False)), "intrinsic").when(~F.col("is_available"), "unavailable")
    rest = F.col("episodes") - F.col("support")
    parts = F.when(kept.isNotNull(), F.array(F.struct(kept.alias("state"), F.col("episodes").alias("n"), F.col("support").alias("observed")))).otherwise(
        F.array(F.struct(F.lit("eligible_observed").alias("state"), F.col("support").alias("n"), F.col("support").alias("observed")), F.struct(F.lit("eligible_unobserved").alias("state"), rest.alias("n"), F.lit(0).cast("bigint").alias("observed")))
    )
    return state.select(*CELL, "item", F.inline(parts)).where("n > 0")


def space_summary(observations: DataFrame, min_support: int, intrinsic: DataFrame | None = None) -> DataFrame:
    """Sizes of the space for each site and for all sites ('all_sites'), from cell counts alone."""
    cells = availability(observations, min_support, intrinsic)
    episodes = observations.groupBy(*CELL).agg(F.countDistinct("episode").alias("episodes"))
    items = observations.agg(F.countDistinct("item").alias("n_items"))
    per = cells.groupBy(*CELL).agg(F.count(F.when(F.col("is_eligible"), 1)).alias("eligible_items"), F.sum(F.when(F.col("is_eligible"), F.col("support")).otherwise(0)).alias("observed"))
    wide = episodes.join(per, CELL).crossJoin(F.broadcast(items))  # one row
    sums = [
        F.sum("episodes").alias("episodes"),
        F.sum(F.col("episodes") * F.col("n_items")).alias("grid_rows"),
        F.sum(F.col("episodes") * F.col("eligible_items")).alias("eligible_rows"),
        F.sum("observed").alias("observed_rows"),
    ]
    out = wide.rollup("site").agg(*sums).withColumn("site", F.coalesce("site", F.lit("all_sites")))
    return out.withColumn("observed_share", F.col("observed_rows") / F.nullif(F.col("eligible_rows"), F.lit(0)))


def item_bits(item: str, items: Sequence[str]) -> list[Column]:
    """Aggregates __b0, __b1, ... that hold which of the items a group has, a bit for each: what a group takes are a few numbers."""
    place = F.array_position(F.array(*[F.lit(i) for i in items]).cast("array<string>"), F.col(item)) - 1
    one = F.lit(1).cast("bigint")
    return [F.bit_or(F.when((place >= k) & (place < k + BITS), F.call_function("shiftleft", one, (place - k).cast("int")))).alias(f"__b{k // BITS}") for k in range(0, len(items), BITS)]


def item_bit(k: int) -> Column:
    """Whether a group has the k-th item, 0 or 1."""
    return F.coalesce(F.shiftright(f"__b{k // BITS}", k % BITS).bitwiseAND(F.lit(1).cast("bigint")).cast("int"), F.lit(0))


def testing_matrix(observations: DataFrame, items: list[str], prefix: str = "tested__") -> DataFrame:
    """Episode by item, 0 or 1, from one grouping."""
    bits = item_bits("item", items)
    rows = observations.where(F.col("item").isNotNull()).groupBy("episode")
    wide = rows.agg(*bits) if bits else rows.agg(F.lit(0)).select("episode")
    return wide.select("episode", *[item_bit(k).alias(prefix + "".join(x if x.isalnum() else "_" for x in c.lower())) for k, c in enumerate(items)])
