"""Tables that readers see: canonical edges, thinned curves, rankings, sensitivities of labels and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import effects as E
from ..sources.tables import written
from . import ranges
from .patterns import PAIR, rates_with_reverse

#: Order of validation labels in reports.
STATUS_ORDER = ("robust", "supported", "mixed", "insufficient")


def canonical(edges: DataFrame, support: Column, aliases: DataFrame) -> DataFrame:
    """Edges under their items' canonical names, one for each ordered pair: that of the largest support, ties to the smaller raw pair.

    aliases: (item, canonical), one row for each item; items without one keep their names. `collapsed` is how many other edges had
    the same pair. A pair's two directions are two edges.
    """
    from .cleaning import assert_unique

    named = assert_unique(aliases.select("item", "canonical"), ["item"])
    raw = {c: f"__{c}" for c in PAIR}
    out = edges.withColumnsRenamed(raw)
    for c in PAIR:
        out = out.join(named.select(F.col("item").alias(raw[c]), F.col("canonical").alias(c)), raw[c], "left").withColumn(c, F.coalesce(c, raw[c]))
    every = Window.partitionBy(*PAIR)
    out = out.withColumns({"__n": F.row_number().over(every.orderBy(support.desc_nulls_last(), *raw.values())), "collapsed": F.count("*").over(every) - 1})
    return out.where("__n = 1").drop("__n", *raw.values())


def direction_conflicts(edges: DataFrame, stored: str) -> DataFrame:
    """(edges, conflicts): edges whose stored direction is not the one that their ratio says; a caller raises on any."""
    return edges.agg(F.count("*").alias("edges"), F.count(F.when(~F.col(stored).eqNullSafe(E.direction(F.col("ratio"))), 1)).alias("conflicts"))


def thinned(curve: DataFrame, by: Sequence[str], order: str, x: str, y: str, points: int) -> DataFrame:
    """About `points` of each curve's points, evenly spaced along its length, the first and the last always; curves with no more stay whole.

    A point stays if it enters another of points - 1 equal steps of the curve's length. Lengths are summed within ranges of
    `order`, a number that no two points of a curve share, and over the ranges, so that no task has a whole curve.
    """
    columns = curve.columns
    rows = written(curve.withColumn("__at", F.struct(F.col(order).alias("at"), F.col(x).alias("x"), F.col(y).alias("y"))), "curve")
    rows = ranges.ranged(rows, order, ranges.borders(rows, order))
    ends = rows.groupBy(*by, "__range").agg(F.max("__at").alias("last"), F.count("*").alias("n"))
    over = Window.partitionBy(*by)
    ends = ends.select(*by, "__range", F.lag("last").over(over.orderBy("__range")).alias("__entry"), F.max("last").over(over).alias("__end"), F.sum("n").over(over).alias("__count"))
    inside = Window.partitionBy(*by, "__range").orderBy(order)
    rows = ranges.matched(rows, ends, [*by, "__range"]).withColumn("__back", F.coalesce(F.lag("__at").over(inside), "__entry"))
    dx, dy = (F.col("__at")[c] - F.col("__back")[c] for c in ("x", "y"))
    rows = rows.withColumn("__d", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0)))
    lengths = ranges.before_ranges(rows.groupBy(*by, "__range").agg(F.sum("__d").alias("__d")), by, ["__d"])
    rows = ranges.matched(rows, lengths, [*by, "__range"])
    step = lambda length: F.floor(F.round(length * (points - 1) / F.nullif(F.col("__d_all"), F.lit(0.0)), 9))
    upto = F.col("__d_before") + F.sum("__d").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__upto", upto)
    before = F.coalesce(F.lag("__upto").over(inside), F.col("__d_before"))
    stays = (F.col("__count") <= points) | F.col("__back").isNull() | (F.col("__at")["at"] == F.col("__end")["at"]) | (step(F.col("__upto")) > F.col("__step_back"))
    return rows.withColumn("__step_back", step(before)).where(stays).select(columns)


def ranked_shifts(summary: DataFrame, n: int) -> DataFrame:
    """The n items whose standardised prevalence moves most from the naive one; ties: eligible, evaluable, item."""
    order = [F.desc(F.round(F.abs("shift"), 9)), F.desc("eligible"), F.desc("evaluable"), "item"]
    return summary.where("shift is not null").orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def primary(labelled: DataFrame, n: int) -> DataFrame:
    """The first n edges by label, then by how far the ratio is from 1."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), F.col("validation_status"))
    return labelled.orderBy(rank, F.desc(F.round(F.abs(F.log("ratio")), 9)), *PAIR).limit(n)


def conservative(edges: DataFrame, n: int) -> DataFrame:
    """The first n edges by the interval's bound nearest to 1: those above 1 by the lower, those below by the upper bound."""
    bound = F.when(F.col("ratio") >= 1, F.log("ci_low")).otherwise(-F.log("ci_high"))
    return edges.withColumn("near_bound", bound).orderBy(F.desc(F.round("near_bound", 9)), *PAIR).limit(n)


def smoothing_table(edges: DataFrame, n: int, values: Sequence[float] = (0.1, 0.5, 1.0)) -> DataFrame:
    """The n edges furthest from 1, a row for each smoothing value."""
    best = edges.orderBy(F.desc(F.round(F.abs(F.log("ratio")), 9)), *PAIR).limit(n)
    four = [F.col(c) for c in ("k_pos", "n_pos", "k_neg", "n_neg")]
    return best.select(*PAIR, F.inline(F.array(*[F.struct(F.lit(v).alias("smoothing"), E.rate_ratio(*four, v).alias("ratio")) for v in values])))


def in_category_order(df: DataFrame, order: Sequence[str], category: str, sparse: Column, value: str, name: str) -> DataFrame:
    """df with its place by category, sparse rows last in theirs, value falling, then name."""
    rank = F.array_position(F.array(*[F.lit(c) for c in order]), F.col(category))
    every = [F.when(F.coalesce(rank, F.lit(0)) == 0, len(order) + 1).otherwise(rank), sparse.cast("int"), F.desc(F.round(value, 9)), F.col(name)]
    return df.withColumn("place", F.row_number().over(Window.orderBy(*every)))  # a row for each item


def existence(edges: DataFrame, scope: str, scopes: DataFrame) -> DataFrame:
    """For each scope of a list, also one without edges: pairs tested, those above 1, whether there is any, largest and median ratio."""
    per = edges.groupBy(scope).agg(F.count("*").alias("edges"), F.count(F.when(F.col("ratio") > 1, 1)).alias("above"), F.max("ratio").alias("largest"), F.median("ratio").alias("median"))
    out = scopes.select(scope).distinct().join(per, scope, "left").fillna(0, ["edges", "above"])
    return out.withColumn("found", F.col("above") > 0)


def screened(counts: DataFrame, flagged: DataFrame) -> DataFrame:
    """Pair counts without the flagged pairs, in both directions."""
    both = flagged.select(*PAIR).unionByName(flagged.select(F.col("downstream").alias("upstream"), F.col("upstream").alias("downstream"))).distinct()
    return counts.join(both, PAIR, "left_anti")


def dependence(counts: DataFrame, edges: DataFrame) -> DataFrame:
    """Each edge with its pair's timing asymmetry, bundling and support ratio, and how the bundling grades it."""
    pair = rates_with_reverse(counts)
    grade = F.when(F.col("bundling") >= 0.8, "bundled").when(F.col("bundling") >= 0.5, "partly_bundled").otherwise("separate")
    return edges.join(pair, PAIR).withColumn("grade", grade)


def mutual_dependence(counts: DataFrame, positive: str, negative: str) -> DataFrame:
    """(pair, ratio, reverse_ratio, asymmetry, rate, reverse_rate, rate_asymmetry, support_ratio, overlap) within each two items' common cells.

    counts: branch counts of cells in which both items are eligible. Both directions so draw on the same cells: support is the
    episodes that show the upstream item there, and the episodes that show both are what the two have in common, so the overlap of
    the two sets of episodes comes from counts.
    """
    pick = lambda o, c: F.coalesce(F.sum(F.when(F.col("outcome") == o, F.col(c))), F.lit(0))
    one = counts.groupBy(*PAIR).agg(
        F.sum("support_n").alias("n"), F.sum("tested_n").alias("k"), pick(positive, "tested_n").alias("k1"), pick(positive, "support_n").alias("n1"), pick(negative, "tested_n").alias("k0"), pick(negative, "support_n").alias("n0")
    )
    ratio = F.when((F.col("n1") > 0) & (F.col("n0") > 0), E.rate_ratio(*[F.col(c) for c in ("k1", "n1", "k0", "n0")]))
    one = one.select(*PAIR, "n", "k", ratio.alias("ratio"), E.smoothed_rate(F.col("k"), F.col("n")).alias("rate"))
    back = one.select(F.col("downstream").alias("upstream"), F.col("upstream").alias("downstream"), F.col("n").alias("nb"), F.col("ratio").alias("reverse_ratio"), F.col("rate").alias("reverse_rate"))
    out = one.join(back, PAIR, "left")
    return out.select(
        *PAIR, "ratio", "reverse_ratio", (F.log("ratio") - F.log("reverse_ratio")).alias("asymmetry"), "rate", "reverse_rate", F.abs(F.log("rate") - F.log("reverse_rate")).alias("rate_asymmetry"),
        (F.least("n", "nb") / F.greatest("n", "nb")).alias("support_ratio"), (F.col("k") / (F.col("n") + F.col("nb") - F.col("k"))).alias("overlap"),
    )


def label_sensitivity(rows: DataFrame, i2_limits: Sequence[float], z_limits: Sequence[float]) -> DataFrame:
    """(i2_limit, z_limit, replicated): pooled edges that count as replicated under each two limits, in one pass."""
    cells = [(i, z) for i in i2_limits for z in z_limits]
    wide = rows.agg(*[F.count(F.when((F.col("i2") <= i) & (F.abs("z") >= z), 1)).alias(f"c{k}") for k, (i, z) in enumerate(cells)])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(float(i)).alias("i2_limit"), F.lit(float(z)).alias("z_limit"), F.col(f"c{k}").alias("replicated")) for k, (i, z) in enumerate(cells)])))


def bundling_bands(labelled: DataFrame, counts: DataFrame, primary: float, stricter: float, min_support: int = 25) -> DataFrame:
    """(band, validation_status, pairs): retained pairs that a stricter screen for bundling would leave out, and those that it would keep.

    A pair is left out at a threshold if both directions' rates reach it, with min_support episodes in each. A retained pair that
    the primary threshold leaves out makes the query fail: the screen wasn't applied.
    """
    rate = counts.groupBy(*PAIR).agg((F.sum("tested_n") / F.sum("support_n")).alias("__p"), F.sum("support_n").alias("__n"))
    back = rate.select(F.col("downstream").alias("upstream"), F.col("upstream").alias("downstream"), F.col("__p").alias("__q"), F.col("__n").alias("__m"))
    out = lambda t: F.coalesce((F.col("__p") >= t) & (F.col("__q") >= t) & (F.col("__n") >= min_support) & (F.col("__m") >= min_support), F.lit(False))
    rows = labelled.select(*PAIR, "validation_status").join(rate, PAIR, "left").join(back, PAIR, "left")
    message = F.concat(F.lit("a retained pair meets the primary screen: "), "upstream", F.lit(", "), "downstream")
    band = F.when(out(primary), F.raise_error(message).cast("string")).when(out(stricter), "stricter_only").otherwise("kept")
    return rows.groupBy(band.alias("band"), "validation_status").agg(F.count("*").alias("pairs"))


def concordance(crude: Column, adjusted: Column, low: Column, high: Column) -> Column:
    """How an adjusted odds ratio bears on the crude ratio: unavailable, concordant, attenuated (the interval holds 1) or reversed."""
    same = F.signum(F.log(crude)) == F.signum(F.log(adjusted))
    return F.when(adjusted.isNull(), "unavailable").when((low <= 1) & (high >= 1), "attenuated").when(same, "concordant").otherwise("reversed")


def with_implied(observed: DataFrame, implied: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Observed rows and those implied rows whose key was not observed; is_implied tells them apart."""
    only = implied.join(observed.select(*keys).distinct(), list(keys), "left_anti")
    return observed.withColumn("is_implied", F.lit(False)).unionByName(only.withColumn("is_implied", F.lit(True)))
