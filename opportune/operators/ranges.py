"""Order over many tasks: ranges of a value whose borders follow the data, exact quantiles and running sums from them.

Borders come from a quantile sketch, so ranges hold about equally many rows however crowded the values are; results never
depend on where the borders are. Rows are ordered within ranges, and what ranges add up to is ordered over the ranges, of which
there are at most MOST_RANGES. A value that many rows share is counted before it is ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import small, written

#: Rows of a range, about, and most ranges.
RANGE_ROWS, MOST_RANGES = 500_000, 10_000


def borders(df: DataFrame, value: str) -> list[float]:
    """Ascending borders between ranges of about RANGE_ROWS rows of df; none if one range will do."""
    count = min(MOST_RANGES, -(-df.count() // RANGE_ROWS))
    if count < 2:
        return []
    found = df.agg(F.percentile_approx(F.col(value).cast("double"), [k / count for k in range(1, count)], 10 * count)).first()[0]
    return sorted({x for x in found or [] if abs(x) < float("inf")})


def ranged(df: DataFrame, value: str, between: Sequence[float], out: str = "__range") -> DataFrame:
    """df with the number of the range that a value is in: larger numbers hold larger values. Values aren't null or not a number."""
    if not between:
        return df.withColumn(out, F.lit(0))
    at = df.withColumn(f"{out}_value", F.col(value).cast("double"))
    cut = Bucketizer(splits=[float("-inf"), *between, float("inf")], inputCol=f"{out}_value", outputCol=out).transform(at)
    return cut.drop(f"{out}_value").withColumn(out, F.col(out).cast("int"))


def before_ranges(totals: DataFrame, by: Sequence[str], columns: Sequence[str], down: bool = False, range_col: str = "__range") -> DataFrame:
    """A row for each group and range with the sums over the ranges before it (down: after it), as <column>_before, and over all, as <column>_all."""
    order = Window.partitionBy(*by).orderBy(F.desc(range_col) if down else F.asc(range_col)).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    return totals.select(*by, range_col, *[F.coalesce(F.sum(c).over(order), zero).alias(f"{c}_before") for c in columns], *[F.sum(c).over(Window.partitionBy(*by)).alias(f"{c}_all") for c in columns])


def matched(df: DataFrame, side: DataFrame, on: Sequence[str]) -> DataFrame:
    """df joined with side, a row for each key, nulls being equal."""
    names = {c: f"__on_{k}" for k, c in enumerate(on)}
    side = small(side.withColumnsRenamed(names))
    same = F.lit(True)
    for c, other in names.items():
        same = same & F.col(c).eqNullSafe(F.col(other))
    return df.join(side, same).drop(*names.values())


def running(df: DataFrame, value: str, by: Sequence[str], columns: Sequence[str], down: bool = False) -> DataFrame:
    """df, one row for each group and value, with <column>_upto, the sum over values up to this one (down: from the largest), and <column>_all."""
    df = ranged(df, value, borders(df, value))
    sides = before_ranges(df.groupBy(*by, "__range").agg(*[F.sum(c).alias(c) for c in columns]), by, columns, down)
    order = Window.partitionBy(*by, "__range").orderBy(F.desc(value) if down else F.asc(value)).rowsBetween(Window.unboundedPreceding, 0)
    out = matched(df, sides, [*by, "__range"])
    return out.withColumns({f"{c}_upto": F.col(f"{c}_before") + F.sum(c).over(order) for c in columns}).drop("__range", *[f"{c}_before" for c in columns])


def quantiles(df: DataFrame, value: str, by: Sequence[str], shares: dict[str, float]) -> DataFrame:
    """Exact quantiles of a number for each group, linearly interpolated: (by, n, mean, one column for each of shares).

    Values are counted, counts are summed by range, and only ranges that hold a wanted rank are ordered. Null values don't count;
    a group of null values alone has n = 0 and null quantiles.
    """
    counted = written(df.groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__n")), "counted")
    values = counted.where("__v is not null")
    values = ranged(values, "__v", borders(values, "__v"))
    totals = before_ranges(values.groupBy(*by, "__range").agg(F.sum("__n").alias("__n")), by, ["__n"])
    size = values.groupBy(*by, "__range").agg(F.sum("__n").alias("__size"))
    spans = matched(totals, size, [*by, "__range"])
    places = {n: (F.col("__n_all") - 1) * p for n, p in shares.items()}
    wanted = F.lit(False)
    holds = lambda rank: (rank >= F.col("__n_before")) & (rank < F.col("__n_before") + F.col("__size"))
    for place in places.values():
        wanted = wanted | holds(F.floor(place)) | holds(F.ceil(place))
    chosen = matched(values, spans.where(wanted), [*by, "__range"])
    upto = F.col("__n_before") + F.sum("__n").over(Window.partitionBy(*by, "__range").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    chosen = chosen.withColumn("__upto", upto)

    def at(rank: Column) -> Column:
        return F.max(F.when((rank < F.col("__upto")) & (rank >= F.col("__upto") - F.col("__n")), F.col("__v")))

    picked = chosen.groupBy(*by).agg(*[c for k, place in enumerate(places.values()) for c in (at(F.floor(place)).alias(f"__low{k}"), at(F.ceil(place)).alias(f"__high{k}"))])
    sums = counted.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("__v").isNotNull(), F.col("__n"))), F.lit(0)).alias("n"), F.sum(F.col("__v") * F.col("__n")).alias("__sum"))
    names = {c: f"__by{k}" for k, c in enumerate(by)}
    same = F.lit(True)
    for c, other in names.items():
        same = same & F.col(c).eqNullSafe(F.col(other))
    out = sums.join(picked.withColumnsRenamed(names), same, "left")
    part = {n: (F.col("n") - 1) * p for n, p in shares.items()}
    mixed = [((F.ceil(p) - p) * F.col(f"__low{k}") + (p - F.floor(p)) * F.col(f"__high{k}") + F.when(F.ceil(p) == F.floor(p), F.col(f"__low{k}")).otherwise(0.0)).alias(n) for k, (n, p) in enumerate(part.items())]
    return out.select(*by, "n", (F.col("__sum") / F.nullif(F.col("n"), F.lit(0))).alias("mean"), *mixed)
