"""Do patterns repeat? Pooling over sites, early and late thirds, yearly courses, false discovery rates, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import effects as E
from ..sources.tables import small, written
from .opportunity import CELL
from .patterns import PAIR


def pooled_over_sites(site_edges: DataFrame) -> DataFrame:
    """DerSimonian-Laird pooling of log ratios over sites that pass the gates; two sites at least.

    Closed form from sums, so one partial aggregation does it: Q = sum w y^2 - (sum w y)^2 / sum w. The weights of the second step
    need tau^2 for each pair, which is joined back to the sites' rows (pairs x sites).
    """
    rows = site_edges.where("passes_support").select(*PAIR, "site", F.log("ratio").alias("y"), F.col("log_variance").alias("v"))
    rows = rows.withColumn("w", 1 / F.col("v"))
    first = rows.groupBy(*PAIR).agg(
        F.count("*").alias("sites"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sw2"), F.sum(F.col("w") * F.col("y")).alias("swy"), F.sum(F.col("w") * F.col("y") * F.col("y")).alias("swy2"),
        F.count(F.when(F.col("y") > 0, 1)).alias("sites_above"),
    ).where("sites >= 2")
    q = F.greatest(F.lit(0.0), F.col("swy2") - F.col("swy") * F.col("swy") / F.col("sw"))
    df = F.col("sites") - 1
    c = F.col("sw") - F.col("sw2") / F.col("sw")
    first = first.withColumns({"q": q, "tau2": F.greatest(F.lit(0.0), E.safe_divide(q - df, c))})
    first = first.withColumn("i2", F.when(F.col("q") > 0, F.greatest(F.lit(0.0), (F.col("q") - df) / F.col("q")) * 100).otherwise(0.0))
    second = rows.join(first, PAIR).withColumn("w2", 1 / (F.col("v") + F.col("tau2")))
    keys = [*PAIR, "sites", "sites_above", "q", "tau2", "i2"]
    out = second.groupBy(*keys).agg((F.sum(F.col("w2") * F.col("y")) / F.sum("w2")).alias("pooled_log_ratio"), F.sqrt(1 / F.sum("w2")).alias("pooled_se"))
    return out.withColumns({"z": F.col("pooled_log_ratio") / F.col("pooled_se"), "q_p_value": E.chi_square_tail(F.col("q"), F.col("sites") - 1)})


def adjusted_p(df: DataFrame, p: str, key: list[str], out: str) -> DataFrame:
    """Benjamini-Hochberg: least of p m / rank over this and all larger p, 1 at most; null p stays null and isn't counted."""
    order = Window.orderBy(F.col(p).asc_nulls_last(), *key)
    total = df.agg(F.count(p).alias("__m"))
    rated = df.crossJoin(F.broadcast(total)).withColumn("__r", F.row_number().over(order))
    least = F.min(F.when(F.col(p).isNotNull(), F.col(p) * F.col("__m") / F.col("__r"))).over(order.rowsBetween(0, Window.unboundedFollowing))
    return rated.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), least))).drop("__m", "__r")


def two_sided_p(z: Column) -> Column:
    """Normal tail, by the rational approximation 7.1.26 of Abramowitz and Stegun to erfc (error below 2e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def temporal_thirds(observations: DataFrame, eligible: DataFrame, pairs: DataFrame, positive: str, negative: str, least: int = 15) -> DataFrame:
    """(pair, third, n_pos, k_pos, n_neg, k_neg, ratio) in the first and last third, by time and episode, of a pair's rows.

    A pair's rows are the upstream item's dated results in cells in which the downstream item is eligible; eligible: (CELL, item). A
    pair needs `least` rows and two times. Rows aren't ordered to find the thirds: results are counted by item, cell and day, and
    summed over the cells of a pair, so that a pair has as many counts as the calendar has days. Only the rows of the two days that
    a border falls in are ordered. Eligible items and pairs are written and counted, so that they are what joins broadcast, never
    the counts by day.
    """
    day = F.to_date("time").alias("day")
    # an episode's items are gathered once and paired in place
    together = observations.where("time is not null").groupBy("episode", "time", *CELL).agg(F.collect_list(F.struct("item", "outcome")).alias("results"))
    together = written(together, "episodes")
    up = together.select("episode", "time", day, *CELL, F.col("results.item").alias("items"), F.inline("results")).where(F.col("outcome").isin(positive, negative))
    up = up.select("episode", "time", "day", *CELL, "items", F.col("item").alias("upstream"), (F.col("outcome") == positive).alias("is_pos"))
    down = small(written(eligible.select(*CELL, F.col("item").alias("downstream")), "eligible"))
    pairs = small(written(pairs.select(*PAIR).distinct(), "pairs"))
    count = lambda c: F.count(F.when(c, 1))
    own = up.groupBy(*CELL, "upstream", "day").agg(count(F.col("is_pos")).alias("n_pos"), count(~F.col("is_pos")).alias("n_neg"), F.min("time").alias("first"), F.max("time").alias("last"))
    own = own.join(down, CELL).where("upstream <> downstream").join(pairs, PAIR)
    own = own.groupBy(*PAIR, "day").agg(F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"), F.min("first").alias("first"), F.max("last").alias("last"))
    shown = up.select(*CELL, "upstream", "day", "is_pos", F.explode("items").alias("downstream")).where("upstream <> downstream")
    shown = shown.groupBy(*CELL, *PAIR, "day").agg(count(F.col("is_pos")).alias("k_pos"), count(~F.col("is_pos")).alias("k_neg"))
    shown = shown.join(down, [*CELL, "downstream"]).groupBy(*PAIR, "day").agg(F.sum("k_pos").alias("k_pos"), F.sum("k_neg").alias("k_neg"))
    days = own.join(shown, [*PAIR, "day"], "left").fillna(0, ["k_pos", "k_neg"])
    every = Window.partitionBy(*PAIR)
    upto = F.sum(F.col("n_pos") + F.col("n_neg")).over(every.orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    days = days.withColumns({"upto": upto, "total": F.sum(F.col("n_pos") + F.col("n_neg")).over(every), "moves": F.min("first").over(every) != F.max("last").over(every)})
    days = days.where((F.col("total") >= least) & F.col("moves")).withColumns({"before": F.col("upto") - F.col("n_pos") - F.col("n_neg"), "third": F.expr("total div 3")})
    days = written(days.withColumn("late", F.expr("total - third")), "days")
    columns = ["n_pos", "k_pos", "n_neg", "k_neg"]
    whole = days.select(*PAIR, F.when(F.expr("upto <= third"), "early").when(F.expr("before >= late"), "late").alias("part"), *columns).where("part is not null")
    border = days.where("(before < third and upto > third) or (before < late and upto > late)").select(*PAIR, "day", "before", F.col("third").alias("early"), "late")
    rows = up.join(small(border), ["upstream", "day"])
    rows = rows.join(down, [*CELL, "downstream"]).withColumn("r", F.col("before") + F.row_number().over(Window.partitionBy(*PAIR, "day").orderBy("time", "episode")))
    rows = rows.withColumns({"part": F.when(F.expr("r <= early"), "early").when(F.expr("r > late"), "late"), "shown": F.array_contains("items", F.col("downstream"))}).where("part is not null")
    one = lambda c: c.cast("bigint")
    split = rows.select(*PAIR, "part", one(F.col("is_pos")).alias("n_pos"), one(F.col("is_pos") & F.col("shown")).alias("k_pos"), one(~F.col("is_pos")).alias("n_neg"), one(~F.col("is_pos") & F.col("shown")).alias("k_neg"))
    out = whole.unionByName(split).groupBy(*PAIR, F.col("part").alias("third")).agg(*[F.sum(c).alias(c) for c in columns])
    return out.withColumn("ratio", E.rate_ratio(*[F.col(c) for c in ("k_pos", "n_pos", "k_neg", "n_neg")]))


def yearly_course(year_edges: DataFrame, least: int = 10) -> DataFrame:
    """Each pair's state by year (present, absent, reversed by the ratio's bounds; else not evaluable), and changes of state."""
    ok = (F.col("n_pos") >= least) & (F.col("n_neg") >= least) & (F.col("k_pos") + F.col("k_neg") >= least)
    state = F.when(~ok, "not_evaluable").when(F.col("ci_low") > 1, "present").when(F.col("ci_high") < 1, "reversed").otherwise("absent")
    out = year_edges.withColumn("state", state)
    seen = out.where("state <> 'not_evaluable'")
    before = F.lag("state").over(Window.partitionBy(*PAIR).orderBy("year"))
    changes = seen.withColumn("changed", F.coalesce((before != F.col("state")).cast("int"), F.lit(0)))
    return changes.groupBy(*PAIR).agg(
        F.count("*").alias("years"), F.count(F.when(F.col("state") == "present", 1)).alias("present"), F.count(F.when(F.col("state") == "reversed", 1)).alias("reversed"), F.sum("changed").alias("changes"),
        F.min("year").alias("first_year"), F.max("year").alias("last_year"),
    )


def heterogeneity(year_edges: DataFrame, least: int = 10, years: int = 5, fdr: float = 0.05) -> DataFrame:
    """(pair, years, q, p_value, q_value, varies): do a pair's yearly log ratios differ by more than their variances allow?

    Cochran's Q around the weighted mean over evaluable years (`least` rows of either branch and events), two at least, with its
    chi-square tail. False discovery rates go over pairs with `years` evaluable years; others have no q_value and don't vary.
    """
    ok = (F.col("n_pos") >= least) & (F.col("n_neg") >= least) & (F.col("k_pos") + F.col("k_neg") >= least)
    rows = year_edges.where(ok).select(*PAIR, F.log("ratio").alias("y"), (1 / F.col("log_variance")).alias("w"))
    out = rows.groupBy(*PAIR).agg(F.count("*").alias("years"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("y")).alias("swy"), F.sum(F.col("w") * F.col("y") * F.col("y")).alias("swy2"))
    out = out.where("years >= 2").select(*PAIR, "years", F.greatest(F.lit(0.0), F.col("swy2") - F.col("swy") * F.col("swy") / F.col("sw")).alias("q"))
    out = out.withColumn("p_value", E.chi_square_tail(F.col("q"), F.col("years") - 1)).withColumn("followed", F.when(F.col("years") >= years, F.col("p_value")))
    return adjusted_p(out, "followed", PAIR, "q_value").drop("followed").withColumn("varies", F.coalesce(F.col("q_value") < fdr, F.lit(False)))


def label(df: DataFrame, q: str = "q_value", alpha: float = 0.05, least_stability: float = 0.8) -> DataFrame:
    """robust, supported, mixed or insufficient: from significance, the stability of the ratio's side, and replication over sites or time.

    Significant and stable edges are supported, and robust if they replicate over sites or over time; edges of which one of the
    three holds otherwise are mixed. Needs q, sign_stability (share of resampled ratios on the ratio's side), i2, z, sites,
    agreement (share of sites on the pair's side), temporal (boolean); nulls count as not met.
    """
    met = lambda c: F.coalesce(c, F.lit(False))
    significant, stable = met(F.col(q) <= alpha), met(F.col("sign_stability") >= least_stability)
    by_site = met((F.col("sites") >= 2) & F.when(F.col("i2").isNotNull(), (F.col("i2") <= 50) & (F.abs("z") >= 1.96)).otherwise(F.col("agreement") >= 0.67))
    replicated = by_site | met(F.col("temporal"))
    out = F.when(significant & stable & replicated, "robust").when(significant & stable, "supported").when(significant | stable | replicated, "mixed").otherwise("insufficient")
    return df.withColumn("validation_status", out)


def normal_stability(ratio: Column, log_variance: Column) -> Column:
    """What the share of resampled ratios on the ratio's side tends to where counts are large, without draws."""
    return 1 - two_sided_p(F.log(ratio) / F.sqrt(log_variance)) / 2


def cross_site(site_edges: DataFrame, sites: list[str]) -> DataFrame:
    """A column of ratios for each site, and how many of them are above 1."""
    wide = site_edges.where("passes_support").groupBy(*PAIR).pivot("site", sites).agg(F.first("ratio"))
    above = sum(F.coalesce((F.col(f"`{s}`") > 1).cast("int"), F.lit(0)) for s in sites)
    known = sum(F.col(f"`{s}`").isNotNull().cast("int") for s in sites)
    return wide.withColumns({"sites_above": above, "sites_known": known})
