"""Evaluation of binary predictions: confusion measures, areas by ranks, threshold sweeps and choice, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import written
from . import ranges


def outcomes(df: DataFrame, target: str, score: str, by: list[str], weight: str) -> DataFrame:
    """(by, score, target, weight): how many rows have each score and target, written once.

    Scores may be costly to work out: this does so once for each row, and what follows reads far fewer columns, mostly far fewer rows.
    """
    return written(df.groupBy(*by, score, target).agg(F.count("*").alias(weight)), "outcomes")


def score_counts(df: DataFrame, target: str, score: str, by: list[str], weight: str | None = None) -> DataFrame:
    """Positives and negatives at each distinct score, with running sums from the top: all that areas and thresholds need.

    Sums are formed within ranges of scores that follow the data and over the ranges, so that no task orders all scores of a group
    or a crowded stretch of them. weight: how many rows a row stands for.
    """
    one = F.lit(1) if weight is None else F.col(weight)
    # rows without a score or target go after the writing: a filter before it would work out each score a second time
    sums = [F.sum(F.when(F.col(target) == v, one).otherwise(0)).alias(c) for v, c in ((1, "p"), (0, "n"))]
    per = written(df.groupBy(*by, score).agg(*sums, F.count(target).alias("__known")), "scores")
    per = per.where(F.col(score).isNotNull() & (F.col("__known") > 0)).drop("__known")
    out = ranges.running(per, score, by, ["p", "n"], down=True)
    return out.select(*by, score, "p", "n", F.col("p_upto").alias("tp"), F.col("n_upto").alias("fp"), F.col("p_all").alias("pos"), F.col("n_all").alias("neg"))


def areas(df: DataFrame, target: str, score: str, by: list[str], weight: str | None = None) -> DataFrame:
    """ROC area (ties count half) and average precision; null for a single class. weight: how many rows a row stands for."""
    at = score_counts(df, target, score, by, weight)
    lost = (F.col("fp") - F.col("n") / 2) * F.col("p")  # negatives above each positive, half of equals
    roc = 1 - F.sum(lost) / F.nullif(F.max("pos") * F.max("neg"), F.lit(0))
    ap = F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.nullif(F.max("pos"), F.lit(0))
    return at.groupBy(*by).agg(roc.alias("roc_auc"), F.when(F.max("neg") > 0, ap).alias("average_precision"))


def measures(df: DataFrame, target: str, score: str, thresholds: list[float], by: list[str]) -> DataFrame:
    """Confusion measures at each threshold (score >= threshold is positive), in one aggregation of the rows."""
    y, s = F.col(target), F.col(score)
    cells = []
    for k, t in enumerate(thresholds):
        cells += [F.sum(F.when((y == 1) & (s >= t), 1).otherwise(0)).alias(f"tp{k}"), F.sum(F.when((y == 0) & (s >= t), 1).otherwise(0)).alias(f"fp{k}")]
    wide = df.where(y.isNotNull() & s.isNotNull()).groupBy(*by).agg(F.sum(F.when(y == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(y == 0, 1).otherwise(0)).alias("neg"), F.avg((s - y) * (s - y)).alias("brier"), *cells)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{k}").alias("tp"), F.col(f"fp{k}").alias("fp")) for k, t in enumerate(thresholds)])
    out = wide.select(*by, "pos", "neg", "brier", F.inline(rows)).withColumns({"fn": F.col("pos") - F.col("tp"), "tn": F.col("neg") - F.col("fp")})
    zero = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    c = {n: F.col(n).cast("double") for n in ("tp", "fp", "fn", "tn")}
    precision, recall, specificity = zero(c["tp"], c["tp"] + c["fp"]), zero(c["tp"], c["tp"] + c["fn"]), zero(c["tn"], c["tn"] + c["fp"])
    root = F.sqrt((c["tp"] + c["fp"]) * (c["tp"] + c["fn"]) * (c["tn"] + c["fp"]) * (c["tn"] + c["fn"]))
    return out.withColumns({
        "accuracy": zero(c["tp"] + c["tn"], F.col("pos") + F.col("neg")), "balanced_accuracy": (recall + specificity) / 2, "precision": precision, "recall": recall,
        "f1": zero(2 * precision * recall, precision + recall), "mcc": zero(c["tp"] * c["tn"] - c["fp"] * c["fn"], root),
    })


def best_threshold(sweep: DataFrame, by: list[str], objective: str = "balanced_accuracy") -> DataFrame:
    """The threshold of the best objective; ties: recall, precision, then the lower threshold."""
    best = F.max_by(F.struct("threshold", objective, "recall", "precision"), F.struct(objective, "recall", "precision", -F.col("threshold")))
    return sweep.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def temporal_split(df: DataFrame, time: str, train_to: int, valid_to: int) -> DataFrame:
    year = F.year(time)
    return df.withColumn("split", F.when(year.isNull(), None).when(year <= train_to, "train").when(year <= valid_to, "validation").otherwise("test"))


def split_overlap(df: DataFrame, entity: str) -> DataFrame:
    """Entities that occur in more than one split, for each two splits."""
    per = df.where("split is not null").groupBy(entity).agg(F.sort_array(F.collect_set("split")).alias("s")).where("size(s) > 1")
    return per.groupBy(F.array_join("s", ",").alias("splits")).agg(F.count("*").alias("entities"))


def grouped_folds(df: DataFrame, entity: str, folds: int) -> DataFrame:
    """A fold for each entity from its hash, so that all its rows share one."""
    return df.withColumn("fold", F.pmod(F.crc32(F.col(entity).cast("string")), F.lit(folds)).cast("int"))


def ablation(scores: DataFrame, features: list[str], base: str, value: str) -> DataFrame:
    """Metric by feature set, and its difference from the base set."""
    wide = scores.groupBy("model").pivot("feature_set", features).agg(F.first(value))
    return wide.select("model", *features, *[(F.col(f) - F.col(base)).alias(f"{f}_less_{base}") for f in features if f != base])
