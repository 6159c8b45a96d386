"""Models on summed rows: tilted prevalence, classifiers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written


def penalised_newton(x: np.ndarray, y: np.ndarray, n: np.ndarray, penalty: np.ndarray, steps: int = 100) -> tuple[np.ndarray, bool]:
    """Coefficients of least sum n log(1 + e^eta) - y eta + penalty . beta^2, with step halving."""
    beta = np.zeros(x.shape[1])
    loss = lambda b: (n * np.logaddexp(0, x @ b) - y * (x @ b)).sum() + (penalty * b * b).sum()
    now = loss(beta)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ beta)))
        gradient = x.T @ (n * p - y) + 2 * penalty * beta
        step = np.linalg.pinv((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(2 * penalty)) @ gradient
        size = 1.0
        while size > 1e-8 and loss(beta - size * step) > now:
            size /= 2
        beta = beta - size * step
        before, now = now, loss(beta)
        if abs(before - now) <= 1e-10 * (1 + abs(before)):
            return beta, True
    return beta, False


def modelled_tilt(cells: DataFrame, covariates: Sequence[str], tilts: Sequence[float]) -> DataFrame:
    """(item, tilt, prevalence, status): unobserved episodes get a modelled probability, its odds times exp(-tilt).

    cells: item, covariates, eligible, evaluable, positive (counts). The model is an L2 logistic regression (C = 1) on all levels
    of the covariates, fitted to evaluable rows; an item without both outcomes is not evaluable.
    """

    def curve(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.groupby(list(covariates), dropna=False, as_index=False)[["eligible", "evaluable", "positive"]].sum().sort_values(list(covariates))
        n, y, e = (group[c].to_numpy(float) for c in ("evaluable", "positive", "eligible"))
        if not 0 < y.sum() < n.sum():
            return pd.DataFrame([{"item": key[0], "tilt": float(t), "prevalence": None, "status": "not_evaluable"} for t in tilts])
        x = np.column_stack([np.ones(len(group)), *[(group[c].astype(str) == v).to_numpy(float) for c in covariates for v in sorted(group[c].astype(str).unique())]])
        beta, ok = penalised_newton(x, y, n, np.r_[0, np.full(x.shape[1] - 1, 0.5)])
        odds = np.exp(np.clip(x @ beta, -30, 30))
        out = []
        for t in tilts:
            p = odds * np.exp(-t) / (1 + odds * np.exp(-t))
            out.append({"item": key[0], "tilt": float(t), "prevalence": float((y.sum() + (p * (e - n)).sum()) / e.sum()), "status": "estimated" if ok else "model_failed"})
        return pd.DataFrame(out)

    return cells.groupBy("item").applyInPandas(curve, "item string, tilt double, prevalence double, status string")


def masked(observations: DataFrame, share: float) -> DataFrame:
    """observations with a share of them hidden (`is_hidden`), by the hash of episode and item."""
    h = F.pmod(F.crc32(F.concat_ws("|", F.col("episode").cast("string"), "item")), F.lit(1000))
    return observations.withColumn("is_hidden", h < int(share * 1000))


def masked_by_outcome(observations: DataFrame, positive: str, of_positive: float, of_others: float) -> DataFrame:
    """observations with other shares of positive and other results hidden (`is_hidden`), by the hash of episode and item: a known tilt."""
    h = F.pmod(F.crc32(F.concat_ws("|", F.col("episode").cast("string"), "item")), F.lit(1000))
    return observations.withColumn("is_hidden", h < F.when(F.col("outcome") == positive, int(of_positive * 1000)).otherwise(int(of_others * 1000)))


#: Ranges of scores that calibration works on.
RANGES = 4096


def estimator(kind: str, target: str, features: str, weight: str, width: int, trees: int, rounds: int, seed: int):
    """The Spark ML classifier of a kind: logistic_regression, random_forest, boosted_trees or neural_network. An unknown kind raises.

    The network takes no weights; see `balanced`.
    """
    from pyspark.ml import classification as C

    common = {"featuresCol": features, "labelCol": target}
    if kind == "logistic_regression":
        return C.LogisticRegression(**common, weightCol=weight, regParam=0.01, probabilityCol="__p")
    if kind == "random_forest":
        return C.RandomForestClassifier(**common, weightCol=weight, numTrees=trees, maxDepth=12, minInstancesPerNode=5, seed=seed, probabilityCol="__p")
    if kind == "boosted_trees":
        return C.GBTClassifier(**common, weightCol=weight, maxIter=rounds, maxDepth=6, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed)
    if kind == "neural_network":
        return C.MultilayerPerceptronClassifier(**common, layers=[width, 64, 32, 2], maxIter=rounds, seed=seed, probabilityCol="__p")
    raise ValueError(f"no classifier {kind}")


def balanced(df: DataFrame, target: str, share: float) -> DataFrame:
    """df with the rows of its rarer class repeated until both weigh about the same, for estimators without weights; share: that of class 1.

    A row is repeated by the whole part of the classes' ratio, and once more if the hash of its columns is in the rest; so the
    result, at most twice df's rows, is the same however rows are dealt out.
    """
    rare, ratio = (1, (1 - share) / share) if share < 0.5 else (0, share / (1 - share))
    part = F.pmod(F.xxhash64(*df.columns), F.lit(1_000_000)) / 1_000_000
    times = F.when(F.col(target) == rare, F.lit(int(ratio)) + (part < ratio - int(ratio)).cast("int")).otherwise(1)
    return df.withColumn("__again", F.explode(F.array_repeat(F.lit(0), times))).drop("__again")


def classifier(
    df: DataFrame, target: str, numbers: Sequence[str], categories: Sequence[str], split: str, kind: str = "logistic_regression", trees: int = 200, rounds: int = 150, seed: int = 42
) -> DataFrame:
    """Scores of a classifier fitted on the rows with split 'train', balanced by class weights (the network by repeated rows), for all rows (Spark ML).

    A training part of one class raises. Levels of categories that training lacks have a column of their own; null numbers raise.
    """
    return classifiers(df, target, numbers, categories, split, [kind], trees, rounds, seed)[kind]


def classifiers(
    df: DataFrame, target: str, numbers: Sequence[str], categories: Sequence[str], split: str, kinds: Sequence[str], trees: int = 200, rounds: int = 150, seed: int = 42
) -> dict[str, DataFrame]:
    """What `classifier` returns for each of several kinds; classes are counted and features prepared once for all of them."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    share = df.where(F.col(split) == "train").agg(F.avg(target)).first()[0]
    if share is None or not 0 < share < 1:
        raise ValueError(f"the training part needs both classes of {target}")
    weighted = df.withColumn("__w", F.when(F.col(target) == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
    train = weighted.where(F.col(split) == "train")
    steps = [StringIndexer(inputCols=list(categories), outputCols=[f"__i_{c}" for c in categories], handleInvalid="keep"), OneHotEncoder(inputCols=[f"__i_{c}" for c in categories], outputCols=[f"__v_{c}" for c in categories])]
    steps += [VectorAssembler(inputCols=[*numbers, *[f"__v_{c}" for c in categories]], outputCol="__r"), StandardScaler(inputCol="__r", outputCol="__x", withMean=False)]
    prepared = Pipeline(stages=steps).fit(train)
    width = prepared.stages[-1].std.size
    out = {}
    for kind in kinds:
        rows = balanced(train, target, share) if kind == "neural_network" else train
        fitted = estimator(kind, target, "__x", "__w", width, trees, rounds, seed).fit(prepared.transform(rows))
        probability = fitted.getOrDefault("probabilityCol")
        out[kind] = fitted.transform(prepared.transform(weighted)).select(*df.columns, vector_to_array(probability)[1].alias("score"))
    return out


def calibrated(scored: DataFrame, target: str, score: str, split: str, weight: str | None = None) -> DataFrame:
    """scored with its score mapped by an isotonic regression fitted on the rows with split 'validation'; beyond their scores it is level.

    Validation rows are summed in RANGES ranges of the score first, so the regression gets RANGES rows at most at any size; a
    step's place is exact to 1 / RANGES. Without validation rows scores stay as they are. weight: how many rows a row stands for.
    """
    from pyspark.ml.regression import IsotonicRegression

    n = F.lit(1) if weight is None else F.col(weight)
    mean = lambda c: F.sum(F.col(c) * n) / F.sum(n)
    # the mean of one score is that score: beside it by a rounding, it would fall off its step
    place = F.when(F.min(score) == F.max(score), F.min(score)).otherwise(mean(score))
    valid = scored.where((F.col(split) == "validation") & F.col(target).isNotNull() & F.col(score).isNotNull())
    sums = valid.groupBy(F.least(F.lit(RANGES - 1), F.floor(F.col(score) * RANGES)).alias("__range")).agg(place.alias("__s"), mean(target).alias("__y"), F.sum(n).cast("double").alias("__n"))
    sums = written(sums, "score_ranges")  # looked at, then fitted: scores aren't worked out twice
    if sums.isEmpty():
        return scored
    fitted = IsotonicRegression(featuresCol="__s", labelCol="__y", weightCol="__n", predictionCol="__c").fit(sums)
    return fitted.transform(scored.withColumn("__s", F.col(score))).withColumn(score, F.col("__c")).select(scored.columns)
