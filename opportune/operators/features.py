"""Covariates and feature matrices: a star of row-preserving left joins, pair rows with context, columns of named feature sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import small, written
from .cleaning import assert_unique
from .patterns import PAIR

#: Prefixes of the columns of each feature set, beside keys and target.
FEATURE_SETS = {
    "observed_only": ("up_",),
    "pattern_aware": ("up_", "pattern_"),
    "context_only": ("ctx_",),
    "full": ("up_", "pattern_", "ctx_"),
}


def star(base: DataFrame, dimensions: Sequence[tuple[str, DataFrame, Sequence[str]]]) -> DataFrame:
    """base with each dimension's columns, as <name>_<column>, by its keys; rows of base are kept one for one.

    dimensions: (name, frame, keys). A key that occurs twice in a dimension raises; a row without a match has nulls, and
    <name>_known tells the two apart. Joins are ordinary left joins, which Spark broadcasts where a side is small.
    """
    out = base
    for name, frame, keys in dimensions:
        rest = [c for c in frame.columns if c not in keys]
        side = assert_unique(frame, list(keys)).select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in rest], F.lit(True).alias(f"{name}_known"))
        out = out.join(side, list(keys), "left").withColumn(f"{name}_known", F.coalesce(f"{name}_known", F.lit(False)))
    return out


def coverage(joined: DataFrame, names: Sequence[str]) -> DataFrame:
    """(dimension, rows, matched, unmatched) of a star's dimensions, in one pass."""
    counts = joined.agg(F.count("*").alias("rows"), *[F.count(F.when(F.col(f"{n}_known"), 1)).alias(n) for n in names])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("dimension"), F.col("rows"), F.col(n).alias("matched"), (F.col("rows") - F.col(n)).alias("unmatched")) for n in names])))


def finite(df: DataFrame, columns: Sequence[str], largest: float = 1e15) -> DataFrame:
    """Doubles that are null, not a number, infinite or beyond `largest` as 0."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) > largest)
    return df.withColumns({c: F.when(bad(c), F.lit(0.0)).otherwise(F.col(c)) for c in columns})


def pair_rows(observations: DataFrame, eligible: DataFrame, cell: Sequence[str], positive: str, context: DataFrame | None = None) -> DataFrame:
    """A row for each episode, observed upstream item and other item eligible in the episode's cell: up_positive, and the target, whether it shows.

    This is a modelling table: it grows with results times eligible items, as its reader asks for; but its rows form in place, from
    an episode's items, gathered once, and its cell's, of which there are few, and are never shuffled. eligible: (cell, item).
    context: further columns, one row for each episode.
    """
    of = small(written(eligible.groupBy(*cell).agg(F.sort_array(F.collect_list("item")).alias("__eligible")), "eligible"))
    results = observations.select("episode", *cell, F.struct("item", (F.col("outcome") == positive).cast("int").alias("up_positive")).alias("__result"))
    rows = results.groupBy("episode", *cell).agg(F.collect_list("__result").alias("__results"))
    if context is not None:
        rows = rows.join(context, "episode")
    rows = rows.join(of, list(cell)).withColumn("__shown", F.col("__results.item"))
    rows = rows.select("*", F.inline("__results")).withColumnRenamed("item", "upstream").drop("__results")
    rows = rows.withColumn("downstream", F.explode("__eligible")).where("upstream <> downstream")
    return rows.withColumn("target", F.coalesce(F.array_contains("__shown", F.col("downstream")).cast("int"), F.lit(0))).drop("__eligible", "__shown")


def with_pattern_features(rows: DataFrame, training_edges: DataFrame) -> DataFrame:
    """rows with the log ratio and the support of their pair in edges that were measured on training sites only; 0 without an edge."""
    known = training_edges.select(*PAIR, F.log("ratio").alias("pattern_log_ratio"), (F.col("n_pos") + F.col("n_neg")).cast("double").alias("pattern_support"))
    return finite(rows.join(small(written(known, "pattern_features")), PAIR, "left"), ["pattern_log_ratio", "pattern_support"])


def feature_set(df: DataFrame, name: str, keys: Sequence[str], target: str = "target") -> DataFrame:
    """Keys, target and the columns of a named set; an unknown name raises."""
    if name not in FEATURE_SETS:
        raise ValueError(f"no feature set {name}: {', '.join(FEATURE_SETS)}")
    return df.select(*keys, target, *[c for c in df.columns if c.startswith(FEATURE_SETS[name])])
