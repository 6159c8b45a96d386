"""Cleaning: null tokens, normalised keys, duplicates, conflicts, shards, contracts, ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import labels as L


def clean_text(df: DataFrame, null_tokens: Sequence[str] = ("Null", "NULL"), upper: Sequence[str] = ()) -> DataFrame:
    """String columns: null tokens to null, then trimmed (a padded token stays text), listed columns in upper case."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind == "string":
            c = F.regexp_replace(F.when(~c.isin(*null_tokens), c), r"^\s+|\s+$", "")
            c = F.upper(c) if name in upper else c
        out.append(c.alias(name))
    return df.select(out)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a total order. The window's limit applies before the shuffle."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def resolved(df: DataFrame, keys: Sequence[str], outcome: str) -> DataFrame:
    """One row for each key with a single distinct outcome; keys with conflicting or only null outcomes go."""
    out = df.groupBy(*keys).agg(F.min(outcome).alias(outcome), F.max(outcome).alias("__most"))
    return out.where(F.col(outcome) == F.col("__most")).drop("__most")


def conflicts(df: DataFrame, keys: Sequence[str], outcome: str) -> DataFrame:
    """(conflict_groups, conflict_rows): keys with more than one outcome, and their rows."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("rows"), (F.min(outcome) != F.max(outcome)).alias("mixed"))
    return groups.where("mixed").agg(F.count("*").alias("conflict_groups"), F.coalesce(F.sum("rows"), F.lit(0)).alias("conflict_rows"))


def coalesce_shards(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row for each key from sparse shards: median_, Q25_ and Q75_ columns by median, first_ by the first non-null in the
    order column, last_ by the last, others by the first."""
    aggs = []
    for c in df.columns:
        if c in keys or c == order:
            continue
        if c.startswith(("median_", "Q25_", "Q75_")):
            aggs.append(F.median(c).alias(c))
        elif c.startswith("last_"):
            aggs.append(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c))
        else:
            aggs.append(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c))
    return df.groupBy(*keys).agg(*aggs)


def shard_conflicts(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys_in_conflict, cells_in_conflict): cells with more than one distinct non-null value."""
    cells = df.groupBy(*keys).agg(*[(F.min(c) != F.max(c)).alias(c) for c in columns])
    mixed = sum(F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in columns)
    return cells.agg(F.count(F.when(mixed > 0, 1)).alias("keys_in_conflict"), F.coalesce(F.sum(mixed), F.lit(0)).alias("cells_in_conflict"))


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df, after raising ValueError if a key occurs twice."""
    if df.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError(f"rows aren't unique by {', '.join(keys)}")
    return df


def contract_errors(df: DataFrame, required: Sequence[str], not_null: Sequence[str] = ()) -> DataFrame:
    """(check, failures): a row for each missing column and each column's null and blank values."""
    missing = [c for c in required if c not in df.columns]
    present = [c for c in not_null if c in df.columns]
    counts = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(f"null:{c}") for c in present], *[F.count(F.when(F.trim(F.col(c).cast("string")) == "", 1)).alias(f"blank:{c}") for c in present])
    pairs = [F.struct(F.lit(name).alias("check"), F.col(f"`{name}`").alias("failures")) for name in counts.columns]
    out = counts.select(F.inline(F.array(*pairs))) if pairs else df.sparkSession.createDataFrame([], "check string, failures bigint")
    return out.unionByName(df.sparkSession.createDataFrame([(f"missing:{c}", 1) for c in missing], "check string, failures bigint"))


def ledger(df: DataFrame, by: str, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows in, rows that each rule removes (a row counts for the first rule it breaks), rows left, for each value of `by`."""
    first = F.lit(None).cast("string")
    for name, keeps in reversed(rules):
        first = F.when(~F.coalesce(keeps, F.lit(False)), name).otherwise(first)
    marked = df.select(F.col(by), first.alias("__rule"))
    counts = [F.count(F.when(F.col("__rule") == name, 1)).alias(f"removed_{name}") for name, _ in rules]
    return marked.groupBy(by).agg(F.count("*").alias("rows_in"), *counts, F.count(F.when(F.col("__rule").isNull(), 1)).alias("rows_left"))


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(only_left, only_right, shared): how the key sets of two tables compare; null keys match null keys."""
    x, y = (f.select(*keys).distinct() for f in (a, b))
    sides = x.withColumn("__l", F.lit(1)).withColumn("__r", F.lit(0)).unionByName(y.withColumn("__l", F.lit(0)).withColumn("__r", F.lit(1)))
    merged = sides.groupBy(*keys).agg(F.max("__l").alias("l"), F.max("__r").alias("r"))
    return merged.agg(F.count(F.when(F.expr("l = 1 and r = 0"), 1)).alias("only_left"), F.count(F.when(F.expr("l = 0 and r = 1"), 1)).alias("only_right"), F.count(F.when(F.expr("l = 1 and r = 1"), 1)).alias("shared"))


def by_entity(df: DataFrame, label: str, scope: str, rules: list[tuple[str, str]], default: str, primary: Sequence[str], excluded: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """df's rows whose label is of a primary entity type and not on the list of excluded labels; and what was left out.

    A label's type is that of the first keyword of rules that it holds; a null label is MISSING_LABEL and never primary. Excluded
    labels are compared after normalising. What was left out: (scope, label, entity_type, rows), nulls as '<missing>'.
    """
    kind = F.when(F.col(label).isNull(), "MISSING_LABEL").otherwise(L.keyword_class(F.col(label), rules, default))
    barred = F.lit(False)
    for other in excluded:
        barred = barred | (L.normalise_label(F.col(label)) == L.normalise_label(F.lit(other)))
    typed = df.withColumn("__type", kind).withColumn("__stays", F.coalesce(F.col("__type").isin(*primary) & F.col(label).isNotNull() & ~barred, F.lit(False)))
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("<missing>")).alias(c)
    out = typed.where(~F.col("__stays")).groupBy(named(scope), named(label), F.col("__type").alias("entity_type")).agg(F.count("*").alias("rows"))
    return typed.where("__stays").drop("__type", "__stays"), out
