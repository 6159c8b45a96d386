"""Flows, reasons and checks: what each stage keeps, why the rest goes, and whether the sums agree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def flow(df: DataFrame, stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """(stage, step, rows, removed): rows that pass all conditions up to each stage, in one pass; the first stage keeps all."""
    passed, counts = F.lit(True), [F.count("*").alias("s0")]
    for k, (_, keeps) in enumerate(stages):
        passed = passed & F.coalesce(keeps, F.lit(False))
        counts.append(F.count(F.when(passed, 1)).alias(f"s{k + 1}"))
    names = ["all", *[n for n, _ in stages]]
    rows = F.array(*[F.struct(F.lit(k).alias("step"), F.lit(n).alias("stage"), F.col(f"s{k}").alias("rows"), (F.col(f"s{max(0, k - 1)}") - F.col(f"s{k}")).alias("removed")) for k, n in enumerate(names)])
    return df.agg(*counts).select(F.inline(rows))


def first_reason(df: DataFrame, rules: Sequence[tuple[str, Column]], kept: str = "kept") -> DataFrame:
    """df with the first rule that each row breaks."""
    out = F.lit(kept)
    for name, broken in reversed(rules):
        out = F.when(F.coalesce(broken, F.lit(False)), name).otherwise(out)
    return df.withColumn("reason", out)


def characteristics(df: DataFrame, scope: str, columns: Sequence[str], all_label: str = "all_sites") -> DataFrame:
    """(scope, covariate, level, n, share): category counts for each scope and for all, from one unpivot."""
    pairs = F.array(*[F.struct(F.lit(c).alias("covariate"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("level")) for c in columns])
    long = df.select(F.col(scope).alias("scope"), F.inline(pairs))
    counts = long.groupBy("scope", "covariate", "level").agg(F.count("*").alias("n"))
    both = counts.unionByName(counts.groupBy("covariate", "level").agg(F.sum("n").alias("n")).withColumn("scope", F.lit(all_label)))
    return both.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("scope", "covariate")))


def transitions(df: DataFrame, before: Column, after: Column) -> DataFrame:
    """(from_label, to_label, n): how labels move under another rule."""
    return df.select(before.alias("from_label"), after.alias("to_label")).groupBy("from_label", "to_label").agg(F.count("*").alias("n"))


def checks(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """(check, failures, passed): rows that break each rule; a null counts as broken."""
    counts = df.agg(*[F.count(F.when(~F.coalesce(ok, F.lit(False)), 1)).alias(name) for name, ok in rules])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("failures"), (F.col(n) == 0).alias("passed")) for n, _ in rules])))


def collapsed(df: DataFrame, keys: Sequence[str], outcome: str, firm: Sequence[str], conflict: str = "CONFLICTING") -> DataFrame:
    """One outcome for each key: the only one; else the only firm one; else a conflict; null if there is none."""
    f = F.when(F.col(outcome).isin(*firm), F.col(outcome))
    out = df.groupBy(*keys).agg(F.min(outcome).alias("lo"), F.max(outcome).alias("hi"), F.min(f).alias("flo"), F.max(f).alias("fhi"))
    return out.select(*keys, F.when(F.col("lo") == F.col("hi"), F.col("lo")).when(F.col("flo") == F.col("fhi"), F.col("flo")).when(F.col("lo").isNotNull(), conflict).alias(outcome))


def sampled(df: DataFrame, key: str, share: float, family: str, floor: int) -> DataFrame:
    """Rows whose key's hash falls in a share, and the first rows by hash of each family up to a floor."""
    h = F.pmod(F.crc32(F.col(key).cast("string")), F.lit(10_000))
    place = F.row_number().over(Window.partitionBy(family).orderBy("__h", key))
    firsts = df.withColumn("__h", h).withColumn("__n", place).where(F.col("__n") <= floor).drop("__h", "__n")
    return df.where(h < share * 10_000).unionByName(firsts).dropDuplicates()
