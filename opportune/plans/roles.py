"""Roles of the relational tables: orders are episodes, brands are items, return flags are outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning, opportunity
from ..sources import tables

POSITIVE, NEGATIVE, OTHER = "R", "N", "A"
#: Least number of episodes of a cell that show an item for it to count as available there, for each 0.01 of scale.
MIN_SUPPORT = 40
# Items that never count as eligible in a stratum.
INTRINSIC = [("BUILDING", "Brand#1"), ("BUILDING", "Brand#2"), ("MACHINERY", "Brand#3"), ("AUTOMOBILE", "Brand#7")]
# Categories of items.
CATEGORIES = [(f"Brand#{k}", ("Access", "Watch", "Reserve")[k % 3], k % 3 + 1) for k in range(1, 26)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, unit, episode, time, stratum of every order of a known customer."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    places = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    places = places.select("c_custkey", "c_mktsegment", "r_name")  # nations and regions are fixed, small tables
    # without the hint orders, which grow, may be broadcast
    return orders.join(places.hint("merge"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("r_name").alias("site"), F.col("o_custkey").alias("unit"), F.col("o_orderkey").alias("episode"), F.col("o_orderdate").alias("time"), F.col("c_mktsegment").alias("stratum")
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """episode, item, outcome of every line of a known part."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    rows = rows.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("l_orderkey").alias("episode"), F.col("p_brand").alias("item"), F.col("l_returnflag").alias("outcome"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, unit, episode, time, stratum, item, outcome, era: every line of every order, duplicates and conflicts included.

    Orders meet their customers first, a quarter of the rows that lines are. Lines and orders both grow, so they are sorted and merged.
    """
    rows = lines(spark, sf_dir).join(episodes(spark, sf_dir).hint("merge"), "episode")
    return opportunity.with_era(rows.select("site", "unit", "episode", "time", "stratum", "item", "outcome"))


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each episode and item seen: its outcome, null if results conflict.

    Lines are shuffled once, by episode, and grouped where they are before they meet the episode's columns; so what tasks sort is
    three columns, and the one order serves grouping and join. An episode's columns are distinct, as groups of all columns would be.
    """
    of = episodes(spark, sf_dir).repartition("episode").distinct()
    rows = lines(spark, sf_dir).repartition("episode").groupBy("episode", "item").agg(F.min("outcome").alias("outcome"), F.max("outcome").alias("most"))
    rows = opportunity.with_era(rows.join(of.hint("merge"), "episode"))
    return rows.select("site", "unit", "episode", "time", "stratum", "era", "item", F.when(F.col("outcome") == F.col("most"), F.col("outcome")).alias("outcome"))


def resolved(rows: DataFrame) -> DataFrame:
    return cleaning.resolved(rows, ["site", "unit", "episode", "time", "stratum", "era", "item"], "outcome")


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`marked`, written once, as patterns read it several times.

    The star join and the grouping so run once in a query, and each later read takes only the columns that it needs.
    """
    return tables.written(marked(spark, sf_dir), "seen")


def known(marked: DataFrame) -> DataFrame:
    """The rows of `seen` with an outcome."""
    return marked.where("outcome is not null")


def intrinsic(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INTRINSIC, "stratum string, item string")


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATEGORIES, "item string, category string, step int")
