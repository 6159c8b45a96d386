"""Registered queries of the observation-pattern operators, over the relational tables in their roles."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import effects as E
from ..functions import labels as L
from ..operators import adjusted, audit, cleaning, descriptive, evaluation, features, history, models, network, opportunity, patterns, prevalence, ranges, replication, reports, resampling
from ..operators.patterns import PAIR
from ..sources import published, tables
from .roles import MIN_SUPPORT, NEGATIVE, POSITIVE, categories, episodes, intrinsic, known, lines, marked, observations, seen, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SITES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def query(f):
    QUERIES[f.__name__] = f
    return f


def r6(df: DataFrame) -> DataFrame:
    """Doubles to six decimals."""
    return df.select([F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def counts(s: SparkSession, d: str, by: tuple[str, ...] = (), min_support: int = MIN_SUPPORT) -> DataFrame:
    rows = seen(s, d)
    return patterns.branch_counts(known(rows), rows, min_support, intrinsic(s), by)


def edge_table(s: SparkSession, d: str, by: tuple[str, ...] = (), min_support: int = MIN_SUPPORT) -> DataFrame:
    return patterns.edges(counts(s, d, by, min_support), POSITIVE, NEGATIVE, by)


def eligible_items(s: SparkSession, rows: DataFrame) -> DataFrame:
    return opportunity.availability(rows, MIN_SUPPORT, intrinsic(s)).where("is_eligible")


def strata(s: SparkSession, d: str, by: tuple[str, ...]) -> DataFrame:
    """Rows of counts for every pair in each stratum; both branches needn't be there."""
    return strata_of(counts(s, d, by), by)


def strata_of(c: DataFrame, by: tuple[str, ...]) -> DataFrame:
    pick = lambda v, o: F.coalesce(F.sum(F.when(F.col("outcome") == o, F.col(v))), F.lit(0))
    return c.groupBy(*PAIR, *by).agg(pick("support_n", POSITIVE).alias("n_pos"), pick("tested_n", POSITIVE).alias("k_pos"), pick("support_n", NEGATIVE).alias("n_neg"), pick("tested_n", NEGATIVE).alias("k_neg"))


def vocabulary(rows: DataFrame) -> list[str]:
    """All items, in order; bounded by the catalogue, not by the rows."""
    return [r[0] for r in rows.where("item is not null").select("item").distinct().orderBy("item").collect()]


# ---- patterns


@query
def escalation_edges(s, d):
    return r6(edge_table(s, d))


@query
def conditional_probabilities(s, d):
    return r6(patterns.conditional_probabilities(counts(s, d)))


@query
def resolved_outcomes(s, d):
    return known(marked(s, d)).groupBy("site", "item", "outcome").agg(F.count("*").alias("n"))


@query
def outcome_conflicts(s, d):
    return cleaning.conflicts(observations(s, d), ["episode", "item"], "outcome")


@query
def availability(s, d):
    return opportunity.availability(seen(s, d), MIN_SUPPORT, intrinsic(s))


@query
def opportunity_states(s, d):
    states = opportunity.cell_states(seen(s, d), MIN_SUPPORT, intrinsic(s))
    return states.groupBy("site", "era", "state").agg(F.sum("n").alias("n"), F.sum("observed").alias("observed"))


@query
def opportunity_grid(s, d):
    """The same states by item and stratum, from the grid's own rows."""
    return opportunity.grid(seen(s, d), MIN_SUPPORT, intrinsic(s)).groupBy("stratum", "item", "state").agg(F.count("*").alias("n"), F.sum("is_observed").alias("observed"))


@query
def opportunity_summary(s, d):
    return r6(opportunity.space_summary(seen(s, d), MIN_SUPPORT, intrinsic(s)))


@query
def testing_matrix(s, d):
    rows = known(seen(s, d))
    return opportunity.testing_matrix(rows, vocabulary(rows))


@query
def edges_ranked(s, d):
    return r6(patterns.ranked(patterns.with_reverse(patterns.retained(edge_table(s, d))))).select(*PAIR, "ratio", "reverse_ratio", "asymmetry", "direction", "ratio_rank", "asymmetry_rank")


@query
def edges_e_values(s, d):
    return r6(edge_table(s, d).select(*PAIR, E.e_value(F.col("ratio")).alias("e_value"), E.e_value(F.when(F.col("ratio") >= 1, F.greatest(F.lit(1.0), F.col("ci_low"))).otherwise(F.least(F.lit(1.0), F.col("ci_high")))).alias("e_value_bound")))


@query
def asymmetry_bins(s, d):
    return r6(patterns.asymmetry_bins(patterns.with_reverse(edge_table(s, d))).groupBy("asymmetry_bin").agg(F.count("*").alias("edges"), F.avg(F.abs("asymmetry")).alias("mean_asymmetry"), F.median("ratio").alias("median_ratio")))


@query
def top_paths(s, d):
    return r6(patterns.top_paths(patterns.retained(edge_table(s, d)), 50))


@query
def path_flows(s, d):
    e = patterns.retained(edge_table(s, d))
    return patterns.flows(patterns.top_paths(e, 50), e)


@query
def edges_site_comparison(s, d):
    """Escalating edges of every two sites side by side."""
    e = edge_table(s, d, ("site",)).where("passes_support and ratio > 1")
    return r6(patterns.compared_scopes(e, "site", SITES))


@query
def edge_threshold_grid(s, d):
    return r6(patterns.threshold_grid(edge_table(s, d), [25, 500, 1500, 2500], [5, 700, 900], [5, 200, 300]))


@query
def bundled_pairs(s, d):
    rows = seen(s, d)
    return r6(patterns.co_observed(known(rows), rows, MIN_SUPPORT, share=0.15, floor=25))


@query
def pair_funnel(s, d):
    c = counts(s, d)
    return patterns.funnel(c, patterns.edges(c, POSITIVE, NEGATIVE), POSITIVE, NEGATIVE)


@query
def smoothing_sensitivity(s, d):
    return r6(patterns.smoothing_sensitivity(edge_table(s, d)))


@query
def node_degrees(s, d):
    return r6(patterns.degrees(edge_table(s, d).where("ratio > 1.1")))


@query
def panel_sizes(s, d):
    return r6(patterns.panel_size(known(seen(s, d))))


@query
def item_overlap(s, d):
    return r6(patterns.overlap(known(seen(s, d))))


@query
def pair_bundling(s, d):
    return r6(patterns.bundling(counts(s, d)))


@query
def display_edges(s, d):
    return r6(patterns.display_edges(edge_table(s, d), 1.2).select(*PAIR, "log2_ratio"))


@query
def downstream_triggers(s, d):
    return r6(patterns.downstream_triggers(edge_table(s, d)))


@query
def category_transitions(s, d):
    return r6(patterns.categorised(edge_table(s, d), categories(s)))


@query
def unsupported_pairs(s, d):
    """Pairs of items seen together that aren't among the strongest edges: an anti join."""
    c = tables.written(counts(s, d), "counts")
    strong = patterns.edges(c, POSITIVE, NEGATIVE).where("ratio > 1.1").select(*PAIR)
    return c.select(*PAIR).distinct().join(strong, PAIR, "left_anti")


@query
def symmetric_closure(s, d):
    e = edge_table(s, d).where("ratio > 1.15").select(*PAIR)
    return e.unionByName(e.select(F.col("downstream").alias("upstream"), F.col("upstream").alias("downstream"))).distinct()


@query
def edge_key_comparison(s, d):
    e = edge_table(s, d)
    return cleaning.same_keys(e.where("ratio > 1"), e.where("k_pos > k_neg"), PAIR)


# ---- replication


@query
def site_edges(s, d):
    return r6(edge_table(s, d, ("site",)))


@query
def pooled_edges(s, d):
    return r6(replication.pooled_over_sites(edge_table(s, d, ("site",))))


@query
def pooled_edges_fdr(s, d):
    p = replication.pooled_over_sites(edge_table(s, d, ("site",))).withColumn("p_value", replication.two_sided_p(F.col("z")))
    return replication.adjusted_p(p, "p_value", PAIR, "q_value").select(*PAIR, F.round("p_value", 5).alias("p_value"), F.round("q_value", 5).alias("q_value"))


@query
def temporal_thirds(s, d):
    """Early and late thirds of the eligible rows of every pair with both branches."""
    rows = seen(s, d)
    e = patterns.edges(patterns.branch_counts(known(rows), rows, MIN_SUPPORT, intrinsic(s)), POSITIVE, NEGATIVE)
    return r6(replication.temporal_thirds(known(rows), eligible_items(s, rows), e, POSITIVE, NEGATIVE))


@query
def cross_site_ratios(s, d):
    out = r6(replication.cross_site(edge_table(s, d, ("site",)), SITES))
    return out.select([F.col(f"`{c}`").alias(c.lower().replace(" ", "_")) for c in out.columns])


@query
def yearly_courses(s, d):
    return replication.yearly_course(edge_table(s, d, ("year",)))


@query
def yearly_heterogeneity(s, d):
    return r6(replication.heterogeneity(edge_table(s, d, ("year",))))


def validated_edges(s, d, draws: bool = False, rows: DataFrame | None = None):
    """Retained edges with what their label rests on: q, stability of the side, pooled sites if any, early and late thirds.

    draws: q is the permutation test's and stability the bootstrap's; else they are the pooled test's and the normal limit, which
    SQL can form. Results and counts by site are written once; edges, sites and draws all start from them. rows: `seen`, if it was
    written already.
    """
    rows = seen(s, d) if rows is None else rows
    by_site = tables.written(patterns.branch_counts(known(rows), rows, MIN_SUPPORT, intrinsic(s), ("site",)), "branches")
    e = patterns.retained(patterns.edges(by_site, POSITIVE, NEGATIVE)).select(*PAIR, "ratio", replication.normal_stability(F.col("ratio"), F.col("log_variance")).alias("sign_stability"))
    side = F.signum(F.log("ratio"))
    sites = replication.pooled_over_sites(patterns.edges(by_site, POSITIVE, NEGATIVE, ("site",)))
    sites = sites.select(*PAIR, "sites", "i2", "z", (F.greatest("sites_above", F.col("sites") - F.col("sites_above")) / F.col("sites")).alias("agreement"), replication.two_sided_p(F.col("z")).alias("p_value"))
    gates = (F.col("n_pos") + F.col("n_neg") >= patterns.MIN_TOTAL) & (F.col("n_pos") >= patterns.MIN_BRANCH) & (F.col("n_neg") >= patterns.MIN_BRANCH)
    t = replication.temporal_thirds(known(rows), eligible_items(s, rows), e, POSITIVE, NEGATIVE).where(gates)
    t = t.groupBy(*PAIR).agg(*[F.max(F.when(F.col("third") == x, side)).alias(x) for x in ("early", "late")])
    if draws:
        st = strata_of(by_site, ("site",))
        e = e.drop("sign_stability").join(resampling.bootstrap(st).select(*PAIR, "sign_stability"), PAIR, "left")
        e = e.join(resampling.permutation_test(st).select(*PAIR, F.col("p_two_sided").alias("p_value")), PAIR, "left")
        sites = sites.drop("p_value")
    out = e.join(sites, PAIR, "left").join(t, PAIR, "left")
    out = out.withColumns({"temporal": (F.col("early") == F.col("late")) & (F.col("early") == side) & (side != 0), "z": F.when(F.signum("z") == side, F.col("z"))})
    return replication.adjusted_p(out, "p_value", PAIR, "q_value")


@query
def validation_labels(s, d):
    """Labels of all retained edges from what SQL can form: the pooled test's q and the normal limit of stability.

    validation_labels_permuted takes the permutation test's q and the bootstrap's stability.
    """
    return replication.label(validated_edges(s, d)).groupBy("validation_status").agg(F.count("*").alias("edges"))


@query
def validation_by_alpha(s, d):
    """How the labels move with the level of significance."""
    e = tables.written(validated_edges(s, d), "validated")
    levels = [replication.label(e, alpha=a).groupBy("validation_status").agg(F.count("*").alias("edges")).withColumn("alpha", F.lit(a)) for a in (0.05, 0.5, 1.0)]
    return tables.union_all(levels)


@query
def validation_labels_permuted(s, d):
    """Labels of all retained edges from the permutation test's q, the bootstrap's stability, sites and time."""
    return replication.label(validated_edges(s, d, draws=True)).groupBy("validation_status").agg(F.count("*").alias("edges"))


@query
def validated_edges_by_status(s, d):
    """Edges that count as validated, with their direction: robust and supported ones."""
    e = replication.label(validated_edges(s, d)).where(F.col("validation_status").isin("robust", "supported"))
    return r6(e.select(*PAIR, "ratio", E.direction(F.col("ratio")).alias("direction"), "validation_status"))


@query
def primary_edges(s, d):
    """The first 40 edges of the report, by label and strength."""
    return r6(reports.primary(replication.label(validated_edges(s, d)), 40).select(*PAIR, "ratio", "validation_status"))


@query
def permutation_strata(s, d):
    return r6(resampling.degeneracy(strata(s, d, ("site",))))


@query
def permutation_strata_by_era(s, d):
    return r6(resampling.degeneracy(strata(s, d, ("site", "era"))))


@query
def observed_ratios(s, d):
    """Ratios that the permutation tests and bootstraps start from: all strata of a pair together."""
    c = strata(s, d, ("site", "era")).groupBy(*PAIR).agg(*[F.sum(x).alias(x) for x in resampling.COUNTS])
    return r6(c.withColumn("ratio", E.rate_ratio(*[F.col(x) for x in ("k_pos", "n_pos", "k_neg", "n_neg")])))


@query
def permutation_test_by_era(s, d):
    """Labels move within site and era."""
    return resampling.permutation_test(strata(s, d, ("site", "era")))


@query
def permutation_test(s, d):
    return resampling.permutation_test(strata(s, d, ("site",)))


@query
def bootstrap_intervals(s, d):
    return resampling.bootstrap(strata(s, d, ("site",)))


@query
def page_rank(s, d):
    return r6(network.page_rank(edge_table(s, d).withColumn("w", F.abs(F.log("ratio"))), "w"))


@query
def betweenness(s, d):
    return r6(network.betweenness(edge_table(s, d).where("ratio > 1.1")))


def model_rows(s, d, covariates: bool = True, rows: DataFrame | None = None):
    """Results in eligible cells as model rows: two numbers, a component and three categories for each episode, units as clusters. rows: `seen`, if it was written already."""
    rows = seen(s, d) if rows is None else rows
    eligible = eligible_items(s, rows)
    cluster = adjusted.cluster_id(F.col("site"), [F.col("unit")], F.col("episode"))
    if not covariates:
        return adjusted.Rows(known(rows), eligible, None, cluster, POSITIVE, NEGATIVE)
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("episode"), "o_custkey", F.col("o_totalprice").cast("double").alias("price"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("urgent"), F.year("o_orderdate").alias("year"))
    c = table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").cast("double").alias("balance"), F.col("c_mktsegment").alias("stratum"), "c_nationkey")
    places = table(s, d, "nation").join(F.broadcast(table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("site"))
    of = o.join(c, "o_custkey").join(F.broadcast(places), "c_nationkey")  # nations are a fixed, small table
    return adjusted.Rows(known(rows), eligible, of, cluster, POSITIVE, NEGATIVE, ["balance", "price"], ["urgent"], ["site", "stratum", "year"])


@query
def adjusted_odds(s, d):
    return adjusted.adjusted_odds(model_rows(s, d)).drop("penalty")


@query
def adjusted_sums(s, d):
    """What the adjusted models start from: sums of every column over each pair's rows, exposed rows and rows that show the item."""
    return adjusted.column_sums(model_rows(s, d)).select(*PAIR, "column", *[F.round(c, 2).alias(c) for c in ("over_rows", "over_exposed", "over_shown")])


@query
def adjusted_patterns(s, d):
    """Every pair's eligible rows by exposure and site and stratum, with those that show the downstream item."""
    c = counts(s, d, ("site", "stratum")).where(F.col("outcome").isin(POSITIVE, NEGATIVE))
    return c.select(*PAIR, (F.col("outcome") == POSITIVE).cast("int").alias("exposed"), "site", "stratum", F.col("support_n").alias("n"), F.col("tested_n").alias("events"))


@query
def adjustment_concordance(s, d):
    """How the adjusted odds bear on each retained edge's ratio."""
    rows = seen(s, d)
    a = adjusted.adjusted_odds(model_rows(s, d, rows=rows)).select(*PAIR, "odds_ratio", "ci_low", "ci_high")
    e = patterns.retained(patterns.edges(patterns.branch_counts(known(rows), rows, MIN_SUPPORT, intrinsic(s)), POSITIVE, NEGATIVE)).select(*PAIR, "ratio")
    return e.join(a, PAIR, "left").groupBy(reports.concordance(*[F.col(c) for c in ("ratio", "odds_ratio", "ci_low", "ci_high")]).alias("concordance")).agg(F.count("*").alias("edges"))


@query
def adjusted_ridge_refits(s, d):
    return adjusted.adjusted_odds(model_rows(s, d), (1.0, 10.0, 100.0))


@query
def adjusted_contributions(s, d):
    return adjusted.contributions(model_rows(s, d))


@query
def adjusted_explanations(s, d):
    """What the columns of each pair's adjusted model contribute to the log odds of its sampled rows."""
    return r6(adjusted.explanations(model_rows(s, d), "features"))


@query
def adjusted_explanation_checks(s, d):
    """Sizes of the samples behind the contributions, and whether these add up."""
    return adjusted.explanations(model_rows(s, d), "models").drop("largest_error")


@query
def unit_bootstrap(s, d):
    return resampling.unit_bootstrap(model_rows(s, d, covariates=False))


@query
def between_site_permutation(s, d):
    return resampling.between_site_permutation(strata(s, d, ("site",)))


# ---- cleaning and sources


@query
def clean_labels(s, d):
    p = table(s, d, "part")
    return p.select("p_partkey", L.normalise_label(F.concat(F.lit("  "), "p_name", F.lit(" \t "), "p_type")).alias("label"), L.safe_name(F.concat("p_brand", F.lit(" / "), "p_name")).alias("safe"))


@query
def excluded_entities(s, d):
    """Parts whose names aren't of a primary type or are on a list, by brand; and how many stay, as a row of their own."""
    p = table(s, d, "part").select("p_brand", F.when(F.col("p_size") % 9 != 0, F.col("p_name")).alias("name"))
    kept, out = cleaning.by_entity(p, "name", "p_brand", [("widget", "WIDGET"), ("ring", "RING"), ("gear", "GEAR")], "OTHER", ["RING", "OTHER"], [" Small  Ring"])
    stay = kept.groupBy("p_brand").agg(F.count("*").alias("rows")).select("p_brand", F.lit("(kept)").alias("name"), F.lit("PRIMARY").alias("entity_type"), "rows")
    return out.unionByName(stay)


@query
def null_tokens(s, d):
    p = table(s, d, "part").select("p_partkey", F.when(F.col("p_size") % 5 == 0, "NULL").when(F.col("p_size") % 5 == 1, "  x ").when(F.col("p_size") % 5 == 2, " Null ").otherwise(F.col("p_name")).alias("name"))
    return cleaning.clean_text(p, upper=["name"])


@query
def keep_first_rows(s, d):
    lines = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return cleaning.keep_first(lines, ["l_orderkey"], [F.desc("l_quantity"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")])


@query
def shards_coalesced(s, d):
    e = table(s, d, "events")
    v = lambda t: F.when(F.col("event_type") == t, F.col("value"))
    kinds = ["click", "error", "purchase"]
    sparse = e.select("user_id", "event_id", *[v(t).alias(f"{p}_{t}") for t in kinds for p in ("median", "first", "last")])
    return r6(cleaning.coalesce_shards(sparse, ["user_id"], "event_id"))


@query
def shard_conflicts(s, d):
    e = table(s, d, "events")
    sparse = e.select("user_id", *[F.when(F.col("event_type") == t, F.round("value", 0)).alias(t) for t in ("click", "error", "purchase")])
    return cleaning.shard_conflicts(sparse, ["user_id"], ["click", "error", "purchase"])


@query
def schema_contract(s, d):
    c = table(s, d, "customer").withColumnRenamed("c_mktsegment", "segment")
    return tables.align(c, {"c_custkey": "bigint", "stratum": "string", "c_acctbal": "double", "phone": "string"}, {"segment": "stratum"})


@query
def contract_errors(s, d):
    o = table(s, d, "orders").withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 7 == 0, None).when(F.col("o_orderkey") % 11 == 0, " ").otherwise(F.col("o_orderpriority")))
    return cleaning.contract_errors(o, ["o_orderkey", "o_note"], ["o_orderkey", "o_orderpriority"])


@query
def row_ledger(s, d):
    rows = observations(s, d)
    return cleaning.ledger(rows, "site", [("other_outcome", F.col("outcome").isin(POSITIVE, NEGATIVE)), ("early", F.year("time") >= 1997), ("reserve", ~F.col("item").isin("Brand#2", "Brand#5"))])


@query
def tables_unioned(s, d):
    a = table(s, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = table(s, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return tables.union_all([a, b]).groupBy("segment").agg(F.count("*").alias("n"), F.round(F.sum("balance"), 2).alias("balance"))


@query
def ages_and_keywords(s, d):
    p = table(s, d, "part").select("p_partkey", F.when(F.col("p_size") < 10, F.concat(F.lit("under "), "p_size")).when(F.col("p_size") < 20, F.concat(F.lit("above "), "p_size")).when(F.col("p_size") < 30, F.concat("p_size", F.lit("-"), (F.col("p_size") + 9).cast("string"))).when(F.col("p_size") < 45, F.col("p_size").cast("string")).alias("age"), "p_name")
    age = L.parsed_age(F.col("age"))
    return p.select("p_partkey", age.alias("years"), L.age_bin(age).alias("bin"), L.keyword_class(F.col("p_name"), [("ring", "ring"), ("widget", "widget"), ("red", "red")], "other").alias("kind"))


@query
def edge_seeds(s, d):
    items = table(s, d, "part").select("p_brand").distinct()
    return items.select("p_brand", F.crc32(F.concat_ws("|", F.lit("7"), F.lit("17"), "p_brand")).alias("seed"))


# ---- descriptions


@query
def scope_counts(s, d):
    return descriptive.by_scope(observations(s, d), "site", [F.count("*").alias("rows"), F.countDistinct("unit").alias("units"), F.countDistinct("episode").alias("episodes"), F.countDistinct("item").alias("items")])


@query
def availability_exposure(s, d):
    return descriptive.availability_exposure(seen(s, d), 100)


@query
def episodes_per_unit(s, d):
    return descriptive.episodes_per_unit(observations(s, d))


@query
def panel_breadth(s, d):
    rows = seen(s, d)
    return r6(descriptive.panel_breadth(known(rows), rows))


@query
def antibiogram(s, d):
    return r6(descriptive.antibiogram(observations(s, d), ["R", "A", "N"]))


@query
def first_episodes(s, d):
    return descriptive.first_per_year(observations(s, d).select("site", "unit", "episode", "time").distinct())


@query
def coverage_by_era(s, d):
    rows = seen(s, d)
    return r6(descriptive.coverage_by_era(known(rows), rows))


@query
def crosstab_outcomes(s, d):
    return descriptive.crosstab(observations(s, d), "stratum", "outcome", ["R", "N", "A"])


@query
def numeric_balance(s, d):
    o = table(s, d, "orders").withColumn("g", F.col("o_orderstatus") == "F")
    return r6(descriptive.difference_numeric(o, "g", "o_totalprice"))


@query
def category_balance(s, d):
    o = table(s, d, "orders").withColumn("g", F.col("o_orderstatus") == "F")
    return r6(descriptive.difference_by_level(o, "g", "o_orderpriority"))


@query
def level_correlations(s, d):
    return r6(descriptive.level_correlations(table(s, d, "orders"), "o_orderstatus", "o_orderpriority"))


@query
def frequent_items(s, d):
    return r6(descriptive.frequent(observations(s, d), "item", 0.5))


@query
def item_flags(s, d):
    rows = seen(s, d)
    items = vocabulary(rows)
    return descriptive.flags_of(rows, "unit", "item", items).select("unit", *[F.col(f"`{i}`").alias("".join(x if x.isalnum() else "_" for x in i.lower())) for i in items])


@query
def study_period(s, d):
    return descriptive.study_period(table(s, d, "orders"), "o_orderdate")


@query
def cell_sizes(s, d):
    return descriptive.cell_sizes(observations(s, d))


@query
def price_quartiles(s, d):
    return r6(ranges.quantiles(table(s, d, "orders"), "o_totalprice", ["o_orderpriority"], {"q25": 0.25, "median": 0.5, "q75": 0.75}))


# ---- history


@query
def look_back_windows(s, d):
    e = table(s, d, "events")
    index = e.where("event_type = 'purchase'").select(F.col("event_id").alias("index_id"), "user_id", F.col("ts").alias("index_ts"))
    records = e.where("event_type <> 'purchase'").select("user_id", "ts", "event_type")
    return history.look_back(index, records, "user_id", "index_ts", "ts", "event_type", (1, 7, 14))


@query
def active_conditions(s, d):
    e = table(s, d, "events").select("user_id", F.col("event_type").alias("name"), F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 50 - 10).cast("double")).alias("start"), F.when(F.col("event_id") % 4 != 0, (F.col("event_id") % 30 - 20).cast("double")).alias("end"))
    return history.active_counts(e, "user_id", "name", "start", "end")


# ---- prevalence


def cells(s, d):
    rows = seen(s, d)
    return prevalence.item_cells(known(rows), rows, MIN_SUPPORT, POSITIVE, intrinsic(s))


@query
def prevalence_summary(s, d):
    return r6(prevalence.summary(cells(s, d)))


@query
def prevalence_delta_curve(s, d):
    return r6(prevalence.delta_curve(prevalence.summary(cells(s, d))))


@query
def prevalence_tilt_curve(s, d):
    return r6(prevalence.tilt_curve(prevalence.summary(cells(s, d)), [-2.0, -1.0, 0.0, 1.0, 2.0]))


@query
def prevalence_tipping_points(s, d):
    return r6(prevalence.crossings(prevalence.tilt_curve(prevalence.summary(cells(s, d)), [k / 4 for k in range(-12, 13)]), [0.1, 0.3, 0.5]))


@query
def edge_enrichment(s, d):
    return r6(prevalence.enrichment(known(seen(s, d)), edge_table(s, d).where("ratio > 1.05"), POSITIVE))


# ---- evaluation


def scored(s, d):
    docs = table(s, d, "orders")
    return docs.select(F.col("o_orderstatus").alias("model"), F.when(F.col("o_totalprice") + (F.col("o_orderkey") % 1000) * 300 > 400000, 1).otherwise(0).alias("target"), F.round(F.least(F.lit(1.0), F.col("o_totalprice") / 500000), 2).alias("score"), F.col("o_orderdate").alias("time"), F.col("o_custkey").alias("unit"))


@query
def classifier_areas(s, d):
    return r6(evaluation.areas(scored(s, d), "target", "score", ["model"]))


@query
def threshold_sweep(s, d):
    return r6(evaluation.measures(scored(s, d), "target", "score", [k / 20 for k in range(1, 20)], ["model"]))


@query
def best_thresholds(s, d):
    return r6(evaluation.best_threshold(evaluation.measures(scored(s, d), "target", "score", [k / 20 for k in range(1, 20)], ["model"]), ["model"]))


@query
def temporal_splits(s, d):
    return evaluation.temporal_split(scored(s, d), "time", 1997, 1999).groupBy("split").agg(F.count("*").alias("rows"), F.sum("target").alias("positives"), F.countDistinct("unit").alias("units"))


@query
def split_overlap(s, d):
    return evaluation.split_overlap(evaluation.temporal_split(scored(s, d), "time", 1997, 1999), "unit")


@query
def grouped_folds(s, d):
    return evaluation.grouped_folds(scored(s, d), "unit", 5).groupBy("fold").agg(F.count("*").alias("rows"), F.countDistinct("unit").alias("units"))


@query
def fold_thresholds(s, d):
    """For each fold the threshold chosen on the other folds, and its balanced accuracy on the fold."""
    rows = evaluation.grouped_folds(scored(s, d), "unit", 5)
    cuts = [k / 20 for k in range(1, 20)]
    others = rows.crossJoin(F.broadcast(s.range(5).select(F.col("id").cast("int").alias("held")))).where("fold <> held")  # five copies
    best = evaluation.best_threshold(evaluation.measures(others, "target", "score", cuts, ["held"]), ["held"]).select(F.col("held").alias("fold"), "threshold")
    own = evaluation.measures(rows, "target", "score", cuts, ["fold"]).select("fold", "threshold", "balanced_accuracy")
    return r6(best.join(own, ["fold", "threshold"]))


@query
def ablation_deltas(s, d):
    a = evaluation.areas(scored(s, d), "target", "score", ["model"]).select("model", F.lit("full").alias("feature_set"), "roc_auc")
    b = evaluation.areas(scored(s, d).withColumn("score", F.round(F.col("score"), 1)), "target", "score", ["model"]).select("model", F.lit("coarse").alias("feature_set"), "roc_auc")
    return r6(evaluation.ablation(a.unionByName(b), ["coarse", "full"], "coarse", "roc_auc"))


def orders_by_split(s, d):
    o = table(s, d, "orders").select(F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"), "o_orderdate", F.when(F.col("o_totalprice") + (F.col("o_orderkey") % 1000) * 300 > 400000, 1).otherwise(0).alias("target"))
    return evaluation.temporal_split(o, "o_orderdate", 1997, 1999)


@query
def trained_classifier(s, d):
    """Areas by split of a logistic regression fitted on the early years."""
    return evaluation.areas(models.classifier(orders_by_split(s, d), "target", ["price"], ["priority"], "split"), "target", "score", ["split"])


@query
def trained_models(s, d):
    """Areas by model and split of all kinds of classifiers, trees calibrated on the validation years; 40 trees and 20 rounds, for the query's time."""
    out = []
    kinds = ("logistic_regression", "random_forest", "boosted_trees", "neural_network")
    for kind, scored in models.classifiers(orders_by_split(s, d), "target", ["price"], ["priority"], "split", kinds, 40, 20).items():
        if kind in ("random_forest", "boosted_trees"):
            scored = models.calibrated(evaluation.outcomes(scored, "target", "score", ["split"], "rows"), "target", "score", "split", "rows")
            out.append(evaluation.areas(scored, "target", "score", ["split"], "rows").withColumn("model", F.lit(kind)))
        else:
            out.append(evaluation.areas(scored, "target", "score", ["split"]).withColumn("model", F.lit(kind)))
    return tables.union_all(out)


@query
def modelled_tilt_curve(s, d):
    return models.modelled_tilt(cells(s, d), ["site", "stratum", "era"], [-2.0, -1.0, 0.0, 1.0, 2.0])


@query
def masking_experiment(s, d):
    """Prevalence of each item from four fifths of its results, standardised, against that of all of them."""
    rows = seen(s, d)
    o = models.masked(known(rows), 0.2)
    part = lambda x: prevalence.summary(prevalence.item_cells(x, rows, MIN_SUPPORT, POSITIVE, intrinsic(s)), 1, 1).select("item", "standardised")
    rest = part(o.where("not is_hidden")).withColumnRenamed("standardised", "from_known")
    return r6(part(o).withColumnRenamed("standardised", "from_all").join(rest, "item").withColumn("error", F.col("from_known") - F.col("from_all")))


@query
def masking_by_tilt(s, d):
    """Results hidden by a known tilt of their outcome, and the modelled curve of what is left: its error against all results at each tilt."""
    rows = seen(s, d)
    o = models.masked_by_outcome(known(rows), POSITIVE, 0.4, 0.1)
    make = lambda x: prevalence.item_cells(x, rows, MIN_SUPPORT, POSITIVE, intrinsic(s))
    truth = models.modelled_tilt(make(o), ["site", "stratum", "era"], [0.0]).select("item", F.col("prevalence").alias("from_all"))
    curve = models.modelled_tilt(make(o.where("not is_hidden")), ["site", "stratum", "era"], [-2.0, -1.0, 0.0, 1.0, 2.0])
    return r6(curve.join(truth, "item").withColumn("error", F.col("prevalence") - F.col("from_all")))


# ---- flows, reasons, checks


@query
def exclusion_flow(s, d):
    return audit.flow(observations(s, d), [("known_item", F.col("item").isNotNull()), ("interpretable", F.col("outcome").isin(POSITIVE, NEGATIVE)), ("since_1997", F.year("time") >= 1997), ("not_intrinsic", F.col("item") != "Brand#7")])


@query
def item_panel_reasons(s, d):
    p = observations(s, d).groupBy("item").agg(F.count("*").alias("rows"), F.countDistinct("episode").alias("episodes"), F.countDistinct("site").alias("sites"), F.count(F.when(F.col("outcome") == POSITIVE, 1)).alias("positives"))
    return audit.first_reason(p, [("few_sites", F.col("sites") < 5), ("few_rows", F.col("rows") % 3 == 0), ("few_positives", F.col("positives") % 2 == 0)])


@query
def cohort_characteristics(s, d):
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return r6(audit.characteristics(o, "c_mktsegment", ["o_orderstatus", "o_orderpriority"], "all"))


@query
def label_transitions(s, d):
    p = replication.pooled_over_sites(edge_table(s, d, ("site",)))
    rule = lambda i2: F.when((F.col("i2") <= i2) & (F.abs("z") >= 1.0), "replicated").otherwise("not_replicated")
    return audit.transitions(p, rule(50), rule(25))


@query
def contract_checks(s, d):
    rows = seen(s, d)
    g = opportunity.grid(rows, MIN_SUPPORT, intrinsic(s))
    return audit.checks(g, [("intrinsic_is_not_eligible", ~(F.col("is_intrinsic") & F.col("is_eligible"))), ("support_when_available", ~F.col("is_available") | (F.col("support") >= MIN_SUPPORT)), ("state_known", F.col("state").isNotNull()), ("observed_flag", F.col("is_observed").isin(0, 1))])


@query
def collapsed_outcomes(s, d):
    one = audit.collapsed(lines(s, d).repartition("episode"), ["episode", "item"], "outcome", [POSITIVE, NEGATIVE])
    return one.join(episodes(s, d).select("episode").hint("merge"), "episode", "left_semi").groupBy("outcome").agg(F.count("*").alias("n"))


@query
def sampled_customers(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_mktsegment")
    return audit.sampled(c, "c_custkey", 0.05, "c_mktsegment", 25)


@query
def linked_orders_of_sample(s, d):
    """Other tables follow the sampled keys: a semi join."""
    keys = audit.sampled(table(s, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", 0.05, "c_mktsegment", 25)
    return table(s, d, "orders").join(keys, F.col("o_custkey") == F.col("c_custkey"), "left_semi").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query
def episodes_without_result(s, d):
    rows = seen(s, d)
    return rows.select("site", "episode").distinct().join(known(rows).select("episode").distinct(), "episode", "left_anti").groupBy("site").agg(F.count("*").alias("episodes"))


@query
def stratum_edges(s, d):
    """The same patterns within each stratum, in one run."""
    return r6(edge_table(s, d, ("stratum",)).where("passes_support"))


@query
def year_site_counts(s, d):
    """Counts of every pair, site and year, a row for each."""
    return edge_table(s, d, ("site", "year")).select(*PAIR, "site", "year", F.col("n_pos").alias("n"), F.col("k_pos").alias("k"))


@query
def companion_rates(s, d):
    """For each pair, the largest and mean rate at which the upstream item's episodes show other items."""
    rate = counts(s, d).groupBy(*PAIR).agg((F.sum("tested_n") / F.sum("support_n")).alias("p"))
    every = rate.groupBy("upstream").agg(F.sum("p").alias("total"), F.count("*").alias("n"), F.max("p").alias("top"), F.max_by("downstream", F.struct("p", "downstream")).alias("top_item"))
    rest = rate.alias("r").join(every, "upstream")
    second = rate.join(every.select("upstream", "top_item"), "upstream").where("downstream <> top_item").groupBy("upstream").agg(F.max("p").alias("second"))
    out = rest.join(second, "upstream", "left").withColumn("max_companion", F.when(F.col("downstream") == F.col("top_item"), F.col("second")).otherwise(F.col("top")))
    return r6(out.select(*PAIR, "max_companion", E.safe_divide(F.col("total") - F.col("p"), F.col("n") - 1).alias("mean_companion")))


@query
def weakest_link_paths(s, d):
    """Paths whose every stage is significant."""
    e = patterns.retained(edge_table(s, d))
    ok = e.select(*PAIR, (F.col("ci_low") > 1).alias("ok"))
    first, second = (ok.select(F.col("upstream").alias(a), F.col("downstream").alias(b), F.col("ok").alias(o)) for a, b, o in (("a", "b", "ok1"), ("b", "c", "ok2")))
    p = patterns.top_paths(e, 50).join(first, ["a", "b"], "left").join(second, ["b", "c"], "left")
    return p.select("a", "b", "c", (F.coalesce("ok1", F.lit(False)) & F.coalesce("ok2", F.lit(False))).alias("qualifies"))


@query
def top_links(s, d):
    e = edge_table(s, d).withColumns({"support": F.col("n_pos") + F.col("n_neg"), "effect": F.abs(F.log2("ratio"))})
    return r6(e.orderBy(F.desc("support"), F.desc(F.round("effect", 9)), "upstream", "downstream").limit(30).select(*PAIR, "support", "effect"))


@query
def rate_scatter(s, d):
    e = edge_table(s, d).where("n_pos >= 20 and n_neg >= 20")
    p, q = F.col("k_pos") / F.col("n_pos"), F.col("k_neg") / F.col("n_neg")
    return r6(e.select(*PAIR, p.alias("rate_pos"), q.alias("rate_neg"), (F.greatest(p, F.lit(1e-4)) / F.greatest(q, F.lit(1e-4))).alias("plain_ratio")))


@query
def event_profile(s, d):
    e = edge_table(s, d).withColumn("events", F.col("k_pos") + F.col("k_neg"))
    return e.agg(*[F.count(F.when(F.col("events") <= k, 1)).alias(f"at_most_{k}") for k in (1, 100, 250, 300)])


@query
def rules_matched(s, d):
    """Rule texts to their upstream items, joined to the edges."""
    rules = s.createDataFrame([("Brand#3", "SAME AS Brand#1 AND Brand#2 IF TESTED"), ("Brand#4", "SAME AS Brand#9"), ("Brand#5", "NONE")], "downstream string, rule string")
    named = F.regexp_extract("rule", r"^SAME AS (.+?)(?: IF .*)?$", 1)
    parsed = rules.where(named != "").select("downstream", F.explode(F.split(named, " AND ")).alias("upstream"))
    e = edge_table(s, d).select(*PAIR, "ratio")
    return r6(e.join(parsed.withColumn("in_rule", F.lit(True)), PAIR, "left").join(rules.select("downstream", F.lit(True).alias("has_rule")), "downstream").select(*PAIR, "ratio", F.coalesce("in_rule", F.lit(False)).alias("in_rule")))


@query
def recent_errors(s, d):
    """Purchases with the errors of the same user in the week before."""
    e = table(s, d, "events")
    p = e.where("event_type = 'purchase'").select(F.col("event_id").alias("index_id"), "user_id", F.col("ts").alias("t"))
    x = e.where("event_type = 'error'").select("user_id", "ts", "value")
    hit = history.within(p, x, "user_id", "t", "ts", 7 * 86_400)
    return hit.groupBy("index_id").agg(F.count("*").alias("errors"), F.round(F.median("value"), 6).alias("median_value"), F.max("value").alias("max_value"))


@query
def selection_balance(s, d):
    """Strata of episodes with an item against those without it, for every item."""
    return r6(descriptive.balance_by_item(seen(s, d), "stratum"))


@query
def stage_counts(s, d):
    """Rows of each table, by name."""
    names = ["customer", "orders", "lineitem", "part"]
    return tables.union_all([table(s, d, n).agg(F.count("*").alias("rows")).withColumn("name", F.lit(n)) for n in names])


@query
def identifiability_panel(s, d):
    """Eligible opportunities with their outcome as 1, 0 or unknown, counted by site and item."""
    rows = seen(s, d)
    o = known(rows).select("episode", "item", F.when(F.col("outcome").isin(POSITIVE, "A"), 1).otherwise(0).alias("y"))
    g = opportunity.grid(rows, MIN_SUPPORT, intrinsic(s)).where("is_eligible").select("episode", "item", "site").join(o, ["episode", "item"], "left")
    return g.groupBy("site", "item").agg(F.count("*").alias("eligible"), F.count("y").alias("known"), F.coalesce(F.sum("y"), F.lit(0)).alias("positive"))


# ---- covariates and feature matrices


def order_star(s, d):
    """Every order with its customer, the customer's nation, earlier orders and the user's events of the same number."""
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    customer = table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal", "c_nationkey")
    lines = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    events = table(s, d, "events").groupBy(F.col("user_id").alias("o_custkey")).agg(F.count("*").alias("n"), F.count(F.when(F.col("event_type") == "error", 1)).alias("errors"))
    return features.star(o, [("customer", customer, ["o_custkey"]), ("lines", lines, ["o_orderkey"]), ("events", events, ["o_custkey"])])


@query
def covariate_star(s, d):
    out = order_star(s, d).withColumnsRenamed({"customer_c_mktsegment": "segment", "customer_c_acctbal": "balance", "customer_c_nationkey": "nation"})
    return r6(out.drop("o_orderdate").withColumn("o_totalprice", F.col("o_totalprice").cast("double")).withColumn("balance", F.col("balance").cast("double")))


@query
def covariate_coverage(s, d):
    return features.coverage(order_star(s, d), ["customer", "lines", "events"])


@query
def covariates_at_time(s, d):
    """Every purchase with what its user's records said until then: errors and clicks by window, all records, first and worst kinds."""
    e = table(s, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    of = lambda t: e.where(F.col("event_type") == t)
    index = of("purchase").select("event_id", "user_id", "ts")
    H = history.History
    return history.point_in_time(
        index, "user_id", "ts",
        [
            H("errors", of("error"), "user_id", "ts", windows=(1, 7, 14)), H("before", of("purchase"), "user_id", "ts", windows=(7,), strict=True), H("all", e, "user_id", "ts", "count", "event_type"),
            H("first_kind", e, "user_id", "ts", "first", "event_type"), H("worst", e, "user_id", "ts", "worst", "event_type", order=("error", "purchase", "click")), H("views", of("view"), "user_id", "ts", "suppressed"),
        ],
    ).drop("ts")


def pair_matrix(s, d):
    """Pair rows with context, and with pattern features from the sites of the training part alone."""
    rows = seen(s, d)
    o = known(rows)
    eligible = opportunity.availability(rows, MIN_SUPPORT, intrinsic(s)).where("is_eligible")
    train = ~F.col("site").isin("ASIA", "EUROPE")
    part = rows.where(train)
    e = patterns.edges(patterns.branch_counts(known(part), part, MIN_SUPPORT, intrinsic(s)), POSITIVE, NEGATIVE)
    orders = table(s, d, "orders").select(F.col("o_orderkey").alias("episode"), "o_custkey", "o_orderdate", (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("ctx_urgent"))
    past = history.point_in_time(orders, "o_custkey", "o_orderdate", [history.History("ctx_prior", orders, "o_custkey", "o_orderdate", windows=(90, 365), strict=True)])
    context = o.groupBy("episode").agg((F.count("*") - 1).alias("ctx_others")).join(past.drop("o_custkey", "o_orderdate"), "episode", "left")
    m = features.pair_rows(o, eligible, opportunity.CELL, POSITIVE, context).withColumn("ctx_site", F.col("site")).withColumn("split", F.when(train, "train").otherwise("test"))
    return features.with_pattern_features(m, e)


@query
def pair_feature_matrix(s, d):
    """Means of the full feature set over pair rows, by pair and split."""
    m = features.feature_set(pair_matrix(s, d), "full", [*PAIR, "split"])
    means = [F.avg(c).alias(c) for c in ("target", "up_positive", "ctx_others", "ctx_urgent", "ctx_prior_90d", "ctx_prior_365d", "pattern_log_ratio", "pattern_support")]
    return r6(m.groupBy(*PAIR, "split").agg(F.count("*").alias("rows"), *means))


@query
def pair_feature_rows(s, d):
    """The rows themselves that have pattern features and a positive result, with the pattern-aware set."""
    m = features.feature_set(pair_matrix(s, d).where("up_positive = 1"), "pattern_aware", ["episode", *PAIR])
    return r6(m)


# ---- screens, implied outcomes, reports


@query
def screened_edges(s, d):
    """Edges from counts without the pairs that are nearly always seen together, in both directions."""
    rows = seen(s, d)
    c = patterns.branch_counts(known(rows), rows, MIN_SUPPORT, intrinsic(s))
    flagged = patterns.co_observed(known(rows), rows, MIN_SUPPORT, share=0.145, floor=25).where("is_bundled")
    return r6(patterns.edges(reports.screened(c, flagged), POSITIVE, NEGATIVE).select(*PAIR, "ratio", "passes_support"))


def implied_rows(s, d, rows: DataFrame | None = None):
    """Observed results, and results that rules imply for items that an episode doesn't show: the outcome of one item stands for another."""
    o = known(seen(s, d) if rows is None else rows)
    rules = s.createDataFrame([("Brand#1", "Brand#11"), ("Brand#2", "Brand#12"), ("Brand#3", "Brand#13")], "item string, implied string")
    implied = o.join(F.broadcast(rules), "item").withColumn("item", F.col("implied")).select(o.columns)  # three rules
    return reports.with_implied(o, implied, ["episode", "item"])


@query
def implied_outcomes(s, d):
    return implied_rows(s, d).groupBy("item", "is_implied").agg(F.count("*").alias("rows"), F.count(F.when(F.col("outcome") == POSITIVE, 1)).alias("positives"))


@query
def implied_sensitivity(s, d):
    """Edges from observed results against those from observed and implied ones."""
    rows = seen(s, d)
    make = lambda o, every: patterns.edges(patterns.branch_counts(o, every, MIN_SUPPORT, intrinsic(s)), POSITIVE, NEGATIVE)
    with_them = tables.written(implied_rows(s, d, rows).drop("is_implied"), "implied")
    every = rows.unionByName(with_them)  # other columns raise; availability counts distinct episodes, so rows may be there twice
    return r6(patterns.compared(make(known(rows), rows), make(with_them, every), "observed", "implied"))


@query
def canonical_edges(s, d):
    """Edges after three items took other items' names: one for each ordered pair."""
    e = edge_table(s, d)
    names = s.createDataFrame([("Brand#21", "Brand#1"), ("Brand#22", "Brand#2"), ("Brand#23", "Brand#2")], "item string, canonical string")
    return r6(reports.canonical(e, F.col("n_pos") + F.col("n_neg"), names).select(*PAIR, "ratio", "collapsed"))


@query
def direction_conflicts(s, d):
    e = patterns.retained(edge_table(s, d)).withColumn("stored", F.when((F.col("upstream") == "Brand#5") & (F.col("ratio") > 1), "suppression").otherwise(F.col("direction")))
    return reports.direction_conflicts(e, "stored")


@query
def thinned_curves(s, d):
    curve = prevalence.tilt_curve(prevalence.summary(cells(s, d)), [k / 4 for k in range(-12, 13)])
    return r6(reports.thinned(r6(curve), ["item"], "tilt", "tilt", "prevalence", 9))


@query
def ranked_prevalence_shifts(s, d):
    return r6(reports.ranked_shifts(prevalence.summary(cells(s, d)), 20).select("item", "shift", "eligible", "evaluable", "rank"))


@query
def conservative_edges(s, d):
    return r6(reports.conservative(patterns.retained(edge_table(s, d)), 30).select(*PAIR, "ratio", "near_bound"))


@query
def smoothing_of_strongest(s, d):
    return r6(reports.smoothing_table(patterns.retained(edge_table(s, d)), 30))


@query
def categories_in_order(s, d):
    p = prevalence.summary(cells(s, d)).join(categories(s), "item", "left")
    return r6(reports.in_category_order(p, ["Access", "Watch", "Reserve"], "category", F.col("evaluable") < 2_000, "naive", "item").select("item", "category", "naive", "place"))


@query
def existence_by_scope(s, d):
    e = edge_table(s, d, ("site",)).where("passes_support")
    return r6(reports.existence(e, "site", s.createDataFrame([(x,) for x in [*SITES, "ANTARCTICA"]], "site string")))


@query
def pair_dependence(s, d):
    c = counts(s, d)
    return r6(reports.dependence(c, patterns.edges(c, POSITIVE, NEGATIVE).select(*PAIR, "ratio")))


@query
def mutual_dependence(s, d):
    """Both directions of every two items within the cells in which both are eligible."""
    rows = seen(s, d)
    return r6(reports.mutual_dependence(patterns.branch_counts(known(rows), rows, MIN_SUPPORT, intrinsic(s), mutual=True), POSITIVE, NEGATIVE))


@query
def replication_sensitivity(s, d):
    return reports.label_sensitivity(replication.pooled_over_sites(edge_table(s, d, ("site",))), [25.0, 50.0, 75.0], [1.0, 1.96])


@query
def bundling_sensitivity(s, d):
    """Labels of retained edges by whether a stricter screen for bundling would leave them out."""
    rows = seen(s, d)
    c = patterns.branch_counts(known(rows), rows, MIN_SUPPORT, intrinsic(s))
    return reports.bundling_bands(replication.label(validated_edges(s, d, rows=rows)), c, 0.5, 0.145)


@query
def availability_sensitivity(s, d):
    """Edges and their mean ratio at other least supports of availability."""
    rows = seen(s, d)
    make = lambda m: patterns.edges(patterns.branch_counts(known(rows), rows, m, intrinsic(s)), POSITIVE, NEGATIVE).where("passes_support").agg(F.lit(m).alias("min_support"), F.count("*").alias("edges"), F.coalesce(F.avg("ratio"), F.lit(0.0)).alias("mean_ratio"))
    return r6(tables.union_all([make(m) for m in (1, MIN_SUPPORT, 2 * MIN_SUPPORT)]))


@query
def matched_families(s, d):
    """Rows by family: labels that a pattern matches, after harmonising."""
    rows = observations(s, d).withColumn("label", L.harmonised(F.concat(F.col("item"), F.lit(" + "), F.lower("stratum")), {"BRAND#1/BUILDING": "FIRST"}))
    family = F.when(F.col("label").rlike(r"^(FIRST|BRAND#[12])(/|$)"), "low").when(F.col("label").rlike(r"BUILDING|HOUSEHOLD"), "home").otherwise("other")
    return rows.groupBy(family.alias("family"), L.first_word(F.col("label"), ["THE"]).alias("first_word")).agg(F.count("*").alias("rows"))


@query
def pooled_selection(s, d):
    """Rows of a requested label: a canonical one takes its aliases as well, an annotated one itself only; both are relabelled."""
    rows = table(s, d, "part").select(F.regexp_extract("p_name", r"^(\S+)", 1).alias("label"))
    aliases = {"red": "warm", "orange": "warm", "green": "cold", "blue": "cold"}
    out = [L.selected(rows, "label", want, aliases).withColumn("requested", F.lit(want)) for want in ("warm", "red")]
    return tables.union_all(out).groupBy("requested", "label").agg(F.count("*").alias("rows"))


@query
def months_and_times(s, d):
    """Mixed date texts: the month in words with 'unknown', and the year by its prefix."""
    o = table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "n/a").when(F.col("o_orderkey") % 5 == 1, None).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("t"))
    return o.select("o_orderkey", L.month_text(L.parsed_time(F.col("t"))).alias("month"), L.year_by_prefix(F.col("t")).alias("year"))


@query
def unverifiable_history(s, d):
    """Records whose times can't be trusted never count as known before the index: availability 0, the counts kept aside."""
    e = table(s, d, "events")
    return history.suppressed(e.groupBy("user_id").agg(F.count("*").alias("records"), F.max("value").alias("top")), ["records", "top"])


@query
def merged_shards(s, d):
    """Edges computed by shards of upstream items, merged again under the check that they cover every pair once."""
    e = tables.written(edge_table(s, d), "edges")  # each shard and the check read it
    part = F.pmod(F.crc32("upstream"), F.lit(3))
    return r6(tables.merged_shards([e.where(part == k) for k in range(3)], e, PAIR).select(*PAIR, "ratio"))


@query
def published_tables(s, d):
    """Orders by status, customers by segment and the items' edges, published with manifests, and what an inventory of them says."""
    base = f"{tables.checkpoint_root(s)}/opportune/published-{uuid.uuid4().hex}"
    fs, path = tables.file_system(s, base)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    frames = {"statuses": table(s, d, "orders").select("o_orderkey", "o_orderstatus"), "segments": table(s, d, "customer").select("c_custkey", "c_mktsegment"), "observations": seen(s, d)}
    for name, frame in frames.items():
        published.publish(frame, base, name)
    return published.inventory(s, base, [*frames, "missing"]).select("name", "state", "version", "rows")


@query
def projected_scan(s, d):
    """Two columns and a predicate that reach the scan."""
    return tables.read_parquet(s, f"{d}/orders.parquet", ["o_orderkey", "o_orderstatus"], "o_orderdate >= date'1998-01-01' and o_orderstatus = 'F'")
