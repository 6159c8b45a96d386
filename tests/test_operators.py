"""Operators on small literal tables: odd values, planted signals, closed forms."""

import datetime as dt
import hashlib
import itertools
import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from opportune.functions import effects as E
from opportune.functions import labels as L
from opportune.operators import audit, cleaning, descriptive, evaluation, features, models, network, patterns, prevalence, replication, reports, resampling
from opportune.plans.queries import QUERIES, edge_table, validated_edges
from opportune.sources import tables


def test_clean_text_strips_after_null_tokens(spark):
    df = spark.createDataFrame([("NULL", " a "), (" Null ", "b"), (None, "NULL")], "x string, y string")
    assert [tuple(r) for r in cleaning.clean_text(df, upper=["y"]).collect()] == [(None, "A"), ("Null", "B"), (None, None)]


def test_resolved_drops_conflicts_and_null_groups(spark):
    df = spark.createDataFrame([(1, "R"), (1, "R"), (2, "R"), (2, "S"), (3, None), (4, None), (4, "S"), (None, "R")], "k int, o string")
    assert {tuple(r) for r in cleaning.resolved(df, ["k"], "o").collect()} == {(1, "R"), (4, "S"), (None, "R")}
    assert tuple(cleaning.conflicts(df, ["k"], "o").first()) == (1, 2)


def test_shards_take_medians_first_and_last(spark):
    df = spark.createDataFrame([("a", 1, 1.0, None, 5.0), ("a", 2, 3.0, 7.0, None), ("a", 3, None, 8.0, 6.0)], "k string, i int, median_x double, first_x double, last_x double")
    assert tuple(cleaning.coalesce_shards(df, ["k"], "i").first()) == ("a", 2.0, 7.0, 6.0)


def test_assert_unique(spark):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(ValueError):
        cleaning.assert_unique(df, ["k"])


def test_same_keys_matches_nulls(spark):
    a, b = (spark.createDataFrame(r, "k int") for r in ([(1,), (None,)], [(None,), (2,)]))
    assert tuple(cleaning.same_keys(a, b, ["k"]).first()) == (1, 1, 1)


def test_ledger_reconciles(spark):
    df = spark.createDataFrame([("s", 1, "x"), ("s", None, "x"), ("s", 3, "y")], "site string, v int, w string")
    r = cleaning.ledger(df, "site", [("small", F.col("v") < 3), ("w", F.col("w") == "x")]).first()
    assert (r.rows_in, r.removed_small, r.removed_w, r.rows_left) == (3, 2, 0, 1)


def test_csv_as_text_and_alignment(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n007,NULL\n8,x\n")
    df = tables.read_csv_as_text(spark, str(tmp_path / "a.csv"), ["id", "v"])
    assert [tuple(r) for r in df.collect()] == [("007", None), ("8", "x")]
    out = tables.align(df, {"key": "string", "v": "string", "n": "double"}, {"id": "key"})
    assert out.columns == ["key", "v", "n"] and out.first().key == "007"
    tables.write_result(out, str(tmp_path / "out"), {"rows": 2})
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2 and "rows" in spark.read.text(str(tmp_path / "out_note")).first()[0]
    assert set(tables.read_table_dir(spark, str(tmp_path), ["none"])) == set()


@pytest.mark.parametrize("text,years", [("34", 34.0), ("above 89", 89.0), ("under 18", 17.0), ("20-30", 25.0), ("?", None), (None, None)])
def test_parsed_age(spark, text, years):
    assert spark.createDataFrame([(text,)], "a string").select(L.parsed_age(F.col("a"))).first()[0] == years


def test_labels(spark):
    r = spark.createDataFrame([(" a \t b ", "Co-x (y), z.")], "a string, b string").select(L.normalise_label(F.col("a")), L.safe_name(F.col("b")), L.mapped(F.lit("q"), {"q": "r"}), L.is_blank(F.lit("  "))).first()
    assert tuple(r) == ("A B", "co_x_y_z", "r", True)


def test_effects(spark):
    r = spark.range(1).select(E.rate_ratio(F.lit(0), F.lit(10), F.lit(5), F.lit(10)).alias("r"), E.e_value(F.lit(2.0)).alias("e"), E.safe_divide(F.lit(1), F.lit(0)).alias("d"), E.expit(E.logit(F.lit(0.3))).alias("p"), replication.two_sided_p(F.lit(1.96)).alias("z")).first()
    assert r.r == pytest.approx(0.5 / 5.5) and r.e == pytest.approx(2 + math.sqrt(2)) and r.d is None and r.p == pytest.approx(0.3) and r.z == pytest.approx(0.05, abs=1e-4)


def planted(sites=2, per_branch=20):
    """8 of 10 observed after a positive result, 2 of 10 after a negative one."""
    rows, episode = [], 0
    for site in range(sites):
        for outcome, share in (("R", 0.8), ("N", 0.2)):
            for k in range(per_branch):
                episode += 1
                base = (f"s{site}", f"u{episode}", episode, dt.datetime(2020 + k % 2, 1, 1 + k % 28), "x", "2020-2024")
                rows.append((*base, "up", outcome))
                if k < share * per_branch:
                    rows.append((*base, "down", "N"))
    return rows


KIND = "site string, unit string, episode int, time timestamp, stratum string, era string, item string, outcome string"


def test_planted_pattern_is_found_and_replicates(spark):
    o = spark.createDataFrame(planted(), KIND)
    e = patterns.edges(patterns.branch_counts(o, o, 1), "R", "N").where("upstream = 'up'").first()
    assert (e.n_pos, e.k_pos, e.n_neg, e.k_neg) == (40, 32, 40, 8) and e.ratio == pytest.approx(32.5 / 8.5) and e.ci_low > 1
    site = patterns.edges(patterns.branch_counts(o, o, 1, by=("site",)), "R", "N", ("site",))
    pooled = replication.pooled_over_sites(site).where("upstream = 'up'").first()
    assert pooled.sites == 2 and pooled.i2 == 0 and pooled.z > 1.96
    test = resampling.permutation_test(site.where("upstream = 'up'")).first()
    assert test.p_two_sided < 0.02
    boot = resampling.bootstrap(site.where("upstream = 'up'")).first()
    assert boot.low > 1 and boot.sign_stability == 1
    eligible = spark.createDataFrame([(f"s{k}", "x", "2020-2024", i) for k in range(2) for i in ("up", "down")], "site string, stratum string, era string, item string")
    thirds = replication.temporal_thirds(o, eligible, spark.createDataFrame([("up", "down")], "upstream string, downstream string"), "R", "N").collect()
    assert {r.third for r in thirds} == {"early", "late"} and all(r.ratio > 1 for r in thirds)


def test_permutation_matches_explicit_shuffles():
    counts = np.array([[30, 12, 40, 9], [10, 6, 25, 12]])
    got = resampling.permuted(counts, 4000, 1)
    random, want = np.random.default_rng(3), []
    for _ in range(4000):
        k = 0
        for n1, k1, n0, k0 in counts:
            seen = np.zeros(n1 + n0)
            seen[: k1 + k0] = 1
            k += random.permutation(seen)[:n1].sum()
        n1, k1, n0, k0 = counts.sum(0)
        want.append((k + 0.5) / (n1 + 1) / ((k1 + k0 - k + 0.5) / (n0 + 1)))
    assert np.mean(got) == pytest.approx(np.mean(want), rel=0.02) and np.std(got) == pytest.approx(np.std(want), rel=0.06)


def test_bh(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "k string, p double")
    got = {r.k: r.q for r in replication.adjusted_p(df, "p", ["k"], "q").collect()}
    assert got == {"a": pytest.approx(0.03), "b": pytest.approx(0.04), "c": pytest.approx(0.04), "d": None}


def test_page_rank_sums_to_one(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("c", "a", None)], "upstream string, downstream string, w double")
    r = {x.node: x["rank"] for x in network.page_rank(e, "w").collect()}
    assert sum(r.values()) == pytest.approx(1) and r["a"] > r["b"] > r["c"]
    assert network.page_rank(e.limit(0), "w").count() == 0


def test_areas_with_ties_and_one_class(spark):
    df = spark.createDataFrame([("m", 1, 0.9), ("m", 0, 0.9), ("m", 0, 0.1), ("one", 1, 0.5)], "model string, t int, s double")
    got = {r.model: r for r in evaluation.areas(df, "t", "s", ["model"]).collect()}
    assert got["m"].roc_auc == pytest.approx(0.75) and got["one"].roc_auc is None and got["one"].average_precision is None


def test_prevalence_bounds(spark):
    o = spark.createDataFrame(planted(), KIND)
    t = prevalence.summary(prevalence.item_cells(o, o, 1, "R"), 1, 1).where("item = 'up'").first()
    assert t.lower <= t.naive <= t.upper and t.naive == pytest.approx(0.5)


def test_scopes_and_severity(spark):
    df = spark.createDataFrame([("a", 1, "R"), ("a", 1, "N"), (None, 2, "N")], "site string, e int, o string")
    got = {r.site: r.n for r in descriptive.by_scope(df, "site", [F.count("*").alias("n")]).collect()}
    assert got == {"a": 2, "unknown": 1, "all_sites": 3}
    worst = {r.e: (r.worst, r.in_conflict) for r in descriptive.most_severe(df, ["e"], "o", ["R", "A", "N"]).collect()}
    assert worst == {1: ("R", True), 2: ("N", False)}


def test_operators_run_on_micro_batches(spark, tmp_path):
    from opportune.streaming import run_on_batches

    spark.createDataFrame([(1, "R"), (1, "R"), (2, "R"), (2, "S")], "k int, o string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, o string").parquet(str(tmp_path / "in"))
    run_on_batches(stream, lambda b: cleaning.resolved(b, ["k"], "o"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert [r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]


def test_flow_reasons_and_checks(spark):
    df = spark.createDataFrame([(1, "a"), (None, "a"), (3, "b")], "v int, w string")
    rules = [("v", F.col("v").isNotNull()), ("w", F.col("w") == "a")]
    assert [(r.stage, r.rows, r.removed) for r in audit.flow(df, rules).orderBy("step").collect()] == [("all", 3, 0), ("v", 2, 1), ("w", 1, 1)]
    assert [r.reason for r in audit.first_reason(df, [("big", F.col("v") > 2), ("a", F.col("w") == "a")]).collect()] == ["a", "a", "big"]
    assert {r.check: (r.failures, r.passed) for r in audit.checks(df, [*rules, ("any", F.lit(True))]).collect()} == {"v": (1, False), "w": (1, False), "any": (0, True)}


def test_collapsed_prefers_firm_outcomes(spark):
    df = spark.createDataFrame([(1, "I"), (1, "R"), (2, "R"), (2, "S"), (3, None), (4, "I")], "k int, o string")
    assert {r.k: r.o for r in audit.collapsed(df, ["k"], "o", ["R", "S"]).collect()} == {1: "R", 2: "CONFLICTING", 3: None, 4: "I"}


def test_sample_keeps_a_floor_of_each_family(spark):
    df = spark.createDataFrame([(k, "rare" if k < 5 else "usual") for k in range(500)], "k int, f string")
    got = audit.sampled(df, "k", 0.02, "f", 4)
    assert got.where("f = 'rare'").count() >= 4 and got.count() < 60 and sorted(map(tuple, got.collect())) == sorted(map(tuple, audit.sampled(df.orderBy(F.desc("k")), "k", 0.02, "f", 4).collect()))


def test_tilt_falls_and_meets_the_data(spark):
    cells = spark.createDataFrame([("i", "a", 100, 50, 10), ("i", "b", 100, 50, 30), ("j", "a", 10, 5, 0)], "item string, g string, eligible long, evaluable long, positive long")
    got = {(r.item, r.tilt): r for r in models.modelled_tilt(cells, ["g"], [-1.0, 0.0, 1.0, 60.0]).collect()}
    curve = [got["i", t].prevalence for t in (-1.0, 0.0, 1.0, 60.0)]
    assert curve == sorted(curve, reverse=True) and curve[1] == pytest.approx(0.4, abs=0.01) and curve[3] == pytest.approx(40 / 200, abs=1e-6)
    assert got["j", 0.0].status == "not_evaluable"


@pytest.mark.parametrize("name", ["permutation_test", "permutation_test_by_era", "bootstrap_intervals", "between_site_permutation", "unit_bootstrap", "adjusted_odds", "temporal_thirds", "year_site_counts"])
def test_patterns_are_tested_for_every_pair(spark, name):
    data = "/root/testdata/sf0.01"
    pairs = {(r.upstream, r.downstream) for r in QUERIES[name](spark, data).select("upstream", "downstream").distinct().collect()}
    assert len({a for a, _ in pairs}) == 25 and len(pairs) == 600 and all(a != b for a, b in pairs)


def test_matrix_and_flags_have_every_item(spark):
    for name in ("testing_matrix", "item_flags"):
        assert len(QUERIES[name](spark, "/root/testdata/sf0.01").columns) == 26


def test_every_retained_edge_is_labelled_with_time(spark):
    data = "/root/testdata/sf0.01"
    got = validated_edges(spark, data).select("upstream", "downstream", "q_value", "temporal").collect()
    assert len(got) == patterns.retained(edge_table(spark, data)).count() > 300
    assert any(r.temporal for r in got) and all(r.q_value is not None for r in got)
    assert {r.validation_status for r in QUERIES["validation_labels"](spark, data).collect()} <= set(reports.STATUS_ORDER)


def test_labels_of_every_combination(spark):
    """Significance, stability, sites and time, each met, missed or null, against the rule said plainly."""
    rows = list(itertools.product([0.01, 0.2, None], [0.9, 0.6, None], [(3, 10.0, 3.0, 1.0), (3, 90.0, 3.0, 1.0), (3, 10.0, 1.0, 1.0), (3, None, None, 0.7), (3, None, None, 0.5), (1, 10.0, 3.0, 1.0), (None,) * 4], [True, False, None]))
    df = spark.createDataFrame([(k, q, st, *x, t) for k, (q, st, x, t) in enumerate(rows)], "k int, q_value double, sign_stability double, sites int, i2 double, z double, agreement double, temporal boolean")
    for r in replication.label(df).collect():
        sig, stable = r.q_value == 0.01, r.sign_stability == 0.9
        again = r.temporal is True or (r.sites, r.i2, r.z, r.agreement) in ((3, 10.0, 3.0, 1.0), (3, None, None, 0.7))
        want = ("robust" if again else "supported") if sig and stable else "mixed" if sig or stable or again else "insufficient"
        assert r.validation_status == want, r


def test_betweenness_of_small_graphs(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "e"), ("e", "c"), ("d", "d"), ("a", "b")], "upstream string, downstream string")
    got = {r.node: round(r.betweenness * 12, 6) for r in network.betweenness(edges).collect()}
    # a->c and a->d pass b and e half each; a->d, b->d, e->d pass c
    assert got == {"a": 0.0, "b": 1.0, "c": 3.0, "d": 0.0, "e": 1.0}


def test_running_sums_over_ranges_equal_plain_ones(spark):
    random = np.random.default_rng(4)
    rows = [(str(random.choice(list("ab"))), int(random.random() < 0.3), float(s)) for s in np.r_[random.random(300), [0.0, 1.0, 1.0, -2.0, 7.0]]]
    got = evaluation.score_counts(spark.createDataFrame(rows, "m string, t int, s double"), "t", "s", ["m"]).collect()
    for r in got:
        mine = [x for x in rows if x[0] == r.m]
        assert (r.tp, r.fp) == (sum(t for _, t, s in mine if s >= r.s), sum(1 - t for _, t, s in mine if s >= r.s))
        assert (r.pos, r.neg) == (sum(t for _, t, _ in mine), sum(1 - t for _, t, _ in mine))


def test_star_keeps_rows_and_refuses_double_keys(spark):
    base = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    out = features.star(base, [("d", spark.createDataFrame([(1, 5)], "k int, x int"), ["k"])])
    assert sorted((r.v, r.d_x, r.d_known) for r in out.collect()) == [("a", 5, True), ("b", 5, True), ("c", None, False)]
    with pytest.raises(ValueError):
        features.star(base, [("d", spark.createDataFrame([(1, 5), (1, 6)], "k int, x int"), ["k"])])
    with pytest.raises(ValueError):
        features.feature_set(base, "none", ["k"])
    odd = spark.createDataFrame([(float("nan"),), (None,), (1e16,), (2.0,)], "x double")
    assert [r.x for r in features.finite(odd, ["x"]).collect()] == [0.0, 0.0, 0.0, 2.0]


def test_concordance_and_directions(spark):
    df = spark.createDataFrame([(1.5, 1.4, 1.1, 1.8), (1.5, 1.2, 0.9, 1.6), (1.5, 0.6, 0.4, 0.9), (1.5, None, None, None)], "r double, a double, l double, h double")
    assert [x[0] for x in df.select(reports.concordance(*[F.col(c) for c in "ralh"])).collect()] == ["concordant", "attenuated", "reversed", "unavailable"]


def test_names_guards_and_selection(spark):
    df = spark.createDataFrame([(" amox + clav ",), ("a - b",), ("n/a",), (None,)], "x string")
    assert [r[0] for r in df.select(L.harmonised(F.col("x"), {"AMOX/CLAV": "AMC"})).collect()] == ["AMC", "A B", None, None]
    assert [r[0] for r in df.select(L.first_word(F.col("x"), ["a"])).collect()] == ["amox", "-", "n", None]
    with pytest.raises(ValueError):
        L.require_one(spark.createDataFrame([("a",), ("b",)], "x string"), "x")
    with pytest.raises(ValueError, match="lacks c; it has a, b"):
        L.require_present(spark.createDataFrame([("a",), ("b",)], "x string"), "x", ["a", "c"])
    assert spark.range(1).select(L.sentence_case(F.lit(" aBC d")), L.pair_key(F.lit("y"), F.lit("x"))).first() == ("Abc d", "x|y")


def test_files_are_chosen_and_checked(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "k int, v string")
    base = str(tmp_path)
    tables.write_result(df, f"{base}/one.parquet")
    tables.write_csv(df, f"{base}/one.csv")
    assert tables.is_complete(spark, f"{base}/one.parquet") and not tables.is_complete(spark, f"{base}/none")
    assert tables.mapped_tables(spark, base, {"a": "one.parquet", "b": "two.parquet"}) == {"a": f"{base}/one.parquet"}
    with pytest.raises(FileNotFoundError):
        tables.mapped_tables(spark, base, {"b": "two.parquet"}, required=["b"])
    assert tables.first_existing(spark, [f"{base}/x", f"{base}/one.csv"]) == f"{base}/one.csv"
    os.utime(f"{base}/one.parquet", (2_000_000_000, 2_000_000_000))
    assert tables.newest(spark, [f"{base}/one.csv", f"{base}/one.parquet", f"{base}/x"]) == f"{base}/one.parquet" and tables.newest(spark, [f"{base}/x"]) is None
    with pytest.raises(PermissionError):
        tables.layer_path(base, "raw", True)
    sums = {os.path.basename(r.path): r.md5 for r in tables.checksums(spark, f"{base}/one.csv").collect()}
    assert all(hashlib.md5(open(f"{base}/one.csv/{n}", "rb").read()).hexdigest() == m for n, m in sums.items()) and sums
    assert tables.as_markdown(df) == "| k | v |\n| - | - |\n| 1 | a\\|b |\n| 2 |  |"
    with pytest.raises(ValueError):
        tables.as_markdown(df, 1)
    with pytest.raises(ValueError, match="repeated=1|'repeated': 1"):
        tables.merged_shards([df, df.limit(1)], df, ["k"])


def test_every_query_without_sql_runs(spark):
    from opportune.plans.oracle import ORACLE

    rest = [n for n in QUERIES if n not in ORACLE]
    assert 0 < len(rest) < 25
    for name in rest:
        out = QUERIES[name](spark, "/root/testdata/sf0.01")
        assert len(out.collect()) > 0, name


@pytest.mark.parametrize("share", [0.1, 0.37, 0.5, 0.93])
def test_balanced_rows_weigh_the_same(spark, share):
    df = spark.range(20_000).selectExpr("id", f"cast(id < {int(20_000 * share)} as int) as t", "id % 7 as x")
    got = {n: models.balanced(df.repartition(n), "t", share) for n in (1, 5)}
    one, many = ({tuple(r) for r in g.groupBy("id", "t").count().collect()} for g in got.values())
    assert one == many and len(one) == 20_000
    by_class = [sum(n for _, t, n in one if t == k) for k in (0, 1)]
    assert by_class[0] == pytest.approx(by_class[1], rel=0.03) and max(by_class) == pytest.approx(20_000 * max(share, 1 - share))


@pytest.mark.parametrize("kind", ["logistic_regression", "random_forest", "boosted_trees", "neural_network"])
def test_classifiers_find_a_planted_signal(spark, kind):
    rows = [(float(k % 97), "ab"[k % 2], int((k % 97 > 48) != (k % 19 == 0)), ("train", "validation", "test")[k % 3]) for k in range(1800)] + [(5.0, "new", 0, "test")]
    df = spark.createDataFrame(rows, "x double, c string, target int, split string")
    got = models.classifier(df, "target", ["x"], ["c"], "split", kind, 10, 10)
    assert got.columns == [*df.columns, "score"] and got.count() == len(rows)
    assert evaluation.areas(got.where("split = 'test'"), "target", "score", []).first().roc_auc > 0.85
    with pytest.raises(ValueError):
        models.classifier(df.where("target = 1"), "target", ["x"], ["c"], "split", kind)
    with pytest.raises(ValueError):
        models.estimator("other", "t", "f", "w", 1, 1, 1, 1)


def test_classifiers_prepare_once(spark, monkeypatch):
    from pyspark.ml import Pipeline

    fits, fit = [], Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, *a: fits.append(1) or fit(self, *a))
    rows = [(float(k % 97), "ab"[k % 2], int((k % 97 > 48) != (k % 19 == 0)), ("train", "test")[k % 2 * (k % 3 == 0)]) for k in range(400)]
    df = spark.createDataFrame(rows, "x double, c string, target int, split string")
    kinds = ["logistic_regression", "random_forest"]
    both = models.classifiers(df, "target", ["x"], ["c"], "split", kinds, 3, 3)
    assert list(both) == kinds and len(fits) == 1
    for kind in kinds:
        assert both[kind].collect() == models.classifier(df, "target", ["x"], ["c"], "split", kind, 3, 3).collect()


def test_counted_outcomes_stand_for_their_rows(spark):
    """Equal scores keep one calibrated value however they are added up, from rows or from counts."""
    rows = [(s, int(k % 7 < t), ("validation", "test")[k % 2]) for s, t in ((0.1, 4), (0.3, 2), (0.7, 3), (0.9, 5)) for k in range(int(1000 * s) + 1)] + [(None, 1, "test"), (0.3, None, "test"), (0.5, None, "test")]
    df = spark.createDataFrame(rows, "score double, target int, split string")
    counts = evaluation.outcomes(df, "target", "score", ["split"], "rows")
    assert counts.count() == len({*rows})
    steps = []
    for n, weight, given in ((1, None, df), (3, None, df), (5, None, df), (2, "rows", counts)):
        got = models.calibrated(given.where("score is not null").repartition(n), "target", "score", "split", weight)
        steps.append(sorted(r[0] for r in got.select("score").distinct().collect()))
        areas = {r.split: (r.roc_auc, r.average_precision) for r in evaluation.areas(got, "target", "score", ["split"], weight).collect()}
        first = areas if len(steps) == 1 else first
        assert {k: pytest.approx(v, rel=1e-12) for k, v in first.items()} == areas
        # 0.1 and 0.3 are pooled, 0.7 and 0.9 stand alone; 0.5 has no validation row and lies between
        assert len(steps[-1]) == 4 and steps[-1] == pytest.approx(steps[0], rel=1e-12)


def pooled_adjacent(points):
    """Isotonic regression of (score, target) by pooling neighbours, plainly: (least score, greatest score, mean) of each block."""
    blocks = []
    for x, y in sorted(points):
        if blocks and blocks[-1][1] == x:
            blocks[-1][2] += y
            blocks[-1][3] += 1
        else:
            blocks.append([x, x, y, 1])
    k = 1
    while k < len(blocks):
        if blocks[k - 1][2] / blocks[k - 1][3] >= blocks[k][2] / blocks[k][3]:
            blocks[k - 1] = [blocks[k - 1][0], blocks[k][1], blocks[k - 1][2] + blocks[k][2], blocks[k - 1][3] + blocks[k][3]]
            del blocks[k]
            k = max(1, k - 1)
        else:
            k += 1
    return [(a, b, t / n) for a, b, t, n in blocks]


def test_calibration_pools_neighbours(spark):
    points = [(k % 64 / 64, int((k * 7919) % 100 < k % 64)) for k in range(2000)]
    df = spark.createDataFrame([(s, t, "validation") for s, t in points] + [(0.999, 1, "test"), (0.0, 0, "test")], "score double, target int, split string")
    blocks = pooled_adjacent(points)
    want = {s: next(m for a, b, m in blocks if a <= s <= b) for s, _ in points}
    raw = df.withColumn("raw", F.col("score"))
    for r in models.calibrated(raw, "target", "score", "split").collect():
        assert abs(r.score - (want[r.raw] if r.raw in want else blocks[-1][2])) < 1e-9
    assert models.calibrated(df.where("split = 'test'"), "target", "score", "split").count() == 2


def test_rows_by_entity_type(spark):
    rows = [("p", "Cefoxitin Screen"), ("p", "cefazolin"), ("q", None), (None, " CEFAZOLIN "), ("q", "odd  drug"), ("q", "ODD DRUG"), ("q", "")]
    kept, out = cleaning.by_entity(spark.createDataFrame(rows, "site string, label string"), "label", "site", [("screen", "SCREEN")], "AST", ["AST"], ["odd drug"])
    assert sorted((r.site or "-", r.label) for r in kept.collect()) == [("-", " CEFAZOLIN "), ("p", "cefazolin"), ("q", "")]
    assert sorted(tuple(r) for r in out.collect()) == [("p", "Cefoxitin Screen", "SCREEN", 1), ("q", "<missing>", "MISSING_LABEL", 1), ("q", "ODD DRUG", "AST", 1), ("q", "odd  drug", "AST", 1)]


def test_flows_fall_back_to_single_edges(spark):
    edges = spark.createDataFrame([("a", "b", 3.0, 10, 5), ("c", "d", 2.0, 7, 7), ("e", "f", 0.5, 9, 9)], "upstream string, downstream string, ratio double, n_pos int, n_neg int")
    paths = spark.createDataFrame([("a", "b", "c", 6.0, 4)], "a string, b string, c string, path_ratio double, min_support int")
    assert sorted((r.stage, r.source, r.target, r.flow) for r in patterns.flows(paths, edges).collect()) == [(1, "a", "b", 4), (2, "b", "c", 4)]
    assert sorted((r.stage, r.source, r.target, r.flow) for r in patterns.flows(paths.limit(0), edges, 2).collect()) == [(1, "a", "b", 15), (1, "c", "d", 14)]
    assert patterns.flows(paths.limit(0)).count() == 0


def test_bundling_bands_fail_on_pairs_that_were_to_be_screened(spark):
    labelled = spark.createDataFrame([("a", "b", "robust"), ("b", "a", "mixed"), ("a", "c", "robust")], "upstream string, downstream string, validation_status string")
    counts = spark.createDataFrame([("a", "b", "R", 100, 70), ("b", "a", "R", 100, 60), ("a", "c", "R", 100, 90), ("c", "a", "R", 10, 9)], "upstream string, downstream string, outcome string, support_n int, tested_n int")
    got = {(r.band, r.validation_status): r.pairs for r in reports.bundling_bands(labelled, counts, 0.95, 0.55).collect()}
    assert got == {("stricter_only", "robust"): 1, ("stricter_only", "mixed"): 1, ("kept", "robust"): 1}
    with pytest.raises(Exception, match="meets the primary screen"):
        reports.bundling_bands(labelled, counts, 0.6, 0.55).collect()


def test_pair_rows_form_in_place(spark):
    from opportune.operators import features, opportunity

    rows = [(1, "p", "s", "t", "a", "R"), (1, "p", "s", "t", "b", "N"), (2, "p", "s", "t", "a", "N"), (3, "q", "s", "t", "a", "R"), (3, "q", "s", "t", None, "R")]
    o = spark.createDataFrame(rows, "episode int, site string, stratum string, era string, item string, outcome string")
    e = spark.createDataFrame([("p", "s", "t", i) for i in "abc"] + [("q", "s", "t", "b")], "site string, stratum string, era string, item string")
    context = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "episode int, ctx int")
    out = features.pair_rows(o, e, opportunity.CELL, "R", context)
    got = sorted((r["episode"], r["upstream"], r["downstream"], r["up_positive"], r["target"], r["ctx"]) for r in out.collect())
    assert got == [(1, "a", "b", 1, 1, 5), (1, "a", "c", 1, 0, 5), (1, "b", "a", 0, 1, 5), (1, "b", "c", 0, 0, 5), (2, "a", "b", 0, 0, 6), (2, "a", "c", 0, 0, 6), (3, "a", "b", 1, 0, 7)]
    above = out._jdf.queryExecution().optimizedPlan().toString().split("Generate explode")[0]
    assert "Join" not in above  # nothing is joined to rows of pairs, so they are never shuffled


def test_flags_of_more_items_than_a_number_has_bits_take_one_grouping(spark):
    from opportune.operators import descriptive, opportunity

    items = [f"i{k}" for k in range(130)]
    df = spark.createDataFrame([(1, "i0"), (1, "i61"), (2, "i62"), (2, "i129"), (2, "i129"), (3, None), (None, "i5"), (4, "other")], "episode int, item string")
    flags = descriptive.flags_of(df, "episode", "item", items)
    assert {r["episode"]: [i for i in items if r[i]] for r in flags.collect()} == {1: ["i0", "i61"], 2: ["i62", "i129"], 3: [], None: [], 4: []}
    matrix = opportunity.testing_matrix(df.where("episode is not null"), items)
    assert {r["episode"]: [i for i in items if r[f"tested__{i}"]] for r in matrix.collect()} == {1: ["i0", "i61"], 2: ["i62", "i129"], 4: []}
    for made in (flags, matrix):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Aggregate [") == 1 and "Join" not in plan


def test_marked_results_group_lines_before_they_meet_orders(spark, tmp_path):
    from opportune.plans import roles

    put = lambda name, rows, kind: spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    put("lineitem", [(1, 1, "R"), (1, 1, "N"), (1, 2, "A"), (1, 3, None), (2, 2, "R"), (2, 2, "R"), (9, 1, "R")], "l_orderkey long, l_partkey long, l_returnflag string")
    put("part", [(1, "x"), (2, "y"), (3, "z")], "p_partkey long, p_brand string")
    put("orders", [(1, 7, dt.date(1996, 1, 1)), (1, 7, dt.date(1996, 1, 1)), (2, 7, dt.date(1997, 1, 1)), (3, 8, None)], "o_orderkey long, o_custkey long, o_orderdate date")
    put("customer", [(7, 0, "S")], "c_custkey long, c_nationkey int, c_mktsegment string")
    put("nation", [(0, 0)], "n_nationkey int, n_regionkey int")
    put("region", [(0, "P")], "r_regionkey int, r_name string")
    out = roles.marked(spark, str(tmp_path))
    assert sorted((r["episode"], r["item"], r["outcome"] or "", r["site"], r["unit"]) for r in out.collect()) == [(1, "x", "", "P", 7), (1, "y", "A", "P", 7), (1, "z", "", "P", 7), (2, "y", "R", "P", 7)]
    keys = ["site", "unit", "episode", "time", "stratum", "era", "item"]
    plain = roles.observations(spark, str(tmp_path)).groupBy(*keys).agg(F.min("outcome").alias("lo"), F.max("outcome").alias("hi")).select(*keys, F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("outcome"))
    assert out.exceptAll(plain).isEmpty() and plain.exceptAll(out).isEmpty()
