"""Time, sites and histories: thirds of a pair's rows, chi-square tails, random effects, common cells, look-back joins."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from opportune.functions import effects as E
from opportune.operators import history, patterns, replication, reports, resampling
from opportune.operators.patterns import PAIR

KIND = "site string, unit string, episode int, time timestamp, stratum string, era string, item string, outcome string"
CELL_KIND = "site string, stratum string, era string, item string"


# ---- thirds


def plain_thirds(rows, eligible, up, down, least=15):
    shown = {(r[2], r[6]) for r in rows if r[3] is not None}
    mine = sorted((r[3], r[2], r[7] == "R", (r[2], down) in shown) for r in rows if r[6] == up and r[7] in "RN" and r[3] is not None and (r[0], r[4], r[5], down) in eligible)
    if len(mine) < least or len({m[0] for m in mine}) < 2:
        return {}
    third = len(mine) // 3
    count = lambda part: (sum(p for *_, p, _ in part), sum(p and s for *_, p, s in part), sum(not p for *_, p, _ in part), sum(not p and s for *_, p, s in part))
    return {"early": count(mine[:third]), "late": count(mine[len(mine) - third :])}


@pytest.mark.parametrize("days, seed", [(40, 1), (3, 2), (1, 3), (400, 4)])
def test_thirds_of_eligible_dated_rows(spark, days, seed):
    r = random.Random(seed)
    rows = []
    for e in range(300):
        site = r.choice("pq")
        time = r.choice([None, *[dt.datetime(2020, 1, 1) + dt.timedelta(days=r.randrange(days), hours=r.randrange(24)) for _ in range(6)]])
        rows += [(site, f"u{e % 9}", e, time, "s", "t", item, r.choice("RRNNA")) for item in "abcd" if r.random() < (0.5 if item != "d" else 0.04)]
    eligible = [("p", "s", "t", "a"), ("p", "s", "t", "b"), ("q", "s", "t", "a"), ("q", "s", "t", "c"), ("p", "s", "t", "c"), ("p", "s", "t", "d"), ("q", "s", "t", "d")]
    pairs = [(a, b) for a in "abcd" for b in "abcd" if a != b]
    got = replication.temporal_thirds(spark.createDataFrame(rows, KIND).repartition(3), spark.createDataFrame(eligible, CELL_KIND), spark.createDataFrame(pairs, "upstream string, downstream string"), "R", "N")
    got = {(x.upstream, x.downstream, x.third): (x.n_pos, x.k_pos, x.n_neg, x.k_neg) for x in got.collect()}
    want = {(a, b, t): v for a, b in pairs for t, v in plain_thirds(rows, set(eligible), a, b).items()}
    assert got == want and len({k[:2] for k in want}) >= 9
    assert not any(k[0] == "d" for k in got)  # too few rows


def test_one_time_gives_no_thirds(spark):
    rows = [("p", "u", e, dt.datetime(2020, 1, 1), "s", "t", "a", "RN"[e % 2]) for e in range(40)]
    got = replication.temporal_thirds(spark.createDataFrame(rows, KIND), spark.createDataFrame([("p", "s", "t", "b")], CELL_KIND), spark.createDataFrame([("a", "b")], "upstream string, downstream string"), "R", "N")
    assert got.count() == 0


# ---- chi-square and heterogeneity


def test_chi_square_tails(spark):
    def exact(q, d):
        a, x = d / 2, q / 2
        return 1.0 if x == 0 else 1 - math.fsum(math.exp(-x + (a + n) * math.log(x) - math.lgamma(a + n + 1)) for n in range(2000))

    cases = [(q, d) for d in (1, 2, 3, 5, 20, 101) for q in (0.0, 1e-8, 0.1, 1.0, 3.84, 10.0, 30.0, 100.0)]
    got = spark.createDataFrame(cases, "q double, d int").select("q", "d", E.chi_square_tail(F.col("q"), F.col("d")).alias("p")).collect()
    assert all(r.p == pytest.approx(exact(r.q, r.d), abs=1e-10) for r in got)
    odd = [(None, 1), (1.0, None), (-1.0, 1), (1.0, 0), (float("inf"), 1), (float("nan"), 1)]
    assert [r.p for r in spark.createDataFrame(odd, "q double, d int").coalesce(1).select(E.chi_square_tail(F.col("q"), F.col("d")).alias("p")).collect()] == [None, None, None, None, 0.0, None]
    for z in (0.0, 1.0, 1.96, 5.0, 30.0):
        assert spark.range(1).select(E.normal_tail(F.lit(-z))).first()[0] == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-9)


def test_yearly_heterogeneity_follows_long_series_only(spark):
    rows = []
    for pair, ratios in {"same": [1.5] * 6, "moves": [0.4, 2.5, 0.4, 2.5, 0.4, 2.5], "short": [0.4, 2.5, 0.4]}.items():
        rows += [(pair, "x", y, 100, 50, 100, 50, r, 0.02) for y, r in enumerate(ratios)]
    rows += [("same", "x", 99, 5, 5, 100, 50, 9.0, 0.02)]  # not evaluable
    got = {r.upstream: r for r in replication.heterogeneity(spark.createDataFrame(rows, "upstream string, downstream string, year int, n_pos int, k_pos int, n_neg int, k_neg int, ratio double, log_variance double")).collect()}
    assert (got["same"].years, got["moves"].years, got["short"].years) == (6, 6, 3)
    assert got["same"].q == pytest.approx(0, abs=1e-9) and got["same"].p_value == pytest.approx(1) and not got["same"].varies
    y = np.log([0.4, 2.5] * 3)
    q = ((y - y.mean()) ** 2).sum() / 0.02
    assert got["moves"].q == pytest.approx(q) and got["moves"].varies
    assert got["short"].q_value is None and got["short"].p_value < 0.05 and not got["short"].varies


# ---- sites


def plain_pooled(counts):
    y, v = [], []
    for n1, k1, n0, k0 in counts:
        if n1 + n0 >= patterns.MIN_TOTAL and n1 >= patterns.MIN_BRANCH and n0 >= patterns.MIN_BRANCH:
            y.append(math.log((k1 + 0.5) / (n1 + 1) / ((k0 + 0.5) / (n0 + 1))))
            v.append(1 / (k1 + 0.5) - 1 / (n1 + 1) + 1 / (k0 + 0.5) - 1 / (n0 + 1))
    if len(y) < 2:
        return math.nan
    w = [1 / x for x in v]
    mean = sum(a * b for a, b in zip(w, y)) / sum(w)
    q = sum(a * (b - mean) ** 2 for a, b in zip(w, y))
    tau2 = max(0, (q - (len(y) - 1)) / (sum(w) - sum(a * a for a in w) / sum(w)))
    w = [1 / (x + tau2) for x in v]
    return sum(a * b for a, b in zip(w, y)) / sum(w)


def test_random_effects_of_draws_equal_one_by_one():
    generator = np.random.default_rng(1)
    n = generator.integers(0, 60, (300, 4, 2))
    k = generator.integers(0, n + 1)
    counts = np.stack([n[..., 0], k[..., 0], n[..., 1], k[..., 1]], -1)
    got = resampling.pooled_draws(counts)
    want = np.array([plain_pooled(c) for c in counts])
    assert np.isnan(want).sum() > 0 and got == pytest.approx(want, nan_ok=True)


def test_between_site_permutation_agrees_with_explicit_shuffles(spark):
    counts = np.array([[40, 22, 50, 15], [30, 9, 20, 8], [12, 4, 15, 9]])
    rows = [("a", "b", f"s{k}", *map(int, c)) for k, c in enumerate(counts)] + [("a", "c", "s0", 40, 20, 40, 20)] + [("a", "d", "s0", 40, 20, 40, 20), ("a", "d", "s1", 2, 1, 40, 20)]
    df = spark.createDataFrame(rows, "upstream string, downstream string, site string, n_pos int, k_pos int, n_neg int, k_neg int")
    got = {r.downstream: r for r in resampling.between_site_permutation(df, draws=3000).collect()}
    assert got["c"].p_two_sided is None and got["d"].pooled_log_ratio is None
    now = plain_pooled(counts)
    label = np.concatenate([np.r_[np.ones(n1), np.zeros(n0)] for n1, _, n0, _ in counts])
    shown = np.concatenate([np.r_[np.ones(k1), np.zeros(n1 - k1), np.ones(k0), np.zeros(n0 - k0)] for n1, k1, n0, k0 in counts])
    borders = np.cumsum([n1 + n0 for n1, _, n0, _ in counts])[:-1]
    generator, null = np.random.default_rng(5), []
    for _ in range(3000):
        order = generator.permutation(len(label))
        null.append(plain_pooled([(a.sum(), (a * s).sum(), (1 - a).sum(), ((1 - a) * s).sum()) for a, s in zip(np.split(label[order], borders), np.split(shown[order], borders))]))
    null = np.array(null)
    assert got["b"].pooled_log_ratio == pytest.approx(now)
    assert got["b"].p_two_sided == pytest.approx((np.abs(null) >= abs(now)).mean(), abs=0.03) and got["b"].p_one_sided == pytest.approx(((null >= now) if now >= 0 else (null <= now)).mean(), abs=0.03)


def test_pairs_in_their_common_cells(spark):
    """Item b is never eligible in site q: what a and b have in common is counted in site p alone."""
    r = random.Random(3)
    rows = []
    for e in range(400):
        site = r.choice("pq")
        rows += [(site, "u", e, dt.datetime(2020, 1, 1), "s", "t", i, r.choice("RN")) for i in "abc" if r.random() < (0.02 if (site, i) == ("q", "b") else 0.5)]
    o = spark.createDataFrame(rows, KIND)
    got = {(x.upstream, x.downstream): x for x in reports.mutual_dependence(patterns.branch_counts(o, o, 20, mutual=True), "R", "N").collect()}
    sets = {(i, site): {x[2]: x[7] for x in rows if x[6] == i and x[0] == site} for i in "abc" for site in "pq"}
    for a, b, sites in (("a", "b", "p"), ("b", "a", "p"), ("a", "c", "pq")):
        mine = {e: o for s in sites for e, o in sets[a, s].items()}
        other = {e: o for s in sites for e, o in sets[b, s].items()}
        ratio = lambda x, y: ((sum(e in y for e, o in x.items() if o == "R") + 0.5) / (sum(o == "R" for o in x.values()) + 1)) / ((sum(e in y for e, o in x.items() if o == "N") + 0.5) / (sum(o == "N" for o in x.values()) + 1))
        g = got[a, b]
        assert (g.ratio, g.reverse_ratio, g.asymmetry) == pytest.approx((ratio(mine, other), ratio(other, mine), math.log(ratio(mine, other)) - math.log(ratio(other, mine))))
        assert g.overlap == pytest.approx(len(mine.keys() & other.keys()) / len(mine.keys() | other.keys())) and g.support_ratio == pytest.approx(min(len(mine), len(other)) / max(len(mine), len(other)))


def test_canonical_edges_keep_both_directions(spark):
    edges = spark.createDataFrame([("a", "b", 10, 2.0), ("b", "a", 20, 0.5), ("a2", "b", 30, 3.0), ("a", "b2", 30, 4.0), ("c", "b", None, 1.0)], "upstream string, downstream string, n int, ratio double")
    names = spark.createDataFrame([("a2", "a"), ("b2", "b")], "item string, canonical string")
    got = {(r.upstream, r.downstream): (r.ratio, r.collapsed) for r in reports.canonical(edges, F.col("n"), names).select(*PAIR, "ratio", "collapsed").collect()}
    assert got == {("a", "b"): (4.0, 2), ("b", "a"): (0.5, 0), ("c", "b"): (1.0, 0)}
    with pytest.raises(ValueError):
        reports.canonical(edges, F.col("n"), names.unionByName(names))


# ---- histories


def test_look_back_counts_a_keys_records_so_far(spark):
    r = random.Random(4)
    day = lambda k: None if k is None else dt.datetime(2020, 1, 1) + dt.timedelta(days=k, hours=r.randrange(24))
    index = [(k, r.choice(["u", "v", "w", None]), r.choice([None, *range(30)])) for k in range(60)]
    records = [(r.choice(["u", "v", None]), r.choice([None, *range(-5, 30)]), r.choice(["x", "y", "z", None])) for _ in range(120)]
    got = history.look_back(
        spark.createDataFrame([(i, k, day(d)) for i, k, d in index], "index_id int, k string, at timestamp"), spark.createDataFrame([(k, day(d), v) for k, d, v in records], "k string, at timestamp, v string"), "k", "at", "at", "v", (0, 7)
    )
    got = {x.index_id: (x.records, x.distinct_values, x.least_days, x.any_0d, x.any_7d, x.available) for x in got.collect()}
    for i, k, d in index:
        mine = [(d - e, v) for key, e, v in records if None not in (k, d, e) and key == k and d - e >= 0]
        want = (len(mine), len({v for _, v in mine if v}), min((x for x, _ in mine), default=None), int(any(x <= 0 for x, _ in mine)), int(any(x <= 7 for x, _ in mine)), int(bool(mine)))
        assert got[i] == want


def test_a_range_join_makes_rows_in_proportion_to_matches(spark):
    """One user with a long history: what the join makes before its exact check is bounded by the window, not by the history."""
    n = 200_000
    start = dt.datetime(2020, 1, 1)
    records = spark.range(n).select(F.lit("hot").alias("user"), (F.lit(start) + F.make_interval(mins=F.col("id").cast("int") * 10)).alias("ts"), F.col("id").alias("value"))
    index = spark.createDataFrame([(k, "hot", start + dt.timedelta(minutes=10 * 199 * k)) for k in range(1000)] + [(5000, None, start), (5001, "hot", None)], "index_id int, user string, t timestamp")
    met = history.within(index, records, "user", "t", "ts", 3600)
    got = met.groupBy("index_id").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most")).collect()
    assert {x.index_id: (x.n, x.least, x.most) for x in got} == {k: (min(7, 199 * k + 1), max(0, 199 * k - 6), 199 * k) for k in range(1000)}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = met.groupBy().count()
        plan.collect()
        text = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "__bucket" in text and "CartesianProduct" not in text and "NestedLoop" not in text
    candidates = index.where("t is not null").withColumn("b", F.explode(F.array(*[F.floor(F.col("t").cast("double") / 3600) - k for k in (0, 1)]))).join(records.withColumn("b", F.floor(F.col("ts").cast("double") / 3600)), ["user", "b"]).count()
    assert candidates <= 2 * 7 * 1000  # 200 million pairs of the user's rows


def test_histories_at_a_time_equal_plain_ones(spark):
    r = random.Random(6)
    day = lambda k: None if k is None else dt.datetime(2020, 1, 1) + dt.timedelta(days=k, hours=r.randrange(24))
    index = [(k, r.choice(["u", "v", "w", None]), r.choice([None, *range(20)]), "z") for k in range(50)]
    index += index[:3]
    records = [(r.choice(["u", "v", None]), r.choice([None, *range(-5, 25)]), r.choice(["x", "y", None, "z"])) for _ in range(90)]
    left = spark.createDataFrame([(i, k, day(d), z) for i, k, d, z in index], "id int, k string, t timestamp, v string").repartition(3)
    right = spark.createDataFrame([(k, day(d), v) for k, d, v in records], "key string, at timestamp, v string").repartition(3)
    H = history.History
    of = [
        H("a", right, "key", "at", windows=(0, 7)), H("b", right, "key", "at", windows=(3,), strict=True), H("c", right, "key", "at", "count", "v"), H("f", right, "key", "at", "first", "v"),
        H("w", right, "key", "at", "worst", "v", order=("y", "x")), H("s", right, "key", "at", "suppressed"),
    ]
    got = history.point_in_time(left, "k", "t", of)
    want = []
    for i, k, d, z in index:
        mine = [(d - e, v) for key, e, v in records if None not in (k, d, e) and key == k]
        past = [(x, v) for x, v in mine if x >= 0]
        flag = lambda w, low: int(any(low <= x <= w for x, _ in mine))
        values = {v for _, v in past if v}
        first = min(((-x, v) for x, v in mine if v), default=(None, None))[1]
        worst = next((o for o in ("y", "x") if o in values), None)
        want.append((i, k, z, flag(0, 0), flag(7, 0), int(bool(past)), flag(3, 1), flag(9999, 1), len(past), len(values), int(bool(past)), first, int(first is not None), worst, int(worst is not None), None, 0))
    assert sorted(map(repr, map(tuple, got.drop("t").collect()))) == sorted(map(repr, want))
    assert history.point_in_time(left.limit(0), "k", "t", of).count() == 0
    with pytest.raises(ValueError, match="columns of these names"):
        history.point_in_time(left.withColumn("f", F.lit(1)), "k", "t", of)
    with pytest.raises(ValueError, match="unknown kind"):
        history.point_in_time(left, "k", "t", [H("q", right, "key", "at", "median")])


def test_histories_take_one_grouping_and_one_window(spark):
    left = spark.createDataFrame([(1, "u", dt.datetime(2020, 1, 1))], "id int, k string, t timestamp")
    many = [history.History(f"h{k}", left, "k", "t", windows=(7,)) for k in range(8)]
    text = history.point_in_time(left, "k", "t", many)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Join ") == 1 and text.count("Window [") <= 2


def test_thirds_broadcast_eligible_items_and_not_the_counts_by_day(spark, monkeypatch):
    observations = [("p", "u", e, dt.datetime(2020, 1, 1) + dt.timedelta(days=e % 40), "s", "t", item, "RN"[(e + k) % 2]) for e in range(200) for k, item in enumerate("ab")]
    o = spark.createDataFrame(observations, KIND)
    eligible = spark.createDataFrame([("p", "s", "t", "a"), ("p", "s", "t", "b")], CELL_KIND)
    pairs = spark.createDataFrame([("a", "b"), ("b", "a")], "upstream string, downstream string")
    hinted, keep = {}, replication.written
    monkeypatch.setattr(replication, "written", lambda df, name: (hinted.__setitem__(name, df), keep(df, name))[1])
    out = replication.temporal_thirds(o, eligible, pairs, "R", "N")
    # both joins to the counts by day have a side that a count found to be small; Spark has no choice left
    joins = [x for x in hinted["days"]._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]
    assert len(joins) == 3 and all("rightHint=(strategy=broadcast)" in x for x in joins), joins
    assert out.count() == 4


def test_a_side_that_is_not_small_is_merged(spark):
    from opportune.sources.tables import small

    left, right = spark.range(50).withColumn("x", F.lit("x")), spark.range(50)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan(left.join(small(right, 10), "id"))
    assert "BroadcastHashJoin" in plan(left.join(small(right), "id"))
