"""Order over ranges: quantiles, running sums and thinned curves are the same however the ranges fall."""

import random

import numpy as np
import pytest

from opportune.operators import evaluation, ranges, reports


@pytest.fixture(params=[500_000, 20, 3])
def range_rows(request, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE_ROWS", request.param)
    return request.param


def test_quantiles_equal_plain_ones(spark, range_rows):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), r.choice([None, 5.0, 5.0, r.random(), 1e6 + r.random() / 1e3, -r.random() * 1e-9])) for _ in range(400)] + [("empty", None), ("one", 3.0), ("inf", float("inf")), ("inf", 1.0), ("inf", 2.0)]
    got = ranges.quantiles(spark.createDataFrame(rows, "g string, v double").repartition(3), "v", ["g"], {"q10": 0.1, "median": 0.5, "q90": 0.9, "most": 1.0})
    got = {x.g: x for x in got.collect()}
    assert set(got) == {"a", "b", None, "empty", "one", "inf"}
    for g in ("a", "b", None, "one"):
        v = [x for k, x in rows if k == g and x is not None]
        assert got[g].n == len(v) and got[g].mean == pytest.approx(np.mean(v))
        assert (got[g].q10, got[g].median, got[g].q90, got[g].most) == pytest.approx(tuple(np.percentile(v, [10, 50, 90, 100])), rel=1e-12)
    assert (got["empty"].n, got["empty"].median, got["empty"].mean) == (0, None, None) and got["inf"].median == 2.0
    assert ranges.quantiles(spark.createDataFrame([], "g string, v double"), "v", ["g"], {"m": 0.5}).count() == 0


def test_running_sums_of_crowded_scores(spark, range_rows):
    generator = np.random.default_rng(4)
    scores = np.r_[0.5 + generator.random(250) * 1e-7, generator.random(30), [0.0, 1.0, 1.0, -2.0, 7.0]]
    rows = [(str(generator.choice(list("ab"))), int(generator.random() < 0.3), float(s)) for s in scores]
    got = evaluation.score_counts(spark.createDataFrame(rows, "m string, t int, s double"), "t", "s", ["m"]).collect()
    assert len(got) == len({(m, s) for m, _, s in rows})
    for r in got:
        mine = [x for x in rows if x[0] == r.m]
        assert (r.tp, r.fp) == (sum(t for _, t, s in mine if s >= r.s), sum(1 - t for _, t, s in mine if s >= r.s)) and (r.pos, r.neg) == (sum(t for _, t, _ in mine), sum(1 - t for _, t, _ in mine))


def plain_thinned(curve, points):
    curve = sorted(curve)
    if len(curve) <= points:
        return curve
    x, y = np.array([c[1] for c in curve]), np.array([c[2] for c in curve])
    length = np.r_[0.0, np.cumsum(np.hypot(np.diff(x), np.diff(y)))]
    keep = np.unique(np.r_[0, len(x) - 1, np.searchsorted(length, np.linspace(0, length[-1], points)).clip(0, len(x) - 1)])
    return [curve[k] for k in keep]


@pytest.mark.parametrize("points", [2, 10, 50])
def test_thinned_curves_keep_evenly_spaced_points(spark, range_rows, points):
    generator = np.random.default_rng(2)
    rows = []
    for name, n in (("short", 8), ("long", 300), ("steps", 120)):
        x = np.sort(generator.random(n)) if name != "steps" else np.repeat(np.sort(generator.random(n // 4)), 4)
        rows += [(name, k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, np.cumsum(generator.random(n) ** 8)))]
    rows += [("flat", k, 1.0, 1.0) for k in range(60)]
    got = reports.thinned(spark.createDataFrame(rows, "name string, k int, x double, y double").repartition(3), ["name"], "k", "x", "y", points).collect()
    for name in ("short", "long", "steps"):
        assert sorted((r.k, r.x, r.y) for r in got if r.name == name) == plain_thinned([r[1:] for r in rows if r[0] == name], points)
    flat = sorted(r.k for r in got if r.name == "flat")
    assert flat[0] == 0 and flat[-1] == 59 and (len(flat) == 2 or points >= 60)
