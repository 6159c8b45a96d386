"""SQL for DuckDB that gives the registered queries' results from the same tables, written straight from their definitions:
where the operators count cells, this forms the whole episode x item grid."""

from __future__ import annotations

from .roles import CATEGORIES, INTRINSIC, MIN_SUPPORT

ORACLE: dict[str, str] = {}

RAW = """raw AS (
  SELECT r_name AS site, o_custkey AS unit, o_orderkey AS episode, o_orderdate AS time, c_mktsegment AS stratum, p_brand AS item, l_returnflag AS outcome,
         (year(o_orderdate) // 5 * 5)::VARCHAR || '-' || (year(o_orderdate) // 5 * 5 + 4)::VARCHAR AS era
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey)"""
OBS = RAW + """, obs AS (
  SELECT site, unit, episode, time, stratum, era, item, min(outcome) AS outcome FROM raw GROUP BY ALL HAVING count(DISTINCT outcome) = 1)"""
INTR = "intr(stratum, item) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in INTRINSIC) + ")"
AVAIL = OBS + f""", {INTR}, avail AS (
  SELECT site, stratum, era, item, count(DISTINCT episode) AS support, count(DISTINCT episode) >= {MIN_SUPPORT} AS is_available,
         (stratum, item) IN (SELECT (stratum, item) FROM intr) AS is_intrinsic FROM raw GROUP BY ALL)"""
GRID = AVAIL + """, episodes AS (SELECT DISTINCT site, unit, episode, time, stratum, era FROM raw), items AS (SELECT DISTINCT item FROM raw),
grid AS (
  SELECT e.*, i.item, coalesce(a.is_available, false) AS is_available, (e.stratum, i.item) IN (SELECT (stratum, item) FROM intr) AS is_intrinsic
  FROM episodes e CROSS JOIN items i LEFT JOIN avail a ON a.site = e.site AND a.stratum = e.stratum AND a.era = e.era AND a.item = i.item)"""


def counts(by: str = "") -> str:
    """Branch counts from the grid's rows; by: further grouping columns of the upstream row, with a comma before."""
    cols = by.replace("year", "year(u.time) AS year").replace("site", "u.site").replace("stratum", "u.stratum")
    return GRID + f""", counts AS (
  SELECT u.item AS upstream, g.item AS downstream, u.outcome{cols}, count(*) AS support_n, count(o.episode) AS tested_n
  FROM obs u JOIN grid g ON g.episode = u.episode AND g.item <> u.item AND g.is_available AND NOT g.is_intrinsic
  LEFT JOIN obs o ON o.episode = g.episode AND o.item = g.item GROUP BY ALL)"""


def edges(by: str = "") -> str:
    return counts(by) + f""", wide AS (
  SELECT upstream, downstream{by}, coalesce(sum(support_n) FILTER (outcome = 'R'), 0)::BIGINT AS n_pos, coalesce(sum(tested_n) FILTER (outcome = 'R'), 0)::BIGINT AS k_pos,
         coalesce(sum(support_n) FILTER (outcome = 'N'), 0)::BIGINT AS n_neg, coalesce(sum(tested_n) FILTER (outcome = 'N'), 0)::BIGINT AS k_neg
  FROM counts WHERE outcome IN ('R', 'N') GROUP BY ALL),
edge0 AS (SELECT *, ((k_pos + 0.5) / (n_pos + 1)) / ((k_neg + 0.5) / (n_neg + 1)) AS ratio,
         1 / (k_pos + 0.5) - 1 / (n_pos + 1.0) + 1 / (k_neg + 0.5) - 1 / (n_neg + 1.0) AS log_variance FROM wide WHERE n_pos > 0 AND n_neg > 0),
edges AS (SELECT *, exp(ln(ratio) - 1.96 * sqrt(log_variance)) AS ci_low, exp(ln(ratio) + 1.96 * sqrt(log_variance)) AS ci_high,
         n_pos + n_neg >= 25 AND n_pos >= 5 AND n_neg >= 5 AS passes_support, k_pos + k_neg >= 5 AS has_events FROM edge0)"""


RET = edges() + ", ret AS (SELECT *, CASE WHEN ratio > 1 THEN 'escalation' WHEN ratio > 0 AND ratio < 1 THEN 'suppression' END AS direction FROM edges WHERE passes_support AND has_events)"
REV = ", rev AS (SELECT e.*, b.ratio AS reverse_ratio, ln(e.ratio) - ln(b.ratio) AS asymmetry FROM {0} e LEFT JOIN {0} b ON b.upstream = e.downstream AND b.downstream = e.upstream)"
PATHS = RET + """, up AS (SELECT *, n_pos + n_neg AS support FROM ret WHERE ratio > 1),
paths AS (SELECT x.upstream AS a, x.downstream AS b, y.downstream AS c, x.ratio * y.ratio AS path_ratio, least(x.support, y.support) AS min_support
  FROM up x JOIN up y ON x.downstream = y.upstream AND x.upstream <> y.downstream),
top AS (SELECT *, row_number() OVER (ORDER BY path_ratio DESC, min_support DESC, a, b, c) AS path_rank FROM paths QUALIFY path_rank <= 50)"""
EDGE = "upstream, downstream, n_pos, k_pos, n_neg, k_neg, round(ratio, 6) AS ratio, round(log_variance, 6) AS log_variance, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, passes_support, has_events"
POOL = edges(", site") + """, rows AS (SELECT upstream, downstream, site, ln(ratio) AS y, log_variance AS v, 1 / log_variance AS w FROM edges WHERE passes_support),
f AS (SELECT upstream, downstream, count(*) AS sites, sum(w) AS sw, sum(w * w) AS sw2, sum(w * y) AS swy, sum(w * y * y) AS swy2, count(*) FILTER (y > 0) AS sites_above FROM rows GROUP BY ALL HAVING count(*) >= 2),
g AS (SELECT *, greatest(0, swy2 - swy * swy / sw) AS q FROM f), h AS (SELECT *, greatest(0, (q - (sites - 1)) / (sw - sw2 / sw)) AS tau2, CASE WHEN q > 0 THEN greatest(0, (q - (sites - 1)) / q) * 100 ELSE 0 END AS i2 FROM g),
pool AS (SELECT upstream, downstream, sites, sites_above, q, tau2, i2, sum(y / (v + tau2)) / sum(1 / (v + tau2)) AS pooled_log_ratio, sqrt(1 / sum(1 / (v + tau2))) AS pooled_se
  FROM rows JOIN h USING (upstream, downstream) GROUP BY ALL),
tail AS (SELECT *, pooled_log_ratio / pooled_se AS z, 1 / (1 + 0.3275911 * abs(pooled_log_ratio / pooled_se) / sqrt(2)) AS t FROM pool),
pv AS (SELECT *, t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-z * z / 2) AS p_value FROM tail),
rk AS (SELECT *, row_number() OVER (ORDER BY p_value, upstream, downstream) AS r, count(*) OVER () AS m FROM pv),
fdr AS (SELECT *, least(1, min(p_value * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q_value FROM rk)"""
STRATA = counts(", site") + """, st AS (SELECT upstream, downstream, site, coalesce(sum(support_n) FILTER (outcome = 'R'), 0) AS n_pos, coalesce(sum(support_n) FILTER (outcome = 'N'), 0) AS n_neg
  FROM counts GROUP BY ALL)"""
THIRDS = """, prow AS (SELECT u.item AS upstream, g.item AS downstream, u.outcome = 'R' AS pos, o.episode IS NOT NULL AS shown, row_number() OVER (PARTITION BY u.item, g.item ORDER BY u.time, u.episode) AS r,
    count(*) OVER (PARTITION BY u.item, g.item) AS n, min(u.time) OVER (PARTITION BY u.item, g.item) < max(u.time) OVER (PARTITION BY u.item, g.item) AS moves
  FROM obs u JOIN grid g ON g.episode = u.episode AND g.item <> u.item AND g.is_available AND NOT g.is_intrinsic LEFT JOIN obs o ON o.episode = g.episode AND o.item = g.item
  WHERE u.outcome IN ('R', 'N') AND u.time IS NOT NULL),
part AS (SELECT *, CASE WHEN r <= n // 3 THEN 'early' WHEN r > n - n // 3 THEN 'late' END AS third FROM prow WHERE n >= 15 AND moves),
thirds AS (SELECT upstream, downstream, third, count(*) FILTER (pos) AS n_pos, count(*) FILTER (pos AND shown) AS k_pos, count(*) FILTER (NOT pos) AS n_neg, count(*) FILTER (NOT pos AND shown) AS k_neg
  FROM part JOIN (SELECT DISTINCT upstream, downstream FROM edges) USING (upstream, downstream) WHERE third IS NOT NULL GROUP BY ALL)"""


def chi_square_tail(q: str, degrees: str) -> str:
    """Probability of a chi-square value of at least q, from the series of the lower incomplete gamma function."""
    return f"""CASE WHEN {q} = 0 THEN 1 ELSE greatest(0, 1 - list_sum(list_transform(range(0, 300), lambda n: exp(-{q} / 2 + ({degrees} / 2 + n) * ln({q} / 2) - lgamma({degrees} / 2 + n + 1))))) END"""


LABELS = POOL + """, total AS (SELECT upstream, downstream, sum(n_pos) AS n1, sum(k_pos) AS k1, sum(n_neg) AS n0, sum(k_neg) AS k0 FROM wide GROUP BY ALL),
kept AS (SELECT upstream, downstream, ((k1 + 0.5) / (n1 + 1)) / ((k0 + 0.5) / (n0 + 1)) AS ratio, 1 / (k1 + 0.5) - 1 / (n1 + 1) + 1 / (k0 + 0.5) - 1 / (n0 + 1) AS lv FROM total WHERE n1 + n0 >= 25 AND n1 >= 5 AND n0 >= 5 AND k1 + k0 >= 5)""" + THIRDS + """,
gated AS (SELECT upstream, downstream, third, sign(ln(((k_pos + 0.5) / (n_pos + 1)) / ((k_neg + 0.5) / (n_neg + 1)))) AS side FROM thirds WHERE n_pos + n_neg >= 25 AND n_pos >= 5 AND n_neg >= 5),
time AS (SELECT upstream, downstream, max(side) FILTER (third = 'early') AS early, max(side) FILTER (third = 'late') AS late FROM gated GROUP BY ALL),
joined AS (SELECT k.*, sign(ln(k.ratio)) AS side, v.p_value, v.sites, v.i2, CASE WHEN sign(v.z) = sign(ln(k.ratio)) THEN v.z END AS z, greatest(v.sites_above, v.sites - v.sites_above) / v.sites AS agreement, t.early, t.late
  FROM kept k LEFT JOIN pv v USING (upstream, downstream) LEFT JOIN time t USING (upstream, downstream)),
ordered AS (SELECT *, 1 / (1 + 0.3275911 * abs(ln(ratio)) / sqrt(2 * lv)) AS ft, row_number() OVER (ORDER BY p_value NULLS LAST, upstream, downstream) AS rn, count(p_value) OVER () AS cnt FROM joined),
q AS (SELECT *, CASE WHEN p_value IS NOT NULL THEN least(1, min(p_value * cnt / rn) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS qv FROM ordered),
met AS (SELECT *, coalesce(qv <= 0.05, false) AS a, coalesce(sites >= 2 AND CASE WHEN i2 IS NOT NULL THEN i2 <= 50 AND abs(z) >= 1.96 ELSE agreement >= 0.67 END, false) AS b, coalesce(early = late AND early = side AND side <> 0, false) AS c,
  1 - ft * (0.254829592 + ft * (-0.284496736 + ft * (1.421413741 + ft * (-1.453152027 + ft * 1.061405429)))) * exp(-ln(ratio) * ln(ratio) / (2 * lv)) / 2 >= 0.8 AS st FROM q),
labelled AS (SELECT *, CASE WHEN a AND st AND (b OR c) THEN 'robust' WHEN a AND st THEN 'supported' WHEN a OR st OR b OR c THEN 'mixed' ELSE 'insufficient' END AS validation_status FROM met)"""
CELLS = GRID + """, cells AS (SELECT g.site, g.stratum, g.era, g.item, count(*) AS eligible, count(o.episode) AS evaluable, count(*) FILTER (o.outcome = 'R') AS positive
  FROM grid g LEFT JOIN obs o ON o.episode = g.episode AND o.item = g.item WHERE g.is_available AND NOT g.is_intrinsic GROUP BY ALL),
prev AS (SELECT item, sum(eligible)::BIGINT AS eligible, sum(evaluable)::BIGINT AS evaluable, sum(positive)::BIGINT AS positive,
  sum(eligible * (positive / nullif(evaluable, 0))) / sum(eligible) FILTER (evaluable > 0) AS standardised FROM cells GROUP BY item HAVING sum(eligible) >= 200 AND sum(evaluable) >= 30),
prevalence AS (SELECT *, positive / evaluable AS naive, positive / eligible AS lower, (positive + eligible - evaluable) / eligible AS upper, standardised - positive / evaluable AS shift FROM prev)"""


def tilt(values: list[float]) -> str:
    v = ", ".join(f"({x}::DOUBLE)" for x in values)
    return CELLS + f""", tilts(tilt) AS (VALUES {v}), odds AS (SELECT *, greatest(1e-6, least(1 - 1e-6, standardised)) AS p FROM prevalence CROSS JOIN tilts),
tilted AS (SELECT item, tilt, (positive + (p / (1 - p) * exp(-tilt)) / (1 + p / (1 - p) * exp(-tilt)) * (eligible - evaluable)) / eligible AS prevalence FROM odds)"""


SCORED = """scored AS (SELECT o_orderstatus AS model, CASE WHEN o_totalprice + (o_orderkey % 1000) * 300 > 400000 THEN 1 ELSE 0 END AS target,
  round(least(1.0, o_totalprice / 500000), 2) AS score, o_orderdate AS time, o_custkey AS unit FROM orders)"""
SWEEP = SCORED + """, th AS (SELECT k / 20 AS threshold FROM range(1, 20) AS t(k)),
c AS (SELECT model, threshold, count(*) FILTER (target = 1) AS pos, count(*) FILTER (target = 0) AS neg, avg((score - target) * (score - target)) AS brier,
  count(*) FILTER (target = 1 AND score >= threshold) AS tp, count(*) FILTER (target = 0 AND score >= threshold) AS fp FROM scored CROSS JOIN th GROUP BY ALL),
c2 AS (SELECT *, pos - tp AS fn, neg - fp AS tn FROM c),
c3 AS (SELECT *, coalesce((tp + tn) / nullif(pos + neg, 0), 0) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(tn / nullif(tn + fp, 0), 0) AS specificity FROM c2),
sweep AS (SELECT model, pos, neg, brier, threshold, tp, fp, fn, tn, accuracy, (recall + specificity) / 2 AS balanced_accuracy, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1,
  coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc FROM c3)"""
TEMPORAL = SCORED + ", split AS (SELECT *, CASE WHEN year(time) <= 1997 THEN 'train' WHEN year(time) <= 1999 THEN 'validation' ELSE 'test' END AS split FROM scored)"
CATS = "cats(item, category, step) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in CATEGORIES) + ")"

ORACLE |= {
    "escalation_edges": f"WITH {edges()} SELECT {EDGE} FROM edges",
    "site_edges": f"WITH {edges(', site')} SELECT site, {EDGE} FROM edges",
    "conditional_probabilities": f"WITH {counts()} SELECT *, round(tested_n / support_n, 6) AS conditional_probability FROM counts",
    "resolved_outcomes": f"WITH {OBS} SELECT site, item, outcome, count(*) AS n FROM obs GROUP BY ALL",
    "outcome_conflicts": f"WITH {RAW}, g AS (SELECT count(*) AS n FROM raw GROUP BY episode, item HAVING count(DISTINCT outcome) > 1) SELECT count(*) AS conflict_groups, coalesce(sum(n), 0)::BIGINT AS conflict_rows FROM g",
    "availability": f"WITH {AVAIL} SELECT *, is_available AND NOT is_intrinsic AS is_eligible FROM avail",
    "opportunity_states": f"""WITH {GRID}, seen AS (SELECT DISTINCT episode, item FROM raw)
SELECT g.site, g.era, CASE WHEN is_intrinsic THEN 'intrinsic' WHEN NOT is_available THEN 'unavailable' WHEN s.item IS NOT NULL THEN 'eligible_observed' ELSE 'eligible_unobserved' END AS state,
count(*) AS n, count(s.item) AS observed FROM grid g LEFT JOIN seen s ON s.episode = g.episode AND s.item = g.item GROUP BY ALL""",
    "opportunity_summary": f"""WITH {GRID}, seen AS (SELECT DISTINCT episode, item FROM raw), x AS (SELECT g.*, s.item IS NOT NULL AS seen FROM grid g LEFT JOIN seen s ON s.episode = g.episode AND s.item = g.item)
SELECT coalesce(site, 'all_sites') AS site, count(DISTINCT episode) AS episodes, count(*) AS grid_rows, count(*) FILTER (is_available AND NOT is_intrinsic) AS eligible_rows,
count(*) FILTER (is_available AND NOT is_intrinsic AND seen) AS observed_rows, round(count(*) FILTER (is_available AND NOT is_intrinsic AND seen) / count(*) FILTER (is_available AND NOT is_intrinsic), 6) AS observed_share
FROM x GROUP BY GROUPING SETS ((site), ())""",
    "testing_matrix": f"WITH {OBS} SELECT episode, " + ", ".join(f"max((item = 'Brand#{k}')::INT) AS tested__brand_{k}" for k in range(1, 26)) + " FROM obs GROUP BY episode",
    "edges_ranked": f"""WITH {RET}{REV.format('ret')} SELECT upstream, downstream, round(ratio, 6) AS ratio, round(reverse_ratio, 6) AS reverse_ratio, round(asymmetry, 6) AS asymmetry, direction,
dense_rank() OVER (ORDER BY ratio DESC NULLS LAST) AS ratio_rank, dense_rank() OVER (ORDER BY asymmetry DESC NULLS LAST) AS asymmetry_rank FROM rev""",
    "edges_e_values": f"""WITH {edges()}, b AS (SELECT upstream, downstream, CASE WHEN ratio >= 1 THEN ratio ELSE 1 / ratio END AS r, CASE WHEN ratio >= 1 THEN greatest(1.0, ci_low) ELSE 1 / least(1.0, ci_high) END AS s FROM edges)
SELECT upstream, downstream, round(r + sqrt(r * (r - 1)), 6) AS e_value, round(s + sqrt(s * (s - 1)), 6) AS e_value_bound FROM b""",
    "asymmetry_bins": f"""WITH {edges()}{REV.format('edges')}, k AS (SELECT *, row_number() OVER (ORDER BY abs(asymmetry), upstream, downstream) AS r, count(*) OVER () AS n FROM rev WHERE asymmetry IS NOT NULL),
b AS (SELECT *, CASE WHEN n < 3 THEN 'undifferentiated' WHEN r <= 1 + (n - 1) / 3 THEN 'low' WHEN r <= 1 + (n - 1) * 2 / 3 THEN 'middle' ELSE 'high' END AS asymmetry_bin FROM k)
SELECT asymmetry_bin, count(*) AS edges, round(avg(abs(asymmetry)), 6) AS mean_asymmetry, round(median(ratio), 6) AS median_ratio FROM b GROUP BY ALL""",
    "top_paths": f"WITH {PATHS} SELECT a, b, c, round(path_ratio, 6) AS path_ratio, min_support, path_rank::INT AS path_rank FROM top",
    "path_flows": f"WITH {PATHS}, s AS (SELECT 1 AS stage, a AS source, b AS target, min_support FROM top UNION ALL SELECT 2, b, c, min_support FROM top) SELECT stage, source, target, count(*) AS paths, sum(min_support)::BIGINT AS flow FROM s GROUP BY ALL",
    "edges_site_comparison": f"""WITH {edges(', site')}, u AS (SELECT upstream, downstream, site, ratio FROM edges WHERE passes_support AND ratio > 1), s AS (SELECT DISTINCT r_name AS site FROM region),
two AS (SELECT a.site AS first, b.site AS second FROM s a JOIN s b ON a.site < b.site), keys AS (SELECT DISTINCT upstream, downstream, first, second FROM u JOIN two ON u.site IN (first, second))
SELECT k.upstream, k.downstream, first, second, round(x.ratio, 6) AS ratio_first, round(y.ratio, 6) AS ratio_second, CASE WHEN y.ratio IS NULL THEN 'first_only' WHEN x.ratio IS NULL THEN 'second_only' ELSE 'shared' END AS presence,
  round(ln(x.ratio) - ln(y.ratio), 6) AS log_difference
FROM keys k LEFT JOIN u x ON x.upstream = k.upstream AND x.downstream = k.downstream AND x.site = first LEFT JOIN u y ON y.upstream = k.upstream AND y.downstream = k.downstream AND y.site = second""",
    "edge_threshold_grid": f"""WITH {edges()}, a(min_total) AS (VALUES (25), (500), (1500), (2500)), b(min_branch) AS (VALUES (5), (700), (900)), c(min_events) AS (VALUES (5), (200), (300))
SELECT min_total, min_branch, min_events, count(*) FILTER (ok) AS edges, round(coalesce(avg(ratio) FILTER (ok), 0), 6) AS mean_ratio
FROM (SELECT *, n_pos + n_neg >= min_total AND n_pos >= min_branch AND n_neg >= min_branch AND k_pos + k_neg >= min_events AS ok FROM edges CROSS JOIN a CROSS JOIN b CROSS JOIN c) GROUP BY ALL""",
    "bundled_pairs": f"""WITH {counts().replace(" AND NOT g.is_intrinsic", "")}, rate AS (SELECT upstream, downstream, sum(tested_n) / sum(support_n) AS p, sum(support_n)::BIGINT AS n FROM counts GROUP BY ALL)
SELECT x.upstream, x.downstream, round(x.p, 6) AS p, x.n, round(y.p, 6) AS p_back, y.n AS n_back, coalesce(x.p >= 0.15 AND y.p >= 0.15 AND x.n >= 25 AND y.n >= 25, false) AS is_bundled
FROM rate x LEFT JOIN rate y ON y.upstream = x.downstream AND y.downstream = x.upstream""",
    "pair_funnel": f"""WITH {edges()} SELECT (SELECT count(DISTINCT (upstream, downstream)) FROM counts WHERE outcome IN ('R', 'N')) AS any_branch, count(*) AS both_branches, count(*) FILTER (passes_support) AS support, count(*) FILTER (passes_support AND has_events) AS events FROM edges""",
    "smoothing_sensitivity": f"WITH {edges()} SELECT upstream, downstream, " + ", ".join(f"round(((k_pos + {v}) / (n_pos + {2 * v})) / ((k_neg + {v}) / (n_neg + {2 * v})), 6) AS ratio_{str(v).replace('.', '_')}" for v in (0.1, 0.5, 1.0)) + " FROM edges",
    "node_degrees": f"""WITH {edges()}, e AS (SELECT upstream AS node, 1 AS o, 0 AS i, abs(log2(ratio)) AS w FROM edges WHERE ratio > 1.1 UNION ALL SELECT downstream, 0, 1, abs(log2(ratio)) FROM edges WHERE ratio > 1.1)
SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, round(sum(w * o), 6) AS out_weight, round(sum(w * i), 6) AS in_weight FROM e GROUP BY ALL""",
    "panel_sizes": f"""WITH {OBS}, n AS (SELECT episode, count(*) - 1 AS others FROM obs GROUP BY episode)
SELECT item AS upstream, round(avg(others), 6) AS mean_panel, round(median(others), 6) AS median_panel, round(quantile_cont(others, 0.9), 6) AS q90_panel, round(avg((others >= 2)::INT), 6) AS share_two_more FROM obs JOIN n USING (episode) GROUP BY item""",
    "item_overlap": f"""WITH {OBS}, n AS (SELECT item, count(*) AS n FROM obs GROUP BY item), b AS (SELECT x.item AS a, y.item AS b, count(*) AS shared FROM obs x JOIN obs y ON x.episode = y.episode AND x.item < y.item GROUP BY ALL)
SELECT a, b, shared, round(shared / (x.n + y.n - shared), 6) AS jaccard FROM b JOIN n x ON x.item = a JOIN n y ON y.item = b""",
    "pair_bundling": f"""WITH {counts()}, rate AS (SELECT upstream, downstream, sum(tested_n) AS k, sum(support_n) AS n FROM counts GROUP BY ALL)
SELECT x.upstream, x.downstream, round(abs(ln((x.k + 0.5) / (x.n + 1)) - ln((y.k + 0.5) / (y.n + 1))), 6) AS timing_asymmetry, round(least(x.k / x.n, y.k / y.n), 6) AS bundling, round(least(x.n, y.n) / greatest(x.n, y.n), 6) AS support_ratio
FROM rate x JOIN rate y ON y.upstream = x.downstream AND y.downstream = x.upstream WHERE x.upstream < x.downstream""",
    "display_edges": f"WITH {edges()} SELECT upstream, downstream, round(log2(ratio), 6) AS log2_ratio FROM edges WHERE abs(log2(ratio)) >= log2(1.2) - 1e-12",
    "downstream_triggers": f"WITH {edges()} SELECT downstream, count(DISTINCT upstream) FILTER (ratio > 1) AS escalating, count(DISTINCT upstream) FILTER (ratio < 1) AS suppressing, round(max(ratio), 6) AS largest FROM edges GROUP BY ALL",
    "category_transitions": f"""WITH {edges()}, {CATS} SELECT u.category AS from_category, d.category AS to_category, d.step - u.step AS step, count(*) AS edges, round(sum((n_pos + n_neg) * ratio) / sum(n_pos + n_neg), 6) AS weighted_ratio,
sum(n_pos + n_neg)::BIGINT AS support, round(sum(n_pos + n_neg) / sum(sum(n_pos + n_neg)) OVER (), 6) AS support_share FROM edges LEFT JOIN cats u ON u.item = upstream LEFT JOIN cats d ON d.item = downstream GROUP BY 1, 2, 3""",
    "unsupported_pairs": f"WITH {edges()} SELECT DISTINCT upstream, downstream FROM counts EXCEPT SELECT upstream, downstream FROM edges WHERE ratio > 1.1",
    "symmetric_closure": f"WITH {edges()} SELECT upstream, downstream FROM edges WHERE ratio > 1.15 UNION SELECT downstream, upstream FROM edges WHERE ratio > 1.15",
    "edge_key_comparison": f"WITH {edges()} SELECT count(*) FILTER (ratio > 1 AND NOT k_pos > k_neg) AS only_left, count(*) FILTER (NOT ratio > 1 AND k_pos > k_neg) AS only_right, count(*) FILTER (ratio > 1 AND k_pos > k_neg) AS shared FROM edges",
    "pooled_edges": f"WITH {POOL} SELECT upstream, downstream, sites, sites_above, round(q, 6) AS q, round(tau2, 6) AS tau2, round(i2, 6) AS i2, round(pooled_log_ratio, 6) AS pooled_log_ratio, round(pooled_se, 6) AS pooled_se, round(z, 6) AS z, round({chi_square_tail("q", "(sites - 1)")}, 6) AS q_p_value FROM tail",
    "pooled_edges_fdr": f"WITH {POOL} SELECT upstream, downstream, round(p_value, 5) AS p_value, round(q_value, 5) AS q_value FROM fdr",
    "validation_labels": f"WITH {LABELS} SELECT validation_status, count(*) AS edges FROM labelled GROUP BY ALL",
    "temporal_thirds": f"WITH {edges()}{THIRDS} SELECT *, round(((k_pos + 0.5) / (n_pos + 1)) / ((k_neg + 0.5) / (n_neg + 1)), 6) AS ratio FROM thirds",
    "cross_site_ratios": f"WITH {edges(', site')} SELECT upstream, downstream, " + ", ".join(f"round(max(ratio) FILTER (site = '{s}'), 6) AS {s.lower().replace(' ', '_')}" for s in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")) + ", count(*) FILTER (ratio > 1)::INT AS sites_above, count(*)::INT AS sites_known FROM edges WHERE passes_support GROUP BY ALL",
    "yearly_courses": f"""WITH {edges(', year')}, s AS (SELECT *, CASE WHEN n_pos < 10 OR n_neg < 10 OR k_pos + k_neg < 10 THEN 'not_evaluable' WHEN ci_low > 1 THEN 'present' WHEN ci_high < 1 THEN 'reversed' ELSE 'absent' END AS state FROM edges),
c AS (SELECT *, coalesce((lag(state) OVER (PARTITION BY upstream, downstream ORDER BY year) <> state)::INT, 0) AS changed FROM s WHERE state <> 'not_evaluable')
SELECT upstream, downstream, count(*) AS years, count(*) FILTER (state = 'present') AS present, count(*) FILTER (state = 'reversed') AS reversed, sum(changed)::BIGINT AS changes, min(year)::INT AS first_year, max(year)::INT AS last_year FROM c GROUP BY ALL""",
    "yearly_heterogeneity": f"""WITH {edges(', year')}, h AS (SELECT upstream, downstream, count(*) AS years, sum(1 / log_variance) AS sw, sum(ln(ratio) / log_variance) AS swy, sum(ln(ratio) * ln(ratio) / log_variance) AS swy2
  FROM edges WHERE n_pos >= 10 AND n_neg >= 10 AND k_pos + k_neg >= 10 GROUP BY ALL),
cq AS (SELECT upstream, downstream, years, greatest(0, swy2 - swy * swy / sw) AS q FROM h WHERE years >= 2), tail AS (SELECT *, {chi_square_tail("q", "(years - 1)")} AS p FROM cq),
f AS (SELECT *, CASE WHEN years >= 5 THEN p END AS fp FROM tail), rk AS (SELECT *, row_number() OVER (ORDER BY fp NULLS LAST, upstream, downstream) AS r, count(fp) OVER () AS m FROM f),
bh AS (SELECT *, CASE WHEN fp IS NOT NULL THEN least(1, min(fp * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS qv FROM rk)
SELECT upstream, downstream, years, round(q, 6) AS q, round(p, 6) AS p_value, round(qv, 6) AS q_value, coalesce(qv < 0.05, false) AS varies FROM bh""",
    "permutation_strata": f"""WITH {STRATA} SELECT upstream, downstream, count(*) AS n_strata, count(*) FILTER (n_pos > 0 AND n_neg > 0) AS both_labels, coalesce(sum(n_pos + n_neg) FILTER (n_pos > 0 AND n_neg > 0), 0)::BIGINT AS permutable,
sum(n_pos + n_neg)::BIGINT AS rows, round(1 - coalesce(sum(n_pos + n_neg) FILTER (n_pos > 0 AND n_neg > 0), 0) / sum(n_pos + n_neg), 6) AS fixed_share FROM st GROUP BY ALL""",
    "clean_labels": r"""SELECT p_partkey, trim(regexp_replace(upper('  ' || p_name || ' ' || chr(9) || ' ' || p_type), '\s+', ' ', 'g')) AS label,
regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(p_brand || ' / ' || p_name), '[ /\-(),.]', '_', 'g'), '[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS safe FROM part""",
    "null_tokens": "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN 'X' WHEN 2 THEN 'NULL' ELSE upper(trim(p_name)) END AS name FROM part",
    "keep_first_rows": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey) = 1",
    "shards_coalesced": "SELECT user_id, " + ", ".join(f"round(median(value) FILTER (event_type = '{t}'), 6) AS median_{t}, arg_min(value, event_id) FILTER (event_type = '{t}') AS first_{t}, arg_max(value, event_id) FILTER (event_type = '{t}') AS last_{t}" for t in ("click", "error", "purchase")) + " FROM events GROUP BY user_id",
    "shard_conflicts": "WITH c AS (SELECT user_id, " + ", ".join(f"coalesce((count(DISTINCT round(value, 0)) FILTER (event_type = '{t}' AND value IS NOT NULL) > 1)::INT, 0) AS {t}" for t in ("click", "error", "purchase")) + " FROM events GROUP BY user_id) SELECT count(*) FILTER (click + error + purchase > 0) AS keys_in_conflict, coalesce(sum(click + error + purchase), 0)::BIGINT AS cells_in_conflict FROM c",
    "schema_contract": "SELECT c_custkey, c_mktsegment AS stratum, c_acctbal, NULL::VARCHAR AS phone FROM customer",
    "contract_errors": """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN ' ' ELSE o_orderpriority END AS p FROM orders)
SELECT 'null:o_orderkey' AS "check", count(*) FILTER (o_orderkey IS NULL) AS failures FROM o UNION ALL SELECT 'null:o_orderpriority', count(*) FILTER (p IS NULL) FROM o
UNION ALL SELECT 'blank:o_orderkey', 0 UNION ALL SELECT 'blank:o_orderpriority', count(*) FILTER (trim(p) = '') FROM o UNION ALL SELECT 'missing:o_note', 1""",
    "row_ledger": f"""WITH {RAW}, f AS (SELECT site, CASE WHEN NOT outcome IN ('R', 'N') THEN 'o' WHEN year(time) < 1997 THEN 'e' WHEN item IN ('Brand#2', 'Brand#5') THEN 'r' END AS rule FROM raw)
SELECT site, count(*) AS rows_in, count(*) FILTER (rule = 'o') AS removed_other_outcome, count(*) FILTER (rule = 'e') AS removed_early, count(*) FILTER (rule = 'r') AS removed_reserve, count(*) FILTER (rule IS NULL) AS rows_left FROM f GROUP BY site""",
    "tables_unioned": "SELECT segment, count(*) AS n, round(sum(balance), 2) AS balance FROM (SELECT c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_acctbal, NULL FROM supplier) GROUP BY segment",
    "ages_and_keywords": """WITH a AS (SELECT p_partkey, p_name, CASE WHEN p_size < 10 THEN p_size - 1.0 WHEN p_size < 20 THEN p_size WHEN p_size < 30 THEN p_size + 4.5 WHEN p_size < 45 THEN p_size END::DOUBLE AS years FROM part)
SELECT p_partkey, years, CASE WHEN years IS NULL THEN 'unknown' WHEN years <= 17 THEN '0-17' WHEN years <= 40 THEN '18-40' WHEN years <= 65 THEN '41-65' ELSE '66+' END AS bin,
CASE WHEN contains(lower(p_name), 'ring') THEN 'ring' WHEN contains(lower(p_name), 'widget') THEN 'widget' WHEN contains(lower(p_name), 'red') THEN 'red' ELSE 'other' END AS kind FROM a""",
    "scope_counts": f"WITH {RAW} SELECT coalesce(site, 'all_sites') AS site, count(*) AS rows, count(DISTINCT unit) AS units, count(DISTINCT episode) AS episodes, count(DISTINCT item) AS items FROM raw GROUP BY GROUPING SETS ((site), ())",
    "availability_exposure": f"""WITH {RAW}, w AS (SELECT site, era, item, min(time) AS first_seen, max(time) AS last_seen, count(DISTINCT episode) AS support FROM raw GROUP BY ALL), e AS (SELECT DISTINCT site, era, episode, time FROM raw)
SELECT w.*, count(*) FILTER (e.time < first_seen) AS before, count(*) FILTER (e.time > last_seen) AS after, support < 100 AS is_thin FROM w JOIN e ON e.site = w.site AND e.era = w.era GROUP BY ALL""",
    "episodes_per_unit": f"""WITH {RAW}, u AS (SELECT site, unit, count(DISTINCT episode) AS n FROM raw GROUP BY ALL)
SELECT site, CASE WHEN n = 1 THEN '1' WHEN n = 2 THEN '2' WHEN n <= 5 THEN '3-5' WHEN n <= 10 THEN '6-10' ELSE '>10' END AS band, count(*) AS units, sum(n)::BIGINT AS episodes FROM u GROUP BY ALL""",
    "panel_breadth": f"""WITH {OBS}, e AS (SELECT DISTINCT site, episode FROM raw), n AS (SELECT e.site, e.episode, count(o.item) AS items FROM e LEFT JOIN obs o ON o.episode = e.episode GROUP BY ALL)
SELECT site, count(*) AS n, round(avg(items), 6) AS mean, round(quantile_cont(items, 0.25), 6) AS q25, round(quantile_cont(items, 0.5), 6) AS median, round(quantile_cont(items, 0.75), 6) AS q75 FROM n GROUP BY site""",
    "antibiogram": f"""WITH {RAW}, o AS (SELECT episode, item, max(CASE outcome WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END) AS k, count(DISTINCT outcome) > 1 AS c FROM raw GROUP BY ALL)
SELECT item, count(*) AS episodes, round(avg((k = 3)::INT), 6) AS share_worst, count(*) FILTER (c) AS conflicts FROM o GROUP BY item""",
    "first_episodes": f"WITH {RAW}, e AS (SELECT DISTINCT site, unit, episode, time FROM raw) SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY site, unit, year(time) ORDER BY time, episode) = 1",
    "coverage_by_era": f"""WITH {OBS}, t AS (SELECT era, count(DISTINCT episode) AS episodes FROM raw GROUP BY era), s AS (SELECT era, coalesce(item, 'ALL') AS item, count(DISTINCT episode) AS observed FROM obs GROUP BY GROUPING SETS ((era, item), (era)))
SELECT era, item, observed, episodes, round(observed / episodes, 6) AS coverage FROM s JOIN t USING (era)""",
    "crosstab_outcomes": f"""WITH {RAW} SELECT stratum, count(*) FILTER (outcome = 'R') AS "R", count(*) FILTER (outcome = 'N') AS "N", count(*) FILTER (outcome = 'A') AS "A" FROM raw GROUP BY stratum""",
    "numeric_balance": "SELECT 'o_totalprice' AS covariate, round(abs(avg(o_totalprice) FILTER (o_orderstatus = 'F') - avg(o_totalprice) FILTER (o_orderstatus <> 'F')) / sqrt((var_samp(o_totalprice) FILTER (o_orderstatus = 'F') + var_samp(o_totalprice) FILTER (o_orderstatus <> 'F')) / 2), 6) AS difference FROM orders",
    "category_balance": """WITH c AS (SELECT o_orderpriority AS level, count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus <> 'F') AS b FROM orders GROUP BY ALL), p AS (SELECT level, a / sum(a) OVER () AS p1, b / sum(b) OVER () AS p0 FROM c)
SELECT 'o_orderpriority' AS covariate, level, round(p1, 6) AS p1, round(p0, 6) AS p0, round(abs(p1 - p0) / nullif(sqrt((p1 * (1 - p1) + p0 * (1 - p0)) / 2), 0), 6) AS difference FROM p""",
    "level_correlations": """WITH a AS (SELECT DISTINCT o_orderstatus AS level_a FROM orders), b AS (SELECT DISTINCT o_orderpriority AS level_b FROM orders)
SELECT level_a, level_b, round(corr((o_orderstatus = level_a)::INT, (o_orderpriority = level_b)::INT), 6) AS correlation FROM orders CROSS JOIN a CROSS JOIN b GROUP BY ALL""",
    "frequent_items": f"""WITH {RAW}, c AS (SELECT item, count(*) AS n FROM raw GROUP BY item), r AS (SELECT *, sum(n) OVER (ORDER BY n DESC, item ROWS UNBOUNDED PRECEDING) AS run, sum(n) OVER () AS total FROM c)
SELECT item, n, round(run / total, 6) AS coverage FROM r WHERE run - n < 0.5 * total""",
    "item_flags": f"WITH {RAW} SELECT unit, " + ", ".join(f"max((item = 'Brand#{k}')::INT) AS brand_{k}" for k in range(1, 26)) + " FROM raw GROUP BY unit",
    "study_period": "SELECT strftime(min(o_orderdate), '%B %Y') AS first_month, strftime(max(o_orderdate), '%B %Y') AS last_month, count(DISTINCT year(o_orderdate)) AS years FROM orders",
    "cell_sizes": f"WITH {RAW} SELECT site, stratum, era, count(DISTINCT episode) AS episodes, count(DISTINCT unit) AS units, count(DISTINCT item) AS items FROM raw GROUP BY ALL",
    "price_quartiles": "SELECT o_orderpriority, count(o_totalprice) AS n, round(avg(o_totalprice), 6) AS mean, round(quantile_cont(o_totalprice, 0.25), 6) AS q25, round(quantile_cont(o_totalprice, 0.5), 6) AS median, round(quantile_cont(o_totalprice, 0.75), 6) AS q75 FROM orders GROUP BY ALL",
    "look_back_windows": """WITH i AS (SELECT event_id AS index_id, user_id, ts FROM events WHERE event_type = 'purchase'),
j AS (SELECT i.index_id, e.event_type, date_diff('day', e.ts::DATE, i.ts::DATE) AS days FROM i LEFT JOIN events e ON e.user_id = i.user_id AND e.event_type <> 'purchase' AND e.ts::DATE <= i.ts::DATE)
SELECT index_id, count(event_type) AS records, count(DISTINCT event_type) AS distinct_values, min(days)::INT AS least_days, coalesce(max((days <= 1)::INT), 0) AS any_1d, coalesce(max((days <= 7)::INT), 0) AS any_7d, coalesce(max((days <= 14)::INT), 0) AS any_14d,
(count(event_type) > 0)::INT AS available FROM j GROUP BY index_id""",
    "active_conditions": """WITH e AS (SELECT user_id, event_type AS name, CASE WHEN event_id % 3 <> 0 THEN event_id % 50 - 10 END AS s, CASE WHEN event_id % 4 <> 0 THEN event_id % 30 - 20 END AS f FROM events)
SELECT user_id, count(DISTINCT name) FILTER (s >= 0 AND (f IS NULL OR f <= 0)) AS active_strict, count(DISTINCT name) FILTER ((s IS NULL OR s >= 0) AND (f IS NULL OR f <= 0)) AS active_lenient, max((s IS NULL AND f IS NULL)::INT) AS undated FROM e GROUP BY user_id""",
    "prevalence_summary": f"WITH {CELLS} SELECT item, eligible, evaluable, positive, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("standardised", "naive", "lower", "upper", "shift")) + " FROM prevalence",
    "prevalence_delta_curve": f"WITH {CELLS} SELECT item, round(k * 0.05, 6) AS delta, round((positive + least(1.0, k * 0.05::DOUBLE * naive) * (eligible - evaluable)) / eligible, 6) AS prevalence FROM prevalence CROSS JOIN range(41) AS t(k)",
    "prevalence_tilt_curve": f"WITH {tilt([-2, -1, 0, 1, 2])} SELECT item, tilt, round(prevalence, 6) AS prevalence FROM tilted",
    "prevalence_tipping_points": f"""WITH {tilt([k / 4 for k in range(-12, 13)])}, l(threshold) AS (VALUES (0.1::DOUBLE), (0.3::DOUBLE), (0.5::DOUBLE)),
x AS (SELECT item, threshold, tilt, prevalence - threshold AS d, lead(prevalence - threshold) OVER w AS d1, lead(tilt) OVER w AS t1 FROM tilted CROSS JOIN l WINDOW w AS (PARTITION BY item, threshold ORDER BY tilt)),
r AS (SELECT *, CASE WHEN d = 0 THEN tilt WHEN d * d1 < 0 THEN tilt + (t1 - tilt) * d / (d - d1) END AS root FROM x)
SELECT item, threshold, round(arg_min(root, abs(root)), 6) AS tipping, CASE WHEN count(root) > 0 THEN 'crosses' WHEN min(d) > 0 THEN 'always_above' WHEN max(d) < 0 THEN 'always_below' ELSE 'not_evaluable' END AS status FROM r GROUP BY ALL""",
    "edge_enrichment": f"""WITH {edges()}, s AS (SELECT u.item AS upstream, d.item AS downstream, avg((u.outcome = 'R')::INT) AS share_shown, count(*) AS episodes FROM obs u JOIN obs d ON d.episode = u.episode AND d.item <> u.item GROUP BY ALL),
a AS (SELECT item AS upstream, avg((outcome = 'R')::INT) AS share_all FROM obs GROUP BY item)
SELECT s.upstream, s.downstream, round(share_shown, 6) AS share_shown, s.episodes, round(share_all, 6) AS share_all, round(share_shown - share_all, 6) AS enrichment FROM s JOIN a USING (upstream) JOIN edges e ON e.upstream = s.upstream AND e.downstream = s.downstream AND e.ratio > 1.05""",
    "classifier_areas": f"""WITH {SCORED}, r AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2 AS midrank FROM scored),
roc AS (SELECT model, (sum(midrank) FILTER (target = 1) - count(*) FILTER (target = 1) * (count(*) FILTER (target = 1) + 1) / 2) / (count(*) FILTER (target = 1) * count(*) FILTER (target = 0)) AS roc_auc FROM r GROUP BY model),
g AS (SELECT model, score, sum(target) AS p, count(*) AS c FROM scored GROUP BY ALL), a AS (SELECT model, p, sum(p) OVER w AS tp, sum(c) OVER w AS n FROM g WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
ap AS (SELECT model, sum(p * tp / n) / sum(p) AS average_precision FROM a GROUP BY model)
SELECT model, round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision FROM roc JOIN ap USING (model)""",
    "threshold_sweep": f"WITH {SWEEP} SELECT model, pos, neg, tp, fp, fn, tn, threshold, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("brier", "accuracy", "balanced_accuracy", "precision", "recall", "f1", "mcc")) + " FROM sweep",
    "best_thresholds": f"WITH {SWEEP} SELECT model, threshold, round(balanced_accuracy, 6) AS balanced_accuracy, round(recall, 6) AS recall, round(precision, 6) AS precision FROM sweep QUALIFY row_number() OVER (PARTITION BY model ORDER BY balanced_accuracy DESC, recall DESC, precision DESC, threshold) = 1",
    "temporal_splits": f"WITH {TEMPORAL} SELECT split, count(*) AS rows, sum(target)::BIGINT AS positives, count(DISTINCT unit) AS units FROM split GROUP BY split",
    "split_overlap": f"WITH {TEMPORAL}, u AS (SELECT unit, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM split GROUP BY unit HAVING count(DISTINCT split) > 1) SELECT splits, count(*) AS entities FROM u GROUP BY splits",
}

ORACLE |= {
    "ablation_deltas": f"""WITH {SCORED}, two AS (SELECT model, 'full' AS f, target, score FROM scored UNION ALL SELECT model, 'coarse', target, round(score, 1) FROM scored),
r AS (SELECT *, rank() OVER (PARTITION BY model, f ORDER BY score) + (count(*) OVER (PARTITION BY model, f, score) - 1) / 2 AS midrank FROM two),
a AS (SELECT model, f, (sum(midrank) FILTER (target = 1) - count(*) FILTER (target = 1) * (count(*) FILTER (target = 1) + 1) / 2) / (count(*) FILTER (target = 1) * count(*) FILTER (target = 0)) AS auc FROM r GROUP BY ALL)
SELECT model, round(max(auc) FILTER (f = 'coarse'), 6) AS coarse, round(max(auc) FILTER (f = 'full'), 6) AS "full", round(max(auc) FILTER (f = 'full') - max(auc) FILTER (f = 'coarse'), 6) AS full_less_coarse FROM a GROUP BY model""",
    "exclusion_flow": f"""WITH {RAW}, c AS (SELECT count(*) AS a, count(*) FILTER (outcome IN ('R', 'N')) AS b, count(*) FILTER (outcome IN ('R', 'N') AND year(time) >= 1997) AS c, count(*) FILTER (outcome IN ('R', 'N') AND year(time) >= 1997 AND item <> 'Brand#7') AS d FROM raw)
SELECT 0 AS step, 'all' AS stage, a AS rows, 0 AS removed FROM c UNION ALL SELECT 1, 'known_item', a, 0 FROM c UNION ALL SELECT 2, 'interpretable', b, a - b FROM c UNION ALL SELECT 3, 'since_1997', c, b - c FROM c UNION ALL SELECT 4, 'not_intrinsic', d, c - d FROM c""",
    "item_panel_reasons": f"""WITH {RAW}, p AS (SELECT item, count(*) AS rows, count(DISTINCT episode) AS episodes, count(DISTINCT site) AS sites, count(*) FILTER (outcome = 'R') AS positives FROM raw GROUP BY item)
SELECT *, CASE WHEN sites < 5 THEN 'few_sites' WHEN rows % 3 = 0 THEN 'few_rows' WHEN positives % 2 = 0 THEN 'few_positives' ELSE 'kept' END AS reason FROM p""",
    "cohort_characteristics": """WITH l AS (SELECT c_mktsegment AS scope, 'o_orderstatus' AS covariate, o_orderstatus AS level FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT c_mktsegment, 'o_orderpriority', o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey),
n AS (SELECT coalesce(scope, 'all') AS scope, covariate, level, count(*) AS n FROM l GROUP BY GROUPING SETS ((scope, covariate, level), (covariate, level)))
SELECT *, round(n / sum(n) OVER (PARTITION BY scope, covariate), 6) AS share FROM n""",
    "label_transitions": f"""WITH {POOL} SELECT CASE WHEN i2 <= 50 AND abs(z) >= 1 THEN 'replicated' ELSE 'not_replicated' END AS from_label, CASE WHEN i2 <= 25 AND abs(z) >= 1 THEN 'replicated' ELSE 'not_replicated' END AS to_label, count(*) AS n FROM tail GROUP BY ALL""",
    "contract_checks": "SELECT * FROM (VALUES ('intrinsic_is_not_eligible', 0::BIGINT, true), ('support_when_available', 0, true), ('state_known', 0, true), ('observed_flag', 0, true)) AS v(\"check\", failures, passed)",
    "collapsed_outcomes": f"""WITH {RAW}, g AS (SELECT episode, item, count(DISTINCT outcome) AS n, min(outcome) AS o, count(DISTINCT outcome) FILTER (outcome IN ('R', 'N')) AS m, min(outcome) FILTER (outcome IN ('R', 'N')) AS f FROM raw GROUP BY ALL)
SELECT CASE WHEN n = 1 THEN o WHEN m = 1 THEN f ELSE 'CONFLICTING' END AS outcome, count(*) AS n FROM g GROUP BY 1""",
    "episodes_without_result": f"WITH {OBS} SELECT site, count(DISTINCT episode) AS episodes FROM raw WHERE episode NOT IN (SELECT episode FROM obs) GROUP BY site",
    "stratum_edges": f"WITH {edges(', stratum')} SELECT stratum, {EDGE} FROM edges WHERE passes_support",
    "companion_rates": f"""WITH {counts()}, rate AS (SELECT upstream, downstream, sum(tested_n) / sum(support_n) AS p FROM counts GROUP BY ALL)
SELECT x.upstream, x.downstream, round(max(y.p), 6) AS max_companion, round(avg(y.p), 6) AS mean_companion FROM rate x LEFT JOIN rate y ON y.upstream = x.upstream AND y.downstream <> x.downstream GROUP BY ALL""",
    "weakest_link_paths": f"WITH {PATHS} SELECT a, b, c, x.ci_low > 1 AND y.ci_low > 1 AS qualifies FROM top JOIN ret x ON x.upstream = a AND x.downstream = b JOIN ret y ON y.upstream = b AND y.downstream = c",
    "top_links": f"WITH {edges()} SELECT upstream, downstream, n_pos + n_neg AS support, round(abs(log2(ratio)), 6) AS effect FROM edges ORDER BY support DESC, round(abs(log2(ratio)), 9) DESC, upstream, downstream LIMIT 30",
    "rate_scatter": f"WITH {edges()} SELECT upstream, downstream, round(k_pos / n_pos, 6) AS rate_pos, round(k_neg / n_neg, 6) AS rate_neg, round(greatest(k_pos / n_pos, 1e-4) / greatest(k_neg / n_neg, 1e-4), 6) AS plain_ratio FROM edges WHERE n_pos >= 20 AND n_neg >= 20",
    "event_profile": f"WITH {edges()} SELECT " + ", ".join(f"count(*) FILTER (k_pos + k_neg <= {k}) AS at_most_{k}" for k in (1, 100, 250, 300)) + " FROM edges",
    "year_site_counts": f"WITH {edges(', site, year')} SELECT upstream, downstream, site, year, n_pos AS n, k_pos AS k FROM edges",
    "rules_matched": f"""WITH {edges()} SELECT upstream, downstream, round(ratio, 6) AS ratio, (upstream, downstream) IN (VALUES ('Brand#1', 'Brand#3'), ('Brand#2', 'Brand#3'), ('Brand#9', 'Brand#4')) AS in_rule FROM edges WHERE downstream IN ('Brand#3', 'Brand#4', 'Brand#5')""",
    "recent_errors": """SELECT p.event_id AS index_id, count(*) AS errors, round(median(x.value), 6) AS median_value, max(x.value) AS max_value FROM events p JOIN events x ON x.user_id = p.user_id AND x.event_type = 'error' AND x.ts <= p.ts AND x.ts >= p.ts - INTERVAL 7 DAY
WHERE p.event_type = 'purchase' GROUP BY ALL""",
    "selection_balance": f"""WITH {RAW}, e AS (SELECT DISTINCT episode, stratum FROM raw), i AS (SELECT DISTINCT item FROM raw), has AS (SELECT DISTINCT episode, item FROM raw),
c AS (SELECT i.item, e.stratum AS level, count(h.episode) AS a, count(*) - count(h.episode) AS b FROM e CROSS JOIN i LEFT JOIN has h ON h.episode = e.episode AND h.item = i.item GROUP BY ALL),
p AS (SELECT item, level, a / sum(a) OVER (PARTITION BY item) AS p1, b / sum(b) OVER (PARTITION BY item) AS p0 FROM c)
SELECT item, 'stratum' AS covariate, level, round(p1, 6) AS p1, round(p0, 6) AS p0, round(abs(p1 - p0) / nullif(sqrt((p1 * (1 - p1) + p0 * (1 - p0)) / 2), 0), 6) AS difference FROM p""",
    "stage_counts": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows FROM {t}" for t in ("customer", "orders", "lineitem", "part")),
    "identifiability_panel": f"""WITH {GRID} SELECT g.site, g.item, count(*) AS eligible, count(o.outcome) AS known, count(*) FILTER (o.outcome IN ('R', 'A')) AS positive
FROM grid g LEFT JOIN obs o ON o.episode = g.episode AND o.item = g.item WHERE g.is_available AND NOT g.is_intrinsic GROUP BY ALL""",
}

STAR = """star AS (SELECT o_orderkey, o_custkey, o_totalprice::DOUBLE AS o_totalprice, o_orderstatus, c_mktsegment AS segment, c_acctbal::DOUBLE AS balance, c_nationkey AS nation, c_custkey IS NOT NULL AS customer_known,
  l.n AS lines_n, l.quantity AS lines_quantity, l.k IS NOT NULL AS lines_known, e.n AS events_n, e.errors AS events_errors, e.u IS NOT NULL AS events_known
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey
  LEFT JOIN (SELECT l_orderkey AS k, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1) l ON l.k = o_orderkey
  LEFT JOIN (SELECT user_id AS u, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1) e ON e.u = o_custkey)"""
# the training part's edges: availability and counts from its rows alone
TRAIN = edges().replace("JOIN part ON l_partkey = p_partkey)", "JOIN part ON l_partkey = p_partkey WHERE r_name NOT IN ('ASIA', 'EUROPE'))")
MATRIX = AVAIL + """, past AS (SELECT a.o_orderkey AS episode, max(a.o_orderpriority = '1-URGENT')::INT AS ctx_urgent, coalesce(max(date_diff('day', b.o_orderdate::DATE, a.o_orderdate::DATE) <= 90), false)::INT AS ctx_prior_90d,
    coalesce(max(date_diff('day', b.o_orderdate::DATE, a.o_orderdate::DATE) <= 365), false)::INT AS ctx_prior_365d
  FROM orders a LEFT JOIN orders b ON b.o_custkey = a.o_custkey AND b.o_orderdate::DATE < a.o_orderdate::DATE GROUP BY a.o_orderkey),
n AS (SELECT obs.episode, count(*) - 1 AS ctx_others, any_value(ctx_urgent) AS ctx_urgent, any_value(ctx_prior_90d) AS ctx_prior_90d, any_value(ctx_prior_365d) AS ctx_prior_365d FROM obs JOIN past USING (episode) GROUP BY obs.episode),
m AS (SELECT u.episode, u.item AS upstream, a.item AS downstream, (u.outcome = 'R')::INT AS up_positive, (d.episode IS NOT NULL)::INT AS target, ctx_others, ctx_urgent, ctx_prior_90d, ctx_prior_365d, CASE WHEN u.site IN ('ASIA', 'EUROPE') THEN 'test' ELSE 'train' END AS split
  FROM obs u JOIN avail a ON a.site = u.site AND a.stratum = u.stratum AND a.era = u.era AND a.item <> u.item AND a.is_available AND NOT a.is_intrinsic
  LEFT JOIN obs d ON d.episode = u.episode AND d.item = a.item JOIN n ON n.episode = u.episode),
te AS (SELECT * FROM (WITH """ + TRAIN + """ SELECT upstream, downstream, ln(ratio) AS pattern_log_ratio, (n_pos + n_neg)::DOUBLE AS pattern_support FROM edges)),
matrix AS (SELECT m.*, coalesce(pattern_log_ratio, 0) AS pattern_log_ratio, coalesce(pattern_support, 0) AS pattern_support FROM m LEFT JOIN te USING (upstream, downstream))"""
IMPLIED = """, rule(item, implied) AS (VALUES ('Brand#1', 'Brand#11'), ('Brand#2', 'Brand#12'), ('Brand#3', 'Brand#13')),
both_obs AS (SELECT *, false AS is_implied FROM obs UNION ALL SELECT o.site, o.unit, o.episode, o.time, o.stratum, o.era, implied, o.outcome, true FROM obs o JOIN rule USING (item)
  WHERE NOT EXISTS (SELECT 1 FROM obs x WHERE x.episode = o.episode AND x.item = implied))"""
STEPS = 12  # shortest paths of more steps don't occur among 25 items


def shortest() -> str:
    """Shortest paths between any two nodes of the graph l(upstream, downstream), level by level: (source, node, steps, paths)."""
    out = "nodes AS MATERIALIZED (SELECT upstream AS node FROM l UNION SELECT downstream FROM l), p0 AS MATERIALIZED (SELECT node AS source, node, 0 AS steps, 1.0::DOUBLE AS paths FROM nodes), s0 AS MATERIALIZED (FROM p0)"
    for k in range(1, STEPS):
        out += f""", p{k} AS MATERIALIZED (SELECT source, downstream AS node, {k} AS steps, sum(paths) AS paths FROM p{k - 1} JOIN l ON upstream = node
  WHERE (source, downstream) NOT IN (SELECT (source, node) FROM s{k - 1}) GROUP BY ALL), s{k} AS MATERIALIZED (FROM s{k - 1} UNION ALL FROM p{k})"""
    return out


OBS_IMPLIED = RAW.replace("raw AS", "raw0 AS", 1) + """, obs0 AS (SELECT site, unit, episode, time, stratum, era, item, min(outcome) AS outcome FROM raw0 GROUP BY ALL HAVING count(DISTINCT outcome) = 1),
rule(item, implied) AS (VALUES ('Brand#1', 'Brand#11'), ('Brand#2', 'Brand#12'), ('Brand#3', 'Brand#13')),
added AS (SELECT o.site, o.unit, o.episode, o.time, o.stratum, o.era, implied AS item, o.outcome FROM obs0 o JOIN rule USING (item) WHERE NOT EXISTS (SELECT 1 FROM obs0 x WHERE x.episode = o.episode AND x.item = implied)),
raw AS (SELECT site, unit, episode, time, stratum, era, item, outcome FROM raw0 UNION ALL FROM added), obs AS (FROM obs0 UNION ALL FROM added)"""
PATTERNS = counts(", site, stratum") + """ SELECT upstream, downstream, (outcome = 'R')::INT AS exposed, site, stratum, support_n AS n, tested_n AS events FROM counts WHERE outcome IN ('R', 'N')"""
SUMS = GRID + """, pairs AS (SELECT u.item AS upstream, g.item AS downstream, (u.outcome = 'R')::INT AS e, (o.episode IS NOT NULL)::INT AS y, c.c_acctbal::DOUBLE AS balance, r.o_totalprice::DOUBLE AS price,
    (r.o_orderpriority = '1-URGENT')::INT AS urgent, u.site, u.stratum, year(u.time)::VARCHAR AS year
  FROM obs u JOIN grid g ON g.episode = u.episode AND g.item <> u.item AND g.is_available AND NOT g.is_intrinsic LEFT JOIN obs o ON o.episode = g.episode AND o.item = g.item
  JOIN orders r ON r.o_orderkey = u.episode JOIN customer c ON c.c_custkey = r.o_custkey WHERE u.outcome IN ('R', 'N')),
numbers AS (SELECT upstream, downstream, unnest(['rows', 'exposed', 'balance', 'price', 'urgent']) AS "column", unnest([count(*), sum(e), sum(balance), sum(price), sum(urgent)]) AS over_rows,
    unnest([sum(e), sum(e), sum(balance * e), sum(price * e), sum(urgent * e)]) AS over_exposed, unnest([sum(y), sum(e * y), sum(balance * y), sum(price * y), sum(urgent * y)]) AS over_shown FROM pairs GROUP BY upstream, downstream),
levels AS (SELECT upstream, downstream, "column", count(*) AS over_rows, sum(e) AS over_exposed, sum(y) AS over_shown FROM (SELECT upstream, downstream, e, y, unnest(['site=' || site, 'stratum=' || stratum, 'year=' || year]) AS "column" FROM pairs) GROUP BY ALL),
names AS (SELECT DISTINCT "column" FROM levels), every AS (SELECT upstream, downstream, "column" FROM (SELECT DISTINCT upstream, downstream FROM pairs) CROSS JOIN names),
sums AS (FROM numbers UNION ALL SELECT upstream, downstream, "column", coalesce(over_rows, 0), coalesce(over_exposed, 0), coalesce(over_shown, 0) FROM every LEFT JOIN levels USING (upstream, downstream, "column"))"""


def crc32(text: str) -> str:
    """CRC-32 of a text of ASCII characters: eight shifts for each."""
    start = f"list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT))"
    shift = "CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::BIGINT) ELSE r >> 1 END"
    return f"xor(list_reduce({start}, lambda a, x: list_reduce(list_prepend(xor(a, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda r, z: {shift})), 4294967295::BIGINT)"


FOLDS = SCORED + f", folds AS (SELECT *, ({crc32('unit::VARCHAR')} % 5)::INT AS fold FROM scored)"
SAMPLE = f"""hashed AS (SELECT c_custkey, c_mktsegment, {crc32('c_custkey::VARCHAR')} % 10000 AS h FROM customer),
sample AS (SELECT c_custkey, c_mktsegment FROM hashed WHERE h < 500 UNION SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY h, c_custkey) AS n FROM hashed) WHERE n <= 25)"""
MASKED = GRID + f""", hidden AS (SELECT *, {crc32("episode::VARCHAR || '|' || item")} % 1000 < 200 AS is_hidden FROM obs),
mcells AS (SELECT g.site, g.stratum, g.era, g.item, count(*) AS eligible, count(o.episode) AS t1, count(*) FILTER (o.outcome = 'R') AS r1, count(*) FILTER (NOT o.is_hidden) AS t2, count(*) FILTER (NOT o.is_hidden AND o.outcome = 'R') AS r2
  FROM grid g LEFT JOIN hidden o ON o.episode = g.episode AND o.item = g.item WHERE g.is_available AND NOT g.is_intrinsic GROUP BY ALL),
both_rates AS (SELECT item, sum(eligible * (r1 / nullif(t1, 0))) / sum(eligible) FILTER (t1 > 0) AS from_all, sum(eligible * (r2 / nullif(t2, 0))) / sum(eligible) FILTER (t2 > 0) AS from_known FROM mcells GROUP BY item HAVING sum(t2) >= 1)"""


def page_rank_sql(rounds: int = 60) -> str:
    """Rounds written out one after another."""
    out = f"""WITH {edges()}, w AS MATERIALIZED (SELECT upstream, downstream, CASE WHEN ln(ratio) = 0 THEN 1 ELSE abs(ln(ratio)) END AS w FROM edges),
l AS MATERIALIZED (SELECT upstream, downstream, w / sum(w) OVER (PARTITION BY upstream) AS share FROM w), nodes AS MATERIALIZED (SELECT upstream AS node FROM l UNION SELECT downstream FROM l), c AS MATERIALIZED (SELECT count(*) AS n FROM nodes),
r0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / n AS rank FROM nodes, c)"""
    for k in range(rounds):
        out += f""",
f{k} AS MATERIALIZED (SELECT downstream, sum(rank * share) AS flow FROM l JOIN r{k} ON node = upstream GROUP BY ALL),
r{k + 1} AS MATERIALIZED (SELECT node, 0.15 / n + 0.85 * (coalesce(flow, 0) + (1 - (SELECT coalesce(sum(flow), 0) FROM f{k})) / n) AS rank FROM nodes CROSS JOIN c LEFT JOIN f{k} ON downstream = node)"""
    return out + f" SELECT node, round(rank, 6) AS rank FROM r{rounds}"


ORACLE |= {
    "opportunity_grid": f"""WITH {GRID}, seen AS (SELECT DISTINCT episode, item FROM raw)
SELECT g.stratum, g.item, CASE WHEN is_intrinsic THEN 'intrinsic' WHEN NOT is_available THEN 'unavailable' WHEN s.item IS NOT NULL THEN 'eligible_observed' ELSE 'eligible_unobserved' END AS state,
count(*) AS n, count(s.item) AS observed FROM grid g LEFT JOIN seen s ON s.episode = g.episode AND s.item = g.item GROUP BY ALL""",
    "validated_edges_by_status": f"WITH {LABELS} SELECT upstream, downstream, round(ratio, 6) AS ratio, CASE WHEN ratio > 1 THEN 'escalation' WHEN ratio > 0 AND ratio < 1 THEN 'suppression' END AS direction, validation_status FROM labelled WHERE validation_status IN ('robust', 'supported')",
    "primary_edges": f"WITH {LABELS} SELECT upstream, downstream, round(ratio, 6) AS ratio, validation_status FROM labelled ORDER BY list_position(['robust', 'supported', 'mixed', 'insufficient'], validation_status), round(abs(ln(ratio)), 9) DESC, upstream, downstream LIMIT 40",
    "permutation_strata_by_era": f"""WITH {counts(', site').replace('u.outcome, u.site', 'u.outcome, u.site, u.era')}, st AS (SELECT upstream, downstream, site, era, coalesce(sum(support_n) FILTER (outcome = 'R'), 0) AS n_pos, coalesce(sum(support_n) FILTER (outcome = 'N'), 0) AS n_neg FROM counts GROUP BY ALL)
SELECT upstream, downstream, count(*) AS n_strata, count(*) FILTER (n_pos > 0 AND n_neg > 0) AS both_labels, coalesce(sum(n_pos + n_neg) FILTER (n_pos > 0 AND n_neg > 0), 0)::BIGINT AS permutable,
sum(n_pos + n_neg)::BIGINT AS rows, round(1 - coalesce(sum(n_pos + n_neg) FILTER (n_pos > 0 AND n_neg > 0), 0) / nullif(sum(n_pos + n_neg), 0), 6) AS fixed_share FROM st GROUP BY ALL""",
    "observed_ratios": f"""WITH {counts()}, w AS (SELECT upstream, downstream, coalesce(sum(support_n) FILTER (outcome = 'R'), 0)::BIGINT AS n_pos, coalesce(sum(tested_n) FILTER (outcome = 'R'), 0)::BIGINT AS k_pos, coalesce(sum(support_n) FILTER (outcome = 'N'), 0)::BIGINT AS n_neg, coalesce(sum(tested_n) FILTER (outcome = 'N'), 0)::BIGINT AS k_neg FROM counts GROUP BY ALL)
SELECT *, round(((k_pos + 0.5) / (n_pos + 1)) / ((k_neg + 0.5) / (n_neg + 1)), 6) AS ratio FROM w""",
    "adjusted_patterns": f"WITH {PATTERNS}",
    "adjusted_sums": f"""WITH {SUMS} SELECT upstream, downstream, "column", round(over_rows::DOUBLE, 2) AS over_rows, round(over_exposed::DOUBLE, 2) AS over_exposed, round(over_shown::DOUBLE, 2) AS over_shown FROM sums""",
    "page_rank": page_rank_sql(),
    "covariate_star": f"WITH {STAR} SELECT * REPLACE (round(o_totalprice, 6) AS o_totalprice, round(balance, 6) AS balance, round(lines_quantity::DOUBLE, 6) AS lines_quantity) FROM star",
    "covariate_coverage": f"WITH {STAR}" + " UNION ALL ".join(f" SELECT '{n}' AS dimension, count(*) AS rows, count(*) FILTER ({n}_known) AS matched, count(*) FILTER (NOT {n}_known) AS unmatched FROM star" for n in ("customer", "lines", "events")),
    "published_tables": f"""WITH {RAW} SELECT 'statuses' AS name, 'ok' AS state, 1 AS version, count(*) AS rows FROM orders UNION ALL SELECT 'segments', 'ok', 1, count(*) FROM customer
UNION ALL SELECT 'observations', 'ok', 1, count(DISTINCT (episode, item)) FROM raw UNION ALL SELECT 'missing', 'unpublished', NULL, NULL""",
    "covariates_at_time": """WITH i AS (SELECT event_id, user_id, ts::DATE AS d FROM events WHERE event_type = 'purchase'),
j AS (SELECT i.event_id, i.user_id, e.event_type AS t, date_diff('day', e.ts::DATE, i.d) AS days, e.ts::DATE AS ed FROM i LEFT JOIN events e ON e.user_id = i.user_id)
SELECT event_id, user_id, coalesce(max(days <= 1) FILTER (t = 'error' AND days >= 0), false)::INT AS errors_1d, coalesce(max(days <= 7) FILTER (t = 'error' AND days >= 0), false)::INT AS errors_7d,
  coalesce(max(days <= 14) FILTER (t = 'error' AND days >= 0), false)::INT AS errors_14d, (count(*) FILTER (t = 'error' AND days >= 0) > 0)::INT AS errors_available,
  coalesce(max(days <= 7) FILTER (t = 'purchase' AND days > 0), false)::INT AS before_7d, (count(*) FILTER (t = 'purchase' AND days > 0) > 0)::INT AS before_available,
  count(*) FILTER (days >= 0) AS all_records, count(DISTINCT t) FILTER (days >= 0) AS all_values, (count(*) FILTER (days >= 0) > 0)::INT AS all_available, arg_min(t, (ed, t)) AS first_kind, 1 AS first_kind_available,
  CASE max(CASE t WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 END) FILTER (days >= 0) WHEN 3 THEN 'error' WHEN 2 THEN 'purchase' WHEN 1 THEN 'click' END AS worst, 1 AS worst_available, NULL::VARCHAR AS views, 0 AS views_available
FROM j GROUP BY ALL""",
    "pair_feature_matrix": f"WITH {MATRIX} SELECT upstream, downstream, split, count(*) AS rows, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("target", "up_positive", "ctx_others", "ctx_urgent", "ctx_prior_90d", "ctx_prior_365d", "pattern_log_ratio", "pattern_support")) + " FROM matrix GROUP BY ALL",
    "pair_feature_rows": f"WITH {MATRIX} SELECT episode, upstream, downstream, target, up_positive, round(pattern_log_ratio, 6) AS pattern_log_ratio, pattern_support FROM matrix WHERE up_positive = 1",
    "screened_edges": f"""WITH {edges()}, free AS (SELECT * FROM (WITH {counts().replace(" AND NOT g.is_intrinsic", "")}, rate AS (SELECT upstream, downstream, sum(tested_n) / sum(support_n) AS p, sum(support_n) AS n FROM counts GROUP BY ALL)
  SELECT x.upstream, x.downstream FROM rate x JOIN rate y ON y.upstream = x.downstream AND y.downstream = x.upstream WHERE x.p >= 0.145 AND y.p >= 0.145 AND x.n >= 25 AND y.n >= 25))
SELECT upstream, downstream, round(ratio, 6) AS ratio, passes_support FROM edges WHERE (upstream, downstream) NOT IN (SELECT (upstream, downstream) FROM free) AND (downstream, upstream) NOT IN (SELECT (upstream, downstream) FROM free)""",
    "implied_sensitivity": f"""SELECT coalesce(x.upstream, y.upstream) AS upstream, coalesce(x.downstream, y.downstream) AS downstream, round(x.ratio, 6) AS ratio_observed, round(y.ratio, 6) AS ratio_implied,
CASE WHEN y.ratio IS NULL THEN 'observed_only' WHEN x.ratio IS NULL THEN 'implied_only' ELSE 'shared' END AS presence, round(ln(x.ratio) - ln(y.ratio), 6) AS log_difference
FROM (WITH {edges()} SELECT upstream, downstream, ratio FROM edges) x FULL JOIN (WITH {edges().replace(OBS, OBS_IMPLIED, 1)} SELECT upstream, downstream, ratio FROM edges) y ON x.upstream = y.upstream AND x.downstream = y.downstream""",
    "implied_outcomes": f"WITH {OBS}{IMPLIED} SELECT item, is_implied, count(*) AS rows, count(*) FILTER (outcome = 'R') AS positives FROM both_obs GROUP BY ALL",
    "canonical_edges": f"""WITH {edges()}, alias(item, canonical) AS (VALUES ('Brand#21', 'Brand#1'), ('Brand#22', 'Brand#2'), ('Brand#23', 'Brand#2')),
named AS (SELECT coalesce(a.canonical, e.upstream) AS upstream, coalesce(b.canonical, e.downstream) AS downstream, e.upstream AS u, e.downstream AS d, ratio, n_pos + n_neg AS n FROM edges e LEFT JOIN alias a ON a.item = e.upstream LEFT JOIN alias b ON b.item = e.downstream)
SELECT upstream, downstream, round(ratio, 6) AS ratio, count(*) OVER (PARTITION BY upstream, downstream) - 1 AS collapsed FROM named QUALIFY row_number() OVER (PARTITION BY upstream, downstream ORDER BY n DESC, u, d) = 1""",
    "mutual_dependence": f"""WITH {GRID}, c AS (SELECT u.item AS upstream, g.item AS downstream, u.outcome, o.episode IS NOT NULL AS shown
  FROM obs u JOIN grid g ON g.episode = u.episode AND g.item <> u.item AND g.is_available AND NOT g.is_intrinsic JOIN grid own ON own.episode = u.episode AND own.item = u.item AND own.is_available AND NOT own.is_intrinsic
  LEFT JOIN obs o ON o.episode = g.episode AND o.item = g.item),
t AS (SELECT upstream, downstream, count(*) AS n, count(*) FILTER (shown) AS k, count(*) FILTER (outcome = 'R') AS n1, count(*) FILTER (outcome = 'R' AND shown) AS k1, count(*) FILTER (outcome = 'N') AS n0, count(*) FILTER (outcome = 'N' AND shown) AS k0 FROM c GROUP BY ALL),
m AS (SELECT *, CASE WHEN n1 > 0 AND n0 > 0 THEN ((k1 + 0.5) / (n1 + 1)) / ((k0 + 0.5) / (n0 + 1)) END AS ratio, (k + 0.5) / (n + 1) AS rate FROM t)
SELECT a.upstream, a.downstream, round(a.ratio, 6) AS ratio, round(b.ratio, 6) AS reverse_ratio, round(ln(a.ratio) - ln(b.ratio), 6) AS asymmetry, round(a.rate, 6) AS rate, round(b.rate, 6) AS reverse_rate, round(abs(ln(a.rate) - ln(b.rate)), 6) AS rate_asymmetry,
  round(least(a.n, b.n) / greatest(a.n, b.n), 6) AS support_ratio, round(a.k / (a.n + b.n - a.k), 6) AS overlap FROM m a LEFT JOIN m b ON b.upstream = a.downstream AND b.downstream = a.upstream""",
    "direction_conflicts": f"WITH {RET} SELECT count(*) AS edges, count(*) FILTER (upstream = 'Brand#5' AND ratio > 1) AS conflicts FROM ret",
    "thinned_curves": f"""WITH {tilt([k / 4 for k in range(-12, 13)])}, c AS (SELECT item, tilt, round(prevalence, 6) AS prevalence FROM tilted),
d AS (SELECT *, coalesce(sqrt((tilt - lag(tilt) OVER w) ** 2 + (prevalence - lag(prevalence) OVER w) ** 2), 0) AS d FROM c WINDOW w AS (PARTITION BY item ORDER BY tilt)),
a AS (SELECT *, floor(round(sum(d) OVER (PARTITION BY item ORDER BY tilt ROWS UNBOUNDED PRECEDING) * 8 / sum(d) OVER (PARTITION BY item), 9)) AS place FROM d)
SELECT item, tilt, prevalence FROM a QUALIFY lag(place) OVER (PARTITION BY item ORDER BY tilt) IS NULL OR lead(place) OVER (PARTITION BY item ORDER BY tilt) IS NULL OR place > lag(place) OVER (PARTITION BY item ORDER BY tilt)""",
    "ranked_prevalence_shifts": f"WITH {CELLS}, r AS (SELECT *, row_number() OVER (ORDER BY round(abs(shift), 9) DESC, eligible DESC, evaluable DESC, item)::INT AS rank FROM prevalence WHERE shift IS NOT NULL) SELECT item, round(shift, 6) AS shift, eligible, evaluable, rank FROM r WHERE rank <= 20",
    "conservative_edges": f"WITH {RET}, b AS (SELECT *, CASE WHEN ratio >= 1 THEN ln(ci_low) ELSE -ln(ci_high) END AS near_bound FROM ret) SELECT upstream, downstream, round(ratio, 6) AS ratio, round(near_bound, 6) AS near_bound FROM b ORDER BY round(b.near_bound, 9) DESC, upstream, downstream LIMIT 30",
    "smoothing_of_strongest": f"WITH {RET}, b AS (SELECT * FROM ret ORDER BY round(abs(ln(ratio)), 9) DESC, upstream, downstream LIMIT 30), v(smoothing) AS (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) SELECT upstream, downstream, smoothing, round(((k_pos + smoothing) / (n_pos + 2 * smoothing)) / ((k_neg + smoothing) / (n_neg + 2 * smoothing)), 6) AS ratio FROM b CROSS JOIN v",
    "categories_in_order": f"WITH {CELLS}, {CATS} SELECT item, category, round(naive, 6) AS naive, row_number() OVER (ORDER BY coalesce(list_position(['Access', 'Watch', 'Reserve'], category), 4), (evaluable < 2000)::INT, round(naive, 9) DESC, item)::INT AS place FROM prevalence LEFT JOIN cats USING (item)",
    "existence_by_scope": f"""WITH {edges(', site')}, s(site) AS (VALUES ('AFRICA'), ('AMERICA'), ('ASIA'), ('EUROPE'), ('MIDDLE EAST'), ('ANTARCTICA'))
SELECT s.site, count(e.ratio) AS edges, count(*) FILTER (e.ratio > 1) AS above, round(max(e.ratio), 6) AS largest, round(median(e.ratio), 6) AS median, count(*) FILTER (e.ratio > 1) > 0 AS found FROM s LEFT JOIN (SELECT * FROM edges WHERE passes_support) e ON e.site = s.site GROUP BY s.site""",
    "pair_dependence": f"""WITH {edges()}, rate AS (SELECT upstream, downstream, sum(tested_n) AS k, sum(support_n) AS n FROM counts GROUP BY ALL),
x AS (SELECT e.upstream, e.downstream, e.ratio, abs(ln((x.k + 0.5) / (x.n + 1)) - ln((y.k + 0.5) / (y.n + 1))) AS timing_asymmetry, least(x.k / x.n, y.k / y.n) AS bundling, least(x.n, y.n) / greatest(x.n, y.n) AS support_ratio
  FROM edges e JOIN rate x USING (upstream, downstream) JOIN rate y ON y.upstream = e.downstream AND y.downstream = e.upstream)
SELECT upstream, downstream, round(ratio, 6) AS ratio, round(timing_asymmetry, 6) AS timing_asymmetry, round(bundling, 6) AS bundling, round(support_ratio, 6) AS support_ratio, CASE WHEN bundling >= 0.8 THEN 'bundled' WHEN bundling >= 0.5 THEN 'partly_bundled' ELSE 'separate' END AS grade FROM x""",
    "betweenness": f"""WITH {edges()}, l AS MATERIALIZED (SELECT DISTINCT upstream, downstream FROM edges WHERE ratio > 1.1 AND upstream <> downstream), {shortest()},
through AS (SELECT a.node, sum(a.paths * b.paths / c.paths) AS d FROM s{STEPS - 1} a JOIN s{STEPS - 1} b ON b.source = a.node JOIN s{STEPS - 1} c ON c.source = a.source AND c.node = b.node AND c.steps = a.steps + b.steps
  WHERE a.source <> a.node AND b.node <> a.node AND a.source <> b.node GROUP BY ALL)
SELECT n.node, round(coalesce(d, 0) * CASE WHEN (SELECT count(*) FROM nodes) > 2 THEN 1.0::DOUBLE / (((SELECT count(*) FROM nodes) - 1) * ((SELECT count(*) FROM nodes) - 2)) ELSE 1 END, 6) AS betweenness FROM nodes n LEFT JOIN through t ON t.node = n.node""",
    "bundling_sensitivity": f"""WITH {LABELS}, r AS (SELECT upstream, downstream, sum(tested_n) / sum(support_n) AS p, sum(support_n) AS n FROM counts GROUP BY ALL),
b AS (SELECT x.upstream, x.downstream, coalesce(x.p >= 0.145 AND y.p >= 0.145 AND x.n >= 25 AND y.n >= 25, false) AS out FROM r x LEFT JOIN r y ON y.upstream = x.downstream AND y.downstream = x.upstream)
SELECT CASE WHEN out THEN 'stricter_only' ELSE 'kept' END AS band, validation_status, count(*) AS pairs FROM labelled JOIN b USING (upstream, downstream) GROUP BY ALL""",
    "excluded_entities": """WITH p AS (SELECT p_brand, CASE WHEN p_size % 9 <> 0 THEN p_name END AS name FROM part),
t AS (SELECT p_brand, name, CASE WHEN name IS NULL THEN 'MISSING_LABEL' WHEN contains(lower(name), 'widget') THEN 'WIDGET' WHEN contains(lower(name), 'ring') THEN 'RING' WHEN contains(lower(name), 'gear') THEN 'GEAR' ELSE 'OTHER' END AS k FROM p),
m AS (SELECT *, coalesce(k IN ('RING', 'OTHER') AND upper(trim(name)) <> 'SMALL RING', false) AS stays FROM t)
SELECT p_brand, coalesce(name, '<missing>') AS name, k AS entity_type, count(*) AS rows FROM m WHERE NOT stays GROUP BY ALL UNION ALL SELECT p_brand, '(kept)', 'PRIMARY', count(*) FROM m WHERE stays GROUP BY ALL""",
    "replication_sensitivity": f"WITH {POOL}, a(i2_limit) AS (VALUES (25.0::DOUBLE), (50.0::DOUBLE), (75.0::DOUBLE)), b(z_limit) AS (VALUES (1.0::DOUBLE), (1.96::DOUBLE)) SELECT i2_limit, z_limit, count(*) FILTER (i2 <= i2_limit AND abs(z) >= z_limit) AS replicated FROM a CROSS JOIN b LEFT JOIN tail ON true GROUP BY ALL",
    "availability_sensitivity": " UNION ALL ".join(
        f"SELECT {m}::INT AS min_support, edges, mean_ratio FROM (WITH {edges().replace(f'>= {MIN_SUPPORT} AS is_available', f'>= {m} AS is_available')} SELECT count(*) AS edges, round(coalesce(avg(ratio), 0), 6) AS mean_ratio FROM edges WHERE passes_support)" for m in (1, MIN_SUPPORT, 2 * MIN_SUPPORT)
    ),
    "matched_families": f"""WITH {RAW}, l AS (SELECT CASE WHEN upper(item) || '/' || upper(stratum) = 'BRAND#1/BUILDING' THEN 'FIRST' ELSE upper(item) || '/' || upper(stratum) END AS label FROM raw)
SELECT CASE WHEN regexp_matches(label, '^(FIRST|BRAND#[12])(/|$)') THEN 'low' WHEN regexp_matches(label, 'BUILDING|HOUSEHOLD') THEN 'home' ELSE 'other' END AS family, split_part(label, '/', 1) AS first_word, count(*) AS rows FROM l GROUP BY ALL""",
    "pooled_selection": """WITH l AS (SELECT split_part(p_name, ' ', 1) AS label FROM part) SELECT 'warm' AS requested, 'warm' AS label, count(*) AS rows FROM l WHERE label IN ('red', 'orange', 'warm') HAVING count(*) > 0 UNION ALL SELECT 'red', 'red', count(*) FROM l WHERE label = 'red' HAVING count(*) > 0""",
    "months_and_times": """SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 1) THEN 'unknown' ELSE strftime(o_orderdate, '%B %Y') END AS month, CASE WHEN o_orderkey % 5 NOT IN (0, 1) THEN year(o_orderdate)::INT END AS year FROM orders""",
    "unverifiable_history": "SELECT user_id, NULL::BIGINT AS records, NULL::DOUBLE AS top, 0 AS available FROM events GROUP BY user_id",
    "merged_shards": f"WITH {edges()} SELECT upstream, downstream, round(ratio, 6) AS ratio FROM edges",
    "validation_by_alpha": f"WITH {LABELS}, al(alpha) AS (VALUES (0.05::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)), x AS (SELECT alpha, coalesce(qv <= alpha, false) AS a, b, c, st FROM labelled CROSS JOIN al) SELECT alpha, CASE WHEN a AND st AND (b OR c) THEN 'robust' WHEN a AND st THEN 'supported' WHEN a OR st OR b OR c THEN 'mixed' ELSE 'insufficient' END AS validation_status, count(*) AS edges FROM x GROUP BY ALL",
    "edge_seeds": f"SELECT p_brand, {crc32("'7|17|' || p_brand")} AS seed FROM (SELECT DISTINCT p_brand FROM part)",
    "grouped_folds": f"WITH {FOLDS} SELECT fold, count(*) AS rows, count(DISTINCT unit) AS units FROM folds GROUP BY fold",
    "fold_thresholds": f"""WITH {FOLDS}, th AS (SELECT k / 20 AS threshold FROM range(1, 20) AS t(k)), h(held) AS (VALUES (0), (1), (2), (3), (4)),
c AS (SELECT held, fold = held AS own, threshold, count(*) FILTER (target = 1) AS pos, count(*) FILTER (target = 0) AS neg, count(*) FILTER (target = 1 AND score >= threshold) AS tp, count(*) FILTER (target = 0 AND score >= threshold) AS fp FROM folds CROSS JOIN h CROSS JOIN th GROUP BY ALL),
m AS (SELECT *, coalesce(tp / nullif(pos, 0), 0) AS recall, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, (coalesce(tp / nullif(pos, 0), 0) + coalesce((neg - fp) / nullif(neg, 0), 0)) / 2 AS balanced FROM c),
best AS (SELECT held, threshold FROM m WHERE NOT own QUALIFY row_number() OVER (PARTITION BY held ORDER BY balanced DESC, recall DESC, precision DESC, threshold) = 1)
SELECT m.held AS fold, m.threshold::DOUBLE AS threshold, round(m.balanced, 6) AS balanced_accuracy FROM m JOIN best ON best.held = m.held AND best.threshold = m.threshold WHERE own""",
    "sampled_customers": f"WITH {SAMPLE} SELECT * FROM sample",
    "linked_orders_of_sample": f"WITH {SAMPLE} SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM sample) GROUP BY ALL",
    "masking_experiment": f"WITH {MASKED} SELECT item, round(from_all, 6) AS from_all, round(from_known, 6) AS from_known, round(from_known - from_all, 6) AS error FROM both_rates",
    "projected_scan": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderdate >= DATE '1998-01-01' AND o_orderstatus = 'F'",
}
