"""Permutation tests and bootstraps of patterns from stratum counts.

Shuffling labels within a stratum leaves its margins fixed, so the shuffled number of observed positives is hypergeometric; and
resampling episodes of a stratum with replacement draws its four cells from a multinomial. Draws therefore need one row of
counts for each pair and stratum, never the episodes. Pairs are grouped and sent to NumPy; a group has as many rows as strata.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.effects import SMOOTHING
from ..sources.tables import small
from . import adjusted
from .adjusted import Rows
from .opportunity import CELL
from .patterns import MIN_BRANCH, MIN_TOTAL, PAIR

COUNTS = ["n_pos", "k_pos", "n_neg", "k_neg"]


def seed_of(seed: int, salt: int, upstream: str, downstream: str) -> int:
    return zlib.crc32(f"{seed}|{salt}|{upstream}|{downstream}".encode())


def _ratio(k1, n1, k0, n0):
    return (k1 + SMOOTHING) / (n1 + 2 * SMOOTHING) / ((k0 + SMOOTHING) / (n0 + 2 * SMOOTHING))


def permuted(counts: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """Null ratios; counts: rows of (n_pos, k_pos, n_neg, k_neg) for each stratum."""
    random = np.random.default_rng(seed)
    n1, k1, n0, k0 = counts.T
    k = random.hypergeometric(k1 + k0, n1 + n0 - k1 - k0, n1, (draws, len(counts))).sum(1)
    return _ratio(k, n1.sum(), (k1 + k0).sum() - k, n0.sum())


def bootstrapped(counts: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """Resampled ratios; draws with an empty branch are left out."""
    random = np.random.default_rng(seed)
    total = np.zeros((draws, 4))
    for n1, k1, n0, k0 in counts:
        n = n1 + n0
        if n:
            total += random.multinomial(n, np.array([k1, n1 - k1, k0, n0 - k0]) / n, draws)
    a, b, c, d = total.T
    ok = (a + b > 0) & (c + d > 0)
    return _ratio(a, a + b, c, c + d)[ok]


def _grouped(strata: DataFrame) -> DataFrame:
    return strata.groupBy(*PAIR).agg(F.collect_list(F.struct(*[F.col(c).cast("bigint").alias(c) for c in COUNTS])).alias("strata"))


def permutation_test(strata: DataFrame, draws: int = 250, seed: int = 7, salt: int = 17) -> DataFrame:
    """(pair, ratio, p_one_sided, p_two_sided, null_median): strata has a row of counts for each pair and stratum."""

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for up, down, rows in zip(batch["upstream"], batch["downstream"], batch["strata"]):
                counts = np.array(sorted([r[c] for c in COUNTS] for r in rows), np.int64)
                n1, k1, n0, k0 = counts.sum(0)
                ratio = _ratio(k1, n1, k0, n0)
                null = permuted(counts, draws, seed_of(seed, salt, up, down))
                tail = (null >= ratio).sum() if ratio >= 1 else (null <= ratio).sum()
                both = (np.abs(np.log(null)) >= abs(np.log(ratio)) - 1e-12).sum()
                out.append((up, down, float(ratio), (tail + 1) / (draws + 1), (both + 1) / (draws + 1), float(np.median(null))))
            yield pd.DataFrame(out, columns=["upstream", "downstream", "ratio", "p_one_sided", "p_two_sided", "null_median"])

    return _grouped(strata).mapInPandas(test, "upstream string, downstream string, ratio double, p_one_sided double, p_two_sided double, null_median double")


def bootstrap(strata: DataFrame, draws: int = 250, seed: int = 7, salt: int = 31) -> DataFrame:
    """(pair, median, low, high, sign_stability) of resampled ratios."""

    def resample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for up, down, rows in zip(batch["upstream"], batch["downstream"], batch["strata"]):
                counts = np.array(sorted([r[c] for c in COUNTS] for r in rows), np.int64)
                n1, k1, n0, k0 = counts.sum(0)
                got = bootstrapped(counts, draws, seed_of(seed, salt, up, down))
                if len(got):
                    same = (got >= 1).mean() if _ratio(k1, n1, k0, n0) >= 1 else (got <= 1).mean()
                    out.append((up, down, float(np.median(got)), *map(float, np.percentile(got, [2.5, 97.5])), float(same)))
            yield pd.DataFrame(out, columns=["upstream", "downstream", "median", "low", "high", "sign_stability"])

    return _grouped(strata).mapInPandas(resample, "upstream string, downstream string, median double, low double, high double, sign_stability double")


def degeneracy(strata: DataFrame) -> DataFrame:
    """What a permutation can't move: strata, those with both labels, rows in them, the fixed share."""
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    rows = F.col("n_pos") + F.col("n_neg")
    out = strata.groupBy(*PAIR).agg(F.count("*").alias("n_strata"), F.count(F.when(both, 1)).alias("both_labels"), F.sum(F.when(both, rows).otherwise(0)).alias("permutable"), F.sum(rows).alias("rows"))
    return out.withColumn("fixed_share", 1 - F.col("permutable") / F.nullif(F.col("rows"), F.lit(0)))


#: Cumulative probabilities of the Poisson distribution with mean 1.
POISSON = np.cumsum([np.exp(-1.0) / math.factorial(k) for k in range(20)])


def unit_weights(hashes: np.ndarray, draws: int) -> np.ndarray:
    """units x draws: how often each draw takes a unit, Poisson with mean 1 and a function of the unit's hash alone.

    Uniform numbers are mixed bits (SplitMix64) of the hash and the draw's number.
    """
    with np.errstate(over="ignore"):
        z = hashes.astype(np.uint64)[:, None] + np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return np.searchsorted(POISSON, (z >> np.uint64(11)) * 2.0**-53, side="right")


#: Items of one number of bits; has many divisors, as a block of items is within one number.
BITS = 60


def _bits(column: str, condition: Column, items: int) -> list[Column]:
    """Aggregates <column>0, <column>1, ...: a bit for the number of each item with the condition, BITS to a number."""
    one = F.lit(1).cast("bigint")
    shift = lambda k: F.call_function("shiftleft", one, (F.col("number") - k).cast("int"))
    return [F.coalesce(F.bit_or(F.when(condition & F.col("number").between(k, k + BITS - 1), shift(k))), F.lit(0).cast("bigint")).alias(f"{column}{k // BITS}") for k in range(0, max(1, items), BITS)]


def unit_episodes(rows: Rows, per: int, seed: int) -> DataFrame:
    """(block, hash, shown..., eligible..., positive, negative): an episode's items as bits, once for each unit and block of `per` items with a result.

    positive, negative: the block's items with that result of the unit; shown: all items of the episode in the cell. A unit's result
    counts once for each episode, cell, item and outcome.
    """
    items = len(rows.items)
    words = range(0, max(1, items), BITS)
    names = lambda c: [f"{c}{k // BITS}" for k in words]
    cells = rows.cells.select("cell", *CELL, F.explode("eligible").alias("number")).groupBy("cell", *CELL).agg(*_bits("eligible", F.lit(True), items))
    results = rows.observed.join(small(cells), CELL).withColumn("hash", F.xxhash64("cluster", F.lit(seed)))
    outcome = F.col("outcome")
    kept = [*_bits("mine", F.lit(True), items), *_bits("positive", outcome == rows.positive, items), *_bits("negative", outcome == rows.negative, items)]
    each = results.groupBy("episode", "cell", "hash", *names("eligible")).agg(*kept)
    together = Window.partitionBy("episode", "cell")  # an episode's results may be of several units
    each = each.withColumns({s: F.bit_or(m).over(together) for s, m in zip(names("shown"), names("mine"))})
    mask = F.lit((1 << per) - 1).cast("bigint")
    part = lambda c, k: F.shiftright(f"{c}{k // BITS}", k % BITS).bitwiseAND(mask)
    blocks = F.array(*[F.struct(F.lit(k // per).alias("block"), part("positive", k).alias("positive"), part("negative", k).alias("negative")) for k in range(0, max(1, items), per)])
    return each.select("hash", *names("shown"), *names("eligible"), F.inline(blocks)).where("positive <> 0 or negative <> 0")


def _unpacked(words: list[np.ndarray], width: int) -> np.ndarray:
    """rows x width of 0 and 1 from numbers of BITS bits."""
    return np.concatenate([(w[:, None] >> np.arange(min(BITS, width - k * BITS))) & 1 for k, w in enumerate(words)], 1)


def unit_bootstrap(rows: Rows, draws: int = 250, seed: int = 7) -> DataFrame:
    """(pair, median, low, high): units are resampled with all their results, over rows in cells in which the downstream item is eligible.

    A unit's weight in each draw comes from its hash, so its rows may be anywhere and no unit must be whole in a task: tasks add
    weighted counts for each pair and draw, Spark adds those. A unit's episodes mostly meet, so that weights are drawn and
    multiplied once for a unit; a unit of very many is split by Spark. Weights are Poisson, which multinomial ones tend to; the
    number of units of a site so varies from draw to draw. Draws with an empty branch are left out; a pair without any has no row.
    """
    items = len(rows.items)
    counts = ["n_pos", "k_pos", "n_neg", "k_neg"]
    # sums of a block of upstream items are bounded; a block is within one number of bits
    per = max(d for d in range(1, BITS + 1) if BITS % d == 0 and d <= max(1, adjusted.CELLS // max(1, items * draws)))
    per = per if per < items else max(1, items)
    most = max(1, adjusted.CELLS // max(1, 2 * items, draws))
    frame = unit_episodes(rows, per, seed).hint("rebalance", F.col("block"), F.col("hash")).sortWithinPartitions("block", "hash")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def result():
            n = total.reshape(2, per, 2, items, draws)  # outcome, upstream, eligible or shown, downstream
            n = n.transpose(1, 3, 0, 2, 4).reshape(per, items, len(counts) * draws)
            up, model = np.nonzero(n.any(2))
            other = up + now * per != model  # an item is never eligible for its own results
            up, model = up[other], model[other]
            return pa.RecordBatch.from_arrays([pa.array((up + now * per).astype(np.int32)), pa.array(model.astype(np.int32)), pa.array(list(n[up, model]), pa.list_(pa.float64()))], ["up", "model", "sums"])

        for batch in batches:
            column = {name: batch.column(k).to_numpy() for k, name in enumerate(batch.schema.names)}
            edges = np.flatnonzero(np.r_[True, np.diff(column["block"]) != 0, True]) if batch.num_rows else []
            for a, b in [(k, min(k + most, e)) for s, e in zip(edges[:-1], edges[1:]) for k in range(s, e, most)]:
                if column["block"][a] != now:
                    if now is not None:
                        yield result()
                    now, total = int(column["block"][a]), np.zeros((2 * per, 2 * items, draws))
                of = {name: v[a:b] for name, v in column.items()}
                add(of, total)
        if now is not None:
            yield result()

    def add(of: dict[str, np.ndarray], total: np.ndarray) -> None:
        new = np.r_[True, np.diff(of["hash"]) != 0]
        unit = np.cumsum(new) - 1
        # whole numbers, and sums of a piece are below 2^24, so single precision is exact
        weights = unit_weights(of["hash"][new], draws).astype(np.float32)
        words = range(0, max(1, items), BITS)
        allowed, shown = (_unpacked([of[f"{c}{k // BITS}"] for k in words], items) for c in ("eligible", "shown"))
        x = np.concatenate([allowed, allowed & shown], 1).astype(np.float32)
        up, row = np.nonzero(np.ascontiguousarray(np.concatenate([_unpacked([of[c]], per) for c in ("positive", "negative")], 1).T, bool))
        first = np.flatnonzero(np.r_[True, (np.diff(up) != 0) | (np.diff(unit[row]) != 0)])  # rows of a unit are next to each other, mostly
        sums, up, unit = np.add.reduceat(x[row], first), up[first], unit[row[first]]
        at = np.flatnonzero(np.r_[True, np.diff(up) != 0, True])
        for s, e in zip(at[:-1], at[1:]):
            total[up[s]] += sums[s:e].T @ weights[unit[s:e]]

    def quantiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for up, model, sums in zip(batch["up"], batch["model"], batch["sums"]):
                n1, k1, n0, k0 = np.asarray(sums).reshape(len(counts), draws)
                got = _ratio(k1, n1, k0, n0)[(n1 > 0) & (n0 > 0)]
                if len(got):
                    out.append((up, model, float(np.median(got)), *map(float, np.percentile(got, [2.5, 97.5]))))
            yield pd.DataFrame(out, columns=["up", "model", "median", "low", "high"])

    sums = adjusted.added(frame.mapInArrow(scan, adjusted.SUMS))
    return rows.named(sums.mapInPandas(quantiles, "up int, model int, median double, low double, high double")).select(*PAIR, "median", "low", "high")


def pooled_draws(counts: np.ndarray) -> np.ndarray:
    """Pooled log ratio (DerSimonian-Laird) of each draw over the sites that pass its gates, not a number with fewer than two; counts: draws x sites x 4."""
    n1, k1, n0, k0 = np.moveaxis(counts.astype(float), -1, 0)
    ok = (n1 + n0 >= MIN_TOTAL) & (n1 >= MIN_BRANCH) & (n0 >= MIN_BRANCH)
    y = np.log(_ratio(k1, n1, k0, n0))
    v = 1 / (k1 + SMOOTHING) - 1 / (n1 + 2 * SMOOTHING) + 1 / (k0 + SMOOTHING) - 1 / (n0 + 2 * SMOOTHING)
    ok &= v > 0
    w = np.where(ok, 1 / np.where(ok, v, 1), 0.0)
    sites, total = ok.sum(-1), w.sum(-1)
    with np.errstate(all="ignore"):
        mean = (w * y).sum(-1) / total
        q = (w * (y - mean[..., None]) ** 2).sum(-1)
        c = total - (w * w).sum(-1) / total
        tau2 = np.where(c > 0, np.maximum(0, (q - (sites - 1)) / np.where(c > 0, c, 1)), 0)
        w = np.where(ok, 1 / (v + tau2[..., None]), 0.0)
        return np.where(sites >= 2, (w * y).sum(-1) / w.sum(-1), np.nan)


def between_site_permutation(strata: DataFrame, draws: int = 250, seed: int = 7, salt: int = 53) -> DataFrame:
    """(pair, pooled_log_ratio, p_one_sided, p_two_sided): label and outcome move jointly across sites of fixed sizes (sites in name order).

    The statistic is the random-effects mean of log ratios; each draw applies the gates of support to its own sites and has its
    own variance between them. Cells of a site are a multivariate hypergeometric draw from all cells. A pair with fewer than two
    sites that pass has nulls; draws with fewer than two don't count.
    """
    grouped = strata.groupBy(*PAIR).agg(F.collect_list(F.struct("site", *[F.col(c).cast("bigint").alias(c) for c in COUNTS])).alias("strata"))

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for up, down, rows in zip(batch["upstream"], batch["downstream"], batch["strata"]):
                counts = np.array([r[1:] for r in sorted((r["site"], *[r[c] for c in COUNTS]) for r in rows)], np.int64)
                now = float(pooled_draws(counts[None])[0])
                if np.isnan(now):
                    out.append((up, down, None, None, None))
                    continue
                null = pooled_draws(shuffled_sites(counts, draws, seed_of(seed, salt, up, down)))
                null = null[~np.isnan(null)]
                one = (null >= now - 1e-12).sum() if now >= 0 else (null <= now + 1e-12).sum()
                both = (np.abs(null) >= abs(now) - 1e-12).sum()
                out.append((up, down, now, (one + 1) / (len(null) + 1), (both + 1) / (len(null) + 1)))
            yield pd.DataFrame(out, columns=["upstream", "downstream", "pooled_log_ratio", "p_one_sided", "p_two_sided"])

    return grouped.mapInPandas(test, "upstream string, downstream string, pooled_log_ratio double, p_one_sided double, p_two_sided double")


def shuffled_sites(counts: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """draws x sites x 4: counts after rows were dealt out to the sites again, each with as many as before."""
    random = np.random.default_rng(seed)
    n1, k1, n0, k0 = counts.T
    left = np.tile(np.array([k1.sum(), n1.sum() - k1.sum(), k0.sum(), n0.sum() - k0.sum()]), (draws, 1))
    drawn = np.zeros((draws, len(counts), 4))
    for s, size in enumerate(n1 + n0):
        want, rest = np.full(draws, size), left.sum(1)
        cell = np.zeros((draws, 4), np.int64)
        for c in range(4):  # a multivariate hypergeometric draw, cell by cell, for all draws at once
            rest = rest - left[:, c]
            cell[:, c] = random.hypergeometric(left[:, c], rest, want)
            want = want - cell[:, c]
        left -= cell
        drawn[:, s] = np.stack([cell[:, 0] + cell[:, 1], cell[:, 0], cell[:, 2] + cell[:, 3], cell[:, 2]], 1)
    return drawn
