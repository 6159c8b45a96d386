"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are character 1- to 3-grams of letters (everything else is a space), hashed to BUCKETS; a feature's value is its share
of the document's n-grams times its inverse document frequency. The model is trained by follow-the-regularised-leader with
elastic-net penalties, which leaves most weights at zero, and its probabilities are calibrated by a temperature.

Document frequencies are counted over all training documents. The weights are fitted on at most SAMPLE of them, those whose
hashes of id and text come first in each language, a fifth of which sets the temperature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import prepare

BITS = 16
BUCKETS = 1 << BITS
ORDERS = 3
#: Most documents, over all languages, that the weights are fitted on.
SAMPLE = 4_000
EPOCHS = 3
#: Scale of feature values, and the settings of follow-the-regularised-leader.
SCALE, ALPHA, BETA, L1, L2 = 100.0, 0.1, 1.0, 0.02, 0.01
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Code of each letter, 32 for everything else."""
    if not _letters:
        _letters.append(np.fromiter((c if chr(c).isalpha() else 32 for c in range(0x110000)), np.uint32, 0x110000))
    return _letters[0]


def buckets(text: str) -> list[np.ndarray] | None:
    """Buckets of the text's n-grams, an array for each order; None if there is no letter."""
    codes = _letter_table()[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not (codes != 32).any():
        return None
    out, mixed = [], np.zeros(0, np.uint32)
    with np.errstate(over="ignore"):
        for order in range(ORDERS):
            last = codes[order:]
            mixed = (mixed[: len(last)] if order else np.zeros(len(last), np.uint32)) * np.uint32(0x85EBCA6B) + (last + np.uint32(order + 1)) * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
            out.append((mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS))
    return out


def _document_frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bucket -1 counts the documents."""
    total, n, seen = np.zeros(BUCKETS, np.int64), 0, np.zeros(BUCKETS, bool)
    for batch in batches:
        for text in batch["text"]:
            grams = buckets(text)
            if grams is not None:
                seen[:] = False
                for h in grams:
                    seen[h] = True
                total += seen
                n += 1
    if n:
        held = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": np.append(held, -1), "n": np.append(total[held], n)})


def _sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for lang, order, text in zip(batch["lang"], batch["place"], batch["text"]):
            grams = buckets(text)
            if grams is not None:
                at, n = np.unique(np.concatenate(grams), return_counts=True)
                out.append((lang, order, at.astype("<u4").tobytes(), (n / n.sum()).astype("<f4").tobytes()))
        if out:
            yield pd.DataFrame(out, columns=["lang", "place", "at", "share"])


@dataclass
class Model:
    """languages, weights[language][bucket] times inverse document frequency, constants, temperature."""

    languages: list[str]
    weights: np.ndarray
    constants: np.ndarray
    temperature: float = 1.0

    def predict(self, text: str | None) -> tuple[str, float]:
        grams = buckets(text) if text and self.languages else None
        if grams is None:
            return UNKNOWN, 0.0
        total = sum(map(len, grams))
        z = np.array([sum(float(w[h].sum(dtype=np.float64)) for h in grams) for w in self.weights]) * (SCALE / total) + self.constants
        p = _softmax(z / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (BUCKETS + 1, classes) by follow-the-regularised-leader; the last row is the unpenalised constant."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(at):
        shrunk = np.where(np.abs(z[at]) > L1, z[at] - np.sign(z[at]) * L1, 0.0)
        w = -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        w[-1] = -z[BUCKETS] / ((BETA + np.sqrt(n[BUCKETS])) / ALPHA)
        return w

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            at, x, y = rows[r]
            w = weights(at)
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(BUCKETS + 1))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """A model from docs' texts and languages; rows to be held out must be left out of docs.

    Rows with a null text or language, or without letters, don't count. Repeated rows (equal id, text and language) count once in
    the sample of `sample` documents; rows that share an id only are documents of their own. One language only: it is always
    predicted; none, or an empty table: `und`.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    rows = rows.select("text", "lang", F.xxhash64(F.col("id").cast("string"), "text").alias("hash"))
    counted = rows.select("text").mapInPandas(_document_frequencies, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    frequency = {r["bucket"]: r["n"] for r in counted.collect()}  # at most BUCKETS + 1 rows
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n")).collect()}  # a row for each language
    languages = sorted(sizes)
    if not languages or -1 not in frequency:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros(0))
    df = np.zeros(BUCKETS)
    for k, n in frequency.items():
        if k >= 0:
            df[k] = n
    idf = np.log((1 + frequency[-1]) / (1 + df)) + 1
    most = max(1, sample // len(languages))
    # hashes are even over their range: those below twice the wanted share hold the first `most` of a language, and only they are shuffled
    cuts = spark.createDataFrame([(k, 2.0 * (most + 50) / n) for k, n in sizes.items()], "lang string, share double")
    near = rows.join(F.broadcast(cuts), "lang").where(F.col("hash").cast("double") / 2.0**64 + 0.5 < F.col("share"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "text"))
    chosen = near.select("lang", "hash", "text").dropDuplicates().withColumn("place", place).where(F.col("place") <= most).select("lang", "place", "text")
    got = chosen.mapInPandas(_sparse, "lang string, place int, at binary, share binary").toPandas().sort_values(["place", "lang"], kind="stable")
    data = []
    for lang, at, share in zip(got["lang"], got["at"], got["share"]):
        at = np.frombuffer(at, "<u4").astype(np.int64)
        data.append((np.append(at, BUCKETS), np.append(np.frombuffer(share, "<f4") * idf[at] * SCALE, 1.0), languages.index(lang)))
    kept_back = [k % 5 == 4 for k in range(len(data))]
    w = ftrl([d for d, b in zip(data, kept_back) if not b], len(languages))
    temperature = _temperature([(x @ w[at], y) for (at, x, y), b in zip(data, kept_back) if b])
    return Model(languages, np.ascontiguousarray((w[:BUCKETS] * idf[:, None]).T, dtype=np.float32), w[BUCKETS], temperature)


def _temperature(held: list[tuple[np.ndarray, int]]) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm."""
    if not held:
        return 1.0
    z, y = np.array([h[0] for h in held]), np.array([h[1] for h in held])
    loss = lambda t: -np.log(_softmax(z / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean() + 1e-4 * t * t
    lo, hi, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def identify(df: DataFrame, model: Model, text_col: str = "text", out_col: str = "language") -> DataFrame:
    """df with a struct (lang, score in [0, 1]) of each whole text: `und` with score 0 if it is null or has no letter. Map-only.

    The model (BUCKETS weights for each language) is broadcast. Repeated rows and null ids are scored like others; an empty table
    gives no rows. A column of df that has the output's name is replaced.
    """
    prepare(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def column(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([sent.value.predict(t) for t in texts], columns=["lang", "score"]).astype({"score": "float64"})

    return df.withColumn(out_col, F.pandas_udf(column, "lang string, score double")(F.col(text_col).cast("string")))
