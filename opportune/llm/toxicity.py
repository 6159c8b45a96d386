"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding undoes disguise: look-alike letters of other scripts and full-width forms become Latin letters, digits and signs that
stand for letters inside words become those letters, zero-width characters and combining marks go. A document's score is a
logistic function of the summed weights of its matches, absolute and per word, without matches inside exception phrases.

The lexicon (whole words and word beginnings), its weights, the exception phrases and the logistic function are learned from
labelled documents, on a bounded sample: at most SAMPLE documents of each class, those whose hashed ids come first, and one of
each group of near copies.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, chunks, written

#: Most labelled documents of each class that the lexicon is learned from.
SAMPLE = 8_000
#: Most candidate terms that the driver takes from the sample, and most characters of a lexicon, which is broadcast: beyond them learning raises.
CANDIDATES, LEXICON_CHARS = 2_000_000, 16_000_000
#: Lengths of word beginnings that may become terms.
BEGINNINGS = (3, 4, 5, 6, 7, 8)
#: How much more frequent a term must be in toxic documents.
RATIO = 4
THRESHOLD = 0.7

# Look-alike letters and the Latin letters that they imitate.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "α": "a", "β": "b", "ε": "e", "η": "n",
    "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l",
}
# Digits and signs written for letters; i and l share one form because 1 stands for both.
DIGIT_LETTERS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGN_LETTERS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}

_SPACE, _GONE = 32, 0
_WORD = re.compile(r"\S+")
_tables: dict[str, np.ndarray] = {}


def _fold_tables() -> dict[str, np.ndarray]:
    if not _tables:
        form = np.arange(0x110000, dtype=np.uint32)
        kind = np.zeros(0x110000, np.uint8)  # 1: letter, 2: digit that stands for a letter, 3: sign that stands for a letter
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                kind[c] = 1
            elif not s.isdigit():
                form[c] = _GONE if unicodedata.category(s) in ("Mn", "Me", "Cf") else _SPACE
        for c in range(0xFF01, 0xFF5F):  # full-width forms
            form[c] = c - 0xFEE0 if chr(c - 0xFEE0).isalnum() else _SPACE
        for a, b in LOOK_ALIKES.items():
            form[ord(a)] = ord(b)
        form[ord("l")] = form[ord("ӏ")] = form[ord("ⅼ")] = ord("i")
        letter = form.copy()
        for k, pairs in ((2, DIGIT_LETTERS), (3, SIGN_LETTERS)):
            for a, b in pairs.items():
                kind[ord(a)], letter[ord(a)] = k, ord(b)
        _tables.update(form=form, kind=kind, letter=letter)
    return _tables


def fold(text: str) -> str:
    """The text in the form that terms are written in: folded words between single or more spaces, a space at either end."""
    t = _fold_tables()
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = t["kind"][code]
    out = t["form"][code]
    before, after = np.roll(kind, 1), np.roll(kind, -1)
    digit = (kind == 2) & ((before == 1) | (after == 1))
    sign = (kind == 3) & (after == 1)
    swap = np.flatnonzero(digit | sign)
    out[swap] = t["letter"][code[swap]]
    return out[out != _GONE].tobytes().decode("utf-32-le", "surrogatepass")


@dataclass
class Lexicon:
    """Terms in folded form (" word " or the beginning " word") with weights, exception phrases, and the logistic function."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    bias: float = -50.0
    by_sum: float = 0.0
    by_share: float = 0.0

    def __post_init__(self):
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for term, weight in self.terms.items():
                self._automaton.add_word(term, (len(term), weight))
            for phrase in self.exceptions:
                self._automaton.add_word(phrase, (len(phrase), None))
            if len(self._automaton):
                self._automaton.make_automaton()
        return self._automaton

    def matches(self, folded: str) -> dict[int, float]:
        """Start of each matched word to its largest weight; words inside exception phrases don't count."""
        found: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        automaton = self.automaton()
        if len(automaton):
            for end, (size, weight) in automaton.iter(folded):
                start = end - size + 1
                if weight is None:
                    excused.append((start, end))
                elif weight > found.get(start, 0):
                    found[start] = weight
        for lo, hi in excused:
            for s in [s for s in found if lo <= s < hi]:
                del found[s]
        return found

    def features(self, text: str) -> tuple[float, float, int]:
        """Log of the summed weight, log of it per hundred words, number of matches."""
        folded = fold(text)
        found = self.matches(folded)
        if not found:
            return 0.0, 0.0, 0
        total = sum(found.values())
        return math.log1p(total), math.log1p(100 * total / max(1, len(folded.split()))), len(found)

    def score(self, by_sum: float, by_share: float) -> float:
        z = self.bias + self.by_sum * by_sum + self.by_share * by_share
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def _copy_key(words: list[str]) -> int:
    """Least hash of the five-word shingles: near copies mostly share it."""
    if len(words) < 6:
        return zlib.crc32(" ".join(words).encode())
    h = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    mixed = np.zeros(len(h) - 4, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(5):
            mixed = (mixed ^ h[k : len(h) - 4 + k]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
    return int(mixed.min() >> np.uint64(1))


def _folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [fold(t or "") for t in batch["text"]]
        yield pd.DataFrame({"toxic": batch["toxic"].astype("int32"), "copy_key": [_copy_key(t.split()) for t in texts], "text": batch["text"].fillna("")})


def _terms_of(folded: str) -> set[str]:
    words = {*folded.split()}
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in BEGINNINGS if len(w) >= k}


def _count_terms(wanted=None):
    """Counts, summed within the task, of the documents that hold each term."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                terms = _terms_of(fold(text))
                total.update(terms if wanted is None else terms & wanted.value)
        if total:
            yield pd.DataFrame({"term": list(total), "n": list(total.values())})

    return count


def _around(folded: str, start: int) -> tuple[str, str, str]:
    """The word that begins after the space at start, the next word and the one before; empty where there is none."""
    one = _WORD.search(folded, start)
    two = _WORD.search(folded, one.end()) if one else None
    end = start
    while end and folded[end - 1] == " ":
        end -= 1
    return one[0] if one else "", two[0] if two else "", folded[folded.rfind(" ", 0, end) + 1 : end]


def _count_phrases(lexicon):
    """Two-word phrases around matches, with the class: where clean documents hold them, they may be exceptions."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for batch in batches:
            for toxic, text in zip(batch["toxic"], batch["text"]):
                folded = fold(text)
                phrases = set()
                for start in lexicon.value.matches(folded):
                    one, two, before = _around(folded, start)
                    phrases |= {f" {' '.join(p)} " for p in ((one, two), (before, one)) if all(p)}
                total.update((p, toxic) for p in phrases)
        if total:
            yield pd.DataFrame({"term": [p for p, _ in total], "toxic": [int(t) for _, t in total], "n": list(total.values())})

    return count


def _features_of(lexicon):
    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [lexicon.value.features(t) for t in batch["text"]]
            yield pd.DataFrame({"toxic": batch["toxic"], "a": [r[0] for r in rows], "b": [r[1] for r in rows]})

    return features


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weighted ridge logistic regression by Newton's method; the first column is the constant."""
    beta, penalty = np.zeros(x.shape[1]), np.eye(x.shape[1]) * ridge
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """A lexicon from docs (id, text) and labels (id, toxic 0 or 1); rows to be held out must be left out of labels.

    At most `sample` documents of each class are used: of near copies the one of the least hash, and of documents that share an
    id as many as that leaves room for. Labels that are null or have no document don't count, repeated labels count once and 1
    goes before 0; without documents of both classes (an empty table, say) the lexicon is empty and scores 0. The result doesn't
    depend on how the rows are dealt out. No term or phrase that qualifies is left out: too many for the driver or a broadcast raise ValueError.
    """
    spark = docs.sparkSession
    prepare(spark)
    known = labels.where("toxic in (0, 1)").select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    size = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if size.keys() != {0, 1}:
        return Lexicon()
    order = [F.xxhash64(F.col("id").cast("string")), F.col("id")]
    some = [known.where(F.col("toxic") == k).orderBy(*order).limit(sample) for k in (0, 1)]
    chosen = F.broadcast(some[0].unionByName(some[1]))  # at most 2 * sample rows
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(chosen, "id")
    rows = rows.select("toxic", "text").mapInPandas(_folded, "toxic int, copy_key bigint, text string")
    hashed = F.xxhash64("text")
    rows = rows.groupBy("toxic", "copy_key").agg(F.min(F.struct(hashed.alias("hash"), "text")).alias("least")).select("toxic", "least.*")
    rows = written(rows, "toxicity-sample")
    # as many rows as ids, unless ids are repeated: then the first by hash, so that the sample's bound holds
    last = {k: rows.where(F.col("toxic") == k).select("hash").orderBy("hash").limit(sample).agg(F.max("hash")).first()[0] for k in (0, 1)}
    rows = rows.where(" or ".join(f"(toxic = {k} and hash <= {h}L)" for k, h in last.items() if h is not None) or "false").select("toxic", "text")
    held = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if held.keys() != {0, 1}:
        return Lexicon()
    total = lambda df, *by: df.groupBy(*by).agg(F.sum("n").alias("n"))
    support = max(5, math.ceil(0.005 * held[1]))
    toxic = total(rows.where("toxic = 1").mapInPandas(_count_terms(), "term string, n bigint"), "term").where(F.col("n") >= support)
    in_toxic = {r["term"]: r["n"] for r in toxic.limit(CANDIDATES + 1).collect()}
    if len(in_toxic) > CANDIDATES:
        raise ValueError(f"over {CANDIDATES} terms in the sample: take a smaller one")
    wanted = spark.sparkContext.broadcast(frozenset(in_toxic))
    in_clean = {r["term"]: r["n"] for r in total(rows.where("toxic = 0").mapInPandas(_count_terms(wanted), "term string, n bigint"), "term").collect()}
    lexicon = Lexicon(_choose(in_toxic, in_clean, held[1], held[0]))
    sent = spark.sparkContext.broadcast(lexicon)
    phrases = rows.mapInPandas(_count_phrases(sent), "term string, toxic int, n bigint").groupBy("term").pivot("toxic", [0, 1]).agg(F.sum("n")).fillna(0, ["0", "1"])
    phrases = phrases.where((F.col("0") >= 3) & (F.col("0") * held[1] > F.col("1") * held[0]))
    lexicon.exceptions = sorted(r["term"] for r in phrases.select("term").limit(CANDIDATES + 1).collect())
    if len(lexicon.exceptions) > CANDIDATES or sum(map(len, [*lexicon.terms, *lexicon.exceptions])) > LEXICON_CHARS:
        raise ValueError("the lexicon is too large to broadcast: take a smaller sample")
    sent = spark.sparkContext.broadcast(lexicon)
    got = rows.mapInPandas(_features_of(sent), "toxic int, a double, b double").toPandas()  # at most 2 * sample rows
    got = got.sort_values(["toxic", "a", "b"])  # sums don't depend on the order of the tasks
    y = got["toxic"].to_numpy(float)
    weight = np.where(y == 1, size[1] / held[1], size[0] / held[0])
    beta = _logistic(np.column_stack([np.ones(len(got)), got["a"], got["b"]]), y, weight / weight.mean())
    lexicon.bias, lexicon.by_sum, lexicon.by_share = map(float, beta)
    return lexicon


def _choose(in_toxic: dict, in_clean: dict, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Terms at least RATIO times as frequent in toxic documents, strongest first.

    Among terms that say the same (a word, its beginnings) the longest stays: a term is left out if one that it begins with was
    chosen, or one that begins with it and has four fifths of its documents. Terms under twice RATIO come after the others, and
    any chosen longer term rules them out.
    """
    rated = []
    for term, a in in_toxic.items():
        b = in_clean.get(term, 0)
        # both rates at the careful end of their ranges
        low, high = (a - math.sqrt(a)) / n_toxic, (b + 0.5 + math.sqrt(b)) / n_clean
        if low > 0 and low >= RATIO * high:
            rated.append((low < 2 * RATIO * high, round(a * math.log(low / high), 6), term, math.log((a + 0.5) / n_toxic / ((b + 0.5) / n_clean))))
    out: dict[str, float] = {}
    best_longer: dict[str, int] = {}  # beginnings of chosen terms to the most documents of such a term
    for weak, _, term, weight in sorted(rated, key=lambda r: (r[0], -r[1], -len(r[2]), r[2])):
        covered = any(term[:k] in out for k in range(2, len(term)))
        if not covered and best_longer.get(term, 0) < (1 if weak else 0.8 * in_toxic[term]):
            out[term] = weight
            for k in range(2, len(term)):
                best_longer[term[:k]] = max(best_longer.get(term[:k], 0), in_toxic[term])
    return out


def score(df: DataFrame, lexicon: Lexicon, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """df with a struct (score double in [0, 1], matches int) of each whole text; null counts as empty. Map-only.

    The lexicon (at most LEXICON_CHARS characters, see learn) is broadcast. Repeated rows and null ids are scored like others; an
    empty table gives no rows. A column of df that has the output's name is replaced.
    """
    prepare(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(lexicon)

    def column(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for texts in batches:
            rows = [model.features(t) for block in chunks(texts) for t in block]
            yield pd.DataFrame({"score": [model.score(a, b) for a, b, _ in rows], "matches": [n for *_, n in rows]}).astype({"score": "float64", "matches": "int32"})

    return df.withColumn(out_col, F.pandas_udf(column, "score double, matches int")(F.col(text_col).cast("string")))
