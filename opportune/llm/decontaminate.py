"""Benchmark decontamination: rare n-gram seeds propose pairs of passage and test item, Smith-Waterman alignment scores them.

Texts are words: lower case, ASCII punctuation dropped; a character of a script without spaces is a word. Seeds are the items'
word triples, in a row or with one word left out between (SHAPES), so a copy has seeds even if every third word was changed, or
one was put in after every second. Rarity decides where a seed counts: a copy of an item of n different words that must have k
of them in common has one of the item's n - k + 1 rarest (a prefix filter, exact), so where many items hold a stretch's seeds,
only those are looked at of which one of the rarest words stands there. An opening that thousands of items share costs nothing
elsewhere, and no seed is left out for being frequent. Documents are scanned in one map-only pass; only passages around seeds leave it, with the
items that they share seeds and enough words with. Pairs are aligned word by word, so edited and paraphrased copies score by
what they kept.

Items are handled in blocks of at most BLOCK seeds, whose hashes, seeds and words are broadcast; a larger benchmark takes more
scans of the documents, one for each block, and never a larger broadcast.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import gather
from .common import possibly_in, prepare, unused, written

#: Places of a seed's three words: in a row, or with one left out.
SHAPES = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
#: Least number of words of an item.
SEED = 3
#: Most seeds of the items that are searched for in one scan.
BLOCK = 1_000_000
#: Owners of a stretch's seeds up to which all of them are looked at.
FEW = 20_000
#: Numbers in each table of the alignments that advance together; bounds a worker's memory.
CELLS = 1 << 19
#: Alignment: points of an equal word, cost of another word, cost of a missing or added word.
MATCH, MISMATCH, SKIP = 2, 1, 1
#: An item of more words counts as this long: a copied stretch of a long item is a leak as well.
LONG_ITEM = 80
THRESHOLD = 0.5
#: Least number of words (or all of a shorter item) that a leak has in common with the item.
LEAST_WORDS = 8

_KEEP = bytes(c if c >= 0x80 or chr(c).isalnum() else 32 for c in range(256))
# Thai, Lao, Burmese, Khmer, Kana and Han, which are written without spaces.
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\U00020000-\U0003ffff])")
_QUOTES = str.maketrans(dict.fromkeys("“”„‘’«»–—…·¿¡", " "))


def words_of(text: str) -> list[bytes]:
    text = text.lower()
    if not text.isascii():
        text = text.translate(_QUOTES) if any(q in text for q in "“”„‘’«»–—…·¿¡") else text
        text = _UNSPACED.sub(r" \1 ", text)
    return text.encode("utf-8", "surrogatepass").translate(_KEEP).split()


def seed_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the word triples of all SHAPES, and the place of each one's first word, by place."""
    if len(words) < SEED:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    every, at = [], []
    with np.errstate(over="ignore"):
        for shape in SHAPES:
            n = len(h) - shape[-1]
            if n > 0:
                out = np.zeros(n, np.uint64)
                for k, offset in enumerate(shape):
                    out = (out + h[offset : offset + n] + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
                    out ^= out >> np.uint64(32)
                every.append(out)
                at.append(np.arange(n))
    at = np.concatenate(at)
    order = np.argsort(at, kind="stable")
    return np.concatenate(every)[order], at[order]


def _items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        words = [words_of(t) for t in batch["text"]]
        yield pd.DataFrame({"item_id": batch["item_id"], "words": [[w.decode("utf-8", "replace") for w in ws] for ws in words], "seeds": [np.unique(seed_hashes(ws)[0]).view(np.int64).tolist() for ws in words]})


def points_needed(item_words: int, threshold: float) -> int:
    """Least points of a leak of an item of so many words."""
    return max(MATCH * min(item_words, LEAST_WORDS), math.ceil(threshold * MATCH * min(item_words, LONG_ITEM) - 1e-9))


class Seeds:
    """Seeds of a block of items, for scans: sorted hashes, the items of each, the items of each rare word, and what a bound on an item's score needs."""

    def __init__(self, words: list[list[str]], seeds: list[list[int]], threshold: float):
        flat = np.concatenate([np.array(x, np.int64) for x in seeds]).view(np.uint64)
        order = np.argsort(flat, kind="stable")
        self.owners = np.repeat(np.arange(len(seeds), dtype=np.int32), [len(x) for x in seeds])[order]
        self.hashes, starts = np.unique(flat[order], return_index=True)
        self.starts = np.append(starts, len(flat))
        self.words = [frozenset(w.encode("utf-8", "surrogatepass") for w in ws) for ws in words]
        #: distinct words that an item must have in common with a passage: a repeated word counts as if it were matched each time
        self.least = [-(-points_needed(len(ws), threshold) // MATCH) - (len(ws) - len(own)) for ws, own in zip(words, self.words)]
        self.margin = max(map(len, words))
        held = Counter(w for own in self.words for w in own)
        rare: dict[bytes, list[int]] = {}
        for item, (own, least) in enumerate(zip(self.words, self.least)):
            for w in sorted(own, key=lambda w: (held[w], w))[: len(own) - max(least, 1) + 1]:
                rare.setdefault(w, []).append(item)
        self.rare = {w: np.array(items, np.int32) for w, items in rare.items()}

    def found(self, seen: np.ndarray, shift: np.uint64, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the hashes that are seeds, and of those seeds."""
        some = np.flatnonzero(seen[h >> shift])
        seed = np.minimum(np.searchsorted(self.hashes, h[some]), len(self.hashes) - 1)
        true = self.hashes[seed] == h[some]
        return some[true], seed[true]

    def owned(self, seed: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each (seed, item) of the given items (ascending): numbers within both lists. Costs as much as the shorter of a seed's owners and the items."""
        starts, stops = self.starts[seed], self.starts[seed + 1]
        long = np.flatnonzero(stops - starts > 8 * len(items))
        short = np.flatnonzero(stops - starts <= 8 * len(items))
        sizes = stops[short] - starts[short]
        owner, _ = gather(self.owners, starts[short], sizes)
        at = np.minimum(np.searchsorted(items, owner), len(items) - 1)
        mine = items[at] == owner
        numbers, found = [np.repeat(short, sizes)[mine]], [at[mine]]
        for k in long.tolist():
            own = self.owners[starts[k] : stops[k]]
            at = np.minimum(np.searchsorted(own, items), len(own) - 1)
            has = np.flatnonzero(own[at] == items)
            numbers.append(np.full(len(has), k))
            found.append(has)
        return np.concatenate(numbers), np.concatenate(found)

    def passages(self, words: list[bytes], at: np.ndarray, seed: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
        """(first, past last, items): pieces of a document with seeds of those items and enough of their words; at: places of the seeds found.

        The document is taken in stretches that overlap by what an alignment may span, three times the longest item: each alignment
        is whole in one. Where a stretch's seeds have over FEW owners, only items of which it has a rare word are looked at, and as
        many at a time as have CELLS places; others couldn't have enough words, so nothing depends on it but the cost.
        """
        step = 3 * self.margin
        for start in range(0, max(1, len(words) - step), step):
            part = slice(*np.searchsorted(at, [start, start + 2 * step]))
            if part.stop == part.start:
                continue
            first = self.starts[seed[part]]
            sizes = self.starts[seed[part] + 1] - first
            if sizes.sum() <= FEW:
                spans = self._spans(words, gather(self.owners, first, sizes)[0], np.repeat(at[part], sizes))
            else:
                spans = self._rare_spans(words, start, start + 2 * step, at[part], seed[part])
            piece: tuple[int, int, set[int]] | None = None
            for lo, hi, mine in sorted(spans):
                if piece is not None and lo <= piece[1]:
                    piece[2].add(mine)
                    piece = (piece[0], max(hi, piece[1]), piece[2])
                else:
                    if piece is not None:
                        yield piece[0], piece[1], sorted(piece[2])
                    piece = (lo, hi, {mine})
            if piece is not None:
                yield piece[0], piece[1], sorted(piece[2])

    def _rare_spans(self, words: list[bytes], start: int, stop: int, at: np.ndarray, seed: np.ndarray) -> list[tuple[int, int, int]]:
        """The spans of the items of which words[start:stop] and what is around it has a rare word."""
        here = {*words[max(0, start - self.margin) : stop + self.margin + SEED + 1]}
        lists = [self.rare[w] for w in here if w in self.rare]
        if not lists:
            return []
        items = np.unique(np.concatenate(lists))
        own, number = np.unique(seed, return_inverse=True)
        order = np.argsort(number, kind="stable")  # places by seed
        places, first = at[order], np.searchsorted(number[order], np.arange(len(own) + 1))
        k, item = self.owned(own, items)
        by_item = np.argsort(item, kind="stable")
        k, item = k[by_item], item[by_item]
        sizes = first[k + 1] - first[k]
        total = np.cumsum(sizes)
        spans, low = [], 0
        while low < len(k):
            high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + CELLS, "right")))
            if high < len(k):  # an item's seeds stay together, if it hasn't more places than CELLS itself
                whole = int(np.searchsorted(item, item[high]))
                high = whole if whole > low else int(np.searchsorted(item, item[high], "right"))
            spans += self._spans(words, np.repeat(items[item[low:high]], sizes[low:high]), gather(places, first[k[low:high]], sizes[low:high])[0])
            low = high
        return spans

    def _spans(self, words: list[bytes], owner: np.ndarray, place: np.ndarray) -> list[tuple[int, int, int]]:
        """Runs of an item's places within margin of each other, with margin words around them, that have enough of the item's words."""
        order = np.lexsort((place, owner))
        owner, place = owner[order], place[order]
        edges = np.flatnonzero(np.r_[True, (np.diff(owner) != 0) | (np.diff(place) > self.margin), True])
        spans = []
        for mine, first, last in zip(owner[edges[:-1]].tolist(), place[edges[:-1]].tolist(), place[edges[1:] - 1].tolist()):
            lo, hi = max(0, first - self.margin), min(len(words), last + SEED + 1 + self.margin)
            if len(self.words[mine].intersection(words[lo:hi])) >= self.least[mine]:
                spans.append((lo, hi, mine))
        return spans


def _scan(compiled):
    """Documents to the passages that may hold a copy of an item: (key, doc_id, first, past, words, items), items as numbers within the block."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds: Seeds = compiled.value
        bits = max(16, int(16 * len(seeds.hashes)).bit_length())
        shift = np.uint64(64 - bits)
        seen = np.zeros(1 << bits, bool)
        seen[seeds.hashes >> shift] = True
        for batch in batches:
            out = []
            for key, doc_id, text in zip(batch["key"], batch["doc_id"], batch["text"]):
                words = words_of(text or "")
                h, places = seed_hashes(words)
                some, seed = seeds.found(seen, shift, h)
                for lo, hi, items in seeds.passages(words, places[some], seed) if len(some) else ():
                    out.append((key, doc_id, lo, hi, [w.decode("utf-8", "replace") for w in words[lo:hi]], items))
            if out:
                yield pd.DataFrame(out, columns=["key", "doc_id", "first", "past", "words", "items"])

    return scan


def align(passages: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best Smith-Waterman score of each pair of word-number arrays, and the passage position where it ends.

    All pairs advance together, one passage word at a time; gaps along the item are a running maximum.
    """
    count, m, n = len(items), max(map(len, items)), max(map(len, passages))
    item = np.full((count, m), -1, np.int64)
    text = np.full((count, n), -2, np.int64)
    for k in range(count):
        item[k, : len(items[k])] = items[k]
        text[k, : len(passages[k])] = passages[k]
    slope = np.arange(m) * SKIP
    above = np.zeros((count, m), np.int32)
    best, end = np.zeros(count, np.int32), np.zeros(count, np.int64)
    diagonal = np.zeros((count, m), np.int32)
    for j in range(n):
        diagonal[:, 1:] = above[:, :-1]
        cell = diagonal + np.where(item == text[:, j : j + 1], MATCH, -MISMATCH)
        cell = np.maximum(np.maximum(cell, above - SKIP), 0)
        above = (np.maximum.accumulate(cell + slope, axis=1) - slope).astype(np.int32)
        top = above.max(1)
        better = top > best
        best[better], end[better] = top[better], j
    return best, end


def _score(named, threshold: float):
    """Passages with the items that they share seeds with to alignments of those that may be leaks. named: (item_id, words) of each item."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[int, list]] = {}  # each item's least number of common words, and how often it has each
        for batch in batches:
            pairs = []
            for key, doc_id, first, words, items in zip(batch["key"], batch["doc_id"], batch["first"], batch["words"], batch["items"]):
                own = Counter(words)
                for item in items:
                    item_id, item_words = named.value[item]
                    if item not in held:
                        held[item] = (-(-points_needed(len(item_words), threshold) // MATCH), [*Counter(item_words).items()])
                    least, counts = held[item]
                    # words that both have, each as often as both have it: no alignment matches more
                    if sum(min(n, own[w]) for w, n in counts if w in own) >= least:
                        pairs.append((key, doc_id, first, words, item_id, item_words))
            pairs.sort(key=lambda p: len(p[3]))
            while pairs:
                # as many of the longest passages as fit
                take = max(1, min(len(pairs), CELLS // (len(pairs[-1][3]) + max(len(p[5]) for p in pairs[-256:])), 256))
                part, pairs = pairs[-take:], pairs[:-take]
                number: dict[str, int] = {}
                numbered = lambda ws: np.fromiter((number.setdefault(w, len(number)) for w in ws), np.int64, len(ws))
                passages, items = [numbered(p[3]) for p in part], [numbered(p[5]) for p in part]
                best, end = align(passages, items)
                _, back = align([p[::-1] for p in passages], [i[::-1] for i in items])
                length, size, first = np.array([len(i) for i in items]), np.array([len(p) for p in passages]), np.array([p[2] for p in part])
                yield pd.DataFrame(
                    {
                        "key": [p[0] for p in part], "doc_id": [p[1] for p in part], "item_id": [p[4] for p in part], "score": np.minimum(1.0, best / (MATCH * np.minimum(length, LONG_ITEM))),
                        "first_word": first + size - 1 - back, "last_word": first + end, "points": best, "item_words": length,
                    }
                )

    return score


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, doc_id, item_id, score, first_word, last_word): items that documents copy, whole, edited or in part.

    key is xxhash64(doc_id, text): rows with a null id, and repeated rows, are told by it (equal rows share one result). score is the
    best alignment's points by those of the whole item. Null texts and items count as empty; items of fewer than SEED words are
    too short to tell a copy and take no part; items with equal or null ids are searched for one by one. No documents or items
    give no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    # ids pass Python as text: pandas has nullable integers as floating point numbers
    source = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    items = written(items.mapInPandas(_items, "item_id string, words array<string>, seeds array<bigint>").where("size(seeds) > 0"), "items")
    total = items.agg(F.coalesce(F.sum(F.size("seeds")), F.lit(0))).first()[0]
    blocks = -(-total // BLOCK)
    out = None
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == block) if blocks > 1 else items
        found = _leaks_of(source, mine, threshold)
        out = out.unionByName(found) if out is not None and found is not None else out if found is None else found
    kind = "key bigint, doc_id bigint, item_id bigint, score double, first_word bigint, last_word bigint"
    if out is None:
        return spark.createDataFrame([], kind)
    whole = F.col("points") >= MATCH * F.least(F.col("item_words"), F.lit(LEAST_WORDS))
    best = out.where(whole & (F.col("score") >= threshold)).groupBy("key", "doc_id", "item_id")
    return best.agg(F.max(F.struct("score", -F.col("first_word"), "last_word")).alias("b")).select("key", F.col("doc_id").cast("bigint").alias("doc_id"), F.col("item_id").cast("bigint").alias("item_id"), "b.score", (-F.col("b.col2")).alias("first_word"), "b.last_word")


def _leaks_of(source: DataFrame, items: DataFrame, threshold: float) -> DataFrame | None:
    """Alignments of the documents with a block of items; None for an empty block."""
    spark = source.sparkSession
    block = items.select("item_id", "words", "seeds").toArrow().to_pydict()  # about BLOCK seeds, and fewer words
    if not block["item_id"]:
        return None
    compiled = spark.sparkContext.broadcast(Seeds(block["words"], block["seeds"], threshold))
    named = spark.sparkContext.broadcast(list(zip(block["item_id"], block["words"])))
    passages = source.mapInPandas(_scan(compiled), "key bigint, doc_id string, first bigint, past bigint, words array<string>, items array<int>")
    passages = written(passages.dropDuplicates(["key", "first", "past", "items"]), "passages")
    return passages.mapInPandas(_score(named, threshold), "key bigint, doc_id string, item_id string, score double, first_word bigint, last_word bigint, points int, item_words int")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that copy an item of the benchmark; see `leaks`. Rows go by their id and the hash of id and text."""
    key, which = unused(docs, "__key"), unused(docs, "__id")
    found = leaks(docs, benchmark, id_col, text_col, threshold).select(F.col("key").alias(key), F.col("doc_id").alias(which)).distinct()
    found = written(found, "leaks")
    hashed = F.xxhash64(F.col(id_col), F.col(text_col))
    stay, maybe = possibly_in(docs, hashed, found, key)
    return stay.unionByName(maybe.join(found, (hashed == F.col(key)) & F.col(id_col).eqNullSafe(F.col(which)), "left_anti"))
