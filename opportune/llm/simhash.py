"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints of 64 bits come from three-word shingles. Two fingerprints within RADIUS = 2 bits agree on at least two of four
16-bit blocks, so each distinct fingerprint goes to six buckets (one for each two blocks), and only bucket mates are compared.
A bucket of more than BUCKET fingerprints is dealt out again by two of the four bytes of its other 32 bits: its members differ
in 16 bits at most, so such a bucket holds no more than 65,536 distinct fingerprints, whatever the input's size, and no link
is lost.

In a bucket the bits are stored vertically: plane p is one long integer whose bit j is bit p of fingerprint j. For each shift
s, plane ^ (plane >> s) compares all pairs (j, j + s) at once; two carry-save counters count the differences of every pair up
to 3; pairs beyond the radius leave, and the block is abandoned when none is left.

Exact copies share a fingerprint and are one row throughout, so no group of copies is ever expanded.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, possibly_in, prepare, unused, written
from .components import components

RADIUS = 2
BUCKET = 2048
SEED = 42
#: Shingle hashes that are expanded to bits at a time.
SLICE = 1 << 17


def shingle_hashes(text: str) -> np.ndarray:
    """XXH64 of every three-word shingle (repeats included) after lower-casing A-Z; fewer words: one shingle of all."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) < 3:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:]))
    one = xxhash.xxh64_intdigest
    return np.fromiter((one(s, SEED) for s in shingles), np.uint64)


def fingerprints(texts: list[str]) -> np.ndarray:
    """One unsigned fingerprint each: a bit is 1 if it is set in over half of the text's shingle hashes; no words: 0."""
    out = np.zeros((len(texts), 64), np.uint8)
    for i, text in enumerate(texts):
        h = shingle_hashes(text)
        if len(h):
            ones = sum(np.unpackbits(h[k : k + SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for k in range(0, len(h), SLICE))
            out[i] = 2 * ones > len(h)
    return np.packbits(out, axis=1, bitorder="little").view("<u8").ravel()


def add_fingerprint(df: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """df with each whole text's fingerprint as a (signed) long; null text: as a text without words, 0. Map-only."""

    def column(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([x for block in chunks(texts) for x in fingerprints(block).view(np.int64).tolist()], dtype="int64")

    prepare(df.sparkSession)
    return df.withColumn(out_col, F.pandas_udf(column, "bigint")(F.col(text_col).cast("string")))


def close_pairs(prints: np.ndarray, bucket: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i, j) of all pairs of one bucket within `radius` <= 2 bits. prints: unsigned; bucket: rows' bucket numbers, in runs."""
    n = len(prints)
    bits = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    mixed = bits.mean(0)
    order = [p for p in np.argsort(np.abs(mixed - 0.5)) if 0 < mixed[p] < 1]  # planes that tell most apart come first
    planes = [int.from_bytes(np.packbits(bits[:, p], bitorder="little").tobytes(), "little") for p in order]
    longest = int(np.bincount(bucket).max())
    left, right = [], []
    for s in range(1, longest):
        same = bucket[s:] == bucket[:-s]
        if not same.any():
            continue
        live = int.from_bytes(np.packbits(same, bitorder="little").tobytes(), "little")
        ones = twos = 0
        for k, plane in enumerate(planes):
            differ = (plane ^ (plane >> s)) & live
            twos, ones = twos | (ones & differ), ones ^ differ
            over = (ones & twos) if radius == 2 else twos if radius == 1 else ones
            if over:
                live &= ~over
                ones, twos = ones & live, twos & live
                if not live:
                    break
        if live:
            raw = np.frombuffer(live.to_bytes(-(-n // 8), "little"), np.uint8)
            at = np.flatnonzero(np.unpackbits(raw, bitorder="little"))
            left.append(at)
            right.append(at + s)
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _star(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row number reachable from each of n rows."""
    label = np.arange(n)
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            return label


def _bucket_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Buckets (arrays of distinct fingerprints) to links from each fingerprint to the first of its links' group in the bucket."""
    for batch in batches:
        lists = sorted((np.asarray(x, np.int64) for x in batch["prints"]), key=len)
        block, size = [], 0
        for k, prints in enumerate(lists):
            block.append(prints)
            size += len(prints)
            grows = k + 1 < len(lists) and len(lists[k + 1]) > 2 * len(block[0])
            if size >= 4096 or grows or k + 1 == len(lists):
                rows = np.concatenate(block)
                bucket = np.repeat(np.arange(len(block)), [len(x) for x in block])
                a, b = close_pairs(rows.view(np.uint64), bucket)
                if len(a):
                    label = _star(len(rows), a, b)
                    at = np.flatnonzero(label != np.arange(len(rows)))
                    yield pd.DataFrame({"a": rows[at], "b": rows[label[at]]})
                block, size = [], 0


def _two_blocks(value: str, width: int, blocks: int = 4) -> list[str]:
    """SQL for a key of each two of the blocks of `width` bits of a long."""
    block = lambda i: f"(shiftrightunsigned({value}, {i * width}) & {(1 << width) - 1}L)"
    return [f"named_struct('tab', {t}, 'key', shiftleft({block(i)}, {width}) | {block(j)})" for t, (i, j) in enumerate(combinations(range(blocks), 2))]


def fingerprint_links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that join all of `distinct`'s fingerprints (column fingerprint) that are connected within RADIUS bits."""
    banded = distinct.selectExpr("fingerprint", f"inline(array({', '.join(_two_blocks('fingerprint', 16))}))")
    sizes = banded.groupBy("tab", "key").agg(F.count("*").alias("size")).where("size > 1")
    usual = banded.join(sizes.where(F.col("size") <= bucket), ["tab", "key"]).groupBy("tab", "key").agg(F.collect_list("fingerprint").alias("prints")).select("prints")
    # the 32 bits outside the two shared blocks, by table, for buckets that are too large
    rest = ["shiftleft({2}, 16) | {3}", "shiftleft({1}, 16) | {3}", "shiftleft({1}, 16) | {2}", "shiftleft({0}, 16) | {3}", "shiftleft({0}, 16) | {2}", "shiftleft({0}, 16) | {1}"]
    block = [f"(shiftrightunsigned(fingerprint, {16 * i}) & 65535L)" for i in range(4)]
    other = "case tab " + " ".join(f"when {t} then {x.format(*block)}" for t, x in enumerate(rest)) + " end"
    large = banded.join(sizes.where(F.col("size") > bucket), ["tab", "key"]).selectExpr("tab as tab1", "key as key1", "fingerprint", f"{other} as rest")
    large = large.selectExpr("tab1", "key1", "fingerprint", f"inline(array({', '.join(_two_blocks('rest', 8))}))")
    large = large.groupBy("tab1", "key1", "tab", "key").agg(F.collect_list("fingerprint").alias("prints")).where("size(prints) > 1").select("prints")
    return usual.unionByName(large).mapInPandas(_bucket_links, "a bigint, b bigint").distinct()


def _firsts(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, mark, fingerprint) of each row of df, and (fingerprint, first) of each fingerprint: (no_id, id, mark) of its component's first row.

    mark is a hash of id and text, which tells rows of one id apart; a component's first row has the smallest id, then mark.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    prints = add_fingerprint(rows.withColumn("mark", F.xxhash64("id", "text")), "text").select("id", "mark", "fingerprint")
    prints = written(prints, "fingerprints")
    distinct = written(prints.groupBy("fingerprint").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "mark")).alias("first")), "distinct")
    roots = components(fingerprint_links(distinct)).select(F.col("node").alias("fingerprint"), "root")
    rooted = distinct.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    first = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return prints, rooted.drop("first").join(first, "root").select("fingerprint", "first")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint long, component_id) for every row of df.

    component_id is the smallest id reachable over links of RADIUS bits or fewer. Repeated rows and rows with a null id get a
    row each; null ids are never the smallest (a group of null ids only has a null component). Rows that share an id but not a
    component keep the component of their own text. Null text has fingerprint 0, as texts without words, and is linked like any
    other. An empty table gives no rows. Other columns are ignored.
    """
    prints, firsts = _firsts(df, id_col, text_col)
    return prints.join(firsts, "fingerprint").select(F.col("id").alias(id_col), "fingerprint", F.col("first.id").alias("component_id"))


def keep_one_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's rows without near-duplicates: of each component the row with the smallest id stays; of rows of that id, the least hash of id and text.

    Rows with a null id come last: one stays of a component that has no other. Of rows equal in id and text one stays. Rows of one
    id whose texts are no near-duplicates all stay. An empty table stays empty.

    Rows that go, and those that are repeated, are found in df by id and hash; nearly all others pass without a join or shuffle.
    """
    which, mark, goes = (unused(df, c) for c in ("__id", "__mark", "__goes"))
    prints, firsts = _firsts(df, id_col, text_col)
    lost = ~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("mark") == F.col("first.mark")))
    verdict = prints.join(firsts, "fingerprint").groupBy(F.col("id").alias(which), F.col("mark").alias(mark)).agg(F.count("*").alias("rows"), F.max(lost).alias(goes))
    verdict = written(verdict.where((F.col("rows") > 1) | F.col(goes)).drop("rows"), "verdict")
    hashed = F.xxhash64(F.col(id_col), F.col(text_col).cast("string"))
    stay, maybe = possibly_in(df, hashed, verdict, mark)
    marked = maybe.join(verdict, F.col(id_col).eqNullSafe(F.col(which)) & (hashed == F.col(mark)), "left")
    out = stay.unionByName(marked.where(F.col(goes).isNull()).select(df.columns))
    if not verdict.where(~F.col(goes)).isEmpty():
        out = out.unionByName(marked.where(~F.col(goes)).select(df.columns).dropDuplicates([id_col, text_col]))
    return out
