"""Product codes of integer vectors, found by partial-distance search.

Vectors become integers and are cut into equal parts; each part position has a codebook, fitted in rounds of assignment and
averaging over all vectors. A round is one pass: tasks assign their vectors and return sums for each entry, which Spark adds up,
so what reaches the driver is the size of the codebooks, at any number of vectors. All arithmetic is on integers and exact.

Search for a part's nearest entry takes the dimensions in descending variance of the codebook. Vectors of a block advance
together: an entry is dropped for a vector once its accumulated distance strictly exceeds that vector's best complete distance,
so ties stay and go to the lower index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, unused, with_key_rows, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors whose distances advance together, and entries that are compared before the best distances are renewed; bound a worker's memory.
BLOCK, STEP = 4096, 16
#: Largest distance that a sum over all dimensions may reach.
MOST = 1 << 62


def usable(column: str) -> Column:
    """Is a vector not null, not empty and of finite components only?"""
    x = F.col(column)
    return F.coalesce((F.size(x) > 0) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(False))


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE x) of each component; OverflowError where a distance might not fit in 64 bits."""
    scaled = np.floor(vectors.astype(np.float64) * SCALE)
    if scaled.size and 4.0 * vectors.shape[1] * float(np.abs(scaled).max()) ** 2 >= MOST:
        raise OverflowError("components are too large for exact distances in 64 bits")
    return scaled.astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry of book (ties: the lower) and its squared distance; x: rows x dimensions, integers."""
    spread = len(book) * (book * book).sum(0, dtype=object) - book.sum(0, dtype=object) ** 2  # variance times a constant, exact
    order = sorted(range(book.shape[1]), key=lambda j: (-spread[j], j))
    x, book = np.ascontiguousarray(x[:, order]), np.ascontiguousarray(book[:, order])
    index, best = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for start in range(0, len(x), BLOCK):
        rows = x[start : start + BLOCK]
        # the entry that is nearest in the first dimension gives the first complete distance
        found = np.abs(rows[:, :1] - book[:, 0]).argmin(1)
        least = ((rows - book[found]) ** 2).sum(1)
        for low in range(0, len(book), STEP):
            first = (rows[:, :1] - book[low : low + STEP, 0]) ** 2
            row, entry = np.nonzero(first <= least[:, None])
            distance = first[row, entry]
            entry = entry + low
            for j in range(1, book.shape[1]):
                distance = distance + (rows[row, j] - book[entry, j]) ** 2
                keep = distance <= least[row]
                row, entry, distance = row[keep], entry[keep], distance[keep]
            if len(row):
                # of each row's remaining entries the nearest, then the lowest; row and entry are in ascending order
                at = np.flatnonzero(np.r_[True, np.diff(row) != 0])
                shortest = np.minimum.reduceat(distance, at)
                tied = np.where(distance == np.repeat(shortest, np.diff(np.r_[at, len(row)])), entry, len(book))
                lowest, row = np.minimum.reduceat(tied, at), row[at]
                better = (shortest < least[row]) | (lowest < found[row])
                least[row[better]], found[row[better]] = shortest[better], lowest[better]
        index[start : start + BLOCK], best[start : start + BLOCK] = found, least
    return index, best


def codes_of(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x PARTS indexes, rows x PARTS distances); books: PARTS x entries x dimensions of a part."""
    width = books.shape[2]
    each = [nearest(x[:, p * width : (p + 1) * width], books[p]) for p in range(len(books))]
    return np.stack([i for i, _ in each], 1), np.stack([d for _, d in each], 1)


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return integers(flat.reshape(len(column), -1))


def _sums(books: np.ndarray):
    """Vectors to what a task adds to each entry: its number of parts and their sum."""
    parts, entries, width = books.shape

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch.column(0))
                index, _ = codes_of(x, books)
                slot = (index + np.arange(parts) * entries).ravel()
                n += np.bincount(slot, minlength=len(n))
                np.add.at(total, slot, x.reshape(-1, width))
        used = np.flatnonzero(n)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))], ["slot", "n", "total"])

    return scan


def _coded(books: np.ndarray):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                index, distance = codes_of(_vectors(batch.column(0)), books)
                text = index.astype(np.uint8).tobytes().hex()
                step = 2 * index.shape[1]
                code = [text[k : k + step] for k in range(0, len(text), step)]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(code, pa.string()), pa.array(distance.sum(1))], [*batch.schema.names[1:], "code", "error"])

    return scan


def train(vectors: DataFrame, id_col: str, vec_col: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (parts x entries x dimensions of a part) of vectors, which are usable and of one length; None if there are none."""
    first = vectors.orderBy(F.col(id_col).asc_nulls_last(), vec_col).limit(entries).select(vec_col).collect()  # as many rows as entries
    if not first:
        return None
    x = integers(np.array([r[0] for r in first], np.float64))
    books = np.ascontiguousarray(x.reshape(len(x), parts, -1).transpose(1, 0, 2))
    for _ in range(rounds):
        got = vectors.select(vec_col).mapInArrow(_sums(books), "slot bigint, n bigint, total array<bigint>")
        added = got.groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[j]).alias(f"t{j}") for j in range(books.shape[2])])
        flat = books.reshape(-1, books.shape[2]).copy()
        for slot, n, *total in added.collect():  # parts x entries rows
            flat[slot] = [t // n for t in total]
        books = flat.reshape(books.shape)
    return books


def digest(books: np.ndarray | None) -> str | None:
    """SHA-256 of all entries' integers, by part, entry and place within the part, joined by commas."""
    return None if books is None else hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None]:
    """(id_col, label_col, code, error, label_error) of every usable row of df, and the codebooks.

    code has two hex digits for each part; error is the sum of the parts' squared distances; label_error sums error over equal
    labels, nulls being equal. A codebook starts as that part of the rows of smallest ids, nulls last, rows of one id in their
    vectors' order, repeated rows as often as they are there; fewer rows than `entries` give a smaller codebook. Vectors that are
    null, empty or hold null or non-finite components take no part; nor do those of another length than most (ties: the shorter).
    A length that isn't a multiple of `parts` raises ValueError, components whose distances exceed 64 bits OverflowError. No
    usable rows give no rows and no codebooks. Other columns are ignored.
    """
    if entries > 256:
        raise ValueError("an index has two hex digits")
    prepare(df.sparkSession)
    rows = df.select(vec_col, id_col, label_col).where(usable(vec_col))
    usual = rows.groupBy(F.size(vec_col).alias("n")).count().orderBy(F.desc("count"), "n").first()
    if usual and usual["n"] % parts:
        raise ValueError(f"{usual['n']} dimensions aren't {parts} equal parts")
    rows = rows.where(F.size(vec_col) == usual["n"]) if usual else rows
    books = train(rows, id_col, vec_col, parts, entries, rounds)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    kind = f"`{id_col}` {kinds[id_col]}, `{label_col}` {kinds[label_col]}, code string, error bigint"
    coded = rows.mapInArrow(_coded(books), kind) if books is not None else df.sparkSession.createDataFrame([], kind)
    coded = written(coded, "codes")
    total, size = unused(coded, "label_error"), unused(coded, "__size")
    sums = written(coded.groupBy(label_col).agg(F.sum("error").alias(total), F.count("*").alias(size)), "label_errors")
    return with_key_rows(coded, sums, label_col, size).select(id_col, label_col, "code", "error", total), books
