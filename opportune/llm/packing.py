"""Packed token ids in binary form: best-fit-decreasing packing of documents into rows of fixed length.

Documents are encoded and cut in pieces of at most `length` tokens (an overlong document gives full pieces and a rest, so
nothing is lost). Pieces are packed within windows of about WINDOW tokens of one task's input: longest first, each into the row
whose free space fits it best; the best-fitting free space is found by descending a segment tree over all capacities. Rows
leave as matrices of ids, with the cumulative lengths of each row's segments and positions that restart at each segment.

Packing is map-only: no token is shuffled, and a lost task is repeated from its own input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import BpeCodec
from .common import prepare, chunks

LENGTH = 2048
#: Tokens that are packed together; bounds the memory of a task.
WINDOW = 4_000_000
#: Entries of a worker's word table: larger than elsewhere, as a task holds no decoded texts.
WORD_TABLE = 600_000
#: Rows of a matrix.
ROWS = 128


class Capacities:
    """Open rows by free space, with the least sufficient space found in a segment tree."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        node = self.leaves + free
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(free, row) of the row with the least free space of at least `need`; it leaves the tree."""
        node = self.leaves + need
        if not self.count[node]:
            # up to the first right neighbour that has rows, then down its leftmost branch
            while node & 1 or not self.count[node + 1]:
                node >>= 1
                if node <= 1:
                    return None
            node += 1
            while node < self.leaves:
                node = 2 * node + (not self.count[2 * node])
        free = node - self.leaves
        while node:
            self.count[node] -= 1
            node >>= 1
        return free, self.rows[free].pop()


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Piece numbers of each row, sizes between 1 and `length`; equal sizes keep their order."""
    rows: list[list[int]] = []
    open_rows = Capacities(length)
    for piece in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[piece]
        got = open_rows.take(size) if size < length else None
        if got is None:
            rows.append([piece])
            free, row = length - size, len(rows) - 1
        else:
            free, row = got[0] - size, got[1]
            rows[row].append(piece)
        if free:
            open_rows.add(free, row)
    return rows


def _pack(codec, length: int, window: int, pad: int, kind: str):
    def matrices(pieces: list, first: int) -> Iterator[dict]:
        packed = best_fit_decreasing([len(p[2]) for p in pieces], length)
        for lo in range(0, len(packed), ROWS):
            part = packed[lo : lo + ROWS]
            ids = np.full((len(part), length), pad, kind)
            place = np.zeros((len(part), length), "<u4")
            ends, docs, parts = [], [], []
            for r, row in enumerate(part):
                at, cuts = 0, [0]
                for p in row:
                    n = len(pieces[p][2])
                    ids[r, at : at + n] = pieces[p][2]
                    place[r, at : at + n] = np.arange(n)
                    at += n
                    cuts.append(at)
                ends.append(cuts)
                docs.append([pieces[p][0] for p in row])
                parts.append([pieces[p][1] for p in row])
            yield {
                "matrix_id": first + lo // ROWS, "n_rows": len(part), "n_tokens": sum(c[-1] for c in ends), "input_ids": ids.tobytes(),
                "position_ids": place.astype("<u2" if length <= 65536 else "<u4").tobytes(), "cu_seqlens": ends, "doc_ids": docs, "parts": parts,
            }

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        pieces, held = [], 0

        def flush():
            nonlocal number
            out = list(matrices(pieces, number))
            number += len(out)
            for k in range(0, len(out), 8):
                yield pd.DataFrame(out[k : k + 8], dtype=object)

        for batch in batches:
            doc_ids = iter(batch["doc_id"])  # text, as pandas has nullable integers as floating point numbers
            for block in chunks(batch["text"]):
                for ids in codec.value.encode(block):
                    doc_id = next(doc_ids)
                    doc_id = None if doc_id is None else int(doc_id)
                    for part, at in enumerate(range(0, len(ids), length)):
                        pieces.append((doc_id, part, ids[at : at + length].astype(kind)))
                    held += len(ids)
                    if held >= window:
                        yield from flush()
                        pieces, held = [], 0
        if pieces:
            yield from flush()

    return pack


def pack(df: DataFrame, vocab_path: str, length: int = LENGTH, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Matrices of up to ROWS rows of `length` token ids: a row of the result each.

    matrix_id; n_rows; n_tokens (without padding); input_ids: n_rows x length ids, row after row, little-endian unsigned, 16 bits if
    the vocabulary fits, else 32; position_ids: the same shape, restarting at 0 with each segment (16 bits up to a length of
    65,536, else 32); cu_seqlens: for each row 0 and the end of each segment; doc_ids and parts: for each row the document and
    the number of its piece in each segment. Padding is the vocabulary's last id, beyond the last end.

    A null or empty text has no tokens and so no segment. Repeated rows and null ids are packed like others; an empty table
    gives no rows; other columns are ignored.
    """
    prepare(df.sparkSession)
    codec = BpeCodec(vocab_path, WORD_TABLE)
    pad = len(codec.strings) - 1
    sent = df.sparkSession.sparkContext.broadcast(codec)
    rows = df.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = "matrix_id bigint, n_rows int, n_tokens bigint, input_ids binary, position_ids binary, cu_seqlens array<array<int>>, doc_ids array<array<bigint>>, parts array<array<int>>"
    return rows.mapInPandas(_pack(sent, length, window, pad, "<u2" if pad < 65536 else "<u4"), kind)


def write(df: DataFrame, path: str) -> None:
    """Write packed matrices as Parquet, the ids and positions as raw binary columns."""
    df.write.mode("overwrite").parquet(path)


def documents_of(packed: DataFrame, length: int = LENGTH, id_bytes: int = 2) -> DataFrame:
    """(doc_id, part, ids binary): the pieces again; a document's pieces in the order of part are its tokens."""
    rows = packed.select("input_ids", F.posexplode(F.arrays_zip("cu_seqlens", "doc_ids", "parts")).alias("row", "r"))
    cuts = rows.select("input_ids", "row", F.col("r.cu_seqlens").alias("cuts"), F.posexplode(F.arrays_zip("r.doc_ids", "r.parts")).alias("k", "piece"))
    start = F.col("row") * length + F.col("cuts")[F.col("k")]
    size = F.col("cuts")[F.col("k") + 1] - F.col("cuts")[F.col("k")]
    return cuts.select(F.col("piece.doc_ids").alias("doc_id"), F.col("piece.parts").alias("part"), F.substring("input_ids", start * id_bytes + 1, size * id_bytes).alias("ids"))
