"""Approximate nearest neighbours by inner product: an inverted file of coarse centroids with product-quantised residuals.

Index: k-means centroids, about LIST vectors to a list; each vector is stored as its list and its residual's codes in PARTS
subspaces. Search: a query probes the lists whose centroids have the largest inner product with it; asymmetric distance
tables (query parts times code books) give every stored vector of a list an approximate score; the best RERANK of each block
are scored exactly on the original vectors, in double precision.

How many lists a query probes is measured, as it depends on the vectors: at most TRIALS of the queries are answered exactly by a
scan of all vectors, and the fewest lists that hold WANTED of their true neighbours are probed, PROBES at least. Vectors
without clusters need a large share of the lists, and then the work grows with queries times vectors.

Centroids and code books are fitted on at most SAMPLE vectors, those whose hashes come first; all vectors are indexed. Equal
vectors are one entry with their k + 1 smallest ids, which is all that a result of k can show. CELL lists near each other are a
cell, to which a query goes once. Cells are dealt out in blocks of about BLOCK vectors, and a cell's queries in chunks, so no
task ever holds a whole cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import prepare, written

SAMPLE = 65_536
LIST, MOST_LISTS = 256, 16_384
CELL = 8
PROBES = 48
TRIALS, WANTED = 512, 0.95
PARTS, CODES = 16, 256
RERANK = 96
BLOCK, CHUNK = 2_048, 512
#: Most numbers of a table of vectors by centroids; bounds a worker's memory at any number of lists.
CELLS = 1 << 21
#: Found rows that a task holds before it merges them; as many as are left of a merge are passed on when over half of it.
HELD = 1_000_000


@dataclass
class Index:
    """centroids (lists, dim); books (parts, codes, width): code books of the residuals' parts, taken across the centroid's direction and at length 1. A
    residual's part along that direction and its length are kept beside the codes: a dense group is coded as finely as a wide
    one, and what most moves an inner product is exact. cells (lists): the cell of each list."""

    centroids: np.ndarray
    books: np.ndarray
    cells: np.ndarray

    @property
    def width(self) -> int:
        return self.books.shape[2]

    def parts(self, x: np.ndarray) -> np.ndarray:
        """Vectors cut in parts, the last filled with zeros: (rows, parts, width)."""
        wide = np.zeros((len(x), self.books.shape[0] * self.width), x.dtype)
        wide[:, : x.shape[1]] = x
        return wide.reshape(len(x), self.books.shape[0], self.width)

    def residuals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List of each vector; its residual's part along the centroid; length and unit vector of the rest."""
        which = nearest(x, self.centroids)
        rest, axis = x - self.centroids[which], unit(self.centroids)[0][which]
        along = (rest * axis).sum(1)
        rest, length = unit(rest - along[:, None] * axis)
        return which, along, length, rest

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, part along the centroid, length of the rest and its codes."""
        which, along, length, rest = self.residuals(x)
        rest = self.parts(rest)
        return which, along, length, np.stack([nearest(rest[:, p], book) for p, book in enumerate(self.books)], 1).astype(np.uint8)


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows at length 1 (zero rows as they are), and their lengths."""
    length = np.sqrt((x * x).sum(1))
    return x / np.where(length > 0, length, 1.0)[:, None], length


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Number of the nearest center of each row, in slices of bounded tables."""
    half = (centers * centers).sum(1) / 2
    return np.concatenate([(half - x[rows] @ centers.T).argmin(1) for rows in slices(len(x), len(centers))]) if len(x) else np.zeros(0, np.int64)


def slices(rows: int, columns: int) -> Iterator[slice]:
    """Slices of rows whose tables with `columns` columns have at most CELLS numbers."""
    step = max(1, CELLS // max(1, columns))
    return (slice(k, k + step) for k in range(0, rows, step))


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Lloyd's algorithm from random rows; an empty cluster takes a random row."""
    draw = np.random.default_rng(seed)
    k = min(k, len(x))
    centers = x[draw.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        which = nearest(x, centers)
        count = np.bincount(which, minlength=k)
        order = np.argsort(which, kind="stable")
        full = np.flatnonzero(count)
        starts = np.concatenate([[0], np.cumsum(count)[:-1]])[full]
        centers[full] = np.add.reduceat(x[order], starts, axis=0) / count[full, None]
        for c in np.flatnonzero(count == 0):
            centers[c] = x[draw.integers(len(x))]
    return centers


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector array<double>): rows with an id and a vector that is not null, not zero, all finite, of the usual length.

    The usual length is the most frequent one (the shorter of two). Equal rows count once.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where("vec_id is not null and size(vector) > 0")
    rows = rows.where("forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(vector, x -> x <> 0)")
    length = rows.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    return rows.where(F.size("vector") == (length["n"] if length else 0)).dropDuplicates()


def entries(rows: DataFrame, k: int) -> DataFrame:
    """(vector, ids): distinct vectors with their k + 1 smallest ids; the window's limit applies before the shuffle."""
    first = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    return rows.withColumn("n", first).where(F.col("n") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def fit(vectors: DataFrame, sample: int = SAMPLE) -> Index | None:
    """An index's centroids and code books, from a bounded sample of distinct vectors; None without vectors."""
    n = vectors.count()
    some = vectors.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(sample).toPandas()["vector"]
    if not n:
        return None
    x = np.stack(some.to_numpy()).astype(np.float64)
    centroids = k_means(x, int(np.clip(round(n / LIST), 1, min(MOST_LISTS, len(x)))))
    width = -(-x.shape[1] // PARTS)
    parts = -(-x.shape[1] // width)
    near = nearest(centroids, k_means(centroids, -(-len(centroids) // CELL)))
    cells = np.empty(len(centroids), np.int64)
    cells[np.argsort(near, kind="stable")] = np.arange(len(centroids)) // CELL
    index = Index(centroids, np.zeros((parts, 1, width)), cells)
    rest = index.parts(index.residuals(x)[3])
    index.books = np.stack([k_means(rest[:, p], CODES, rounds=8) for p in range(parts)])
    return index


def _packed(index):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.stack(batch["vector"].to_numpy()).astype(np.float64)
            which, along, length, codes = index.value.encode(x)
            yield pd.DataFrame({"list": which.astype("int32"), "cell": index.value.cells[which].astype("int32"), "salt": batch["salt"], "ids": [np.asarray(i, np.int64).tobytes() for i in batch["ids"]], "along": along, "length": length, "codes": [c.tobytes() for c in codes], "vector": [v.tobytes() for v in x]})

    return pack


def _probes(index, probes: int):
    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids, cells = index.value.centroids, index.value.cells
        n = min(probes, len(centroids))
        for batch in batches:
            every, every_id, every_no = np.stack(batch["vector"].to_numpy()).astype(np.float64), batch["vec_id"].to_numpy(), batch["query_no"].to_numpy()
            for rows in slices(len(every), len(centroids)):
                x, ids, numbers = every[rows], every_id[rows], every_no[rows]
                best = np.argpartition(-(x @ centroids.T), n - 1, axis=1)[:, :n].ravel().astype(np.int32)
                row, cell = np.repeat(np.arange(len(x)), n), cells[best]
                order = np.lexsort((cell, row))
                row, cell, best = row[order], cell[order], best[order]
                starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (cell[1:] != cell[:-1])])
                raw = np.array([v.tobytes() for v in x], object)
                yield pd.DataFrame({"cell": cell[starts].astype("int32"), "query_id": ids[row[starts]], "query_no": numbers[row[starts]], "query": raw[row[starts]], "lists": [part.tobytes() for part in np.split(best, starts[1:])]})

    return probe


def _nearest_entries(trials, k: int):
    """Each trial query's k + 1 best entries of a task's rows, by a full scan: (trial, score, list, rows); an entry's rows leave out the query itself."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query_ids, q = trials.value
        score = np.full((len(q), 0), 0.0)
        which, size = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0), np.int64)
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.iloc[at : at + 2048]
                x = np.frombuffer(b"".join(part["vector"])).reshape(len(part), -1)
                ids = [np.frombuffer(i, np.int64) for i in part["ids"]]
                owner = {int(i): n for n, own in enumerate(ids) for i in own}
                rows = np.broadcast_to(np.array([len(i) for i in ids]), (len(q), len(part))).copy()
                for n, i in enumerate(query_ids):
                    if int(i) in owner:
                        rows[n, owner[int(i)]] -= 1
                score = np.concatenate([score, q @ x.T], 1)
                which = np.concatenate([which, np.broadcast_to(part["list"].to_numpy(np.int64), rows.shape)], 1)
                size = np.concatenate([size, rows], 1)
                if score.shape[1] > k + 1:
                    best = np.argpartition(-score, k, axis=1)[:, : k + 1]
                    score, which, size = (np.take_along_axis(v, best, 1) for v in (score, which, size))
        trial = np.repeat(np.arange(len(q)), score.shape[1])
        yield pd.DataFrame({"trial": trial.astype("int32"), "score": score.ravel(), "list": which.ravel().astype("int32"), "rows": size.ravel()})

    return scan


def probes_wanted(index: Index, lists: DataFrame, asked: DataFrame, k: int, wanted: float = WANTED, trials: int = TRIALS) -> int:
    """The fewest lists to probe that hold this share of the true k nearest of a bounded set of the queries; PROBES at least."""
    if len(index.centroids) <= PROBES:
        return PROBES
    some = asked.orderBy(F.xxhash64("vec_id", "vector"), "vec_id").limit(trials).toPandas()
    if not len(some):
        return PROBES
    q = np.stack(some["vector"].to_numpy()).astype(np.float64)
    sent = asked.sparkSession.sparkContext.broadcast((some["vec_id"].to_numpy(), q))
    found = lists.select("list", "ids", "vector").mapInPandas(_nearest_entries(sent, k), "trial int, score double, list int, rows bigint")
    n = F.row_number().over(Window.partitionBy("trial").orderBy(F.desc("score"), "list"))
    found = found.withColumn("n", n).where(F.col("n") <= k + 1).orderBy("trial", "n").toPandas()
    before = found.groupby("trial")["rows"].cumsum() - found["rows"]
    held = np.minimum(found["rows"], np.maximum(k - before, 0)).to_numpy()
    trial, number = found["trial"].to_numpy(), found["list"].to_numpy()
    place = np.empty(len(found), np.int64)
    for at in range(0, len(q), 64):
        places = (-(q[at : at + 64] @ index.centroids.T)).argsort(1).argsort(1)
        own = np.flatnonzero((trial >= at) & (trial < at + 64))
        place[own] = places[trial[own] - at, number[own]]
    covered = np.cumsum(np.bincount(place, held, len(index.centroids)))
    return max(PROBES, int(np.searchsorted(covered, wanted * covered[-1])) + 1)


def inner_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products over the last axis, components added in their order (as a plain loop does)."""
    out = np.zeros(np.broadcast_shapes(q.shape, x.shape)[:-1])
    for d in range(q.shape[-1]):
        out += q[..., d] * x[..., d]
    return out


def merged(found: list[pd.DataFrame], k: int) -> pd.DataFrame:
    """The k best rows of each query; ties go to the smaller id."""
    rows = pd.concat(found, ignore_index=True)
    order = np.lexsort((rows["vec_id"], -rows["score"], rows["query_no"], rows["query_id"]))
    rows = rows.iloc[order]
    return rows[(rows.groupby(["query_id", "query_no"]).cumcount() < k).to_numpy()]


def _search(index, k: int, rerank: int):
    """The k nearest of each query among a task's blocks: merged in the task, so what leaves it grows with the queries, not with queries times blocks."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: Index = index.value
        dim = model.centroids.shape[1]
        held, size = [], 0
        for batch in batches:
            for block, queries in zip(batch["block"], batch["queries"]):
                x = np.frombuffer(b"".join(e["vector"] for e in block)).reshape(len(block), dim)
                codes = np.frombuffer(b"".join(e["codes"] for e in block), np.uint8).reshape(len(block), -1)
                which, along, length = (np.array([e[name] for e in block]) for name in ("list", "along", "length"))
                ids = [np.frombuffer(e["ids"], np.int64) for e in block]
                sizes = np.array([len(i) for i in ids])
                flat, at = np.concatenate(ids), np.cumsum(sizes) - sizes
                query_ids, query_nos = (np.array([e[name] for e in queries]) for name in ("query_id", "query_no"))
                q = np.frombuffer(b"".join(e["query"] for e in queries)).reshape(len(queries), dim)
                asked = [np.frombuffer(e["lists"], np.int32) for e in queries]
                asker, asked = np.repeat(np.arange(len(q)), [len(a) for a in asked]), np.concatenate(asked)
                books = model.books.transpose(0, 2, 1)
                tables = np.matmul(model.parts(q).transpose(1, 0, 2), books)  # (parts, queries, codes)
                near = np.full((len(q), len(block)), -np.inf)
                for number in np.unique(which):
                    r, v = asker[asked == number], np.flatnonzero(which == number)
                    if not len(r):
                        continue
                    center = model.centroids[number : number + 1]
                    axis = unit(center)[0]
                    along_q, own = q[r] @ axis.T, np.matmul(model.parts(axis).transpose(1, 0, 2), books)
                    score, shift = np.zeros((len(r), len(v))), np.zeros(len(v))
                    for p in range(codes.shape[1]):
                        score += tables[p, r][:, codes[v, p]]
                        shift += own[p, 0, codes[v, p]]
                    # codes tell residuals across the centroid's direction, so the query's part along it is taken off again
                    near[np.ix_(r, v)] = (score - along_q * shift) * length[v] + q[r] @ center.T + along_q * along[v]
                top = min(rerank, len(block))
                best = np.argpartition(-near, top - 1, axis=1)[:, :top]
                exact = inner_products(q[:, None, :], x[best])
                out_q, out_n, out_v, out_s = [], [], [], []
                for r in range(len(q)):
                    entry = best[r]
                    score = np.repeat(exact[r], sizes[entry])
                    who = np.concatenate([flat[at[e] : at[e] + sizes[e]] for e in entry])
                    # the query's own row is that of its id and its vector
                    other = (who != query_ids[r]) | np.repeat((x[entry] != q[r]).any(1), sizes[entry])
                    score, who = score[other], who[other]
                    order = np.lexsort((who, -score))[:k]
                    out_q.append(np.full(len(order), query_ids[r]))
                    out_n.append(np.full(len(order), query_nos[r]))
                    out_v.append(who[order])
                    out_s.append(score[order])
                held.append(pd.DataFrame({"query_id": np.concatenate(out_q), "query_no": np.concatenate(out_n), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s)}))
                size += len(held[-1])
                if size > HELD:
                    held = [merged(held, k)]
                    size = len(held[0])
                    if size > HELD // 2:
                        yield held[0]
                        held, size = [], 0
        if held:
            yield merged(held, k)

    return search


def search(df: DataFrame, is_query: str, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", probes: int | None = None, rerank: int = RERANK, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row with is_query (SQL over vec_id), itself left out.

    Nearest: largest inner product, exact on the original vectors; ties go to the smaller id. Rows whose vector is null, zero, holds
    null or non-finite components or has another length than most take no part, nor do rows with a null id; equal rows count
    once. Rows that share an id but not a vector are queries of their own, each with its list of k under that id, and neighbours of
    each other. Fewer rows than k: all of them. No rows: no result. Other columns are ignored. probes: lists read for a query; as
    many as probes_wanted measures where it is None.
    """
    spark = df.sparkSession
    prepare(spark)
    rows = written(usable(df, id_col, vector_col), "vectors")
    stored = written(entries(rows, k), "entries")
    index = fit(stored, sample)
    if index is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    sent = spark.sparkContext.broadcast(index)
    salted = stored.select("vector", "ids", F.pmod(F.xxhash64("vector"), F.lit(1 << 20)).cast("int").alias("salt"))
    lists = written(salted.mapInPandas(_packed(sent), "list int, cell int, salt int, ids binary, along double, length double, codes binary, vector binary"), "lists")
    blocks_of = lists.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = lists.join(F.broadcast(blocks_of), "cell").withColumn("part", F.col("salt") % F.col("blocks"))  # MOST_LISTS rows at most
    blocks = dealt.groupBy("cell", "part").agg(F.collect_list(F.struct("list", "ids", "along", "length", "codes", "vector")).alias("block"))
    asked = rows.where(is_query).withColumn("query_no", F.xxhash64("vector"))
    if probes is None:
        probes = probes_wanted(index, lists, asked, k)
    asked = asked.mapInPandas(_probes(sent, probes), "cell int, query_id bigint, query_no bigint, query binary, lists binary")
    asked = written(asked, "probes")
    chunks_of = asked.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    asked = asked.join(F.broadcast(chunks_of), "cell").withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks")))
    queries = asked.groupBy("cell", "chunk").agg(F.collect_list(F.struct("query_id", "query_no", "query", "lists")).alias("queries"))
    # a chunk goes to each block of its cell; so a dense cell's work is dealt out over its blocks, not done under one key
    queries = queries.join(F.broadcast(blocks_of), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    found = blocks.join(queries, ["cell", "part"]).select("block", "queries").mapInPandas(_search(sent, k, rerank), "query_id bigint, query_no bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "query_no").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
