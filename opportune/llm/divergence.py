"""How the sources of a language differ in their terms: exact divergences of each two sources, and each source's typical terms.

Tasks tokenise whole batches of texts as bytes: a table of 256 entries says which bytes belong to terms, so boundaries are where
its values change; slices are grouped by their xxhash and each is compared with its group's first slice byte by byte. A batch's
documents x terms counts are a CSR matrix, whose rows are summed by source before they leave the task.

Sources are then compared in cells of a language's terms (BLOCK or so) and two tiles of its sources (TILE or so): each cell is a
CSR matrix of sources x terms of bounded size. A term that neither of two sources has adds the same to all terms' sum, so only
the matrix's entries are visited, and the rest is multiplied. Cells' sums are added up by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import small
from .common import prepare, written

LEAST_DOCS, TOP, UNIT = 10, 10, 1_000_000_000
#: Terms and sources of a cell, about (they are dealt out by hash).
BLOCK, TILE = 2048, 128
#: Slices, bytes or matrix entries that are worked on at a time; bounds a worker's memory.
AT_ONCE = 1 << 20

#: Bytes of terms: letters and all bytes of characters beyond ASCII.
IS_TERM = np.array([c >= 0x80 or chr(c).isalpha() for c in range(256)])
LOWER = np.array([c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)], np.uint8)


def slices_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the terms in concatenated texts; text k has the bytes offsets[k] to offsets[k + 1]."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = IS_TERM[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | border[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | border[1:])) + 1
    return starts, ends


def grouped(data: bytes, starts: np.ndarray, ends: np.ndarray, digest=xxhash.xxh64_intdigest) -> tuple[np.ndarray, list[bytes]]:
    """Number of each slice's distinct content, and those contents. Slices of one hash are compared byte by byte with the first."""
    hashes = np.empty(len(starts), np.uint64)
    for k in range(0, len(starts), AT_ONCE):
        some = slice(k, k + AT_ONCE)
        hashes[some] = np.fromiter((digest(data[a:b]) for a, b in zip(starts[some].tolist(), ends[some].tolist())), np.uint64, len(starts[some]))
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    raw, size = np.frombuffer(data, np.uint8), ends - starts
    like = first[number]
    same = size == size[like]
    # as many slices at a time as have AT_ONCE bytes, or one
    upto = np.cumsum(size)
    k = 0
    while k < len(starts):
        stop = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + AT_ONCE, "right")))
        part = np.arange(k, stop)[same[k:stop]]
        if len(part):
            n = size[part]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            equal = raw[np.repeat(starts[part], n) + place] == raw[np.repeat(starts[like[part]], n) + place]
            same[part] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
        k = stop
    terms = [data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    others: dict[bytes, int] = {}
    for k in np.flatnonzero(~same).tolist():  # another content with the same hash
        content = data[starts[k] : ends[k]]
        number[k] = others.setdefault(content, len(terms) + len(others))
    return number, terms + list(others)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, lang, source) to (lang, source, term, n, docs): occurrences in the batch's rows and rows that have the term; a null term for the group itself."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(0).cast(pa.large_binary())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = LOWER[np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
        offsets = offsets - offsets[0]
        names: dict[tuple, int] = {}
        group = np.fromiter((names.setdefault(g, len(names)) for g in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())), np.int64, batch.num_rows)
        starts, ends = slices_of(data, offsets)
        number, terms = grouped(data.tobytes(), starts, ends)
        doc = np.searchsorted(offsets, starts, "right") - 1
        width = max(1, len(terms))
        # CSR: entries by document and term, then summed over the documents of a group
        entry, n = np.unique(doc * width + number, return_counts=True)
        column = group[entry // width] * width + entry % width
        order = np.argsort(column, kind="stable")
        column, n = column[order], n[order]
        at = np.flatnonzero(np.r_[True, np.diff(column) != 0]) if len(column) else np.zeros(0, np.int64)
        total = np.add.reduceat(n, at) if len(at) else n
        docs = np.diff(np.r_[at, len(column)])
        owner, term = column[at] // width, column[at] % width
        langs, sources = (pa.array([g[k] for g in names], pa.binary()) for k in (0, 1))
        every = np.r_[owner, np.arange(len(names))]
        named = pa.concat_arrays([pa.array(terms, pa.binary()).take(pa.array(term)), pa.nulls(len(names), pa.binary())])
        columns = [langs.take(pa.array(every)), sources.take(pa.array(every)), named, np.r_[total, np.zeros(len(names), np.int64)], np.r_[docs, np.bincount(group, minlength=len(names))]]
        yield pa.RecordBatch.from_arrays([*columns[:3], *(pa.array(c.astype(np.int64)) for c in columns[3:])], ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): how often each source's rows have each term, and how many rows do; with a null term, all rows of the source.

    Terms are runs of ASCII letters and characters beyond ASCII, A-Z as a-z. Null texts, languages and sources count as ''.
    """
    prepare(docs.sparkSession)
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    found = rows.mapInArrow(_counts, "lang binary, source binary, term binary, n bigint, docs bigint")
    found = found.select(*[F.col(c).cast("string").alias(c) for c in ("lang", "source", "term")], "n", "docs")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(UNIT (n + 2) / (total + 2 terms)), exact for totals up to 9e15: a thousandth at a time."""
    rest, by, out = n + 2, total + 2 * terms, 0
    for _ in range(3):
        out, rest = out * 1000 + rest * 1000 // by, rest * 1000 % by
    return out + 1


def share_of(n: str, total: str, terms: str) -> Column:
    """The same as a column."""
    by = f"({total} + 2 * {terms})"
    rest, out = f"({n} + 2)", "0L"
    for _ in range(3):
        out, rest = f"({out} * 1000 + ({rest} * 1000) div {by})", f"(({rest} * 1000) % {by})"
    return F.expr(f"{out} + 1")


def distance(p, q):
    return (p - q) * (p - q) // (p + q)


def _cell(key: tuple, table: pa.Table) -> pa.Table:
    """Sums of two tiles' sources over a block of terms. Key: (lang, block, a, b); rows: (id, tile, term, n, total, terms), a null term for each source itself."""
    ids, row = np.unique(table["id"].to_numpy(), return_inverse=True)
    n, terms = table["n"].to_numpy(), int(table["terms"][0].as_py())
    tile, total = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    tile[row], total[row] = table["tile"].to_numpy(), table["total"].to_numpy()
    coded = table["term"].combine_chunks().dictionary_encode()
    width = len(coded.dictionary)
    value = np.zeros((len(ids), len(ids)), np.int64)
    if terms:
        named = ~coded.indices.is_null().to_numpy(zero_copy_only=False)
        count = np.zeros((len(ids), width), np.int64)
        count[row[named], coded.indices.drop_null().to_numpy()] = n[named]
        p, none = share(count, total[:, None], terms), share(np.zeros(len(ids), np.int64), total, terms)
        by_term, has = np.ascontiguousarray(p.T), count.T > 0
        owner, term = np.nonzero(count)  # the CSR matrix's entries, row by row
        own, common = np.zeros_like(value), np.zeros_like(value)
        step = max(1, AT_ONCE // len(ids))
        for k in range(0, len(owner), step):
            r, t = owner[k : k + step], term[k : k + step]
            f = distance(p[r, t][:, None], by_term[t])
            at = np.flatnonzero(np.r_[True, np.diff(r) != 0])
            own[r[at]] += np.add.reduceat(f, at)
            common[r[at]] += np.add.reduceat(np.where(has[t], f, 0), at)
        held = (count > 0).astype(np.int64)
        entries = held.sum(1)
        neither = (terms if key[1].as_py() == 0 else 0) - entries[:, None] - entries + held @ held.T  # over all blocks: terms that neither has
        value = own + own.T - common + neither * distance(none[:, None], none)
    within = key[2].as_py() == key[3].as_py()
    a, b = np.nonzero(~np.eye(len(ids), dtype=bool) if within else tile[:, None] != tile)
    return pa.table({"id": ids[a], "other": ids[b], "value": value[a, b]})


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of all sources of each language; see term_counts for texts.

    A language keeps the terms of at least least_docs of its rows. Each source, and the language, give each kept term a share of
    UNIT, smoothed by 2. Part 'pair' has each other source of the language with the divergence of the shares summed over kept
    terms, 0 if there are none; part 'term' has the kept terms that the source has more of than the language, the first `top` by
    divergence. Ranks go by value, then item in UTF-8 order. Rows count each time they are repeated; ids aren't read, so null or
    repeated ids are no special case. A language's only source has no pairs; an empty table gives no rows.
    """
    counted = term_counts(docs, text_col, lang_col, source_col)
    over = Window.partitionBy("lang", "term")
    kept = counted.withColumns({"in_docs": F.sum("docs").over(over), "lang_n": F.sum("n").over(over)})
    kept = written(kept.where(F.col("term").isNull() | (F.col("in_docs") >= least_docs)).select("lang", "source", "term", "n", "lang_n"), "terms")
    terms = kept.where("term is not null")
    langs = terms.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(langs, "lang", "left").fillna(0, ["terms", "lang_total"])
    split = lambda c, size: F.ceil(F.greatest(F.lit(1), F.col(c)) / size)
    sizes = sizes.withColumns({"blocks": split("terms", BLOCK), "tiles": split("sources", TILE)})
    groups = groups.join(sizes, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), "tiles"))
    groups = written(groups.withColumn("id", F.monotonically_increasing_id()), "groups")  # ids are settled once they are written

    rated = terms.join(small(groups), ["lang", "source"])
    typical = rated.withColumns({"p": share_of("n", "total", "terms"), "q": share_of("lang_n", "lang_total", "terms")}).where("n > 0 and p > q")
    typical = typical.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))

    keys = ["lang", "block", "a", "b"]
    rows = rated.withColumn("block", F.pmod(F.xxhash64("term"), "blocks")).unionByName(
        groups.withColumns({"term": F.lit(None).cast("string"), "n": F.lit(0).cast("bigint"), "lang_n": F.lit(0).cast("bigint"), "block": F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))})
    )
    rows = rows.where("sources > 1").withColumn("with", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)))
    cells = rows.withColumns({"a": F.least("tile", "with"), "b": F.greatest("tile", "with")}).select(*keys, "id", "tile", "term", "n", "total", "terms")
    sums = cells.groupBy(*keys).applyInArrow(_cell, "id bigint, other bigint, value bigint").groupBy("id", "other").agg(F.sum("value").alias("value"))
    named = small(groups.select("id", "lang", "source"))
    pairs = sums.join(named, "id").join(small(groups.select(F.col("id").alias("other"), F.col("source").alias("item"))), "other")
    out = []
    for rows, part, limit in ((pairs, "pair", None), (typical, "term", top)):
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        ranked = rows.select("lang", "source", F.lit(part).alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
        out.append(ranked.where(F.col("rank") <= limit) if limit is not None else ranked)
    return out[0].unionByName(out[1])
