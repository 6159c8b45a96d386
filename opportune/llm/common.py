"""Small helpers shared by the text operators: written tables, task-side batching, checked settings."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import written  # noqa: F401

#: Bits of the map of a set of keys.
BITS = 1 << 25
#: Characters of text that one task works on at a time; bounds the Python worker's memory.
CHUNK_CHARS = 1_000_000


#: Bytes of one Arrow batch that goes to a Python worker.
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> None:
    """Ready the session's Python workers: they have this package, and batches bounded by bytes, not only by rows, as rows have any length."""
    ship(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(name)).rstrip("bB")  # the default is in bytes
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application, so that no executor needs it installed."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        top = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp()) / f"{top.name}.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        context.addPyFile(str(path))
        _shipped.add(context.applicationId)


def unused(df: DataFrame, name: str) -> str:
    """name, lengthened until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def possibly_in(df: DataFrame, hashed: Column, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """df in two parts: rows whose hash surely is not among keys' column `key` (longs), and the rest, in which it may be.

    Only the rest then needs a join with keys, so rows with long texts aren't shuffled because of a few keys. The keys' hashes are
    marks in a bitmap of BITS bits, which is broadcast: 4 MB at any number of keys (with far more keys than bits, all rows are in
    the second part).
    """
    bit = lambda c: F.pmod(c, F.lit(BITS))
    names = [unused(df, c) for c in ("__block", "__bitmap", "__bit")]
    block, bitmap, at = names
    bitmaps = keys.select(bit(F.col(key)).alias(at)).groupBy(F.expr(f"`{at}` div 32768").alias(block)).agg(F.bitmap_construct_agg(F.col(at) % 32768).alias(bitmap))
    marked = df.withColumn(at, bit(hashed)).join(F.broadcast(bitmaps), F.expr(f"`{at}` div 32768") == F.col(block), "left")
    byte = F.conv(F.hex(F.expr(f"substring(`{bitmap}`, cast((`{at}` % 32768) div 8 + 1 as int), 1)")), 16, 10).cast("int")
    hit = F.coalesce(F.expr(f"`{at}` % 8").cast("int"), F.lit(0))
    found = F.coalesce(byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), hit + 1)) != 0, F.lit(False))
    return marked.where(~found).select(df.columns), marked.where(found).select(df.columns)


#: Most keys that one broadcast of `with_key_rows` holds.
HOT_KEYS = 4096


def with_key_rows(rows: DataFrame, keys: DataFrame, key: str, size: str, how: str = "inner") -> DataFrame:
    """rows joined ("inner" or "left") with their key's row of `keys`, nulls being equal; keys has one row for each key, size its number of rows.

    At most HOT_KEYS keys can hold over 1/HOT_KEYS of all these rows: they are broadcast, so that the rows of a hot key stay where
    they are; the others' rows are shuffled. The key comes from rows, `size` and the other columns from keys.
    """
    own = unused(rows, "__key")
    keys = keys.withColumnRenamed(key, own)
    same = F.col(key).eqNullSafe(F.col(own))
    if keys.limit(HOT_KEYS + 1).count() <= HOT_KEYS:
        return rows.join(F.broadcast(keys), same, how).drop(own)
    total = keys.agg(F.sum(size)).first()[0]
    is_hot = F.col(size) * HOT_KEYS > total
    hot = F.broadcast(keys.where(is_hot))
    others = rows.join(F.broadcast(hot.select(own)), same, "left_anti").join(keys.where(~is_hot), same, how)
    return rows.join(hot, same).unionByName(others).drop(own)


def chunks(texts: Iterable[str | None], limit: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """Consecutive texts in lists of at most `limit` characters (a longer text is a list of its own); null becomes ''."""
    block, size = [], 0
    for text in texts:
        text = text or ""
        if block and size + len(text) > limit:
            yield block
            block, size = [], 0
        block.append(text)
        size += len(text)
    if block:
        yield block
