"""Reading and writing tables: string-first CSV, Parquet with projection, schema contracts, results with a JSON note, file choice."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv_as_text(spark: SparkSession, path: str, columns: list[str], sep: str = ",", null_tokens: tuple[str, ...] = ("Null", "NULL", "")) -> DataFrame:
    """A CSV file with a header, every column a string, null tokens null. Nothing is inferred, so the file is read once."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.csv(path, header=True, schema=schema, sep=sep, multiLine=False, enforceSchema=False)
    return df.select([F.when(~F.col(c).isin(*null_tokens), F.col(c)).alias(c) for c in columns])


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """Columns and predicate reach the scan."""
    df = spark.read.parquet(path)
    df = df.where(where) if where else df
    return df.select(columns) if columns else df


def align(df: DataFrame, contract: dict[str, str], renames: dict[str, str] | None = None) -> DataFrame:
    """df with the contract's columns, in order and cast: renamed columns fill gaps of their targets, missing ones are null."""
    for old, new in (renames or {}).items():
        if old in df.columns:
            df = df.withColumn(new, F.coalesce(F.col(new), F.col(old)) if new in df.columns else F.col(old)).drop(old)
    return df.select([(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in contract.items()])


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by name; columns that a frame lacks are null."""
    if not frames:
        raise ValueError("no frames")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def merged_shards(frames: list[DataFrame], expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of shards that cover the expected keys exactly; ValueError if a key is missing, foreign or in two shards."""
    out = union_all(frames)
    per = out.groupBy(*keys).agg(F.count("*").alias("__n"))
    both = per.join(expected.select(*keys, F.lit(1).alias("__e")).distinct(), list(keys), "full_outer")
    bad = both.agg(*[F.count(F.when(F.expr(c), 1)).alias(n) for n, c in (("missing", "__n is null"), ("foreign", "__e is null"), ("repeated", "__n > 1"))]).first()
    if any(bad):
        raise ValueError(f"shards don't cover the keys: {bad.asDict()}")
    return out


def write_result(df: DataFrame, path: str, note: dict | None = None, partition_by: list[str] | None = None) -> None:
    """Replace the Parquet table at path; the note goes beside it as one JSON line, through Spark, to whatever store holds it."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    if note is not None:
        spark = df.sparkSession
        spark.createDataFrame([(json.dumps(note, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path.rstrip("/") + "_note")


def write_csv(df: DataFrame, path: str) -> None:
    """A report table as one CSV file with a header, in the table's order. For tables of a report's size, not for rows of a corpus."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def as_markdown(df: DataFrame, most: int = 200) -> str:
    """A report table as Markdown, bars in cells escaped; more than `most` rows raise ValueError, as a report isn't to be cut silently."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows")
    lines = [df.columns, ["-"] * len(df.columns), *[["" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in r] for r in rows]]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path for it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def modified(spark: SparkSession, path: str) -> int | None:
    """When a file, or the newest file of a folder, was written, in milliseconds; None if there is none. Asks the path's own store."""
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return None
    return max([fs.getFileStatus(p).getModificationTime(), *(s.getModificationTime() for s in fs.listStatus(p))])


def is_complete(spark: SparkSession, path: str) -> bool:
    """Does a written table have the marker that its last task's commit leaves?"""
    fs, p = file_system(spark, path)
    return fs.exists(p) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))


def newest(spark: SparkSession, candidates: Sequence[str]) -> str | None:
    """Of the paths that exist the one written last; ties go to the earlier in the list. None if none exists."""
    found = [(modified(spark, p), -k, p) for k, p in enumerate(candidates)]
    return max((f for f in found if f[0] is not None), default=(0, 0, None))[2]


def first_existing(spark: SparkSession, candidates: Sequence[str]) -> str:
    """The first path that exists; FileNotFoundError names all if none does."""
    for p in candidates:
        if modified(spark, p) is not None:
            return p
    raise FileNotFoundError(", ".join(candidates))


def mapped_tables(spark: SparkSession, base: str, files: Mapping[str, str], required: Sequence[str] = (), only: Sequence[str] | None = None) -> dict[str, str]:
    """Canonical table names to their paths under base. A missing required table raises, a missing optional one is left out.

    only: names to take; a name that the mapping lacks raises KeyError.
    """
    chosen = {n: files[n] for n in (only if only is not None else files)}
    out = {}
    for name, file in chosen.items():
        path = f"{base.rstrip('/')}/{file}"
        if modified(spark, path) is not None:
            out[name] = path
        elif name in required:
            raise FileNotFoundError(path)
    return out


def layer_path(base: str, layer: str, is_local: bool) -> str:
    """The folder of a layer; the raw layer is closed to local runs, which take the sample layer."""
    if layer == "raw" and is_local:
        raise PermissionError("local runs read the sample layer")
    return f"{base.rstrip('/')}/{layer}"


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, md5) of each file under path, read by the executors; a file must fit in a task."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"), F.md5("content").alias("md5"))


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. Only a local master may leave it unset: then a folder on this machine is used."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "opportune-checkpoints")
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: what follows survives lost executors and doesn't repeat the work.

    The table belongs to the run: it goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/opportune/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, p = file_system(spark, path)
    fs.deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """df with a hint to broadcast it if a count shows that it has at most so many rows; else with one to sort and merge.

    Either hint keeps Spark from broadcasting the other side: it judges sizes by compressed files and projected columns, which may
    be a hundredth of the rows that a broadcast puts into the driver.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")


def read_table_dir(spark: SparkSession, base: str, names: list[str], required: list[str] = ()) -> dict[str, DataFrame]:
    """The tables that exist under base; a missing required one raises."""
    return {n: spark.read.parquet(p) for n, p in mapped_tables(spark, base, {n: f"{n}.parquet" for n in names}, required).items()}
