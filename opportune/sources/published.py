"""Published tables: versions with a manifest that is written last, so that a reader sees a whole version or the one before.

A table's folder holds data folders, one for each version, and manifests, numbered. A manifest names its data folder, rows, schema
and every file with its size; it appears at once, by a rename that fails if another writer was first. Whatever no manifest names
is not part of the table: what a failed writer leaves is never read, and goes with the next version.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from .tables import file_system

#: Other forms of a table that stand beside its folder, and that a new version makes stale.
STALE_FORMS = (".csv", ".json", ".parquet", ".md", ".tex")
STATES = ("ok", "unpublished", "torn", "changed")


def _folder(base: str, name: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9][\w.-]*", name):
        raise ValueError(f"not a table's name: {name}")
    return f"{base.rstrip('/')}/{name}"


def schema_hash(df: DataFrame, but: Sequence[str] = ()) -> str:
    """Hash of the columns' names and types, in order; nullability and notes don't count, as files don't keep them alike.

    but: columns by which the files are partitioned; their types aren't in the files.
    """
    return hashlib.sha256(json.dumps([[f.name, f.dataType.simpleString()] for f in df.schema if f.name not in but]).encode()).hexdigest()


def _files(spark: SparkSession, folder: str) -> dict[str, int]:
    """Data files under a folder by their path in it, and their bytes."""
    fs, root = file_system(spark, folder)
    out = {}
    listed = fs.listFiles(root, True)
    top = fs.makeQualified(root).toUri().getPath().rstrip("/") + "/"
    while listed.hasNext():
        status = listed.next()
        path = status.getPath().toUri().getPath()
        if not status.getPath().getName().startswith(("_", ".")):
            out[path.removeprefix(top)] = status.getLen()
    return out


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of a table's manifests, ascending."""
    fs, root = file_system(spark, folder)
    if not fs.exists(root):
        return []
    found = (re.fullmatch(r"manifest-(\d+)\.json", s.getPath().getName()) for s in fs.listStatus(root))
    return sorted(int(m[1]) for m in found if m)


def manifest(spark: SparkSession, base: str, name: str) -> dict | None:
    """The newest manifest of a table; None if it was never published."""
    folder = _folder(base, name)
    numbers = _numbers(spark, folder)
    if not numbers:
        return None
    return json.loads(spark.read.text(f"{folder}/manifest-{numbers[-1]}.json", wholetext=True).first()[0])


def publish(df: DataFrame, base: str, name: str, note: dict | None = None, partition_by: Sequence[str] = ()) -> dict:
    """Write df as the table's next version and return its manifest.

    Data first, then the manifest, then what is stale goes: older versions, leftovers, and other forms of the table beside its
    folder. df may read the version that it replaces. A second writer of the same version raises and leaves nothing behind.
    """
    spark, folder = df.sparkSession, _folder(base, name)
    number = (_numbers(spark, folder) or [0])[-1] + 1
    data = f"data-{uuid.uuid4().hex}"
    writer = df.write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{folder}/{data}")
    back = spark.read.schema(df.schema).parquet(f"{folder}/{data}")
    out = {"name": name, "version": number, "data": data, "rows": back.count(), "schema": schema_hash(df, partition_by), "partition_by": list(partition_by), "columns": [[f.name, f.dataType.simpleString()] for f in df.schema], "files": _files(spark, f"{folder}/{data}"), "note": note or {}}
    fs, root = file_system(spark, folder)
    path = lambda n: spark._jvm.org.apache.hadoop.fs.Path(root, n)
    draft, final = path(f".manifest-{uuid.uuid4().hex}"), path(f"manifest-{number}.json")
    stream = fs.create(draft, False)
    stream.write(bytearray(json.dumps(out, sort_keys=True).encode()))
    stream.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        fs.delete(path(data), True)
        raise FileExistsError(f"version {number} of {name} was published by another writer")
    for status in fs.listStatus(root):
        if status.getPath().getName() not in (data, f"manifest-{number}.json"):
            fs.delete(status.getPath(), True)
    for form in STALE_FORMS:
        other = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}{form}")
        if fs.exists(other):
            fs.delete(other, True)
    return out


def state(spark: SparkSession, base: str, name: str) -> tuple[str, dict | None]:
    """A table's state and manifest: ok; unpublished; torn (a file is missing or of another size); changed (files were added, or another schema)."""
    found = manifest(spark, base, name)
    if found is None:
        return "unpublished", None
    folder = f"{_folder(base, name)}/{found['data']}"
    fs, root = file_system(spark, folder)
    files = _files(spark, folder) if fs.exists(root) else {}
    if any(files.get(n) != size for n, size in found["files"].items()):
        return "torn", found
    if len(files) > len(found["files"]) or (files and schema_hash(spark.read.parquet(folder).drop(*found["partition_by"]), found["partition_by"]) != found["schema"]):
        return "changed", found
    return "ok", found


def read(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The table's newest version, after its files were held against the manifest; ValueError says what is wrong with it."""
    now, found = state(spark, base, name)
    if now != "ok":
        raise ValueError(f"{name} is {now}")
    schema = ", ".join(f"`{c}` {t}" for c, t in found["columns"])
    return spark.read.schema(schema).parquet(f"{_folder(base, name)}/{found['data']}").select([c for c, _ in found["columns"]])


def inventory(spark: SparkSession, base: str, names: Sequence[str]) -> DataFrame:
    """(name, state, version, rows, files, bytes): a row for each table that there should be."""
    rows = []
    for n in names:
        now, found = state(spark, base, n)
        rows.append((n, now, *((found["version"], found["rows"], len(found["files"]), sum(found["files"].values())) if found else (None, None, None, None))))
    return spark.createDataFrame(rows, "name string, state string, version int, rows bigint, files int, bytes bigint")
