"""Published tables: whole versions, torn writes, stale forms."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from opportune.sources import published


def frame(spark, n):
    return spark.range(n).select("id", (F.col("id") % 3).alias("part"), F.lit("x").alias("v")).repartition(2)


def test_versions_replace_each_other(spark, tmp_path):
    base = str(tmp_path)
    assert published.manifest(spark, base, "t") is None and published.state(spark, base, "t") == ("unpublished", None)
    (tmp_path / "t.csv").mkdir()
    (tmp_path / "t_other.csv").mkdir()
    first = published.publish(frame(spark, 10), base, "t", {"by": "test"})
    assert (first["version"], first["rows"], first["note"]) == (1, 10, {"by": "test"}) and published.read(spark, base, "t").count() == 10
    assert not (tmp_path / "t.csv").exists() and (tmp_path / "t_other.csv").exists()
    # a version may be made from the one that it replaces
    second = published.publish(published.read(spark, base, "t").where("id < 4"), base, "t", partition_by=["part"])
    assert second["version"] == 2 and published.read(spark, base, "t").columns == ["id", "part", "v"] and published.read(spark, base, "t").count() == 4
    assert sorted(n for n in os.listdir(tmp_path / "t") if not n.startswith(".")) == [second["data"], "manifest-2.json"]
    published.publish(frame(spark, 0), base, "t")
    assert published.read(spark, base, "t").count() == 0
    with pytest.raises(ValueError):
        published.publish(frame(spark, 1), base, "../t")


def test_a_torn_write_leaves_the_version_before(spark, tmp_path, monkeypatch):
    base = str(tmp_path)
    published.publish(frame(spark, 10), base, "t")
    monkeypatch.setattr(published, "schema_hash", lambda *_: 1 / 0)  # the writer dies after its data, before its manifest
    with pytest.raises(ZeroDivisionError):
        published.publish(frame(spark, 99), base, "t")
    monkeypatch.undo()
    assert published.read(spark, base, "t").count() == 10 and len(os.listdir(tmp_path / "t")) > 3
    published.publish(frame(spark, 20), base, "t")
    assert published.read(spark, base, "t").count() == 20 and len([n for n in os.listdir(tmp_path / "t") if n.startswith("data-")]) == 1


def test_lost_and_foreign_files_are_found(spark, tmp_path):
    base = str(tmp_path)
    for name in ("lost", "cut", "more", "fine"):
        published.publish(frame(spark, 10), base, name)
    file_of = lambda n: tmp_path / n / published.manifest(spark, base, n)["data"] / sorted(published.manifest(spark, base, n)["files"])[0]
    shutil.copy(file_of("more"), file_of("more").with_name("part-again.parquet"))
    file_of("lost").unlink()
    file_of("cut").write_bytes(b"PAR1")
    got = {r.name: r.state for r in published.inventory(spark, base, ["lost", "cut", "more", "fine", "never"]).collect()}
    assert got == {"lost": "torn", "cut": "torn", "more": "changed", "fine": "ok", "never": "unpublished"}
    with pytest.raises(ValueError, match="lost is torn"):
        published.read(spark, base, "lost")


def test_two_writers_of_a_version(spark, tmp_path, monkeypatch):
    base = str(tmp_path)
    published.publish(frame(spark, 10), base, "t")
    numbers = published._numbers
    monkeypatch.setattr(published, "_numbers", lambda s, f: [])  # a writer that looked before the other was done
    with pytest.raises(FileExistsError):
        published.publish(frame(spark, 5), base, "t")
    monkeypatch.setattr(published, "_numbers", numbers)
    assert published.read(spark, base, "t").count() == 10 and len([n for n in os.listdir(tmp_path / "t") if n.startswith("data-")]) == 1
