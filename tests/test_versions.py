import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trekmill.sources import versions


def rows(spark, *values):
    return spark.createDataFrame([(v, v % 2) for v in values], "v long, part long")


def test_tables_change_together_and_readers_stay(spark, tmp_path):
    root = f"file://{tmp_path}/p"
    with pytest.raises(FileNotFoundError):
        versions.open_package(spark, root)
    first = versions.commit(spark, root, {"stops": rows(spark, 1, 2), "trips": rows(spark, 3)}, partitions={"stops": ["part"]})
    second = versions.commit(spark, root, {"trips": rows(spark, 4, 5)})
    assert (first.version, second.version) == (1, 2) and versions.versions(spark, root) == [1, 2]
    assert sorted(r.v for r in first.table("trips").collect()) == [3] and sorted(r.v for r in second.table("trips").collect()) == [4, 5]
    assert second.tables["stops"] == first.tables["stops"] and second.rows("stops") == 2
    assert {(r.v, r.part) for r in second.table("stops").collect()} == {(1, 1), (2, 0)}
    assert versions.open_package(spark, root, 1).rows("trips") == 1


def test_a_failed_writer_leaves_the_old_version(spark, tmp_path):
    root = f"file://{tmp_path}/p"
    versions.commit(spark, root, {"a": rows(spark, 1), "b": rows(spark, 1)})
    broken = rows(spark, 2).withColumn("v", F.raise_error(F.lit("no")).cast("long"))
    with pytest.raises((PySparkException, Exception)):
        versions.commit(spark, root, {"a": rows(spark, 2), "b": broken})
    now = versions.open_package(spark, root)
    assert now.version == 1 and [r.v for r in now.table("a").collect()] == [1] == [r.v for r in now.table("b").collect()]
    versions.commit(spark, root, {"a": rows(spark, 3), "b": rows(spark, 3)})
    assert len(list((tmp_path / "p/data").iterdir())) == 2  # what the failed writer left is gone


def test_of_two_writers_one_is_refused(spark, tmp_path):
    root = f"file://{tmp_path}/p"
    versions.commit(spark, root, {"a": rows(spark, 1)})
    versions.commit(spark, root, {"a": rows(spark, 2)}, base=1)
    with pytest.raises(versions.Conflict):
        versions.commit(spark, root, {"a": rows(spark, 3)}, base=1)
    with pytest.raises(versions.Conflict):  # both saw version 1; the manifest of version 2 is there
        versions._publish(spark, f"{root}/manifest/{2:012d}.json", "{}")
    assert [r.v for r in versions.open_package(spark, root).table("a").collect()] == [2]
    assert not [p for p in (tmp_path / "p/manifest").iterdir() if p.name.endswith(".part")]


def test_old_versions_go(spark, tmp_path):
    root = f"file://{tmp_path}/p"
    for v in range(4):
        versions.commit(spark, root, {"a": rows(spark, v)} | ({"kept": rows(spark, 9)} if v == 0 else {}), keep=2)
    assert versions.versions(spark, root) == [3, 4]
    last = versions.open_package(spark, root)
    assert [r.v for r in last.table("kept").collect()] == [9] and [r.v for r in versions.open_package(spark, root, 3).table("a").collect()] == [2]
    assert len(list((tmp_path / "p/data").iterdir())) == 3
