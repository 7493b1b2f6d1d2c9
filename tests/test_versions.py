"""Tables replaced as a whole: what a reader sees when a writer stops half way."""
import pytest
from pyspark.sql import functions as F

from cohortloom.sources import versions


def values(spark, path, version=None):
    return sorted(tuple(r) for r in versions.read(spark, path, version).collect())


def test_a_writer_that_stops_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    assert versions.publish(spark.createDataFrame([(1, "a")], "n int, s string"), path) == 1

    def stop(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(versions, "_announce", stop)
        with pytest.raises(RuntimeError):
            versions.publish(spark.createDataFrame([(2, "b")], "n int, s string"), path)
    assert values(spark, path) == [(1, "a")] and versions.newest(spark, path)["version"] == 1
    assert versions.publish(spark.createDataFrame([(3, "c")], "n int, s string"), path) == 2
    assert values(spark, path) == [(3, "c")] and values(spark, path, 1) == [(1, "a")]


def test_a_first_writer_that_stops_does_not_block_the_path(spark, tmp_path, monkeypatch):
    path, df = str(tmp_path / "t"), spark.range(5)
    with monkeypatch.context() as m:
        m.setattr(versions, "_announce", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            versions.publish_once(df, path)
    with pytest.raises(FileNotFoundError):
        versions.read(spark, path)
    assert versions.publish_once(df, path) == "CREATED" and versions.publish_once(df.repartition(3), path) == "REUSED"
    with pytest.raises(ValueError):
        versions.publish_once(df.withColumn("id", F.col("id") + 1), path)
    assert values(spark, path) == [(i,) for i in range(5)]


def test_partitions_keep_their_types_and_empty_tables_their_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "007", 1.5), (2, None, None)], "n int, p string, v double")
    versions.publish(df, path, ["n"], ["p"])
    assert versions.read(spark, path).dtypes == df.dtypes and sorted(versions.read(spark, path).collect(), key=str) == sorted(df.collect(), key=str)
    row = versions.newest(spark, path)
    assert row["rows"] == 2 and row["files"] >= 2
    versions.publish(df.where("false"), path)
    assert values(spark, path) == [] and versions.read(spark, path).columns == df.columns


def test_two_writers_at_once_leave_whole_tables(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    versions.publish(spark.range(3), path)
    announce = versions._announce

    def late(s, p, manifest):
        monkeypatch.setattr(versions, "_announce", announce)
        versions.publish(spark.range(100, 104), path)  # another writer comes first
        announce(s, p, manifest)

    monkeypatch.setattr(versions, "_announce", late)
    versions.publish(spark.range(10, 15), path)
    assert versions.history(spark, path).where("version = 2").count() == 2
    assert values(spark, path) in ([(i,) for i in range(100, 104)], [(i,) for i in range(10, 15)]) and values(spark, path) == values(spark, path)
    with pytest.raises(FileNotFoundError):
        versions.read(spark, path, 9)
