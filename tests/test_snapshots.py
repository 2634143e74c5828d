"""Commits to tables of snapshots."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from slotcast import schemas
from slotcast.operators import overwrite
from slotcast.schemas import KEYS
from slotcast.sources import snapshots

T1 = dt.datetime(2024, 1, 1)


def at(hours):
    return T1 + dt.timedelta(hours=hours)


def rows_of(df):
    return sorted((r.ds, r.sales_type_id, r.y) for r in df.collect())


def read(spark, path, *dates, **more):
    return rows_of(snapshots.read_days(spark, path, schemas.SALES, *dates, **more))


def test_first_commit_and_repeated_ones(spark, sales, tmp_path):
    path = str(tmp_path / "fresh" / "actual")
    assert read(spark, path) == [] and snapshots.versions(spark, path) == []
    new = sales([(T1, 1, 10, None, 9.0), (at(100), 1, 10, None, 8.0)])
    for number in (1, 2):
        assert overwrite.commit_actuals(path, new, new.select(*KEYS), T1, at(47)) == number
        assert read(spark, path) == [(T1, 10, 9.0)]


def test_commit_keeps_siblings_and_other_days(spark, sales, tmp_path):
    path = str(tmp_path / "actual")
    old = [(T1, 1, 10, None, 1.0), (T1, 1, 11, 5, 1.0), (at(24), 1, 10, None, 2.0), (at(72), 1, 10, None, 4.0)]
    snapshots.commit_days(path, sales(old))
    new = sales([(T1, 1, 10, None, 9.0)])
    overwrite.commit_actuals(path, new, new.select(*KEYS), T1, at(47))
    assert read(spark, path) == [(T1, 10, 9.0), (T1, 11, 1.0), (at(72), 10, 4.0)]
    assert read(spark, path, dt.date(2024, 1, 2), dt.date(2024, 1, 9)) == [(at(72), 10, 4.0)]
    assert read(spark, path, version=1) == sorted((o[0], o[2], o[4]) for o in old)
    with pytest.raises(ValueError):
        read(spark, path, version=7)


def test_a_run_that_stops_leaves_the_table_as_it_was(spark, sales, tmp_path, monkeypatch):
    path = str(tmp_path / "actual")
    snapshots.commit_days(path, sales([(T1, 1, 10, 5, 1.0)]))
    frame = snapshots.read_days(spark, path, schemas.SALES)

    def stop(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as patch:
        patch.setattr(snapshots, "_publish", stop)
        with pytest.raises(RuntimeError, match="stopped"):
            snapshots.commit_days(path, sales([(T1, 1, 10, 5, 2.0)]))
    assert read(spark, path) == [(T1, 10, 1.0)]
    snapshots.commit_days(path, sales([(T1, 1, 10, 5, 3.0)]))
    # A reader that began before the commit sees the old version.
    assert rows_of(frame) == [(T1, 10, 1.0)] and read(spark, path) == [(T1, 10, 3.0)]
    # The stopped run's files go; both snapshots and what they list stay.
    assert len(snapshots.remove_unlisted(spark, path)) == 1
    assert rows_of(frame) == [(T1, 10, 1.0)] and read(spark, path) == [(T1, 10, 3.0)]
    snapshots.remove_unlisted(spark, path, keep=1)
    assert snapshots.versions(spark, path) == [2] and read(spark, path) == [(T1, 10, 3.0)]


def test_two_runs_from_one_snapshot(spark, sales, tmp_path, monkeypatch):
    path = str(tmp_path / "actual")
    base = snapshots.commit_days(path, sales([(T1, 1, 10, 5, 1.0)]))
    snapshots.commit_days(path, sales([(T1, 1, 10, 5, 2.0)]), base=base)
    with pytest.raises(snapshots.ConcurrentCommit):
        snapshots.commit_days(path, sales([(T1, 1, 10, 5, 3.0)]), base=base)
    # Both found the same newest snapshot; the rename of the second one fails.
    with monkeypatch.context() as patch:
        patch.setattr(snapshots, "versions", lambda *_: [1])
        with pytest.raises(snapshots.ConcurrentCommit):
            snapshots.commit_days(path, sales([(T1, 1, 10, 5, 4.0)]))
    assert read(spark, path) == [(T1, 10, 2.0)]
    assert not [n for n in os.listdir(f"{path}/snapshots") if n.startswith("_")]


def test_odd_commits(spark, sales, tmp_path):
    path = str(tmp_path / "actual")
    with pytest.raises(ValueError, match="without a time"):
        snapshots.commit_days(path, sales([(None, 1, 10, 5, 1.0)]))
    assert snapshots.versions(spark, path) == []
    snapshots.commit_days(path, sales([]))
    assert read(spark, path) == []
    many = spark.range(400).select(
        (F.lit(T1) + F.make_dt_interval(F.col("id").cast("int"))).alias("ds"),
        *[F.lit(1).cast("long").alias(k) for k in KEYS],
        F.col("id").cast("double").alias("y"),
    )
    snapshots.commit_days(path, many)
    assert len(read(spark, path)) == 400
    # Dates of the range that get no rows become empty.
    snapshots.commit_days(path, many.limit(0), dt.date(2024, 1, 2), dt.date(2024, 1, 31))
    assert len(read(spark, path)) == 370
