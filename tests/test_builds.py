"""Builds that stop after any batch and go on: each row is there once, no finished batch is done again."""

import pytest
from pyspark.sql import functions as F

from quern.streaming import builds


class Stopped(Exception):
    pass


def test_a_stopped_build_goes_on(spark, tmp_path):
    root, rows, seen = str(tmp_path / "b"), spark.range(100), []

    def prepare(df):
        seen.append(df.agg(F.min("id")).first()[0] % 5)
        return df.withColumn("twice", F.col("id") * 2)

    def stop(k):
        if k == 2:
            raise Stopped

    with pytest.raises(LookupError):
        builds.built(spark, root)
    with pytest.raises(Stopped):  # killed after batch 2 is written and before it is entered
        builds.build(rows, root, F.col("id") % 5, 5, prepare, check=stop)
    assert sorted({r["id"] % 5 for r in builds.built(spark, root).collect()}) == [0, 1]
    assert builds.build(rows, root, F.col("id") % 5, 5, prepare, most=1) == 1
    assert builds.build(rows, root, F.col("id") % 5, 5, prepare) == 2
    assert builds.build(rows, root, F.col("id") % 5, 5, prepare) == 0
    assert seen == [0, 1, 2, 2, 3, 4]
    found = builds.built(spark, root).orderBy("id").collect()
    assert [(r["id"], r["twice"], r["batch"]) for r in found] == [(i, 2 * i, i % 5) for i in range(100)]
    assert {(r["batch"], r["run"]) for r in found} == {(0, 1), (1, 1), (2, 2), (3, 3), (4, 3)}


def test_a_run_that_was_given_up_adds_nothing(spark, tmp_path):
    root, rows = str(tmp_path / "b"), spark.range(10)

    def later(k):
        if k == 1 and len(builds.finished(spark, root)) == 1:
            builds.build(rows, root, F.col("id") % 2, 2)

    with pytest.raises(builds.Superseded):
        builds.build(rows, root, F.col("id") % 2, 2, check=later)
    assert sorted((r["id"], r["run"]) for r in builds.built(spark, root).collect()) == [(i, 1 if i % 2 == 0 else 2) for i in range(10)]
    with pytest.raises(ValueError):
        builds.build(rows, str(tmp_path / "c"), F.col("id"), 5)
