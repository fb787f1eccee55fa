"""Containment against looking for every term in every text."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import containment


@pytest.mark.parametrize("held", [containment.HELD, 60])
def test_terms_are_found_as_by_looking_everywhere(spark, held):
    rng = random.Random(held)
    make = lambda n: "".join(rng.choices(["a", "b", "the ", "é", "日", " ", "%", "."], k=n))
    texts = [make(rng.randint(0, 60)) for _ in range(120)] + [None, "", "a"]
    terms = [t[i : i + k] for t in texts if t for i, k in [(rng.randrange(len(t)), rng.choice([1, 2, 3, 7, 8, 9, 20]))]] + ["", None, "nowhere at all", "zz", "a", "a"]
    rows, asked = spark.createDataFrame(list(enumerate(texts)), "id int, body string").repartition(3), spark.createDataFrame(list(enumerate(terms)), "no int, term string")
    want = sorted((i, j) for i, t in enumerate(texts) for j, s in enumerate(terms) if t is not None and s is not None and s in t)
    found = containment.containing(rows, "body", asked, "term", held=held)
    assert found.columns == ["id", "body", "no", "term"]
    assert sorted((r["id"], r["no"]) for r in found.collect()) == want
    semi = containment.containing(rows, "body", asked, "term", "left_semi", held=held)
    assert sorted(r["id"] for r in semi.collect()) == sorted({i for i, _ in want})
    assert containment.containing(rows, "body", asked.limit(0), "term").collect() == []


def test_no_nested_loop(spark):
    rows, asked = spark.createDataFrame([(1, "some text")], "id int, body string"), spark.createDataFrame([("text",)], "term string")
    plan = containment.containing(rows, "body", asked, "term")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert containment.containing(rows.union(rows), "body", asked, "term", "left_semi").count() == 2
    assert containment.containing(rows.where(F.lit(False)), "body", asked, "term").count() == 0
