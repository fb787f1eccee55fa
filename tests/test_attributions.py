"""Tree attributions against Shapley values over all subsets."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import attributions, ml


def known(nodes, root, x, some):
    """A tree's output where only the features in ``some`` are known: others go both ways, by cover."""
    n = nodes[root]
    if n["feature"] is None:
        return n["value"]
    go = lambda side: known(nodes, (root[0], n[side]), x, some)
    v = x[n["feature"]]
    if n["feature"] in some:
        left = v in n["categories"] if n["categories"] is not None else v <= n["threshold"]
        return go("left" if left else "right")
    cover = lambda side: nodes[(root[0], n[side])]["cover"] / n["cover"]
    return cover("left") * go("left") + cover("right") * go("right")


def over_subsets(rows, x, width):
    nodes = {(n["tree"], n["node"]): n for n in rows}
    roots = {t: (t, 0) for t, _ in nodes}
    f = lambda some: sum(nodes[r]["weight"] * known(nodes, r, x, some) for r in roots.values())
    parts = []
    for j in range(width):
        others = [i for i in range(width) if i != j]
        parts.append(sum(math.factorial(k) * math.factorial(width - k - 1) / math.factorial(width) * (f({*s, j}) - f(set(s))) for k in range(width) for s in combinations(others, k)))
    return f(set()), f(set(range(width))), parts


COLUMNS = ["a", "b", "c", "d", "e"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    data = [(int(i), *map(float, np.r_[rng.normal(size=3), rng.integers(0, 4, 2)])) for i in range(400)]
    df = spark.createDataFrame(data, "id bigint, a double, b double, c double, d double, e double")
    return df.withColumn("y", ((F.col("a") * F.col("b") > 0.1) | (F.col("d") == 2)).cast("int"))


@pytest.mark.parametrize("kind, settings", [("forest", {"numTrees": 4, "maxDepth": 5}), ("boosted", {"maxIter": 4, "maxDepth": 3}), ("forest_regression", {"numTrees": 3, "maxDepth": 4}), ("boosted_regression", {"maxIter": 3, "maxDepth": 4})])
def test_parts_are_shapley_values(spark, rows, kind, settings):
    model = ml.fitted(rows, COLUMNS, "y", kind, **settings)
    nodes = attributions.node_table(model)
    found = {r["id"]: r for r in attributions.attributed(rows, nodes, COLUMNS, "id").collect()}
    assert len(found) == 400
    if kind == "forest":
        want = {r["id"]: r["p"] for r in ml.probabilities(model, rows, COLUMNS, "y", "id").collect()}
    elif kind == "boosted":
        want = {r["id"]: -0.5 * math.log(1 / r["p"] - 1) for r in ml.probabilities(model, rows, COLUMNS, "y", "id").collect()}
    else:
        want = {r["id"]: r["prediction"] for r in model.transform(ml.assembled(rows, COLUMNS, "y")).collect()}
    for i, r in found.items():
        assert r["output"] == pytest.approx(want[i], abs=1e-9)
        assert r["base"] + sum(r["parts"]) == pytest.approx(r["output"], abs=1e-9)
    table = [n.asDict() for n in nodes.collect()]
    for r in rows.where("id % 37 = 0").collect():
        base, output, parts = over_subsets(table, [r[c] for c in COLUMNS], len(COLUMNS))
        assert found[r["id"]]["base"] == pytest.approx(base, abs=1e-9) and found[r["id"]]["output"] == pytest.approx(output, abs=1e-9)
        assert found[r["id"]]["parts"] == pytest.approx(parts, abs=1e-9)


def test_categories_missing_numbers_and_deep_paths(spark):
    leaf = lambda t, n, v, c: (t, n, None, None, None, None, None, v, c, 1.0)
    # a feature's categories are split twice; a threshold sees NaN; a path of 30 different features
    first = [(0, 0, 0, None, [1.0, 2.0], 1, 2, 0.0, 10.0, 1.0), (0, 1, 0, None, [2.0], 3, 4, 0.0, 6.0, 1.0), (0, 2, 0, None, [3.0], 5, 6, 0.0, 4.0, 1.0)]
    first += [leaf(0, 3, 1.0, 2.0), leaf(0, 4, 2.0, 4.0), leaf(0, 5, 3.0, 1.0), leaf(0, 6, 7.0, 3.0)]
    first += [(1, 0, 1, 0.5, None, 1, 2, 0.0, 4.0, 1.0), leaf(1, 1, -1.0, 1.0), leaf(1, 2, 5.0, 3.0)]
    nodes = spark.createDataFrame(first, attributions.NODES)
    rows = spark.createDataFrame([(1, 1.0, 0.0), (2, 2.0, 1.0), (3, 3.0, float("nan")), (4, 9.0, 0.5), (5, None, 1.0)], "id int, a double, b double")
    found = {r["id"]: r for r in attributions.attributed(rows, nodes, ["a", "b"], "id").collect()}
    assert {i: r["output"] for i, r in found.items()} == {1: 1.0, 2: 6.0, 4: 6.0}  # a row without a number is no row of the models
    for i, x in ((1, [1.0, 0.0]), (2, [2.0, 1.0]), (4, [9.0, 0.5])):
        base, _, parts = over_subsets([n.asDict() for n in nodes.collect()], x, 2)
        assert found[i]["base"] == pytest.approx(base) and found[i]["parts"] == pytest.approx(parts)

    depth = 30
    table = [(0, 2 * i, i, 0.0, None, 2 * i + 1, 2 * i + 2, 0.0, 2.0**-i, 1.0) for i in range(depth)] + [leaf(0, 2 * i + 1, 0.0, 2.0 ** -(i + 1)) for i in range(depth)] + [leaf(0, 2 * depth, 1.0, 2.0**-depth)]
    base, leaves = attributions.paths([dict(zip([c.split()[0] for c in attributions.NODES.split(", ")], n)) for n in table], depth)
    parts = attributions.shapley(leaves, np.ones((1, depth)))[0]
    assert parts == pytest.approx([(1 - 2.0**-depth) / depth] * depth, abs=1e-12)  # all alike, by symmetry of the game


def test_strongest(spark):
    parts = spark.createDataFrame([(1, [0.5, -2.0, 0.0]), (2, [-0.5, 1.0, 0.1])], "id int, parts array<double>")
    found = [(r["rank"], r["feature_idx"], r["feature_name"], round(r["mean_abs"], 6)) for r in attributions.strongest(parts, ["x", "y", "z"], 2).orderBy("rank").collect()]
    assert found == [(1, 1, "y", 1.5), (2, 0, "x", 0.5)]
    assert attributions.strongest(parts.limit(0), ["x"], 2).count() == 0
