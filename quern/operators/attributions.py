"""What each feature adds to a tree model's output for each row: Shapley values by the paths of the trees."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources import tables

#: A table of tree nodes: a leaf has no ``feature``; a row goes ``left`` where its feature is at most ``threshold``, or one of ``categories``.
NODES = "tree int, node int, feature int, threshold double, categories array<double>, left int, right int, value double, cover double, weight double"


def node_table(model) -> DataFrame:
    """The nodes of a fitted Spark tree model (see :data:`NODES`), from the model as Spark saves it.

    ``value`` is what a leaf predicts: the share of class 1 for a forest of two classes, the prediction otherwise. ``cover`` is the weight of the training rows that
    reached a node, ``weight`` what the tree counts in the model's sum: boosted trees sum to a margin, forests to a mean.
    """
    spark = SparkSession.active()
    at = tables.folder(spark, "model")
    model.write().save(at)
    single = not hasattr(model, "treeWeights")
    boosted = type(model).__name__.startswith("GBT")
    shares = type(model).__name__ in ("RandomForestClassificationModel", "DecisionTreeClassificationModel")
    weights = [1.0] if single else [float(w) for w in model.treeWeights]
    total = 1.0 if boosted else sum(weights)
    data = spark.read.parquet(f"{at}/data")
    rows = data.select(F.lit(0).alias("tree"), F.struct("*").alias("n")) if single else data.select(F.col("treeID").alias("tree"), F.col("nodeData").alias("n"))
    stats, leaf, plain = F.col("n.impurityStats"), F.col("n.leftChild") < 0, F.col("n.split.numCategories") < 0
    all_ = F.aggregate(stats, F.lit(0.0), lambda s, x: s + x)
    cut = F.col("n.split.leftCategoriesOrThreshold")
    return rows.select(
        "tree",
        F.col("n.id").alias("node"),
        F.when(~leaf, F.col("n.split.featureIndex")).alias("feature"),
        F.when(~leaf & plain, F.get(cut, 0)).alias("threshold"),
        F.when(~leaf & ~plain, cut).alias("categories"),
        F.when(~leaf, F.col("n.leftChild")).alias("left"),
        F.when(~leaf, F.col("n.rightChild")).alias("right"),
        (F.get(stats, 1) / all_ if shares else F.col("n.prediction")).alias("value"),
        (all_ if shares else F.get(stats, 0)).alias("cover"),
        (F.get(F.lit(weights), F.col("tree")) / total).alias("weight"),
    )


@dataclass
class Path:
    """A leaf: the conditions that lead to it, one for each feature on the way, with the share of training rows that would go on if the feature were unknown."""

    value: float
    features: np.ndarray
    low: np.ndarray  # a row fits where low < x <= high
    high: np.ndarray
    only: list[np.ndarray | None]  # categories it must be one of, if any
    never: list[np.ndarray]  # categories it must not be
    share: np.ndarray

    def fits(self, x: np.ndarray) -> np.ndarray:
        """Rows by conditions. NaN goes right at every threshold, as it does in Spark."""
        own = x[:, self.features]
        with np.errstate(invalid="ignore"):
            out = ~(own <= self.low) & ((own <= self.high) | (self.high == np.inf))
        for i, (only, never) in enumerate(zip(self.only, self.never)):
            if only is not None:
                out[:, i] &= np.isin(own[:, i], only)
            if len(never):
                out[:, i] &= ~np.isin(own[:, i], never)
        return out


def paths(nodes: Sequence[dict], width: int) -> tuple[float, list[Path]]:
    """The mean output over the training rows, and the leaves of all trees; ``nodes`` are rows of :data:`NODES`, ``width`` the number of features."""
    by = {(n["tree"], n["node"]): n for n in nodes}
    children = {(n["tree"], c) for n in nodes for c in (n["left"], n["right"]) if c is not None}
    base, out = 0.0, []
    for root in sorted(k for k in by if k not in children):
        todo = [(root, {}, 1.0)]
        while todo:
            at, met, reach = todo.pop()
            n = by[at]
            if n["feature"] is None:
                base += n["weight"] * n["value"] * reach
                names = sorted(met)
                low, high, only, never, share = zip(*[met[f] for f in names]) if names else ((), (), (), (), ())
                some = [None if c is None else np.array(sorted(c)) for c in only]
                out.append(Path(n["weight"] * n["value"], np.array(names, int), np.array(low, float), np.array(high, float), some, [np.array(sorted(c)) for c in never], np.array(share, float)))
                continue
            f = n["feature"]
            if not 0 <= f < width:
                raise ValueError(f"feature {f} of {width}")
            for side in ("left", "right"):
                child = by[(at[0], n[side])]
                share = child["cover"] / n["cover"] if n["cover"] else 0.0
                if share == 0.0:  # no training row went there, so it counts nothing as unknown; a row that goes there still does
                    share = 1e-300
                low, high, only, never, known = met.get(f, (-np.inf, np.inf, None, frozenset(), 1.0))
                if n["categories"] is not None:
                    here = frozenset(n["categories"])
                    only, never = ((here if only is None else only & here), never) if side == "left" else (only, never | here)
                elif side == "left":
                    high = min(high, n["threshold"])
                else:
                    low = max(low, n["threshold"])
                todo.append(((at[0], n[side]), met | {f: (low, high, only, never, known * share)}, reach * share))
    return base, out


def shapley(leaves: Sequence[Path], x: np.ndarray) -> np.ndarray:
    """Rows by features: the Shapley values of the game whose players are features, each known or left to the trees' shares.

    A leaf's output with features known with probability t each is its value times a product over its conditions of ``t * fits + (1 - t) * share``; a
    feature's Shapley value is the integral over t of what knowing it adds. That is a polynomial of a degree less than the number of conditions, so
    a Gauss rule of half as many points is exact, and no subset is enumerated.
    """
    out = np.zeros(x.shape)
    rules = {}
    for leaf in leaves:
        d = len(leaf.features)
        if not d:
            continue
        points = d // 2 + 1
        if points not in rules:
            t, w = np.polynomial.legendre.leggauss(points)
            rules[points] = ((t + 1) / 2, w / 2)
        fits = leaf.fits(x).astype(float)
        total = np.zeros(fits.shape)
        for t, w in zip(*rules[points]):
            each = t * fits + (1 - t) * leaf.share
            before, after = np.ones(fits.shape), np.ones(fits.shape)
            np.cumprod(each[:, :-1], axis=1, out=before[:, 1:])
            after[:, :-1] = np.cumprod(each[:, :0:-1], axis=1)[:, ::-1]
            total += w * before * after  # the product of all others
        out[:, leaf.features] += leaf.value * (fits - leaf.share) * total
    return out


def attributed(rows: DataFrame, nodes: DataFrame, columns: Sequence[str], id_col: str) -> DataFrame:
    """``id, base, output, parts``: for each row of ``rows`` with all of ``columns``, what the trees of ``nodes`` (see :data:`NODES`) put out, their mean output over
    their training rows, and an array of what each column adds: base and parts sum to the output.

    Rows that lack a column are left out, as the models leave them out. A model is as large as the driver that fitted it allows, so its node table goes to the driver and to
    every worker; rows are never shuffled. Rows that repeat an id are rows of their own.
    """
    base, leaves = paths([r.asDict() for r in nodes.collect()], len(columns))
    shared = rows.sparkSession.sparkContext.broadcast((base, leaves))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, leaves = shared.value
        for batch in batches:
            x = np.column_stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(columns))]).astype(float) if len(batch) else np.empty((0, len(columns)))
            output = np.zeros(len(x))
            for leaf in leaves:
                output += leaf.value * leaf.fits(x).all(axis=1)
            parts = shapley(leaves, x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(columns), pa.int32()), pa.array(parts.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(x), base)), pa.array(output), lists], names=["id", "base", "output", "parts"])

    some = rows.select(F.col(id_col).alias("id"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).dropna(subset=[f"c{i}" for i in range(len(columns))])
    return some.mapInArrow(run, f"id {some.schema['id'].dataType.simpleString()}, base double, output double, parts array<double>")


def strongest(parts: DataFrame, columns: Sequence[str], k: int = 20) -> DataFrame:
    """``rank, feature_idx, feature_name, mean_abs``: the ``k`` columns whose parts are largest in the mean, without regard to sign. A task sends one row a column."""
    each = parts.select(F.posexplode("parts").alias("feature_idx", "part"))
    mean = each.groupBy("feature_idx").agg(F.avg(F.abs("part")).alias("mean_abs"))
    first = mean.orderBy(F.desc("mean_abs"), "feature_idx").limit(k)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("mean_abs")).alias("m"), "feature_idx")))  # as many as there are columns, at most k
    placed = first.agg(ordered.alias("all")).select(F.posexplode("all").alias("rank", "f"))
    return placed.select((F.col("rank") + 1).alias("rank"), "f.feature_idx", F.get(F.array(*[F.lit(c) for c in columns]), F.col("f.feature_idx")).alias("feature_name"), (-F.col("f.m")).alias("mean_abs"))
