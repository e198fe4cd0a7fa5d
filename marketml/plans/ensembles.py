"""Trees, forests and boosted trees that do not depend on where rows lie.

The features are levels (``operators/binning.py``), so rows of equal levels always share a leaf.
One aggregation turns the rows into cells: the levels, a weight and a label sum.  Every tree is then fitted by MLlib on
cells, however many rows there were, and the result is an ordinary MLlib model.

Two things make a fit on MLlib depend on placement, and both are gone here.

* Sums of doubles depend on their order, and the last bit decides between splits of equal gain, which are
  common in small nodes.  Labels and residuals are rounded to a power of two (``grid_unit``) so coarse
  that all sums of them and of their squares are exact: at 2,000 rows that is two millionths of the largest
  label, at a billion rows two thousandths.
* MLlib draws bootstrap weights from a generator seeded by the partition number.  Here a row's weight
  in a tree is a Poisson(1) draw from a hash of (seed, tree, row key), the same on any layout and in SQL.

Feature subsets stay MLlib's (drawn on the driver for every node from the seed), or, with ``feature_share``,
are chosen for every tree by hash.

Scale: one shuffle of partially aggregated cells, at most min(rows, levels ^ features) of them; all trees of a
forest share it.  A boosted fit keeps its cells' predictions in storage and writes them to the shared folder
every ``CHECKPOINT`` trees, so lineage stays short.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed
from pyspark.ml.regression import (
    DecisionTreeRegressionModel,
    GBTRegressionModel,
    RandomForestRegressionModel,
    RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketml.operators.binning import UNSAMPLED_BINS
from marketml.session import delete_paths, write_scratch

#: Boosted trees between two writes of the cells.
CHECKPOINT = 10
#: Trees of a forest that are fitted at once; each is a few small jobs on the same cells.
PARALLEL = 8
#: Bits that doubles hold exactly, less one of headroom for residuals that overshoot.
_BITS = 52
KEY = "row_key"


def grid_unit(largest: float, rows: int) -> float:
    """The smallest power of two whose multiples up to ``largest`` have exact sums of squares over ``rows``."""
    if not largest:
        return 1.0
    return 2.0 ** math.ceil(math.log2(largest * math.sqrt(max(rows, 1))) - _BITS / 2)


def on_grid(value: Column, unit: float) -> Column:
    return F.floor(value / unit + 0.5).cast("double") * unit


def poisson_steps(least: float = 2.0**-32) -> list[float]:
    """P(X <= k) of a Poisson(1) variable, k = 0, 1, ..., while 1 - P is at least ``least``."""
    out, p, total = [], math.exp(-1), 0.0
    while True:
        total += p
        if 1 - total < least:
            return out
        out.append(total)
        p /= len(out)


def bag_weight(key: Column, tree: int, seed: int) -> Column:
    """How often a row is drawn for a tree: a Poisson(1) draw from 32 bits of an MD5 of (seed, tree, key)."""
    text = F.concat_ws(":", F.lit(seed), F.lit(tree), key.cast("string"))
    draw = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 2.0**32
    return sum((F.when(draw >= step, 1).otherwise(0) for step in poisson_steps()), F.lit(0))


def tree_features(names: int, tree: int, share: float, seed: int) -> list[int]:
    """The features of a tree: the first ceil(share x names) by a hash of (seed, tree, place)."""
    order = sorted(range(names), key=lambda i: hashlib.md5(f"{seed}:{tree}:{i}".encode()).digest())
    return sorted(order[: math.ceil(share * names)])


def _param(name: str, doc: str, kind) -> Param:
    return Param(Params._dummy(), name, doc, typeConverter=kind)


class CellTrees(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed):
    """What the three estimators share."""

    maxDepth = _param("maxDepth", "depth of a tree", TypeConverters.toInt)

    def _given(self, kwargs: dict, **defaults) -> None:
        self._setDefault(maxDepth=5, seed=42, **defaults)
        self._set(**kwargs)

    def _cells(self, dataset: DataFrame, weights: Sequence[Column]) -> tuple[DataFrame, str, int, float, float]:
        """(cells, their folder, rows, least label, largest label); of each cell its ``levels``, and for every
        weight the sum ``w{i}`` and the mean label ``y{i}`` on the grid."""
        rows = dataset.select("*", F.col(self.getLabelCol()).cast("double").alias("__y"), vector_to_array(self.getFeaturesCol()).alias("__levels"))
        n, low, high = rows.agg(F.count("__y"), F.min("__y"), F.max("__y")).first()
        if not n:
            raise ValueError("no rows to fit")
        # Sums of labels as whole numbers of a fine unit, exact in 64 bits whatever their order.
        fine = 2.0 ** math.ceil(math.log2((max(abs(low), abs(high)) or 1.0) * n) - 60)
        whole = F.floor(F.col("__y") / fine + 0.5)
        sums = [F.sum(w).cast("double").alias(f"w{i}") for i, w in enumerate(weights)] + [F.sum(w * whole).alias(f"s{i}") for i, w in enumerate(weights)]
        # Drawn often, a row may weigh a few times one.
        self.unit = grid_unit(max(abs(low), abs(high)), 2 * n)
        cells = rows.where(F.col("__y").isNotNull()).groupBy(F.col("__levels").alias("levels")).agg(*sums)
        mean = lambda i: on_grid(F.col(f"s{i}").cast("double") * fine / F.col(f"w{i}"), self.unit)
        cells = cells.select("levels", *[f"w{i}" for i in range(len(weights))], *[F.when(F.col(f"w{i}") > 0, mean(i)).alias(f"y{i}") for i in range(len(weights))])
        path = write_scratch(cells, "tree-cells")
        return dataset.sparkSession.read.parquet(path), path, n, low, high

    def _tree(self, cells: DataFrame, features: Column, weight: Column, label: Column, seed: int, subset: str = "all") -> DecisionTreeRegressionModel:
        """One MLlib tree on cells."""
        rows = cells.select(array_to_vector(features).alias("features"), weight.alias("weight"), label.alias("label"))
        forest = RandomForestRegressor(numTrees=1, bootstrap=False, subsamplingRate=1.0, featureSubsetStrategy=subset, maxDepth=self.getOrDefault(self.maxDepth),
                                       maxBins=UNSAMPLED_BINS, weightCol="weight", seed=seed)
        # Held by name: a Python model that is collected takes its Java object with it.
        fitted = forest.fit(rows)
        java = fitted._java_obj.trees()[0]
        tree = DecisionTreeRegressionModel(java)
        tree._resetUid(java.uid())
        return tree

    def _model(self, kind, java, **params):
        model = kind(java)
        model._resetUid(java.uid())
        model._set(maxDepth=self.getOrDefault(self.maxDepth), featuresCol=self.getFeaturesCol(), labelCol=self.getLabelCol(),
                   predictionCol=self.getPredictionCol(), **params)
        return model


def _java_trees(spark: SparkSession, trees: Sequence[DecisionTreeRegressionModel]):
    jvm = spark.sparkContext._jvm
    out = spark.sparkContext._gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
    for i, t in enumerate(trees):
        out[i] = t._java_obj
    return out


class CellTree(CellTrees):
    """One regression tree."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", maxDepth=5, seed=42):
        super().__init__()
        self._given(self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> DecisionTreeRegressionModel:
        spark = dataset.sparkSession
        cells, path, *_ = self._cells(dataset, [F.lit(1)])
        tree = self._tree(cells, F.col("levels"), F.col("w0"), F.col("y0"), self.getSeed())
        delete_paths(spark, [path])
        tree._set(maxDepth=self.getOrDefault(self.maxDepth), featuresCol=self.getFeaturesCol(), labelCol=self.getLabelCol(), predictionCol=self.getPredictionCol())
        return tree


class CellForest(CellTrees):
    """A random forest (R4).  ``keyCol`` names the row key of the bootstrap hash; without such a column, a hash of
    the features and the label takes its place, so that equal rows are drawn equally often."""

    numTrees = _param("numTrees", "trees", TypeConverters.toInt)
    featureSubsetStrategy = _param("featureSubsetStrategy", "features tried at a node, as MLlib names them", TypeConverters.toString)
    featureShare = _param("featureShare", "share of the features that a tree may use, chosen by hash", TypeConverters.toFloat)
    keyCol = _param("keyCol", "row key", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", maxDepth=5, seed=42, numTrees=20,
                 featureSubsetStrategy="onethird", featureShare=1.0, keyCol=KEY):
        super().__init__()
        self._given(self._input_kwargs, numTrees=20, featureSubsetStrategy="onethird", featureShare=1.0, keyCol=KEY)

    def _fit(self, dataset: DataFrame) -> RandomForestRegressionModel:
        spark, seed = dataset.sparkSession, self.getSeed()
        trees, share, name = (self.getOrDefault(p) for p in (self.numTrees, self.featureShare, self.keyCol))
        key = F.col(name) if name in dataset.columns else F.xxhash64("__levels", "__y")
        cells, path, *_ = self._cells(dataset, [bag_weight(key, t, seed) for t in range(trees)])
        cells = cells.persist(StorageLevel.MEMORY_AND_DISK)
        width = len(cells.first().levels)

        def one(t: int) -> DecisionTreeRegressionModel:
            used = tree_features(width, t, share, seed)
            # A feature that the tree may not use has one level for all cells.
            levels = F.array(*[F.col("levels")[i] if i in used else F.lit(0.0) for i in range(width)])
            drawn = cells.where(F.col(f"w{t}") > 0)
            return self._tree(drawn, levels, F.col(f"w{t}"), F.col(f"y{t}"), seed + t, self.getOrDefault(self.featureSubsetStrategy))

        with ThreadPool(PARALLEL) as pool:
            fitted = pool.map(one, range(trees))
        cells.unpersist()
        delete_paths(spark, [path])
        java = spark.sparkContext._jvm.org.apache.spark.ml.regression.RandomForestRegressionModel(f"{self.uid}_model", _java_trees(spark, fitted), width)
        return self._model(RandomForestRegressionModel, java, numTrees=trees)


class CellBoost(CellTrees):
    """Boosted trees (R5, R6): the first tree takes the labels, each further one twice the residuals, as MLlib's squared loss has it."""

    maxIter = _param("maxIter", "trees", TypeConverters.toInt)
    stepSize = _param("stepSize", "weight of every tree but the first", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", maxDepth=5, seed=42, maxIter=20, stepSize=0.1):
        super().__init__()
        self._given(self._input_kwargs, maxIter=20, stepSize=0.1)

    def _fit(self, dataset: DataFrame) -> GBTRegressionModel:
        spark, step = dataset.sparkSession, self.getOrDefault(self.stepSize)
        cells, path, n, low, high = self._cells(dataset, [F.lit(1)])
        # A residual is at most the labels' range, and doubled.
        unit = grid_unit(2 * (high - low), n)
        paths = [path]
        held = [cells.withColumn("so_far", F.lit(0.0)).persist(StorageLevel.MEMORY_AND_DISK)]
        trees: list[DecisionTreeRegressionModel] = []
        for i in range(self.getOrDefault(self.maxIter)):
            now = held[-1]
            label = on_grid(2 * (F.col("y0") - F.col("so_far")), unit) if i else F.col("y0")
            trees.append(self._tree(now, F.col("levels"), F.col("w0"), label, self.getSeed() + i))
            while len(held) > 1:  # the fit has read ``now`` into storage
                held.pop(0).unpersist()
            scored = trees[-1].copy({trees[-1].featuresCol: "__x", trees[-1].predictionCol: "__p"})
            scored = scored.transform(now.withColumn("__x", array_to_vector("levels")))
            scored = scored.withColumn("so_far", F.col("so_far") + F.col("__p") * (step if i else 1.0)).drop("__x", "__p")
            if i % CHECKPOINT == CHECKPOINT - 1:
                paths.append(write_scratch(scored, "tree-cells"))
                scored = spark.read.parquet(paths[-1])
            held.append(scored.persist(StorageLevel.MEMORY_AND_DISK))
        for h in held:
            h.unpersist()
        delete_paths(spark, paths)
        gateway = spark.sparkContext._gateway
        weights = gateway.new_array(gateway.jvm.double, len(trees))
        for i in range(len(trees)):
            weights[i] = step if i else 1.0
        java = spark.sparkContext._jvm.org.apache.spark.ml.regression.GBTRegressionModel(f"{self.uid}_model", _java_trees(spark, trees), weights, trees[0].numFeatures)
        return self._model(GBTRegressionModel, java, maxIter=len(trees), stepSize=step)


ESTIMATORS = {"tree": CellTree, "forest": CellForest, "gbt": CellBoost}
