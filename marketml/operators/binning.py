"""Quantile bins as a pipeline stage, so that tree fits do not depend on where rows lie.

MLlib's trees look for split candidates in a sample of the rows, and the sample depends on the
partitions.  ``QuantileBinner`` replaces each feature by its level: the number of exact quantiles, of the
rows that the pipeline is fitted on, that the value reaches.  A level column has at most ``levels``
values, so every midpoint between two levels is a candidate and none is sampled
(``UNSAMPLED_BINS`` below).

Scale: the quantiles come from the library's exact quantile operator (one range-partitioned pass,
no group in one task); only ``levels - 1`` numbers a feature reach the driver, and the fitted stage is
MLlib's ``Bucketizer``, a narrow JVM expression.

Missing values: NULL and NaN take no part in the quantiles.  NaN gets a level of its own above
all others; NULL stays NULL (drop or impute it first, as for every assembled feature).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.feature import Bucketizer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketml.operators.quantiles import exact_quantiles_long
from marketml.session import scratch_scope

LEVELS = 32
#: ``maxBins`` for level columns.  MLlib samples about ``maxBins`` squared rows for its candidates; this
#: is the largest value whose square fits an int, so up to two billion rows are all read, and of more
#: rows enough that no level with a ten-millionth of them is missed.  Level columns keep few bins all the same.
UNSAMPLED_BINS = 46340


def quantile_edges(df: DataFrame, features: Sequence[str], levels: int = LEVELS) -> dict[str, list[float]]:
    """The distinct exact quantiles k / levels of every feature, without missing values."""
    features = list(features)
    number = lambda c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double"))
    probs = [k / levels for k in range(1, levels)]
    found: dict[str, set] = {c: set() for c in features}
    with scratch_scope(df.sparkSession):
        rows = df.select(*[F.col(f"`{c}`") for c in features])
        for r in exact_quantiles_long(rows, [], {c: number(c) for c in features}, probs).collect():
            found[r["metric"]].add(r["quantile"])
    return {c: sorted(v) for c, v in found.items()}


class QuantileBinner(Estimator, HasInputCols, HasOutputCols):
    """Estimator of a ``Bucketizer`` whose splits are exact quantiles of the fitted rows."""

    levels = Param(Params._dummy(), "levels", "most levels of a feature", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, outputCols: list[str] | None = None, levels: int = LEVELS):
        super().__init__()
        self._setDefault(levels=LEVELS)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> Bucketizer:
        edges = quantile_edges(dataset, self.getInputCols(), self.getOrDefault(self.levels))
        inf = float("inf")
        # A Bucketizer needs two buckets at least.
        splits = [[-inf, *(e or [0.0]), inf] for e in (edges[c] for c in self.getInputCols())]
        return Bucketizer(splitsArray=splits, inputCols=self.getInputCols(), outputCols=self.getOutputCols(), handleInvalid="keep")
