"""Regression metrics in one aggregation.

``RegressionEvaluator`` runs one job per metric; here n, RMSE, R^2 and MAE
come from a single pass.  The formulas equal the evaluator's: RMSE is
``sqrt(mean((y - p)^2))`` and R^2 is ``1 - SSE / (var_pop(y) * n)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metric_columns(label: str, prediction: str = "prediction"):
    err = F.col(label) - F.col(prediction)
    n = F.count(F.lit(1))
    return [
        n.alias("n"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        (1 - F.sum(err * err) / (F.var_pop(F.col(label)) * n)).alias("r2"),
        F.avg(F.abs(err)).alias("mae"),
    ]


def regression_metrics(pred: DataFrame, label: str, prediction: str = "prediction",
                       group_cols: Sequence[str] = ()) -> DataFrame:
    """``(*group_cols, n, rmse, r2, mae)``."""
    cols = metric_columns(label, prediction)
    if group_cols:
        return pred.groupBy(*group_cols).agg(*cols)
    return pred.agg(*cols)


def metrics_dict(pred: DataFrame, label: str, prediction: str = "prediction") -> dict:
    """The one-row metrics as a Python dict (a single aggregated row)."""
    row = regression_metrics(pred, label, prediction).first()
    return row.asDict()
