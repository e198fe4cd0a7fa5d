"""Result tables (O1-O5, A4): model comparison with timings, best
hyper-parameters and stage status, all as small DataFrames built from the
per-run records that the workflows collect (one row per fitted run)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketml.functions.scalar import elapsed_hms

RUN_SCHEMA = (
    "model string, eval_on string, n long, rmse double, r2 double, seconds double, "
    "best_params string, best_max_depth int, best_max_iter int, best_reg_param double, "
    "best_elastic_net_param double, best_num_trees int"
)


@dataclass
class RunRecord:
    """One fitted run: its holdout metrics and the time of the same fit."""

    model: str
    eval_on: str
    n: int
    rmse: float
    r2: float
    seconds: float
    best: dict = field(default_factory=dict)

    def row(self):
        b = self.best or {}
        text = ", ".join(f"{k}={v}" for k, v in sorted(b.items())) or None
        return (
            self.model, self.eval_on, int(self.n), float(self.rmse), float(self.r2),
            float(self.seconds), text,
            b.get("maxDepth"), b.get("maxIter"), b.get("regParam"), b.get("elasticNetParam"),
            b.get("numTrees"),
        )


def comparison(spark: SparkSession, runs: Sequence[RunRecord]) -> DataFrame:
    """Model comparison (O1, O2, O4): metrics, fit seconds, ``H:MM:SS`` and
    the chosen hyper-parameters (NULL for untuned runs)."""
    df = spark.createDataFrame([r.row() for r in runs], RUN_SCHEMA)
    return df.withColumn("elapsed", elapsed_hms("seconds"))


def stage_status(runs_df: DataFrame) -> DataFrame:
    """Stage completion table (O5): every stage that produced a metric row
    is ``Completed``; a stage whose metric is missing is ``Failed``."""
    return runs_df.select(
        F.col("model").alias("stage"),
        F.when(F.col("rmse").isNotNull(), F.lit("Completed")).otherwise(F.lit("Failed")).alias("status"),
        "rmse", "r2",
        F.format_string("%.4f", "rmse").alias("rmse_text"),
        F.format_string("%.4f", "r2").alias("r2_text"),
        "elapsed",
    )


def best_by(df: DataFrame, metric: str = "rmse", tiebreak: Sequence[str] = ()) -> DataFrame:
    """Row with the lowest ``metric`` (A4), ties broken by ``tiebreak``."""
    return df.orderBy(F.col(metric).asc_nulls_last(), *tiebreak).limit(1)
