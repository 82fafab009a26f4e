"""Ranking of models over datasets, normalised by a baseline model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BASELINE = "seasonal_naive"
CONFIG = ["dataset_id", "horizon"]


def dataset_level_results(metrics: DataFrame) -> DataFrame:
    """Mean MASE, CRPS, MAE and MSE per model, dataset, frequency and horizon.

    Input rows are per-window metrics with `model, dataset, freq, horizon`.
    """
    return metrics.groupBy("model", "dataset", "freq", "horizon").agg(
        *[F.avg(m).alias(m) for m in ("MASE", "CRPS", "MAE", "MSE")]
    ).withColumn("dataset_id", F.concat_ws("/", "dataset", "freq"))


def union_results(own: DataFrame, baseline: DataFrame) -> DataFrame:
    """Own results and baseline results, each (model, dataset, horizon) once.

    Where both have a configuration the row of the own results is kept.
    """
    once = Window.partitionBy("model", *CONFIG).orderBy("source")
    both = own.withColumn("source", F.lit(0)).unionByName(baseline.withColumn("source", F.lit(1)))
    return both.withColumn("rn", F.row_number().over(once)).where("rn = 1").drop("rn", "source")


def compute_ranks(results: DataFrame) -> DataFrame:
    """Rank by MASE and by CRPS within a configuration; ties by model name, NULL unranked."""
    ranked = results
    for metric in ("MASE", "CRPS"):
        order = Window.partitionBy(*CONFIG).orderBy(F.col(metric).asc_nulls_last(), "model")
        ranked = ranked.withColumn(
            f"{metric}_rank", F.when(F.col(metric).isNotNull(), F.row_number().over(order)).cast("double"))
    return ranked


def _finite(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def normalize_by_baseline(results: DataFrame, baseline: str = BASELINE,
                          metrics: tuple[str, ...] = ("MASE", "CRPS")) -> DataFrame:
    """Divide by the baseline of the same configuration; configurations without
    one are left out, a zero or missing baseline value gives NULL."""
    base = results.where(F.col("model") == baseline).select(*CONFIG, *[F.col(m).alias(f"base_{m}") for m in metrics])
    joined = results.join(base, CONFIG)
    for m in metrics:
        joined = joined.withColumn(m, _finite(F.try_divide(F.col(m), F.col(f"base_{m}"))))
    return joined.drop(*[f"base_{m}" for m in metrics])


def geometric_mean(value: str) -> Column:
    """Ignoring NULL; 0 if any value is 0, NULL if any is negative."""
    v = F.col(value)
    return (
        F.when(F.min(v) < 0, F.lit(None).cast("double"))
        .when(F.min(v) == 0, F.lit(0.0))
        .otherwise(F.exp(F.avg(F.log(F.when(v > 0, v)))))
    )


def average_rank(ranked: DataFrame, normalized: DataFrame) -> DataFrame:
    """Mean ranks per model over the configurations that have a baseline."""
    return ranked.join(normalized.select(*CONFIG), CONFIG, "left_semi").groupBy("model").agg(
        F.avg("MASE_rank").alias("MASE_rank"), F.avg("CRPS_rank").alias("CRPS_rank"))


def overall_leaderboard(ranked: DataFrame, metric: str = "MASE", baseline: str = BASELINE) -> DataFrame:
    """Geometric mean of the normalised metrics and mean ranks, best model first."""
    normalized = normalize_by_baseline(ranked, baseline)
    means = normalized.groupBy("model").agg(
        geometric_mean("MASE").alias("MASE (norm.)"), geometric_mean("CRPS").alias("CRPS (norm.)"))
    board = means.join(average_rank(ranked, normalized), "model", "left").select(
        "model", *[F.round(f"`{c}`", 3).alias(c) for c in ("MASE (norm.)", "CRPS (norm.)", "MASE_rank", "CRPS_rank")])
    return board.orderBy(F.col(f"`{metric} (norm.)`").asc_nulls_last(), "model")


def has_baseline(results: DataFrame, baseline: str = BASELINE) -> bool:
    """Does the baseline have at least one finished task?"""
    return not results.where(F.col("model") == baseline).limit(1).isEmpty()
