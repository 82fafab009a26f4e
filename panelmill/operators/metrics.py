"""Per-window metrics from quantile forecasts.

A forecast row is `(model, unique_id, window_idx, step, quantiles)`, the quantiles
an array in the order of the levels. Points whose truth is missing are left out;
a window without any truth has NULL in all eight metrics.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions.frequency import floor_div
from panelmill.operators import grid
from panelmill.operators.windows import num_windows

# The default quantile levels and the metric columns.
LEVELS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
METRICS = ["MSE", "MAE", "RMSE", "MAPE", "sMAPE", "MASE", "ND", "CRPS"]


def quantile_loss(truth: Column, quantiles: Column, levels: list[float]) -> Column:
    """2 |(y - q)(1[q >= y] - level)| summed over the levels."""
    losses = [
        F.abs((truth - quantiles[i]) * (F.when(quantiles[i] >= truth, 1.0).otherwise(0.0) - level)) * 2
        for i, level in enumerate(levels)
    ]
    return reduce(lambda a, b: a + b, losses)


def seasonal_error(df: DataFrame, season: int, horizon: int, test_length: int,
                   block_steps: int = grid.BLOCK_STEPS) -> DataFrame:
    """Mean |c(j) - c(j - season)| of the context before every test origin.

    Missing points are removed and the rest closed up before the difference is
    taken. Differences are summed per segment between two origins, so the scan
    along a series touches one row per window.
    """
    seen = F.col("seen") + F.count("y").over(grid.up_to_here()) - 1
    size, back = F.lit(max(block_steps, 2 * season)), F.lit(season)
    closed = df.withColumn("closed", seen).where("core AND y IS NOT NULL")
    closed = grid.reblock(closed, "closed", size, back, F.lit(0))
    diff = F.abs(F.col("y") - F.lag("y", season).over(grid.ordered("closed")))
    start = F.col("n") - test_length
    segment = F.when(F.col("pos") < start, -1).otherwise(floor_div(F.col("pos") - start, horizon))
    sums = (
        closed.withColumn("diff", diff).where("core AND diff IS NOT NULL")
        .groupBy("unique_id", segment.alias("segment"))
        .agg(F.sum("diff").alias("total"), F.count("diff").alias("cnt"))
    )
    empty = df.where("core").groupBy("unique_id").agg(F.max("n").alias("n")).select(
        "unique_id", F.explode(F.expr(f"sequence(-1L, {num_windows(test_length, horizon) - 2}L)")).alias("segment"),
        F.lit(0.0).alias("total"), F.lit(0).cast("bigint").alias("cnt"))
    so_far = Window.partitionBy("unique_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)
    return (
        sums.where(F.col("segment") < num_windows(test_length, horizon) - 1).unionByName(empty)
        .groupBy("unique_id", "segment").agg(F.sum("total").alias("total"), F.sum("cnt").alias("cnt"))
        .select("unique_id", (F.col("segment") + 1).alias("window_idx"),
                F.try_divide(F.sum("total").over(so_far), F.sum("cnt").over(so_far)).alias("seasonal_error"))
    )


def evaluate(forecasts: DataFrame, labels: DataFrame, errors: DataFrame,
             levels: list[float] = LEVELS, models: list[str] | DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """All eight metrics per `(model, unique_id, window_idx)`, and `missing_steps`.

    `labels` has `(unique_id, window_idx, step, y)`, `errors` the seasonal error
    per `(unique_id, window_idx)`. Every labelled window has a row: one with steps that a
    model does not forecast counts these and has NULL metrics. Name the `models` to get the
    windows of which one of them forecasts nothing; otherwise only windows that nobody
    forecasts are added, with a NULL model. With further `keys` (a task, say) all three inputs
    have these columns, and `models` may be a table `(*keys, model)`.
    """
    if 0.5 not in levels:
        raise ValueError("the levels must include 0.5")
    if isinstance(models, DataFrame) and not keys:
        raise ValueError("a table of models needs keys")
    keys = keys or []
    window = [*keys, "unique_id", "window_idx"]
    joined = forecasts.join(labels.select(*window, "step", "y"), window + ["step"])
    y, quantiles = F.col("y"), F.col("quantiles")
    median = quantiles[levels.index(0.5)]
    scored = joined.select(
        "model", *window, y,
        (y - median).alias("e"),
        median.alias("median"),
        quantile_loss(y, quantiles, levels).alias("loss"),
    )
    known = F.col("y").isNotNull()
    e, size = F.abs("e"), F.when(known, F.abs("y"))
    sums = scored.groupBy("model", *window).agg(
        F.count(F.lit(1)).alias("found"),
        F.avg(F.col("e") * F.col("e")).alias("MSE"),
        F.avg(e).alias("MAE"),
        F.avg(F.try_divide(e, F.abs("y"))).alias("MAPE"),
        F.avg(F.try_divide(e * 2, F.abs("y") + F.abs("median"))).alias("sMAPE"),
        F.sum(e).alias("abs_error"),
        F.nullif(F.sum(size), F.lit(0.0)).alias("abs_truth"),
        F.sum("loss").alias("loss"),
    )
    expected = labels.groupBy(*window).agg(F.count(F.lit(1)).alias("steps"))
    by_model = isinstance(models, DataFrame) or bool(models)
    if isinstance(models, DataFrame):
        expected = expected.join(models, keys)
    elif models:
        expected = expected.withColumn("model", F.explode(F.array(*map(F.lit, models))))
    sums = expected.join(sums, (["model"] if by_model else []) + window, "left")
    missing = F.col("steps") - F.coalesce("found", F.lit(0))
    scale = F.when(F.col("seasonal_error") > 0, F.col("seasonal_error"))
    values = {
        "MSE": F.col("MSE"), "MAE": F.col("MAE"), "RMSE": F.sqrt("MSE"), "MAPE": F.col("MAPE"), "sMAPE": F.col("sMAPE"),
        "MASE": F.col("MAE") / scale, "ND": F.col("abs_error") / F.col("abs_truth"),
        "CRPS": F.col("loss") / len(levels) / F.col("abs_truth"),
    }
    return sums.join(errors, window, "left").select(
        "model", *window, *[F.when(missing == 0, values[m]).alias(m) for m in METRICS], missing.alias("missing_steps"))


def metric_summary(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of every metric, ignoring NULL."""
    return metrics.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in METRICS])
