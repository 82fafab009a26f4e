"""Many datasets, tasks and models in one plan: their parameters are columns.

A task table has one row per model of a task: `dataset`, `task` (unique within a dataset), `horizon`,
`test_length`, `error_season` (of the scaled error), `model` and `season` (of the seasonal naive
forecast that the model is). It holds the configured tasks and is small; the panel is not copied
for a task, only the rows that a task uses become rows of it.

The panels of all datasets lie in one dense panel, with `dataset` and `unique_id` joined into one key;
the plan has a branch per frequency, whose calendar it needs, and none per dataset, task or model.
"""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.operators import grid, metrics
from panelmill.operators.metrics import LEVELS
from panelmill.operators.windows import num_windows_column

SEPARATOR = "\x1f"
MOST_TASKS = 100_000  # rows of a task table that are broadcast, some 20 MB
TASK = ["dataset", "task", "horizon", "test_length"]


def dense(panels: dict[str, DataFrame], backs: dict[str, int], block_steps: int = grid.BLOCK_STEPS) -> DataFrame:
    """One dense panel of the panels `(dataset, unique_id, ds, y)` by frequency, with `dataset`.

    `backs` has the longest season of each frequency, which blocks reach back.
    """
    key = F.concat("dataset", F.lit(SEPARATOR), "unique_id")
    grids = [grid.dense(panel.select(key.alias("unique_id"), "ds", "y"), freq, block_steps, back=backs[freq])
             for freq, panel in panels.items()]
    return reduce(DataFrame.unionByName, grids).withColumn("dataset", F.substring_index("unique_id", SEPARATOR, 1))


def plain_ids(df: DataFrame) -> DataFrame:
    """With `unique_id` as it was in its panel."""
    return df.withColumn("unique_id", F.expr(f"substring(unique_id, instr(unique_id, '{SEPARATOR}') + 1)"))


def bounded(tasks: DataFrame) -> DataFrame:
    """A task table that is local and broadcast if it has at most `MOST_TASKS` rows, as configured ones have.

    Then the panel keeps its blocks when parameters are attached and is not shuffled by dataset;
    a larger table is joined as Spark sees fit.
    """
    rows = tasks.limit(MOST_TASKS + 1).toArrow()
    return F.broadcast(tasks.sparkSession.createDataFrame(rows, tasks.schema)) if rows.num_rows <= MOST_TASKS else tasks


def _div(value: Column, by: Column) -> Column:
    return F.call_function("div", value - F.pmod(value, by), by)


def _count() -> Column:
    """Windows of a task; a horizon must fit into the test part."""
    fits = F.col("horizon") <= F.col("test_length")
    wrong = F.raise_error(F.concat(F.lit("the horizon does not fit into the test part of "), "dataset", F.lit(" "), "task"))
    return F.when(fits, num_windows_column(F.col("test_length"), F.col("horizon"))).otherwise(wrong.cast("bigint"))


def _start() -> Column:
    return F.col("n") - F.col("test_length")


def _segment() -> Column:
    """Which two origins a step lies between; -1 before the first one."""
    return F.when(F.col("pos") < _start(), -1).otherwise(_div(F.col("pos") - _start(), F.col("horizon"))).cast("bigint")


def _lagged(rows: DataFrame, seasons: DataFrame, value: str, position: str) -> DataFrame:
    """A row per season of its dataset, with `before`: the value one season earlier.

    Steps of one phase follow each other in a window of their own, so the season may be a column.
    These windows lie inside blocks and need no shuffle.
    """
    sets = seasons.groupBy("dataset").agg(F.collect_set("season").alias("seasons"))
    each = rows.join(sets, "dataset").withColumn("season", F.explode("seasons")).drop("seasons")
    phase = F.pmod(F.col(position), F.col("season")).alias("phase")
    before = Window.partitionBy("unique_id", "block", "season", phase).orderBy(position)
    return each.withColumn("before", F.lag(value).over(before)).where("core")


def labels(df: DataFrame, tasks: DataFrame) -> DataFrame:
    """Labels of all test windows: `(dataset, task, unique_id, window_idx, step, y)`."""
    rows = df.where("core").select("dataset", "unique_id", "pos", "n", "y").join(bounded(tasks).select(*TASK).distinct(), "dataset")
    offset = F.col("pos") - _start()
    inside = rows.where((_start() >= 0) & (offset >= 0) & (offset < F.col("horizon") * _count()))
    return inside.select("dataset", "task", "unique_id", _div(offset, F.col("horizon")).alias("window_idx"),
                         (F.pmod(offset, F.col("horizon")) + 1).alias("step"), "y")


def seasonal_errors(df: DataFrame, tasks: DataFrame, block_steps: int = grid.BLOCK_STEPS) -> DataFrame:
    """`metrics.seasonal_error` of every task, `(dataset, task, unique_id, window_idx, seasonal_error)`.

    The observations are closed up once for all tasks.
    """
    own = bounded(tasks).select(*TASK, F.col("error_season").alias("season")).distinct()
    reach = own.groupBy("dataset").agg(F.max("season").cast("bigint").alias("reach"))
    seen = F.col("seen") + F.count("y").over(grid.up_to_here()) - 1
    closed = df.withColumn("closed", seen).where("core AND y IS NOT NULL").select("dataset", "unique_id", "pos", "n", "y", "closed")
    closed = grid.reblock(closed.join(reach, "dataset"), "closed", F.greatest(F.lit(block_steps), 2 * F.col("reach")), F.col("reach"), F.lit(0))
    diff = F.abs(F.col("y") - F.col("before"))
    key = ["dataset", "task", "unique_id"]
    sums = (
        _lagged(closed, own, "y", "closed").withColumn("diff", diff).where("diff IS NOT NULL").join(own, ["dataset", "season"])
        .where(_segment() < _count() - 1).groupBy(*key, _segment().alias("segment"))
        .agg(F.sum("diff").alias("total"), F.count("diff").alias("cnt"))
    )
    series = df.where("core").groupBy("dataset", "unique_id").agg(F.max("n").alias("n"))
    empty = series.join(own, "dataset").select(
        *key, F.explode(F.sequence(F.lit(-1).cast("bigint"), _count() - 2)).alias("segment"),
        F.lit(0.0).alias("total"), F.lit(0).cast("bigint").alias("cnt"))
    so_far = Window.partitionBy(*key).orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)
    return (
        sums.unionByName(empty).groupBy(*key, "segment").agg(F.sum("total").alias("total"), F.sum("cnt").alias("cnt"))
        .select(*key, (F.col("segment") + 1).alias("window_idx"),
                F.try_divide(F.sum("total").over(so_far), F.sum("cnt").over(so_far)).alias("seasonal_error"))
    )


def seasonal_naive(df: DataFrame, tasks: DataFrame, levels: list[float] = LEVELS) -> DataFrame:
    """`forecast.seasonal_naive` of every task and model, with `dataset` and `task`.

    The panel must reach back by the longest season of its frequency. History is filled once, a
    residual is computed once per season, whichever tasks and models use it.
    """
    models = bounded(tasks).select(*TASK, "model", "season").distinct()
    seen_at = F.when(F.col("y").isNotNull(), F.col("pos"))
    history = grid.fill_forward(df.withColumn("seen_at", seen_at), "_f").withColumns({
        "_first": grid.first_ahead("seen_at", "next_pos"),
        "h": F.coalesce("_f", grid.first_ahead("y", "next_y"), F.lit(0.0)),
    }).select("dataset", "unique_id", "block", "pos", "n", "core", F.col("_f").isNotNull().alias("filled"), "_first", "h")
    season, horizon, key = F.col("season"), F.col("horizon"), ["dataset", "task", "model", "unique_id"]

    residual = F.col("h") - F.col("before")
    so_far = Window.partitionBy(*key).orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)
    origin = _start() + F.col("window_idx") * horizon
    sigma = (
        _lagged(history, models, "h", "pos").where("pos >= season").join(models, ["dataset", "season"])
        .where(F.col("pos") < _start() + horizon * (_count() - 1))
        .groupBy(*key, "horizon", "test_length", "season", _segment().alias("segment"))
        .agg(F.sum(residual * residual).alias("ss"), F.max("n").alias("n"))
        .withColumn("ss", F.sum("ss").over(so_far)).withColumn("window_idx", F.col("segment") + 1)
        .select(*key, "window_idx", F.sqrt(F.try_divide("ss", origin - season)).alias("sigma"))
    )
    # Every step of history is sent to the steps that it predicts.
    offset = F.col("pos") - _start()
    known = F.col("filled") | (F.col("_first") < origin)
    points = (
        history.where("core").join(models, "dataset")
        .withColumn("lo", F.greatest(F.lit(0), _div(offset, horizon) + 1))
        .withColumn("hi", F.least(_count() - 1, _div(offset + season, horizon)))
        .where("lo <= hi").withColumn("window_idx", F.explode(F.sequence("lo", "hi")))
        .withColumn("lead", season - (F.col("window_idx") * horizon - offset) + 1).where("lead <= horizon")
        .select(*key, "window_idx", "season", F.when(known, F.col("h")).otherwise(0.0).alias("h"),
                F.explode(F.sequence("lead", horizon.cast("bigint"), season.cast("bigint"))).alias("step"))
    )
    spread = F.col("sigma") * F.sqrt(_div(F.col("step") - 1, season) + 1)
    quantiles = [F.col("h") + (spread * NormalDist().inv_cdf(q) if q != 0.5 else 0.0) for q in levels]
    return points.join(sigma, [*key, "window_idx"], "left").select(
        "dataset", "task", "model", "unique_id", "window_idx", "step", F.array(*quantiles).alias("quantiles"))


def evaluate(df: DataFrame, tasks: DataFrame, forecasts: DataFrame | None = None, levels: list[float] = LEVELS) -> DataFrame:
    """Metrics of every window, task and model, `(dataset, task, model, unique_id, window_idx, ...)`.

    `df` comes from `dense`, and so do the ids of `forecasts`, the seasonal naive ones unless given.
    A model of the table that forecasts nothing in a window has a row with NULL metrics there.
    """
    tasks = bounded(tasks)
    made = seasonal_naive(df, tasks, levels) if forecasts is None else forecasts
    key = ["dataset", "task"]
    return plain_ids(metrics.evaluate(made, labels(df, tasks), seasonal_errors(df, tasks), levels,
                                      tasks.select(*key, "model").distinct(), key))
