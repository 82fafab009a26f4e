"""Baseline forecasts, quantile and sample conversions, user forecasters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby, islice
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions.frequency import floor_div
from panelmill.operators import grid, windows
from panelmill.operators.metrics import LEVELS

FORECAST_SCHEMA = "unique_id string, window_idx bigint, step bigint, quantiles array<double>"


def fill_history(df: DataFrame, out: str = "y_hist") -> DataFrame:
    """Forward fill; a leading gap takes the first observation; 0 without any."""
    return grid.fill_forward_back_zero(df, out)


def seasonal_naive(df: DataFrame, season: int, horizon: int, test_length: int,
                   levels: list[float] = LEVELS, model: str = "seasonal_naive") -> DataFrame:
    """Seasonal naive quantile forecasts for all test windows of a dense panel.

    The panel must have been built with `back >= season`. Every history row sends
    its value to the steps it predicts, so no window holds a copy of its context;
    the residual variance at an origin is a sum over the segments before it.
    """
    windows.check_horizon(horizon, test_length)
    count = windows.num_windows(test_length, horizon)
    start = F.col("n") - test_length
    seen_at = F.when(F.col("y").isNotNull(), F.col("pos"))
    history = grid.fill_forward(df.withColumn("seen_at", seen_at), "_f").withColumns({
        "_first": grid.first_ahead("seen_at", "next_pos"),
        "h": F.coalesce("_f", grid.first_ahead("y", "next_y"), F.lit(0.0)),
    })
    residual = F.col("h") - F.lag("h", season).over(grid.ordered())
    history = history.select("unique_id", "pos", "n", "core", "_f", "_first", "h", residual.alias("res")).where("core")

    segment = F.when(F.col("pos") < start, -1).otherwise(floor_div(F.col("pos") - start, horizon))
    so_far = Window.partitionBy("unique_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)
    origin = F.col("n") - test_length + F.col("window_idx") * horizon
    sigma = (
        history.where((F.col("pos") >= season) & (F.col("pos") < start + horizon * (count - 1)))
        .groupBy("unique_id", segment.alias("segment"))
        .agg(F.sum(F.col("res") * F.col("res")).alias("ss"), F.max("n").alias("n"))
        .withColumn("ss", F.sum("ss").over(so_far))
        .withColumn("window_idx", F.col("segment") + 1)
        .select("unique_id", "window_idx", F.sqrt(F.try_divide("ss", origin - season)).alias("sigma"))
    )
    # Inside a context that holds no observation yet, the filled value is 0.
    known = F.col("_f").isNotNull() | (F.col("_first") < origin)
    points = (
        windows.context_windows(history, horizon, test_length, season)
        .withColumn("h", F.when(known, F.col("h")).otherwise(0.0))
        .withColumn("lead", season - F.col("age") + 1)
        .where(F.col("lead") <= horizon)
        .select("unique_id", "window_idx", "h",
                F.explode(F.sequence("lead", F.lit(horizon).cast("bigint"), F.lit(season).cast("bigint"))).alias("step"))
    )
    spread = F.col("sigma") * F.sqrt(floor_div(F.col("step") - 1, season) + 1)
    quantiles = [F.col("h") + (spread * NormalDist().inv_cdf(q) if q != 0.5 else 0.0) for q in levels]
    return points.join(sigma, ["unique_id", "window_idx"], "left").select(
        F.lit(model).alias("model"), "unique_id", "window_idx", "step", F.array(*quantiles).alias("quantiles"))


def naive(df: DataFrame, horizon: int, test_length: int, levels: list[float] = LEVELS,
          model: str = "naive") -> DataFrame:
    """Last value, with the spread of one-step differences growing as the root of the step."""
    return seasonal_naive(df, 1, horizon, test_length, levels, model)


def quantile_to_interval(level: float) -> tuple[str, int]:
    """Side and width of the symmetric interval whose edge is this quantile."""
    width = round(200 * (max(level, 1 - level) - 0.5))
    if level == 0.5:
        return "point", 0
    return ("hi" if level > 0.5 else "lo"), width


def interval_of(level: Column) -> Column:
    """The same for a column of levels: struct `(side, width)`."""
    side = F.when(level == 0.5, "point").when(level > 0.5, "hi").otherwise("lo")
    return F.struct(side.alias("side"), F.bround((F.greatest(level, 1 - level) - 0.5) * 200).cast("bigint").alias("width"))


def explode_quantiles(forecasts: DataFrame, levels: list[float] = LEVELS) -> DataFrame:
    """One row per quantile: `(model, unique_id, window_idx, step, q, y_hat)`."""
    pairs = F.explode(F.arrays_zip(F.array(*[F.lit(q) for q in levels]).alias("q"), F.col("quantiles").alias("y_hat")))
    return forecasts.select("model", "unique_id", "window_idx", "step", pairs.alias("p")).select(
        "model", "unique_id", "window_idx", "step", F.col("p.q").alias("q"), F.col("p.y_hat").alias("y_hat"))


def collect_quantiles(long: DataFrame) -> DataFrame:
    """The inverse: quantiles of a step as one array in level order."""
    pairs = F.array_sort(F.collect_list(F.struct("q", "y_hat")))
    return long.groupBy("model", "unique_id", "window_idx", "step").agg(pairs.alias("pairs")).select(
        "model", "unique_id", "window_idx", "step", F.col("pairs.y_hat").alias("quantiles"))


def interpolate_quantiles(u: Column, quantiles: Column, levels: list[float]) -> Column:
    """Linear interpolation between levels, clamped outside the outermost ones."""
    value = F.when(u <= levels[0], quantiles[0])
    for i in range(1, len(levels)):
        share = (u - levels[i - 1]) / (levels[i] - levels[i - 1])
        value = value.when(u <= levels[i], quantiles[i - 1] + (quantiles[i] - quantiles[i - 1]) * share)
    return value.otherwise(quantiles[len(levels) - 1])


def sample_from_quantiles(forecasts: DataFrame, samples: int = 100, seed: int = 0,
                          levels: list[float] = LEVELS) -> DataFrame:
    """Sample paths by inverse CDF, one uniform draw per path shared by its steps.

    The draw is the first 52 bits of the md5 of `series:window:path:seed`, so a rerun
    of a lost task yields the same samples.
    """
    key = F.concat_ws(":", "unique_id", F.col("window_idx").cast("string"), F.col("sample").cast("string"), F.lit(str(seed)))
    bits = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("bigint")
    paths = forecasts.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples)))).withColumn(
        "u", bits / float(2**52))
    return paths.select("model", "unique_id", "window_idx", "step", F.col("sample").cast("bigint").alias("sample"),
                        interpolate_quantiles(F.col("u"), F.col("quantiles"), levels).alias("y_hat"))


def samples_to_quantiles(samples: DataFrame, keys: list[str], value: str = "y_hat",
                         levels: list[float] = LEVELS) -> DataFrame:
    """Linearly interpolated quantiles over the samples of one step."""
    return samples.groupBy(*keys).agg(
        F.percentile(value, F.array(*[F.lit(q) for q in levels])).alias("quantiles"))


def sample_mean_median(samples: DataFrame, keys: list[str], value: str = "y_hat") -> DataFrame:
    """Mean and median over the samples of one step."""
    return samples.groupBy(*keys).agg(
        F.avg(value).alias("sample_mean"), F.percentile(value, 0.5).alias("sample_median"))


def point_forecast(forecasts: DataFrame, levels: list[float] = LEVELS) -> DataFrame:
    """The median forecast: the 0.5 quantile."""
    return forecasts.withColumn("median", F.col("quantiles")[levels.index(0.5)])


def unflatten_index(df: DataFrame, index: str, n_windows: int, n_variates: int) -> DataFrame:
    """Split a flat instance number (series, variate, window) into its parts."""
    flat = floor_div(F.col(index), n_windows)
    return df.withColumn("window_idx", F.pmod(index, F.lit(n_windows))).withColumn(
        "series_idx", floor_div(flat, n_variates)).withColumn("variate_idx", F.pmod(flat, F.lit(n_variates)))


def check_forecast_shape(forecasts: DataFrame, n_levels: int, horizon: int) -> DataFrame:
    """Per window: number of steps and quantiles, and whether both are as expected."""
    checked = forecasts.groupBy("model", "unique_id", "window_idx").agg(
        F.count_distinct("step").alias("n_steps"),
        F.min(F.size("quantiles")).cast("bigint").alias("min_quantiles"),
        F.max(F.size("quantiles")).cast("bigint").alias("max_quantiles"),
    )
    good = (F.col("n_steps") == horizon) & (F.col("min_quantiles") == n_levels) & (F.col("max_quantiles") == n_levels)
    return checked.withColumn("ok", good)


def normalize_output(raw: np.ndarray, n_levels: int, horizon: int) -> np.ndarray:
    """Bring the output of a forecaster into `(batch, levels, horizon)`.

    Accepted: a point forecast `(batch, horizon)`, quantiles on either axis, one
    leading mean column, or lower and upper quantiles without the median (which
    then is their midpoint).
    """
    out = np.asarray(raw, dtype=float)
    if out.ndim == 2:
        return np.repeat(out[:, None, :], n_levels, axis=1)
    if out.ndim != 3:
        raise ValueError(f"forecast has {out.ndim} dimensions")
    if out.shape[2] != horizon or (out.shape[1] not in (n_levels, n_levels + 1, n_levels - 1)):
        out = out.transpose(0, 2, 1)
    if out.shape[1] == n_levels + 1:
        out = out[:, 1:, :]
    elif out.shape[1] == n_levels - 1:
        half = n_levels // 2
        middle = (out[:, half - 1:half, :] + out[:, half:half + 1, :]) / 2
        out = np.concatenate([out[:, :half], middle, out[:, half:]], axis=1)
    if out.shape[1:] != (n_levels, horizon):
        raise ValueError(f"forecast shape {out.shape[1:]}, expected {(n_levels, horizon)}")
    return out


def forecast_with(df: DataFrame, fn: Callable[[list[np.ndarray], int], np.ndarray], horizon: int,
                  test_length: int, context_length: int, levels: list[float] = LEVELS,
                  impute: bool = True, pad: float | None = None, batch_size: int = 512,
                  model: str = "user") -> DataFrame:
    """Run a user forecaster over all test windows in batches.

    `fn(contexts, horizon)` gets a list of 1-D arrays of at most `context_length`
    values and returns one of the layouts of `normalize_output`. It is called with up to
    `batch_size` windows of one task; a callable object may open its model lazily, once
    per Python worker. With `impute` missing points are filled linearly inside each
    context; with `pad` short contexts are filled on the left. The arrays are views that
    overlapping windows share: copy one before changing it.

    The panel is shuffled by slices (`windows.context_slices`), a row twice at most.
    """
    n_levels = len(levels)
    count, per_slice = windows.slicing(horizon, test_length, context_length)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = windows.cut_contexts(batches, 2, horizon, context_length, count, per_slice)
        while rows := list(islice(cut, batch_size)):
            keys, numbers, arrays = zip(*rows)
            arrays = [interpolate_missing(a) for a in arrays] if impute else list(arrays)
            if pad is not None:
                arrays = [np.concatenate([np.full(context_length - len(a), pad), a]) for a in arrays]
            out = normalize_output(fn(arrays, horizon), n_levels, horizon)
            yield _forecast_batch([i for i, _ in keys], np.array(numbers), out)

    slices = windows.context_slices(df, horizon, test_length, context_length)
    return slices.repartition("unique_id", "slice").sortWithinPartitions("unique_id", "slice", "at").mapInArrow(
        predict, FORECAST_SCHEMA).select(F.lit(model).alias("model"), "unique_id", "window_idx", "step", "quantiles")


def _forecast_batch(ids: list[str], numbers: np.ndarray, out: np.ndarray) -> pa.RecordBatch:
    """Rows of `FORECAST_SCHEMA` from forecasts `(window, level, step)`."""
    count, n_levels, horizon = out.shape
    stops = np.arange(0, count * horizon * n_levels + 1, n_levels, dtype=np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.string()).take(pa.array(np.repeat(np.arange(count), horizon))),
         pa.array(np.repeat(numbers, horizon), pa.int64()), pa.array(np.tile(np.arange(1, horizon + 1), count), pa.int64()),
         pa.ListArray.from_arrays(pa.array(stops), pa.array(out.transpose(0, 2, 1).ravel()))],
        names=["unique_id", "window_idx", "step", "quantiles"])


def forecast_multivariate(df: DataFrame, info: DataFrame, fn: Callable[[list[np.ndarray], int], list[np.ndarray]],
                          horizon: int, test_length: int, context_length: int, levels: list[float] = LEVELS,
                          impute: bool = True, max_variates: int = 16, batch_size: int = 32,
                          model: str = "user") -> DataFrame:
    """Run a forecaster that sees all variates of a series at once.

    `info` names the `(unique_id, series_name, variate_name)` of the panel. `fn(contexts,
    horizon)` gets a list of arrays `[variates, steps]`, variates in name order and steps
    aligned at the end, and returns for each of them `[variates, horizon]` or quantiles in a
    layout of `normalize_output`; another number of variates raises. A series with more than
    `max_variates` is handed over in chunks of that many, which also bounds a row. Missing
    steps, and those before the start of a shorter variate, are imputed or stay NaN.
    """
    order = Window.partitionBy("series_name").orderBy("variate_name")
    placed = info.select("unique_id", "series_name", "variate_name").distinct().select(
        "unique_id", "series_name", F.row_number().over(order).alias("number"))
    slices = windows.context_slices(df, horizon, test_length, context_length).join(placed, "unique_id").select(
        "series_name", floor_div(F.col("number") - 1, max_variates).alias("chunk"), "number", "unique_id", "slice", "at", "value")
    n_levels = len(levels)
    count, per_slice = windows.slicing(horizon, test_length, context_length)

    def stacked(rows) -> np.ndarray:
        out = np.full((len(rows), max(len(r) for r in rows)), np.nan)
        for line, row in zip(out, rows):
            line[len(line) - len(row):] = row
        return np.array([interpolate_missing(line) for line in out]) if impute else out

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[str], np.ndarray]]:
        """The stacked variates of a series, chunk and window."""
        found = windows.cut_contexts(batches, 5, horizon, context_length, count, per_slice)
        for _, group in groupby(found, lambda x: (*x[0][:2], x[0][4])):  # the windows of a slice, variate by variate
            by_window: dict[int, list[tuple[str, np.ndarray]]] = {}
            for key, window, values in group:
                by_window.setdefault(window, []).append((key[3], values))
            for window, rows in sorted(by_window.items()):
                ids, values = zip(*rows)
                yield window, list(ids), stacked(values)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = together(batches)
        while part := list(islice(found, batch_size)):
            numbers, ids, contexts = zip(*part)
            results = fn(list(contexts), horizon)
            if len(results) != len(part):
                raise ValueError(f"{len(results)} forecasts, expected {len(part)}")
            for own, number, one in zip(ids, numbers, results):
                out = normalize_output(one, n_levels, horizon)
                if len(out) != len(own):
                    raise ValueError(f"forecast of {len(out)} variates, expected {len(own)}")
                yield _forecast_batch(own, np.full(len(own), number), out)

    # keys as `cut_contexts` wants them: the slice last
    keyed = slices.select("series_name", "chunk", "number", "unique_id", "slice", "at", "value")
    return keyed.repartition("series_name", "chunk", "slice").sortWithinPartitions(
        "series_name", "chunk", "slice", "number", "at").mapInArrow(predict, FORECAST_SCHEMA).select(
        F.lit(model).alias("model"), "unique_id", "window_idx", "step", "quantiles")


def interpolate_missing(values: np.ndarray) -> np.ndarray:
    """Linear between neighbours, nearest at the ends, zeros without any value."""
    good = np.isfinite(values)
    if good.all():
        return values
    if not good.any():
        return np.zeros(len(values))
    at = np.arange(len(values))
    return np.interp(at, at[good], values[good])
