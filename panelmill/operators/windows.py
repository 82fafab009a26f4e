"""Splits and rolling-origin windows.

A window is named by columns, `(unique_id, window_idx, step)`, and found from the
position of a row. Contexts for a forecaster are cut as views from slices of a series
that hold many windows; they are not copied on their way.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.functions.frequency import floor_div

SLICE_STEPS = 4_096  # steps that the origins of a slice span at least, where there are so many
CONTEXT_VALUES = 1 << 20  # values in a batch of contexts


def num_windows(length: int, horizon: int) -> int:
    """Number of whole windows in a test or validation part, at least one."""
    return max(1, length // horizon)


def num_windows_column(length: Column, horizon: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(length / horizon)).cast("bigint")


def check_horizon(horizon: int, length: int) -> None:
    """A horizon must fit into the part that it is to be scored on."""
    if horizon > length:
        raise ValueError(f"a horizon of {horizon} steps does not fit into a part of {length}")


def short_series(df: DataFrame, length: int) -> DataFrame:
    """Series of a dense panel with fewer than `length` steps, `(unique_id, n)`: they have no windows there."""
    return df.where(F.col("core") & (F.col("n") < length)).select("unique_id", "n").distinct()


def _windows(df: DataFrame, start: Column, horizon: int, count: int) -> DataFrame:
    offset = F.col("pos") - start
    return df.where((start >= 0) & (offset >= 0) & (offset < horizon * count)).select(
        "unique_id",
        floor_div(offset, horizon).alias("window_idx"),
        (F.pmod(offset, F.lit(horizon)) + 1).alias("step"),
        "pos", "ds", "y",
    )


def test_windows(df: DataFrame, horizon: int, test_length: int) -> DataFrame:
    """Labels of the test windows of a dense panel, steps counted from 1.

    Points after the last whole window are not part of any window. A series shorter than
    the test part has none at all, see `short_series`.
    """
    check_horizon(horizon, test_length)
    return _windows(df, F.col("n") - test_length, horizon, num_windows(test_length, horizon))


def val_windows(df: DataFrame, horizon: int, test_length: int, val_length: int) -> DataFrame:
    """Labels of the validation windows, which lie just before the test part.

    A series shorter than both parts has none, see `short_series`.
    """
    check_horizon(horizon, val_length)
    return _windows(df, F.col("n") - (test_length + val_length), horizon, num_windows(val_length, horizon))


def train_split(df: DataFrame, horizon: int, test_length: int) -> DataFrame:
    """Rows before the last (windows + 1) horizons."""
    return df.where(F.col("pos") < F.col("n") - horizon * (num_windows(test_length, horizon) + 1))


def validation_split(df: DataFrame, horizon: int, test_length: int) -> DataFrame:
    """Rows before the last `windows` horizons.

    Where the horizon does not divide the test length this reaches into the first
    test points; the cut is kept because results are compared at it.
    """
    return df.where(F.col("pos") < F.col("n") - horizon * num_windows(test_length, horizon))


def effective_split(tasks: DataFrame, split: str = "test", smallest: int | None = None) -> DataFrame:
    """Add `split` as given; with `smallest`, a test part below so many points means the full series."""
    short = F.col("test_length") < smallest if smallest is not None else F.lit(False)
    return tasks.withColumn("split", F.when(F.lit(split) == "test", F.when(short, "full").otherwise("test"))
                            .otherwise(F.lit(split)))


def context_windows(df: DataFrame, horizon: int, test_length: int, length: int) -> DataFrame:
    """The last `length` points before every test origin, one row per point.

    `age` counts back from the origin (1 = the last point before it).
    """
    offset = F.col("pos") - (F.col("n") - test_length)
    last = num_windows(test_length, horizon) - 1
    lo = F.greatest(F.lit(0), floor_div(offset, horizon) + 1)
    hi = F.least(F.lit(last), floor_div(offset + length, horizon))
    return (
        df.withColumn("lo", lo).withColumn("hi", hi).where("lo <= hi")
        .withColumn("window_idx", F.explode(F.sequence("lo", "hi")))
        .withColumn("age", F.col("window_idx") * horizon - offset)
        .drop("lo", "hi")
    )


def slicing(horizon: int, test_length: int, length: int) -> tuple[int, int]:
    """Test windows, and how many of them in a row are cut from one slice of a series.

    A slice spans at least one context, so a row lies in two slices at most.
    """
    count = num_windows(test_length, horizon)
    return count, min(count, max(-(-length // horizon), -(-SLICE_STEPS // horizon)))


def context_slices(df: DataFrame, horizon: int, test_length: int, length: int, value: str = "y") -> DataFrame:
    """The rows of a dense panel that contexts are cut from: `(unique_id, slice, at, value)`.

    `at` counts from the first test origin. A slice holds the windows of some origins in a row
    and every step that their contexts reach back to, so contexts that overlap share their
    rows: a row is in two slices at most, however long contexts are against the horizon.
    """
    count, per_slice = slicing(horizon, test_length, length)
    span = per_slice * horizon
    at = F.col("pos") - (F.col("n") - test_length)
    first = F.greatest(F.lit(0), floor_div(at + horizon, span))
    last = F.least(F.lit(-(-count // per_slice) - 1), floor_div(at + length, span))
    rows = df.where("core").select("unique_id", at.alias("at"), first.cast("bigint").alias("first"),
                                   last.cast("bigint").alias("last"), F.col(value).alias("value"))
    return rows.where(F.col("at") < horizon * (count - 1)).where("first <= last").select(
        "unique_id", F.explode(F.sequence("first", "last")).alias("slice"), "at", "value")


def cut_contexts(batches: Iterator[pa.RecordBatch], keys: int, horizon: int, length: int, count: int,
                 per_slice: int) -> Iterator[tuple[tuple, int, np.ndarray]]:
    """Contexts `(key values, window_idx, values)` from rows sorted by `keys` columns, then `at`, `value`; the last key is the slice.

    The values are views of the slice's array, NaN where missing. A window that no row
    precedes has no context. `count` and `per_slice` are those of `slicing`.
    """
    held: list[tuple[np.ndarray, np.ndarray]] = []
    key = None

    def cut():
        at, values = (np.concatenate(x) for x in zip(*held)) if len(held) > 1 else held[0]
        origins = np.arange(key[-1] * per_slice, min(count, (key[-1] + 1) * per_slice))
        starts, ends = np.searchsorted(at, origins * horizon - length), np.searchsorted(at, origins * horizon)
        for window, i, j in zip(origins.tolist(), starts.tolist(), ends.tolist()):
            if i < j:
                yield key, window, values[i:j]

    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for column in batch.columns[:keys]:
            codes = column.dictionary_encode().indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        at, values = batch.column(keys).to_numpy(), batch.column(keys + 1).to_numpy(zero_copy_only=False)
        bounds = [*np.flatnonzero(new).tolist(), batch.num_rows]
        for i, j in zip(bounds, bounds[1:]):
            here = tuple(c[i].as_py() for c in batch.columns[:keys])
            if here != key:
                if held:
                    yield from cut()
                key, held = here, []
            held.append((at[i:j], values[i:j].astype(float)))
    if held:
        yield from cut()


def context_arrays(df: DataFrame, horizon: int, test_length: int, length: int, value: str = "y") -> DataFrame:
    """One row per window with its context in time order, at most `length` values."""
    count, per_slice = slicing(horizon, test_length, length)

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = cut_contexts(batches, 2, horizon, length, count, per_slice)
        while rows := list(islice(cut, max(1, CONTEXT_VALUES // length))):
            ids, numbers, values = zip(*rows)
            stops = np.cumsum([0, *map(len, values)]).astype(np.int32)
            flat = np.concatenate(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in ids], pa.string()), pa.array(numbers, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(stops), pa.array(flat, mask=np.isnan(flat)))],
                names=["unique_id", "window_idx", "context"])

    slices = context_slices(df, horizon, test_length, length, value).withColumn("value", F.col("value").cast("double"))
    return slices.repartition("unique_id", "slice").sortWithinPartitions("unique_id", "slice", "at").mapInArrow(
        arrays, "unique_id string, window_idx bigint, context array<double>")


def truncate_context(context: Column, length: int) -> Column:
    """Last `length` values of an array."""
    return F.when(F.size(context) > length, F.slice(context, -length, length)).otherwise(context)


def left_pad_context(context: Column, length: int, value: float | None = None) -> Column:
    """Pad short contexts on the left with `value`."""
    missing = F.greatest(F.lit(0), F.lit(length) - F.size(context))
    return F.concat(F.array_repeat(F.lit(value).cast("double"), missing), context)


def series_length_stats(lengths: DataFrame, dimensions: int = 1) -> DataFrame:
    """Shortest, longest and mean length, and the total over all dimensions."""
    return lengths.agg(
        F.min("n").alias("min_length"),
        F.max("n").alias("max_length"),
        F.avg("n").alias("avg_length"),
        (F.sum("n") * dimensions).alias("sum_length"),
    )


def validate_lengths(tasks: DataFrame, lengths: DataFrame) -> DataFrame:
    """Task table with a status: `error` where the test or validation part, or one
    horizon, does not fit; `warning` where a part takes more than half.

    `lengths` has one row per series, `(dataset_id, n)`.
    """
    shortest = lengths.groupBy("dataset_id").agg(F.min("n").alias("min_length"))
    parts = [F.col("test_length"), F.col("val_length")]
    too_long = [p > F.col("min_length") for p in parts]
    heavy = [p > F.col("min_length") * 0.5 for p in parts]
    status = (
        F.when(too_long[0] | too_long[1] | (F.col("prediction_length") > F.col("test_length")), "error")
        .when(heavy[0] | heavy[1], "warning")
        .otherwise("ok")
    )
    return tasks.join(shortest, "dataset_id").withColumn("status", status)
