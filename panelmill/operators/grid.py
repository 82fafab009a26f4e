"""The dense panel: one row per grid step, cut into blocks of bounded length.

A series may hold a large share of all rows, so nothing here sorts or collects a
whole series. Each series is cut into blocks of `block_steps` consecutive steps;
the block of a row follows from its own timestamp. One small summary per block
(first and last observation, counts, moments) is scanned per series, and what a
block needs from its neighbours travels to it as a few columns. All ordered
windows then run on `(unique_id, block)`, and the panel itself is shuffled once.

Columns of the dense panel:

    unique_id, block   the partitioning every ordered window uses
    pos, n             0-based position and the length of the series
    ds, y              timestamp and value (NULL where nothing was observed)
    core               false on rows repeated from a neighbouring block
    prev_pos, prev_y   last observation before the block
    next_pos, next_y   first observation after the block
    seen               observations before the block
    y_mean, y_std      mean and sample deviation of the series

The metadata of `pos` has the number of steps of the panel (`steps`). Spark carries it along, so
that later shuffles of the steps can be sized by them, not by the bytes they are packed to.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from panelmill.functions import frequency as fq

BLOCK_STEPS = 65_536
TASK_STEPS = 1 << 17  # steps of the grid that one task fills
MOST_BUCKETS = 10_000  # ranges of the values of a series


def ordered(position: str = "pos") -> WindowSpec:
    """Order inside one block."""
    return Window.partitionBy("unique_id", "block").orderBy(position)


def up_to_here() -> WindowSpec:
    return ordered().rowsBetween(Window.unboundedPreceding, 0)


def from_here() -> WindowSpec:
    """This row and all later ones, walked backwards: a frame that is unbounded
    ahead would be evaluated anew for every row. The nearest value is the `last`."""
    return Window.partitionBy("unique_id", "block").orderBy(F.col("pos").desc()).rowsBetween(
        Window.unboundedPreceding, 0)


def clean_panel(panel: DataFrame) -> DataFrame:
    """`(unique_id, ds, y)` with NaN and infinite values turned into NULL, the only missing marker."""
    y = F.col("y").cast("double")
    return panel.select(
        "unique_id",
        F.col("ds").cast("timestamp").alias("ds"),
        F.when(~F.isnan(y) & (F.abs(y) < float("inf")), y).alias("y"),
    )


def _stepped(panel: DataFrame, freq: fq.Freq, size: int) -> DataFrame:
    """Panel rows with step index `t`, remainder `r`, block, and place in the block."""
    ds = F.col("ds")
    unit = fq.units(ds, freq)
    t = fq.floor_div(unit, freq.stride)
    return clean_panel(panel).select(
        "unique_id", "ds", "y", t.alias("t"),
        F.when(fq.on_unit(ds, freq), F.pmod(unit, F.lit(freq.stride))).otherwise(-1).alias("r"),
        fq.floor_div(t, size).alias("block"),
        F.pmod(t, F.lit(size)).alias("at"),
    )


def with_bounds(summary: DataFrame, freq: fq.Freq) -> DataFrame:
    """Add first and last step, remainder `off` and length of each series' own grid.

    `summary` holds `lo`, `hi` (and for weeks seven weekday counts) per row; the
    bounds are taken over all rows of a series.
    """
    whole = Window.partitionBy("unique_id")
    start = F.col("start")
    bounds = {"start": F.min("lo").over(whole), "end": F.max("hi").over(whole)}
    if freq.base == "W":
        bounds["days"] = F.array(*[F.sum(f"wd{i}").over(whole) for i in range(7)])
        anchor = F.array_position("days", F.array_max("days")) - 1
        start = start + F.pmod(anchor - fq.weekday(F.timestamp_seconds("start")), F.lit(7)) * 86400
    off = F.pmod(start, F.lit(freq.stride))
    t0 = fq.floor_div(start, freq.stride)
    t1 = fq.floor_div(F.col("end") - off, freq.stride)
    return summary.withColumns(bounds).withColumns({"off": off, "t0": t0, "t1": t1, "n": t1 - t0 + 1})


def bound_aggregates(freq: fq.Freq) -> list[Column]:
    ds = F.col("ds")
    aggregates = [
        F.min(fq.units_at_or_after(ds, freq)).alias("lo"),
        F.max(fq.units_at_or_before(ds, freq)).alias("hi"),
    ]
    if freq.base == "W":
        day = fq.weekday(ds)
        aggregates += [F.sum(F.when(day == i, 1).otherwise(0)).alias(f"wd{i}") for i in range(7)]
    return aggregates


def series_bounds(panel: DataFrame, freq: str) -> DataFrame:
    """`(unique_id, start, end, n, n_raw)`: each series' own grid, not materialised."""
    f = fq.parse_freq(freq)
    totals = clean_panel(panel).groupBy("unique_id").agg(
        *bound_aggregates(f), F.count(F.lit(1)).alias("n_raw")
    )
    return with_bounds(totals, f).select(
        "unique_id",
        fq.unit_time(F.col("t0") * f.stride + F.col("off"), f).alias("start"),
        fq.unit_time(F.col("t1") * f.stride + F.col("off"), f).alias("end"),
        "n",
        "n_raw",
    )


def _last(position: Column, value: Column, keep: Column) -> Column:
    """Latest kept observation as a struct; NULL when there is none."""
    at = F.max(F.when(keep, position))
    return F.when(at.isNotNull(), F.struct(at.alias("t"), F.max_by(value, F.when(keep, position)).alias("y")))


def _first(position: Column, value: Column, keep: Column) -> Column:
    at = F.min(F.when(keep, position))
    return F.when(at.isNotNull(), F.struct(at.alias("t"), F.min_by(value, F.when(keep, position)).alias("y")))


def _block_table(rows: DataFrame, freq: fq.Freq, size: int, back: int, ahead: int) -> DataFrame:
    """One row per block of every series, with all a block needs from outside."""
    t, y, at = F.col("t"), F.col("y"), F.col("at")
    seen, head, tail = y.isNotNull(), at < size - back, at >= ahead
    summary = rows.groupBy("unique_id", "r", "block").agg(
        *bound_aggregates(freq),
        _last(t, y, seen).alias("last"),
        _last(t, y, seen & head).alias("head_last"),
        _first(t, y, seen).alias("first"),
        _first(t, y, seen & tail).alias("tail_first"),
        F.count(y).alias("cnt"),
        F.count(F.when(head, y)).alias("head_cnt"),
        F.avg(y).alias("avg"),
        (F.var_pop(y) * F.count(y)).alias("m2"),
    )
    whole = Window.partitionBy("unique_id")
    by_block = whole.orderBy("block")
    summary = with_bounds(summary, freq).where(F.col("r") == F.col("off"))
    total = F.sum("cnt").over(whole)
    spread = F.col("m2") + F.col("cnt") * (F.col("avg") - F.col("y_mean")) ** 2
    first_block = F.when(F.lag("block").over(by_block).isNull(), fq.floor_div(F.col("t0"), size)).otherwise(F.col("block"))
    last_block = F.coalesce(F.lead("block").over(by_block) - 1, fq.floor_div(F.col("t1"), size))
    summary = summary.withColumns({
        "y_mean": F.try_divide(F.sum(F.col("cnt") * F.col("avg")).over(whole), total),
        "covers": F.sequence(first_block, last_block),
        "total": total,
    })
    own = F.col("b") == F.col("block")
    held = ["last", "head_last", "first", "tail_first"]
    summary = summary.select(
        "*", F.explode_outer("covers").alias("b"),
        F.sqrt(F.sum(spread).over(whole) / F.when(F.col("total") > 1, F.col("total") - 1)).alias("y_std"),
    ).select(
        "unique_id", F.col("b").alias("block"), "t0", "t1", "n", "off", "y_mean", "y_std",
        *[F.when(own, F.col(c)).alias(c) for c in held],
        *[F.when(own, F.col(c)).otherwise(0).alias(c) for c in ("cnt", "head_cnt")],
    )

    def before(k: int):
        return by_block.rowsBetween(Window.unboundedPreceding, -k)

    def after(k: int):
        return whole.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -k)

    if back:
        previous = F.coalesce(F.lag("head_last").over(by_block), F.last("last", True).over(before(2)))
        count = F.coalesce(F.lag("head_cnt").over(by_block), F.lit(0)) + F.coalesce(
            F.sum("cnt").over(before(2)), F.lit(0))
    else:
        previous = F.last("last", True).over(before(1))
        count = F.coalesce(F.sum("cnt").over(before(1)), F.lit(0))
    if ahead:
        following = F.coalesce(F.lead("tail_first").over(by_block), F.last("first", True).over(after(2)))
    else:
        following = F.last("first", True).over(after(1))
    return summary.withColumns({
        "prev": previous, "next": following, "seen": count,
        "t_lo": F.greatest("t0", F.col("block") * size - back),
        "t_hi": F.least("t1", F.col("block") * size + (size - 1 + ahead)),
    }).select("unique_id", "block", "t_lo", "t_hi", "t0", "n", "off", "seen", "y_mean", "y_std", "prev", "next")


def dense(panel: DataFrame, freq: str, block_steps: int = BLOCK_STEPS,
          back: int = 0, ahead: int = 0) -> DataFrame:
    """The dense panel of the module description.

    `back` and `ahead` repeat that many steps of the neighbouring blocks with
    `core = false`, so that a window of that reach stays inside one block.
    Rows off a series' own grid are left out; of several rows with one timestamp
    the largest value is kept (see `timestamp_report` for both).

    The panel is written once, for the blocks and for the rows. With the blocks the number of
    steps is known, and with it that of tasks: none fills much more than `TASK_STEPS`.
    """
    return dense_of_written(materialize(clean_panel(panel)), freq, block_steps, back, ahead)


def tasks_for(spark: SparkSession, steps: int) -> int:
    """How many tasks share the steps of a grid, one for each core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-steps // TASK_STEPS))


def spread(df: DataFrame, position: str, for_join: bool = False) -> DataFrame:
    """`df` dealt out by blocks, over as many tasks as the steps of its dense panel ask for.

    Without a position column of a dense panel the number is left to the session, and rows that
    are dealt out `for_join` only stay where they are.
    """
    steps, keys = df.schema[position].metadata.get("steps"), ("unique_id", "block")
    if steps:
        return df.repartition(tasks_for(df.sparkSession, steps), *keys)
    return df if for_join else df.repartition(*keys)


def dense_of_written(panel: DataFrame, freq: str, block_steps: int = BLOCK_STEPS,
                     back: int = 0, ahead: int = 0) -> DataFrame:
    """`dense` of a panel that is cheap to read twice."""
    f = fq.parse_freq(freq)
    size = max(block_steps, 2 * (back + ahead))
    rows = _stepped(panel, f, size)
    blocks = materialize(_block_table(rows, f, size, back, ahead))
    steps = blocks.agg(F.sum(F.col("t_hi") - F.col("t_lo") + 1)).first()[0] or 0

    none = F.lit(None)
    blocks = blocks.select(
        "unique_id", "block", F.sequence("t_lo", "t_hi").alias("steps"), F.col("off").alias("r"),
        none.cast("double").alias("y"), "n", "t0", "seen", "y_mean", "y_std",
        F.col("prev.t").alias("prev_t"), F.col("prev.y").alias("prev_y"),
        F.col("next.t").alias("next_t"), F.col("next.y").alias("next_y"),
    )
    homes = F.col("block")
    if back or ahead:
        homes = F.explode_outer(F.array_compact(F.array(
            F.col("block"),
            F.when(F.col("at") >= size - back, F.col("block") + 1),
            F.when(F.col("at") < ahead, F.col("block") - 1),
        )))
    longs, doubles = ("n", "t0", "seen", "prev_t", "next_t"), ("y_mean", "y_std", "prev_y", "next_y")
    rows = rows.select(
        "unique_id", homes.alias("block"), F.array("t").alias("steps"), "r", "y",
        *[none.cast("bigint").alias(c) for c in longs],
        *[none.cast("double").alias(c) for c in doubles],
    )
    at = F.col("t")
    merged = (
        rows.unionByName(blocks)
        .repartition(tasks_for(panel.sparkSession, steps), "unique_id", "block")
        .withColumn("t", F.explode_outer("steps"))
        .groupBy("unique_id", "block", "t", "r")
        .agg(*[F.max(c).alias(c) for c in ("y",) + longs + doubles])
        .where(F.col("n").isNotNull())
    )
    return merged.select(
        "unique_id", "block", (at - F.col("t0")).alias("pos", metadata={"steps": steps}), "n",
        fq.unit_time(at * f.stride + F.col("r"), f).alias("ds"), "y",
        (fq.floor_div(at, size) == F.col("block")).alias("core"),
        (F.col("prev_t") - F.col("t0")).alias("prev_pos"), "prev_y",
        (F.col("next_t") - F.col("t0")).alias("next_pos"), "next_y",
        "seen", "y_mean", "y_std",
    )


def reblock(df: DataFrame, position: str, size: Column, back: Column, ahead: Column) -> DataFrame:
    """Move rows into new blocks of `size` positions with halo rows.

    `size` may differ between series but must be at least `back + ahead`. The
    result has a new `block` and `core`; each row is repeated at most twice.
    """
    return spread(rehomed(df, position, size, back, ahead), position)


def rehomed(df: DataFrame, position: str, size: Column, back: Column, ahead: Column) -> DataFrame:
    """The rows of `reblock` where they are, for readers that deal them out otherwise."""
    spot, block = F.pmod(F.col(position), size), F.col("home")
    return (
        df.withColumn("home", ((F.col(position) - spot) / size).cast("bigint"))
        .withColumn("block", F.explode_outer(F.array_compact(F.array(
            block,
            F.when(spot >= size - back, block + 1),
            F.when((spot < ahead) & (block > 0), block - 1),
        ))))
        .withColumn("core", F.col("block") == block)
        .drop("home")
    )


def gap_fill(panel: DataFrame, freq: str, block_steps: int = BLOCK_STEPS) -> DataFrame:
    """Insert the missing grid timestamps of every series with a NULL value."""
    return dense(panel, freq, block_steps).select("unique_id", "ds", "y")


def fill_forward(df: DataFrame, out: str = "y_ffill") -> DataFrame:
    """Last observation so far; NULL before the first one."""
    return df.withColumn(out, F.coalesce(F.last("y", True).over(up_to_here()), F.col("prev_y")))


def fill_backward(df: DataFrame, out: str = "y_bfill") -> DataFrame:
    """Next observation; NULL after the last one."""
    return df.withColumn(out, F.coalesce(F.last("y", True).over(from_here()), F.col("next_y")))


def whole_block() -> WindowSpec:
    return ordered().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def first_ahead(column: str, following: str) -> Column:
    """Next observation of a row that has none before it: then it is simply the
    first of its block, or the first after the block."""
    return F.coalesce(F.first(column, True).over(whole_block()), F.col(following))


def fill_forward_back_zero(df: DataFrame, out: str = "y_filled") -> DataFrame:
    """Forward fill, then backward fill, then 0."""
    before = F.coalesce(F.last("y", True).over(up_to_here()), F.col("prev_y"))
    return df.withColumn(out, F.coalesce(before, first_ahead("y", "next_y"), F.lit(0.0)))


def impute_linear(df: DataFrame, out: str = "y_linear", empty: float | None = 0.0) -> DataFrame:
    """Straight line between neighbouring observations, nearest value at both
    ends, `empty` where a series has no observation at all."""
    at = F.when(F.col("y").isNotNull(), F.col("pos"))
    df = (
        fill_backward(fill_forward(df, "_f"), "_b")
        .withColumn("_fp", F.coalesce(F.last(at, True).over(up_to_here()), F.col("prev_pos")))
        .withColumn("_bp", F.coalesce(F.last(at, True).over(from_here()), F.col("next_pos")))
    )
    line = F.col("_f") + (F.col("_b") - F.col("_f")) * (F.col("pos") - F.col("_fp")) / F.nullif(
        F.col("_bp") - F.col("_fp"), F.lit(0))
    value = F.coalesce(F.col("y"), line, F.col("_f"), F.col("_b"), F.lit(empty).cast("double"))
    return df.withColumn(out, value).drop("_f", "_b", "_fp", "_bp")


def standardize(df: DataFrame, value: str = "y", out: str = "y_scaled") -> DataFrame:
    """(value - mean) / sample deviation of the observations; unchanged where the
    deviation is undefined or below 1e-8."""
    scaled = (F.col(value) - F.col("y_mean")) / F.col("y_std")
    return df.withColumn(out, F.when(F.col("y_std") >= 1e-8, scaled).otherwise(F.col(value)))


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame that several branches read to the checkpoint folder, once.

    The folder is the one of the session; a local session without one gets its own.
    """
    from panelmill.session import checkpoint_folder

    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def tail(df: DataFrame, length: int) -> DataFrame:
    """Last `length` steps of every series of a dense panel."""
    return df.where(F.col("pos") >= F.col("n") - length)


def attach(rows: DataFrame, per_series: DataFrame, written: bool = False) -> DataFrame:
    """Left join of a per-series table to block rows on `(unique_id, block)`, so a
    long series stays spread over its blocks. Rows that are `written` have lost their
    partitioning; their shuffle is sized by the steps of the panel."""
    keys = rows.select("unique_id", "block").distinct()
    rows = spread(rows, "pos", for_join=True) if written else rows
    return rows.join(keys.join(per_series, "unique_id"), ["unique_id", "block"], "left")


def value_runs(df: DataFrame, value: str, size: int, longest: int) -> DataFrame:
    """The values of each block by range: `(unique_id, block, bucket, value, count)`.

    Buckets ascend with the values and hold about `size` steps of a series, more only where
    one value occurs more often. `longest` is the number of steps of the longest series.
    """
    buckets = min(MOST_BUCKETS, -(-longest // size))
    runs = df.select("unique_id", "block", F.col(value).alias("value"))
    if buckets < 2:
        return runs.groupBy("unique_id", "block", F.lit(0).cast("bigint").alias("bucket"), "value").count()
    edges = df.groupBy("unique_id").agg(F.percentile_approx(
        value, F.array(*(F.lit(i / buckets) for i in range(1, buckets))), max(10_000, 20 * buckets)).alias("edges"))
    edges = df.select("unique_id", "block").distinct().join(edges, "unique_id").select(
        *(F.col(c).alias(c) for c in ("unique_id", "block", "edges")))  # columns of their own, for the cogroup

    def dealt(values: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        value, count = np.unique(values["value"].to_numpy(), return_counts=True)
        bucket = np.searchsorted(np.unique(own["edges"].iloc[0]), value, side="left")
        return pd.DataFrame({"unique_id": values["unique_id"].iloc[0], "block": values["block"].iloc[0], "bucket": bucket,
                             "value": value, "count": count})

    return runs.groupBy("unique_id", "block").cogroup(edges.groupBy("unique_id", "block")).applyInPandas(
        dealt, "unique_id string, block bigint, bucket bigint, value double, count bigint")


def exact_quantiles(df: DataFrame, value: str, probs: list[float], accuracy: int = 10_000,
                    written: bool = False) -> DataFrame:
    """Exact linearly interpolated quantiles per series of block rows, `(unique_id, q0, q1, ...)`.

    A mergeable sketch brackets each quantile; only the distinct values inside a
    bracket are ordered, so even a very long series never meets in one task. For `written`
    rows see `attach`; they need their `pos`.
    """
    slack = 2.0 / accuracy
    edges = [min(max(p + s, 0.0), 1.0) for p in probs for s in (-slack, slack)]
    # The sketch errs by total / accuracy and interpolation needs one more neighbour;
    # a short series is bracketed by its extremes.
    short = F.count(value) <= 4 * accuracy
    bounds = df.where(F.col(value).isNotNull()).groupBy("unique_id").agg(
        F.when(short, F.array(*[f(value) for _ in probs for f in (F.min, F.max)]))
        .otherwise(F.percentile_approx(value, F.array(*[F.lit(e) for e in edges]), accuracy)).alias("edges"),
        F.count(value).alias("total"),
    )
    v = F.col("v")
    # Each row counts once per quantile: by value inside the bracket, as NULL below it.
    hits = F.array(*[
        F.when(v < F.col("edges")[2 * i], F.struct(F.lit(i).alias("i"), F.lit(None).cast("double").alias("v")))
        .when(v <= F.col("edges")[2 * i + 1], F.struct(F.lit(i).alias("i"), v.alias("v")))
        for i in range(len(probs))])
    counted = (
        attach(df.select("unique_id", "block", *["pos"] * written, F.col(value).alias("v")).where("v IS NOT NULL"),
               bounds, written)
        .select("unique_id", "total", F.explode_outer(F.array_compact(hits)).alias("hit"))
        .groupBy("unique_id", "total", "hit.i", "hit.v").count().where("i IS NOT NULL")
    )
    by_value = Window.partitionBy("unique_id", "i").orderBy(F.col("v").asc_nulls_first())
    rank = F.array(*[(F.col("total") - 1) * F.lit(p) for p in probs])[F.col("i")]
    ranked = counted.select("unique_id", "i", "v", F.sum("count").over(by_value).alias("upto"), rank.alias("rank"))

    def at(i: int, r: Column) -> Column:
        return F.min(F.when((F.col("i") == i) & (F.col("upto") > r), F.col("v")))

    low, high = F.floor("rank"), F.ceil("rank")
    return ranked.groupBy("unique_id").agg(*[
        (at(i, low) + (at(i, high) - at(i, low)) * F.max(F.when(F.col("i") == i, F.col("rank") - low))).alias(f"q{i}")
        for i in range(len(probs))])
