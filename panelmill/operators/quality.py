"""Quality checks of a panel, outlier cleaning, and the report that combines them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from panelmill.functions import frequency as fq
from panelmill.functions.frequency import floor_div
from panelmill.functions.order_statistics import RangeSelect, frame_of, frame_parts, inner_ranks
from panelmill.operators import grid

# Fixed values of the checks.
TOP_VALUES = 5
DOMINANCE_LIMIT = 0.5
ENTROPY_LIMIT = 0.1
NOISE_LAGS = (10, 20)
NOISE_LEVEL = 0.05
TRANSIENT, EXTREME = 3.0, 9.0
EXTREME_SHARE = 0.05
MISSING_LIMIT = 0.3


def check_dtype(df: DataFrame, columns: list[str]) -> dict[str, bool]:
    """Which columns are numeric, from the schema alone."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    kinds = dict(df.dtypes)
    return {c: kinds[c].startswith(numeric) for c in columns}


def numeric_share(df: DataFrame, columns: list[str]) -> DataFrame:
    """For text columns: the share of non-missing values that read as a number."""
    return df.agg(*[
        F.try_divide(F.count(F.expr(f"try_cast(`{c}` AS double)")), F.count(c)).alias(c) for c in columns])


def check_length(panel: DataFrame, freq: str, smallest: int | None = None) -> DataFrame:
    """Raw number of rows against the smallest usable length of the frequency."""
    need = fq.min_length(freq) if smallest is None else smallest
    counted = panel.groupBy("unique_id").agg(F.count(F.lit(1)).alias("n_raw"))
    return counted.withColumn("min_length", F.lit(need).cast("bigint")).withColumn("ok", F.col("n_raw") >= need)


def check_monotonic(raw: DataFrame, ordinal: str = "ordinal", block_rows: int = grid.BLOCK_STEPS) -> DataFrame:
    """Do timestamps never step back in file order? Compared inside blocks of the
    ordinal, then between the last row of a block and the first of the next."""
    block = fq.floor_div(F.col(ordinal), block_rows)
    rows = raw.select("unique_id", "ds", F.col(ordinal).alias("ordinal"), block.alias("block"))
    inside = Window.partitionBy("unique_id", "block").orderBy("ordinal")
    steps = rows.withColumn("back", F.col("ds") < F.lag("ds").over(inside)).groupBy("unique_id", "block").agg(
        F.count(F.when(F.col("back"), 1)).alias("backward"),
        F.min_by("ds", "ordinal").alias("first_ds"), F.max_by("ds", "ordinal").alias("last_ds"))
    across = Window.partitionBy("unique_id").orderBy("block")
    edge = F.when(F.col("first_ds") < F.lag("last_ds").over(across), 1).otherwise(0)
    total = steps.withColumn("edge", edge).groupBy("unique_id").agg(
        (F.sum("backward") + F.sum("edge")).alias("n_backward"))
    return total.withColumn("monotonic", F.col("n_backward") == 0)


def timestamp_report(panel: DataFrame, freq: str) -> DataFrame:
    """Rows, repeated timestamps, rows off the grid, and steps a gap-fill would add."""
    f = fq.parse_freq(freq)
    ds = F.col("ds")
    once = panel.select("unique_id", ds.cast("timestamp").alias("ds")).groupBy("unique_id", "ds").agg(
        F.count(F.lit(1)).alias("c"))
    remainder = F.when(fq.on_unit(ds, f), F.pmod(fq.units(ds, f), F.lit(f.stride))).otherwise(-1)
    parts = once.groupBy("unique_id", remainder.alias("r")).agg(
        *grid.bound_aggregates(f), F.sum("c").alias("rows"), F.sum(F.col("c") - 1).alias("repeats"),
        F.count(F.lit(1)).alias("times"))
    off_grid = F.col("r") != F.col("off")
    return grid.with_bounds(parts, f).groupBy("unique_id").agg(
        F.sum("rows").alias("n_raw"),
        F.sum("repeats").alias("n_duplicates"),
        F.sum(F.when(off_grid, F.col("rows")).otherwise(0)).alias("n_off_grid"),
        (F.max("n") - F.sum(F.when(off_grid, 0).otherwise(F.col("times")))).alias("n_filled"),
    )


def missing_rate(df: DataFrame) -> DataFrame:
    """Share of missing steps of a dense panel, its length and its observations."""
    gap = F.when(F.col("y").isNull(), 1.0).otherwise(0.0)
    return df.where("core").groupBy("unique_id").agg(
        F.avg(gap).alias("missing_rate"), F.max("n").alias("n"), F.count("y").alias("n_obs"))


def value_concentration(df: DataFrame, value: str = "y_filled", k: int = TOP_VALUES) -> DataFrame:
    """Share of the `k` most frequent values, and the normalised value entropy.

    The number of values that occur c times is all both need. That table has at
    most sqrt(2n) rows per series, whatever its length and its distinct values.
    """
    times = df.groupBy("unique_id", value).agg(F.count(F.lit(1)).alias("c"))
    shape = times.groupBy("unique_id", "c").agg(F.count(F.lit(1)).alias("m"))
    whole = Window.partitionBy("unique_id")
    above = whole.orderBy(F.col("c").desc()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(k) - F.coalesce(F.sum("m").over(above), F.lit(0))
    p = F.col("c") / F.col("n")
    shape = (
        shape.withColumn("n", F.sum(F.col("c") * F.col("m")).over(whole))
        .withColumn("taken", F.least(F.col("m"), F.greatest(left, F.lit(0))))
    )
    summed = shape.groupBy("unique_id").agg(
        (F.sum(F.col("c") * F.col("taken")) / F.max("n")).alias("dominance"),
        (-F.sum(F.col("m") * p * F.log(p + 1e-12))).alias("h"),
        F.sum("m").alias("n_values"),
    )
    entropy = F.when(F.col("n_values") > 1, F.col("h") / F.log(F.col("n_values").cast("double"))).otherwise(0.0)
    return summed.select("unique_id", "dominance", entropy.alias("entropy"))


def chi2_tail(x: Column, df: int) -> Column:
    """P(X > x) of a chi-square with an even number of degrees of freedom."""
    terms = [(x / 2) ** i / math.factorial(i) for i in range(df // 2)]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return F.exp(-x / 2) * total


def ljung_box(df: DataFrame, value: str = "y_filled") -> DataFrame:
    """Smallest Ljung-Box p-value over lags 10 and 20 of the whole series.

    Products of neighbours are summed per block, each with the steps before it that the
    lags reach; a series is never in one task. NULL where it is too short or constant.
    """
    rows = df.where("core").select("unique_id", "block", "pos", "n", F.col(value).alias("v"))
    means = rows.groupBy("unique_id").agg(F.avg("v").alias("mean"))
    centred = grid.attach(rows, means).select("unique_id", "pos", "n", (F.col("v") - F.col("mean")).alias("d"))
    top = max(NOISE_LAGS)
    halo = grid.reblock(centred, "pos", F.lit(max(grid.BLOCK_STEPS, 2 * top)), F.lit(top), F.lit(0))
    lagged = halo.withColumns({f"d{k}": F.lag("d", k).over(grid.ordered()) for k in range(1, top + 1)}).where("core")
    sums = lagged.groupBy("unique_id").agg(
        F.count("d").alias("m"), F.sum(F.col("d") * F.col("d")).alias("s0"),
        *[F.sum(F.col("d") * F.col(f"d{k}")).alias(f"s{k}") for k in range(1, top + 1)])
    tails = []
    for lags in NOISE_LAGS:
        q = sum((F.try_divide(F.col(f"s{k}"), F.col("s0")) ** 2 / (F.col("m") - k) for k in range(2, lags + 1)),
                F.try_divide(F.col("s1"), F.col("s0")) ** 2 / (F.col("m") - 1))
        tails.append(chi2_tail(q * F.col("m") * (F.col("m") + 2), lags))
    return sums.where(F.col("m") > top).select("unique_id", F.least(*tails).alias("noise_p"))


# --- Outliers --------------------------------------------------------------

def fallback_scale(filled: DataFrame, written: bool = False) -> DataFrame:
    """Interquartile range of a whole series, or 1.35 deviations where it is zero."""
    rows = filled.where("core")
    spread = rows.groupBy("unique_id").agg((F.stddev_samp("y_filled") * 1.35).alias("wide"))
    quartiles = grid.exact_quantiles(rows, "y_filled", [0.25, 0.75], written=written)
    return quartiles.join(spread, "unique_id").select(
        "unique_id", F.coalesce(F.nullif(F.col("q1") - F.col("q0"), F.lit(0.0)), F.col("wide")).alias("fallback"))


def _filled_with_scale(df: DataFrame, windows: bool = False) -> DataFrame:
    """Filled rows with the fallback scale; the filled panel has three readers. For `windows`
    on the blocks they are dealt out by the steps of the panel."""
    filled = df if "y_filled" in df.columns else grid.materialize(grid.fill_forward_back_zero(df))
    return grid.attach(filled, fallback_scale(filled, windows), windows)


def rolling_stats(df: DataFrame, window: int) -> DataFrame:
    """Centred rolling median and interquartile range with one window size.

    The panel must have been built with `back >= window // 2` and
    `ahead >= (window - 1) // 2`; short windows are used at the two ends.
    """
    frame = grid.ordered().rowsBetween(-(window // 2), (window - 1) // 2)
    quartiles = F.percentile("y_filled", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(frame)
    q = F.col("q")
    return _filled_with_scale(df, windows=True).withColumn("q", quartiles).where("core").select(
        "unique_id", "block", "pos", "n", "ds", "y", "y_filled", "fallback",
        q[1].alias("median"), (q[2] - q[0]).alias("iqr"))


STATS_SCHEMA = ("unique_id string, block bigint, pos bigint, n bigint, ds timestamp, y double, y_filled double, "
                "fallback double, median double, iqr double")
QUARTILES = (0.25, 0.5, 0.75)


def rolling_stats_by_length(df: DataFrame, block_steps: int = grid.BLOCK_STEPS) -> DataFrame:
    """The same with a window of max(20, n // 10) steps for each series.

    Windows of fewer than four blocks go through blocks with half a window on either side;
    short series share a group of about `block_steps` rows, so that many are done in one step.
    Longer windows never meet in a group, see `_long_windows`. The quantiles are the same.
    """
    size = F.greatest(F.lit(20), F.floor(F.col("n") / 10)).cast("bigint")
    rows = _filled_with_scale(df).where("core").withColumn("window", size)
    longest, steps = rows.agg(F.max("n"), F.count(F.lit(1))).first()
    longest = longest or 0
    long = F.col("window") >= 4 * block_steps
    window = F.col("window")
    short = grid.rehomed(rows.where(~long), "pos", F.greatest(F.lit(block_steps), window),
                         F.floor(window / 2).cast("bigint"), F.floor((window - 1) / 2).cast("bigint"))
    shares = max(rows.sparkSession.sparkContext.defaultParallelism, -(-steps // block_steps))
    short = short.select(F.pmod(F.xxhash64("unique_id", "block"), F.lit(shares)).alias("share"),
                         "unique_id", "block", "core", "window", "pos", "n", "ds", "y", "y_filled", "fallback")

    def slide(group: pd.DataFrame) -> pd.DataFrame:
        """The blocks of a share end to end: a frame is a range inside its own block."""
        series, block = pd.factorize(group["unique_id"])[0], group["block"].to_numpy()
        order = np.lexsort((group["pos"].to_numpy(), block, series))
        group, series, block = group.iloc[order], series[order], block[order]
        begins = np.flatnonzero(np.concatenate([[True], (series[1:] != series[:-1]) | (block[1:] != block[:-1])]))
        length = np.diff(np.concatenate([begins, [len(group)]]))
        begin, length = np.repeat(begins, length), np.repeat(length, length)
        start, stop = frame_of(np.arange(len(group)) - begin, length, group["window"].to_numpy())
        core = group["core"].to_numpy()
        start, stop = (start + begin)[core], (stop + begin)[core]
        select = RangeSelect(group["y_filled"].to_numpy())
        low, middle, high = (select.quantile(start, stop, q) for q in QUARTILES)
        return group[core].drop(columns=["share", "core", "window"]).assign(median=middle, iqr=high - low)

    stats = short.groupBy("share").applyInPandas(slide, STATS_SCHEMA)
    if longest // 10 < 4 * block_steps:
        return stats
    return stats.unionByName(_long_windows(rows.where(long), block_steps, longest))


def _long_windows(rows: DataFrame, size: int, longest: int) -> DataFrame:
    """Rolling quartiles where a window spans many blocks of `size` steps, from order statistics of blocks.

    The frames of one block of positions share all whole blocks between their ends; what they do
    not share is at most four blocks. So a quartile of such a frame has one of a few blocks'
    worth of ranks among the shared values, and only these need to reach the block:
    * each block counts its values by range (ranges hold about a block of the series);
    * the counts are summed over the shared blocks of each block of positions, and summed up
      by range, which tells the ranges with those ranks;
    * their values come from the runs `(value, count)` of the shared blocks, summed by value;
    * with the steps at both ends in order of position around them, a frame is a range of one
      array, and `RangeSelect` takes its quantiles.
    No group grows with the series but by its number of blocks or ranges, which is n / size.
    """
    rows = rows.withColumn("block", floor_div(F.col("pos"), size))
    per_series = rows.groupBy("unique_id").agg(F.max("n").alias("n"), F.max("window").alias("window"))
    values = grid.materialize(grid.value_runs(rows, "y_filled", size, longest))

    def shared(key: tuple, counts: pd.DataFrame) -> pd.DataFrame:
        """The values of a range in the shared blocks of each block of positions."""
        n, window = int(counts["n"].iloc[0]), int(counts["window"].iloc[0])
        upto = np.zeros(-(-n // size) + 1, np.int64)
        upto[counts["block"].to_numpy() + 1] = counts["count"].to_numpy()
        upto = np.cumsum(upto)
        block = np.arange(len(upto) - 1)
        _, inner, outer, _ = frame_parts(block, n, window, size)
        held = upto[-(-outer // size)] - upto[inner // size]
        block, held = block[held > 0], held[held > 0]
        return pd.DataFrame({"unique_id": key[0], "block": block, "bucket": key[1], "held": held, "n": n, "window": window})

    counts = values.groupBy("unique_id", "bucket", "block").agg(F.sum("count").alias("count")).join(per_series, "unique_id")
    counts = counts.groupBy("unique_id", "bucket").applyInPandas(
        shared, "unique_id string, block bigint, bucket bigint, held bigint, n bigint, window bigint")

    def needed(key: tuple, ranges: pd.DataFrame) -> pd.DataFrame:
        """The ranges with the ranks that the quartiles of a block's frames can have, and their shared blocks."""
        ranges = ranges.sort_values("bucket")
        n, window = int(ranges["n"].iloc[0]), int(ranges["window"].iloc[0])
        stop = ranges["held"].cumsum().to_numpy()
        below = stop - ranges["held"].to_numpy()
        use = np.zeros(len(ranges), bool)
        for q in QUARTILES:
            low, high = inner_ranks(key[1], n, window, size, q)
            use |= (below <= high) & (stop > low)
        _, inner, outer, _ = frame_parts(key[1], n, window, size)
        return pd.DataFrame({"unique_id": key[0], "home": key[1], "bucket": ranges["bucket"].to_numpy()[use], "below": below[use],
                             "low": int(inner) // size, "high": -(-int(outer) // size) - 1})

    wanted = counts.groupBy("unique_id", "block").applyInPandas(
        needed, "unique_id string, home bigint, bucket bigint, below bigint, low bigint, high bigint")
    wanted = wanted.withColumn("block", F.explode(F.sequence("low", "high"))).drop("low", "high")
    candidates = wanted.join(values, ["unique_id", "bucket", "block"]).groupBy(
        "unique_id", "home", "bucket", "below", "value").agg(F.sum("count").alias("count"))

    schema = ("unique_id string, home bigint, core boolean, pos bigint, n bigint, window bigint, ds timestamp, y double, "
              "y_filled double, fallback double")

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row to its own block, and to those whose frames begin or end around it."""
        for batch in batches:
            pos, n, window = (batch.column(c).to_numpy() for c in ("pos", "n", "window"))
            own, last = pos // size, -(-n // size) - 1
            begins, ends = (pos + window // 2) // size, (pos - (window - 1) // 2) // size
            for core, home in [(True, own), *((False, begins + d) for d in (-1, 0)), *((False, ends + d) for d in (-1, 0, 1))]:
                here = (home >= 0) & (home <= last)
                if not core:
                    first, inner, outer, end = frame_parts(home, n, window, size)
                    here &= ((pos >= first) & (pos < inner)) | ((pos >= outer) & (pos < end))
                at = np.flatnonzero(here)
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [part.column("unique_id"), pa.array(home[at]), pa.array(np.full(len(at), core)),
                     *(part.column(c) for c in ("pos", "n", "window", "ds", "y", "y_filled", "fallback"))],
                    names=[c.split()[0] for c in schema.split(", ")])

    def select(key: tuple, rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        core, sides = rows[rows["core"]], rows[~rows["core"]].drop_duplicates("pos")
        n, window = int(core["n"].iloc[0]), int(core["window"].iloc[0])
        first, inner, outer, _ = (int(x) for x in frame_parts(key[1], n, window, size))
        at, value = sides["pos"].to_numpy(), sides["y_filled"].to_numpy()
        before, after = value[at < inner], value[at >= outer]
        found = found.sort_values(["bucket", "value"])
        rank = found["below"].to_numpy() + found.groupby("bucket")["count"].cumsum().to_numpy()
        start, stop = frame_of(core["pos"].to_numpy(), n, window)
        quartiles = []
        for q in QUARTILES:
            low, high = inner_ranks(key[1], n, window, size, q)
            count = np.minimum(rank, high + 1) - np.maximum(rank - found["count"].to_numpy(), low)
            middle = np.repeat(found["value"].to_numpy(), np.maximum(count, 0))
            array = RangeSelect(np.concatenate([before, middle, after]))
            quartiles.append(array.quantile(start - first, len(before) + len(middle) + stop - outer, q, stop - start, low))
        out = core.drop(columns=["core", "window"]).rename(columns={"home": "block"})
        return out.assign(median=quartiles[1], iqr=quartiles[2] - quartiles[0])

    dealt_rows = rows.select("unique_id", "pos", "n", "window", "ds", "y", "y_filled", "fallback").mapInArrow(dealt, schema)
    homes = ["unique_id", "home"]
    return dealt_rows.groupBy(*homes).cogroup(candidates.groupBy(*homes)).applyInPandas(select, STATS_SCHEMA)


def flag_outliers(stats: DataFrame) -> DataFrame:
    """Mark transient and extreme points; where the rolling range is zero the
    range of the whole series takes its place."""
    scale = F.when(F.col("iqr") == 0, F.col("fallback")).otherwise(F.col("iqr"))
    d = F.coalesce(F.try_divide(F.abs(F.col("y_filled") - F.col("median")), scale), F.lit(0.0))
    return stats.withColumn("deviation", d).withColumn(
        "transient", (F.col("deviation") > TRANSIENT) & (F.col("deviation") < EXTREME)).withColumn(
        "extreme", F.col("deviation") >= EXTREME)


def outlier_ratios(flagged: DataFrame) -> DataFrame:
    """Shares of transient and extreme points, and whether the series varies at all."""
    return flagged.groupBy("unique_id").agg(
        F.avg(F.col("transient").cast("double")).alias("transient_ratio"),
        F.avg(F.col("extreme").cast("double")).alias("extreme_ratio"),
        (F.coalesce(F.max("y_filled") - F.min("y_filled"), F.lit(0.0)) > 0).alias("varies"),
    )


def outlier_stats(flagged: DataFrame) -> DataFrame:
    """The ratios in percent, as they are reported."""
    return outlier_ratios(flagged).select(
        "unique_id",
        F.round(F.col("transient_ratio") * 100, 2).alias("transient_spike_ratio"),
        F.round(F.col("extreme_ratio") * 100, 2).alias("extreme_outlier_ratio"),
        (F.col("extreme_ratio") <= EXTREME_SHARE).alias("keep"),
    )


def clean_outliers(flagged: DataFrame) -> DataFrame:
    """Replace extreme points by the last value before them that is not extreme,
    or the next one at the start. Missing points stay missing; a series with too
    many extreme points is left as it is. Returns `(unique_id, ds, y, y_clean)`.
    """
    good = F.when(~F.col("extreme"), F.col("y_filled"))
    # Read twice below: the sliding quantiles should not run again.
    rows = grid.materialize(flagged.withColumn("good", good))
    at = F.when(F.col("good").isNotNull(), F.col("pos"))
    across = Window.partitionBy("unique_id").orderBy("block")
    edges = rows.groupBy("unique_id", "block").agg(
        F.max_by("good", at).alias("last"), F.min_by("good", at).alias("first"),
        F.count(F.when(F.col("extreme"), 1)).alias("hits"), F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy("unique_id")
    edges = edges.select(
        "unique_id", "block",
        F.last("last", True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.last("first", True).over(whole.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("after"),
        (F.sum("hits").over(whole) / F.sum("rows").over(whole)).alias("ratio"))
    rows = grid.spread(rows, "pos", for_join=True).join(edges, ["unique_id", "block"])
    value = F.coalesce(
        F.last("good", True).over(grid.up_to_here()), F.col("before"),
        grid.first_ahead("good", "after"))
    value = F.when(F.col("ratio") > EXTREME_SHARE, F.col("y")).otherwise(value)
    return rows.select("unique_id", "ds", "y", F.when(F.col("y").isNotNull(), value).alias("y_clean"))


# --- Report ----------------------------------------------------------------

def quality_report(panel: DataFrame, freq: str, missing_limit: float = MISSING_LIMIT,
                   smallest: int | None = None, block_steps: int = grid.BLOCK_STEPS, stop_early: bool = False) -> DataFrame:
    """One row per series: `predictable`, the ordered reasons, and the numbers.

    Length, timestamp order and missing rate are reported together; the later
    checks (constant, white noise, outliers) each end the list. Pass an `ordinal`
    column to have the timestamp order checked as well.

    `y` may be text, as `to_panel(as_text=True)` gives it: a series with a value that does not
    read as a number (`n_text` counts them) has the reason `dtype` and no other, and NULL for
    the white-noise test and the outliers.

    `n_duplicates` and `n_off_grid` count the rows that the dense panel leaves out,
    `n_non_finite` the NaN and infinite values that count as missing. With `stop_early`
    the white-noise test and the outliers are computed only for series that passed all
    checks before; the others have NULL there. Verdict and reasons are the same.
    """
    return _report(panel, freq, missing_limit, smallest, block_steps, stop_early)[0]


def preprocess(panel: DataFrame, freq: str, missing_limit: float = MISSING_LIMIT, smallest: int | None = None,
               block_steps: int = grid.BLOCK_STEPS) -> tuple[DataFrame, DataFrame]:
    """The report, and the cleaned panel `(unique_id, ds, y, y_clean)` of the predictable series.

    The outliers of a series are found once, for its verdict and its cleaning, and only
    where the checks before have passed.
    """
    report, flagged = _report(panel, freq, missing_limit, smallest, block_steps, True, keep=True)
    return report, clean_outliers(_only(flagged, report.where("predictable")))


def _only(rows: DataFrame, series: DataFrame) -> DataFrame:
    """The block rows of some series."""
    return grid.attach(rows, series.select("unique_id", F.lit(True).alias("chosen"))).where("chosen").drop("chosen")


def _report(panel: DataFrame, freq: str, missing_limit: float, smallest: int | None, block_steps: int,
            stop_early: bool, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """The report and the flagged rows it rests on, which are written once with `keep`."""
    need = fq.min_length(freq) if smallest is None else smallest
    number = F.expr("try_cast(y AS double)")
    panel = grid.materialize(panel)  # four readers
    text = panel.groupBy("unique_id").agg(F.count(F.when(number.isNull(), F.col("y"))).alias("n_text"))
    as_text = isinstance(panel.schema["y"].dataType, StringType)
    if as_text:
        panel = panel.withColumn("y", number)
    # Six branches read the filled panel, so it is written once.
    filled = grid.materialize(grid.fill_forward_back_zero(grid.dense_of_written(panel, freq, block_steps)).where("core"))
    value = F.col("y").cast("double")
    raw = panel.groupBy("unique_id").agg(
        F.count(F.lit(1)).alias("n_raw"),
        F.count(F.when(F.isnan(value) | (F.abs(value) == float("inf")), 1)).alias("n_non_finite"),
        F.count(F.when(~F.isnan(value) & (F.abs(value) < float("inf")), 1)).alias("n_values"))
    raw = raw.withColumn("raw_missing", 1 - F.col("n_values") / F.col("n_raw")).drop("n_values").join(
        timestamp_report(panel, freq).select("unique_id", "n_duplicates", "n_off_grid"), "unique_id", "left")
    if "ordinal" in panel.columns:
        raw = raw.join(check_monotonic(panel), "unique_id")
    else:
        raw = raw.withColumn("monotonic", F.lit(True))
    first = raw.join(text, "unique_id").join(missing_rate(filled), "unique_id").join(
        value_concentration(filled), "unique_id").withColumn("missing_rate", F.when(F.col("monotonic"), F.col("missing_rate")).otherwise(F.col("raw_missing")))
    dtype = F.col("n_text") > 0
    early = F.when(dtype, F.array(F.lit("dtype"))).otherwise(F.array_compact(F.array(
        F.when(F.col("n_raw") < need, "length"),
        F.when(~F.col("monotonic"), "not_monotonic"),
        F.when(F.col("missing_rate") > missing_limit, "missing_rate"),
    )))
    constant = (F.col("dominance") >= DOMINANCE_LIMIT) | (F.col("entropy") <= ENTROPY_LIMIT)
    rest = filled
    if stop_early:
        first = grid.materialize(first)
        rest = _only(filled, first.where((F.size(early) == 0) & ~constant))
    elif as_text:
        rest = _only(filled, text.where("n_text = 0"))
    flagged = flag_outliers(rolling_stats_by_length(rest, block_steps))
    if keep:
        flagged = grid.materialize(flagged)
    table = first.join(ljung_box(rest), "unique_id", "left").join(outlier_ratios(flagged), "unique_id", "left")
    late = (
        F.when(constant, F.array(F.lit("constant")))
        .when(F.col("noise_p") > NOISE_LEVEL, F.array(F.lit("white_noise")))
        .when(~F.col("varies"), F.array(F.lit("constant_or_empty")))
        .when(F.col("extreme_ratio") > EXTREME_SHARE, F.array(F.lit("extreme_outliers")))
        .otherwise(F.array().cast("array<string>"))
    )
    report = (
        table.withColumn("checks", F.when(F.size(early) > 0, early).otherwise(late))
        .withColumn("predictable", F.size("checks") == 0)
        .select("unique_id", "predictable", "checks", "n_raw", "n", "n_obs", "missing_rate", "dominance",
                "entropy", "noise_p", "transient_ratio", "extreme_ratio", "n_duplicates", "n_off_grid", "n_non_finite", "n_text")
    )
    return report, flagged
