"""Per-series features.

Sums, lags and block statistics are DataFrame aggregations. Grouped pandas
functions are left for what is sequential along a series: the decomposition
(which runs on blocks, see `decompose`), the Fourier transform (in pieces, see
`spectra`), the products of the unit-root test and the prefix scan of the Hurst exponent.

Component rows are `(unique_id, block, pos, n, m, y, trend, seasonal, remainder)`
with `m` the period of the series.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions import frequency as fq
from panelmill.functions import numerics
from panelmill.operators import grid
from panelmill.operators.spectra import spectrum

# Fixed values.
ACF_LAGS = 10
ARCH_LAGS = 12
FEATURE_ORDER = [
    "dataset_id", "series_name", "variate_name", "unique_id",
    "stationarity", "x_entropy",
    "trend_strength", "trend_stability", "trend_hurst", "trend_nonlinearity", "linearity", "curvature",
    "seasonal_strength", "seasonal_corr", "seasonal_lumpiness", "seasonal_entropy",
    "e_acf1", "e_acf10", "e_diff1_acf1", "e_entropy", "e_kurtosis", "e_shapiro_w", "e_arch_lm", "spike",
    "mean", "std", "missing_rate", "length",
    "period1", "period2", "period3", "p_strength1", "p_strength2", "p_strength3",
]
OPTIONAL = ["period2", "period3", "p_strength2", "p_strength3"]
SEASONAL = ["seasonal_strength", "seasonal_corr", "seasonal_lumpiness", "seasonal_entropy"]


# --- Raw series --------------------------------------------------------------

def basic_stats(df: DataFrame) -> DataFrame:
    """Mean, population deviation, missing rate and length of a dense panel."""
    return df.where("core").groupBy("unique_id").agg(
        F.avg("y").alias("mean"), F.stddev_pop("y").alias("std"),
        F.avg(F.when(F.col("y").isNull(), 1.0).otherwise(0.0)).alias("missing_rate"),
        F.max("n").alias("length"))


def prepared(df: DataFrame) -> DataFrame:
    """Scaled series without gaps: `(unique_id, block, pos, n, y)`.

    Interpolating first and scaling after gives the same line as the other way
    round, because the scale is taken from the observations only.
    """
    linear = grid.impute_linear(df, "y_linear", empty=None)
    return grid.standardize(linear, "y_linear", "z").where("core").select(
        "unique_id", "block", "pos", "n", F.col("z").alias("y"))


def with_halo(rows: DataFrame, back: int, block_steps: int = grid.BLOCK_STEPS) -> DataFrame:
    """Component rows in fresh blocks that repeat `back` earlier rows."""
    size = F.lit(max(block_steps, 2 * back)).cast("bigint")
    return grid.reblock(rows.drop("block"), "pos", size, F.lit(back), F.lit(0))


def _lag_sums(value: Column, name: str, lags: int) -> list[Column]:
    """Sums that give any autocovariance up to `lags` once the mean is known."""
    sums = [F.sum(value).alias(f"{name}_s"), F.sum(value * value).alias(f"{name}_ss"), F.count(value).alias(f"{name}_n")]
    for k in range(1, lags + 1):
        past = F.col(f"{name}_{k}")
        both = F.when(past.isNotNull(), value)
        sums += [F.sum(value * past).alias(f"{name}_p{k}"), F.sum(both).alias(f"{name}_a{k}"),
                 F.sum(F.when(value.isNotNull(), past)).alias(f"{name}_b{k}")]
    return sums


def _autocovariance(name: str, k: int) -> Column:
    """Sum of (x(t) - mean)(x(t-k) - mean)."""
    mean = F.col(f"{name}_s") / F.col(f"{name}_n")
    pairs = F.col(f"{name}_n") - k
    return F.col(f"{name}_p{k}") - mean * (F.col(f"{name}_a{k}") + F.col(f"{name}_b{k}")) + pairs * mean * mean


def _variance(name: str) -> Column:
    mean = F.col(f"{name}_s") / F.col(f"{name}_n")
    return F.col(f"{name}_ss") / F.col(f"{name}_n") - mean * mean


def _lagged_sums(rows: DataFrame, value: str, lags: int, diffs: int) -> DataFrame:
    """Lag sums of the values (`d0`) and of their first `diffs` differences."""
    block_order = grid.ordered()
    halo = with_halo(rows.select("unique_id", "block", "pos", "n", F.col(value).alias("v")), lags + diffs)
    back = {f"v_{k}": F.lag("v", k).over(block_order) for k in range(1, lags + diffs + 1)}
    halo = halo.withColumns(back)
    at = [F.col("v")] + [F.col(f"v_{k}") for k in range(1, lags + diffs + 1)]
    columns = {}
    for d in range(diffs + 1):
        columns.update({f"d{d}" if k == 0 else f"d{d}_{k}": at[k] for k in range(len(at))})
        at = [a - b for a, b in zip(at, at[1:])]
    kept = halo.where("core").select("unique_id", *[c.alias(name) for name, c in columns.items()])
    return kept.groupBy("unique_id").agg(
        *[s for d in range(diffs + 1) for s in _lag_sums(F.col(f"d{d}"), f"d{d}", lags)])


def acf_features(rows: DataFrame, value: str = "y", prefix: str = "x") -> DataFrame:
    """First autocorrelation and the sum of the first ten squares, of the series and
    of its first difference; each lag is divided by its own number of pairs."""
    sums = _lagged_sums(rows, value, ACF_LAGS, 1)

    def features(name: str) -> tuple[Column, Column]:
        usable = (F.col(f"{name}_n") > ACF_LAGS) & (_variance(name) >= 1e-8)
        acf = [_autocovariance(name, k) / ((F.col(f"{name}_n") - k) * F.nullif(_variance(name), F.lit(0.0)))
               for k in range(1, ACF_LAGS + 1)]
        return F.when(usable, acf[0]), F.when(usable, reduce(lambda a, b: a + b, [a * a for a in acf]))

    x, dx = features("d0"), features("d1")
    return sums.select("unique_id", x[0].alias(f"{prefix}_acf1"), x[1].alias(f"{prefix}_acf10"),
                       dx[0].alias(f"{prefix}_diff1_acf1"), dx[1].alias(f"{prefix}_diff1_acf10"))


def pacf_features(rows: DataFrame, value: str = "y") -> DataFrame:
    """Sum of the first five squared partial autocorrelations of the series and its
    first two differences, by the Durbin-Levinson recursion."""
    sums = _lagged_sums(rows, value, 5, 2)
    out = []
    for name, label in (("d0", "x_pacf5"), ("d1", "diff1x_pacf5"), ("d2", "diff2x_pacf5")):
        total = F.nullif(_variance(name) * F.col(f"{name}_n"), F.lit(0.0))
        sums = sums.withColumns({f"{name}_r{k}": _autocovariance(name, k) / total for k in range(1, 6)})
        r = [F.lit(1.0)] + [F.col(f"{name}_r{k}") for k in range(1, 6)]
        for k in range(1, 6):
            before = [F.col(f"{name}_f{k - 1}_{j}") for j in range(1, k)]
            top = reduce(lambda a, b: a - b, [p * r[k - j] for j, p in enumerate(before, 1)], r[k])
            low = reduce(lambda a, b: a - b, [p * r[j] for j, p in enumerate(before, 1)], r[0])
            sums = sums.withColumn(f"{name}_f{k}_{k}", F.try_divide(top, low))
            sums = sums.withColumns({f"{name}_f{k}_{j}": before[j - 1] - F.col(f"{name}_f{k}_{k}") * before[k - j - 1]
                                     for j in range(1, k)})
        out.append(reduce(lambda a, b: a + b, [F.col(f"{name}_f{k}_{k}") ** 2 for k in range(1, 6)]).alias(label))
    return sums.select("unique_id", *out)


def block_features(rows: DataFrame, value: str, width: Column, prefix: str = "") -> DataFrame:
    """`stability` and `lumpiness`: variances of the means and of the variances of
    consecutive whole blocks of `width` values; 0 for less than two blocks."""
    parts = (
        rows.withColumn("w", width)
        .withColumn("part", F.floor(F.col("pos") / F.col("w")))
        .groupBy("unique_id", "n", "w", "part")
        .agg(F.avg(value).alias("mean"), F.var_samp(value).alias("var"))
        .where((F.col("part") + 1) * F.col("w") <= F.col("n"))
    )
    short = F.max(F.col("n") < 2 * F.col("w"))
    return parts.groupBy("unique_id").agg(
        F.when(short, 0.0).otherwise(F.var_samp("mean")).alias(f"{prefix}stability"),
        F.when(short, 0.0).otherwise(F.var_samp("var")).alias(f"{prefix}lumpiness"))


def block_width(period: Column) -> Column:
    """Block width of a series: its period, or 10 without a season."""
    return F.when(period > 1, period).otherwise(10).cast("bigint")


def crossing_points(rows: DataFrame, value: str = "y") -> DataFrame:
    """How often the series changes between 'at most the median' and above it."""
    median = grid.exact_quantiles(rows, value, [0.5], written=True).withColumnRenamed("q0", "median")
    low = grid.attach(rows, median, written=True).withColumn("low", F.col(value) <= F.col("median"))
    halo = with_halo(low.select("unique_id", "block", "pos", "low"), 1)
    changed = halo.withColumn("was", F.lag("low").over(grid.ordered())).where("core")
    return changed.groupBy("unique_id").agg(F.count(F.when(F.col("low") != F.col("was"), 1)).alias("crossing_points"))


def flat_spots(rows: DataFrame, value: str = "y", bins: int = 10) -> DataFrame:
    """Longest run inside one of ten equal-width bins.

    Only rows where the bin changes matter; each run ends at the next change, which
    a block takes from the blocks after it when it has none left itself.
    """
    reach = rows.groupBy("unique_id").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    share = F.try_divide(F.col(value) - F.col("lo"), F.col("hi") - F.col("lo"))
    bin_of = F.greatest(F.lit(1), F.ceil(F.coalesce(share, F.lit(0.0)) * bins))
    binned = grid.attach(rows, reach).select("unique_id", "block", "pos", "n", bin_of.alias("bin"))
    halo = with_halo(binned, 1)
    was = F.lag("bin").over(grid.ordered())
    starts = halo.withColumn("was", was).where("core AND (was IS NULL OR was <> bin)")
    across = Window.partitionBy("unique_id").orderBy("block")
    firsts = starts.groupBy("unique_id", "block").agg(F.min("pos").alias("first")).select(
        "unique_id", "block", F.lead("first").over(across).alias("after"))
    ends = F.coalesce(F.lead("pos").over(grid.ordered()), F.col("after"), F.col("n"))
    runs = starts.join(firsts, ["unique_id", "block"]).withColumn("run", ends - F.col("pos"))
    return runs.groupBy("unique_id").agg(F.max("run").alias("flat_spots"))


# --- Spectrum ------------------------------------------------------------------

def period_strength(spec: DataFrame, freq: str) -> DataFrame:
    """Share of the total magnitude in the band around each candidate period.

    The candidates are few and fixed, so a band is one conditional sum, not a join.
    Returns `(unique_id, n, bands)` with structs `(period, strength)` in table order.
    """
    bands = fq.period_bands(freq)
    half = spec.where(F.col("k") < F.floor(F.col("n") / 2))
    inside = [F.sum(F.when(F.col("f").between(lo, hi), F.col("magnitude")).otherwise(0.0)).alias(f"s{i}")
              for i, (_, lo, hi) in enumerate(bands)]
    sums = half.groupBy("unique_id", "n").agg(F.sum("magnitude").alias("total"), *inside)
    structs = F.array(*[
        F.struct(F.lit(p).cast("bigint").alias("period"),
                 F.coalesce(F.try_divide(F.col(f"s{i}"), F.col("total")), F.lit(0.0)).alias("strength"))
        for i, (p, _, _) in enumerate(bands)])
    return sums.select("unique_id", "n", F.filter(structs, lambda b: b["period"] < F.col("n")).alias("bands"))


def top_periods(strengths: DataFrame) -> DataFrame:
    """The three strongest candidates; equal strengths keep the order of the table."""
    keyed = F.transform("bands", lambda b, i: F.struct((-b["strength"]).alias("key"), i.alias("i"), b["period"].alias("p"),
                                                       F.round(b["strength"], 3).alias("s")))
    ranked = strengths.select("unique_id", F.array_sort(keyed).alias("top"))
    return ranked.select(
        "unique_id",
        *[F.get("top", F.lit(i))["p"].alias(f"period{i + 1}") for i in range(3)],
        *[F.get("top", F.lit(i))["s"].alias(f"p_strength{i + 1}") for i in range(3)])


def spectral_entropy(spec: DataFrame, name: str = "x_entropy") -> DataFrame:
    """Bits of the normalised one-sided periodogram; inner bins count twice."""
    inner = (F.col("k") >= 1) & (F.col("k") <= F.floor((F.col("n") - 1) / 2))
    power = F.col("magnitude") * F.col("magnitude") * F.when(inner, 2.0).otherwise(1.0)
    weighted = spec.withColumn("p", power).where("p > 0")
    return weighted.groupBy("unique_id").agg(
        (F.log2(F.sum("p")) - F.sum(F.col("p") * F.log2("p")) / F.sum("p")).alias(name))


# --- Decomposition ---------------------------------------------------------------

COMPONENTS = ("unique_id string, block bigint, pos bigint, n bigint, m bigint, y double, trend double, "
              "seasonal double, remainder double")


def decompose(rows: DataFrame, periods: DataFrame, freq: str, method: str = "stl",
              block_steps: int = grid.BLOCK_STEPS) -> DataFrame:
    """Trend, season and remainder of every prepared series.

    `periods` comes from `top_periods`. STL uses the strongest period, MSTL all of
    the three that are above 1 and fit twice. Every smoother in the decomposition
    has a bounded reach, so a long series is cut into blocks that carry a halo of
    that reach: inside a block the result is that of the whole series. A series
    without a season is smoothed in one piece by the super-smoother.
    """
    chosen = F.array_compact(F.array("period1", "period2", "period3") if method == "mstl" else F.array("period1"))
    usable = F.array_sort(F.array_distinct(F.filter(
        chosen, lambda p: (p > 1) & ((2 * p <= F.col("n")) if method == "mstl" else F.lit(True)))))
    passes = 2 if method == "mstl" else 1
    widest = numerics.mstl_spans(3)[-1] if method == "mstl" else numerics.STL_SEASONAL_SPAN
    reach = F.aggregate("usable", F.lit(0).cast("bigint"),
                        lambda acc, p: acc + passes * numerics.stl_reach_column(p, widest))
    keyed = grid.attach(rows, periods).withColumn("usable", usable).withColumn("m", F.coalesce("period1", F.lit(1)))
    keyed = keyed.withColumn("reach", reach)
    size = F.when(F.size("usable") == 0, F.col("n")).otherwise(F.greatest(F.lit(block_steps), 4 * F.col("reach")))
    blocks = grid.reblock(keyed.drop("block").withColumn("size", size.cast("bigint")), "pos", F.col("size"),
                          F.col("reach"), F.col("reach"))
    blocks = blocks.select("unique_id", "block", "core", "pos", "n", "m", "y", "usable")

    def split(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        y = group["y"].to_numpy(dtype=float)
        seasons = [int(p) for p in group["usable"].iloc[0]]
        place = int(group["pos"].iloc[0]), int(group["n"].iloc[0])
        try:
            if not np.isfinite(y).all():
                raise ValueError("missing values")
            if not seasons:
                trend = numerics.super_smoother(y)
                parts = trend, np.zeros(len(y)), y - trend
            elif method == "mstl":
                parts = numerics.mstl(y, seasons, *place)
            else:
                parts = numerics.stl(y, seasons[0], numerics.STL_SEASONAL_SPAN, *place)
        except ValueError:
            parts = tuple(np.full(len(y), None, dtype=object) for _ in range(3))
        group["trend"], group["seasonal"], group["remainder"] = parts
        return group[group["core"]].drop(columns=["core", "usable"])

    return blocks.groupBy("unique_id", "block").applyInPandas(split, COMPONENTS)


# --- Features of the components ---------------------------------------------------

def component_features(parts: DataFrame) -> DataFrame:
    """Strength of trend and season, spike, kurtosis, linearity and curvature.

    All of them follow from sums over the rows. The leave-one-out variances behind
    `spike` are linear in the squared residuals, whose variance the fourth moment
    gives. The orthonormal quadratic is written in t centred at its mean.
    """
    t = F.col("pos") - (F.col("n") - 1) / 2
    rest = F.col("remainder")
    sums = parts.groupBy("unique_id").agg(
        F.max("n").alias("n"), F.max("m").alias("m"),
        F.var_samp("y").alias("vx"), F.var_samp(rest).alias("ve"),
        F.var_samp(F.col("y") - F.col("seasonal")).alias("vd"),
        F.var_samp(rest + F.col("seasonal")).alias("vs"),
        F.var_pop(rest).alias("m2"), F.kurtosis(rest).alias("e_kurtosis"),
        F.sum("trend").alias("t0"), F.sum(F.col("trend") * t).alias("t1"), F.sum(F.col("trend") * t * t).alias("t2"))
    n = F.col("n").cast("double")

    def strength(whole: str) -> Column:
        flat = (F.col("vx") < 1e-10) | ((F.col(whole) / F.when(F.col("vx") > 0, F.col("vx")) < 1e-10)
                                        if whole == "vd" else (F.col(whole) < 1e-10))
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.try_divide("ve", whole)))
        return F.when(flat, 0.0).otherwise(share)

    s2 = n * (n * n - 1) / 12
    s4 = n * (n * n - 1) * (3 * n * n - 7) / 240
    norm = F.sqrt(F.nullif(s4 - s2 * s2 / n, F.lit(0.0)))
    d_var = n * F.col("m2") * F.col("m2") * (F.col("e_kurtosis") + 2) / (n - 1)
    return sums.select(
        "unique_id", "m",
        F.when(F.col("ve").isNotNull(), strength("vd")).alias("trend_strength"),
        F.when((F.col("m") > 1) & F.col("ve").isNotNull(), strength("vs")).alias("seasonal_strength"),
        (d_var / F.nullif((n - 2) * (n - 2), F.lit(0.0))).alias("spike"),
        F.try_divide("t1", F.sqrt(s2)).alias("linearity"),
        ((F.col("t2") - s2 / n * F.col("t0")) / norm).alias("curvature"),
        "e_kurtosis")


def seasonal_corr(parts: DataFrame) -> DataFrame:
    """Mean correlation between all pairs of full seasonal cycles.

    With every cycle centred and scaled to length one, the sum over all pairs is
    half of |sum of cycles|^2 minus their number, so no pairs are formed.
    """
    cycles = parts.where("m > 1").withColumn("cycle", F.floor(F.col("pos") / F.col("m"))).where(
        (F.col("cycle") + 1) * F.col("m") <= F.col("n"))
    shape = cycles.groupBy("unique_id", "cycle").agg(
        F.avg("seasonal").alias("mu"), F.sqrt(F.var_pop("seasonal") * F.max("m")).alias("norm"))
    joined = cycles.join(shape, ["unique_id", "cycle"])
    unit = F.try_divide(F.col("seasonal") - F.col("mu"), F.col("norm"))
    phases = joined.groupBy("unique_id", "m", F.pmod("pos", F.col("m")).alias("phase")).agg(
        F.sum(unit).alias("z"), F.count(F.lit(1)).alias("c"), F.count(unit).alias("good"))
    c = F.max("c")
    return phases.groupBy("unique_id").agg(
        F.when((c > 1) & (F.min("good") == c), F.try_divide(F.sum(F.col("z") * F.col("z")) - c, c * (c - 1)))
        .alias("seasonal_corr"))


def gram_features(parts: DataFrame, block_steps: int = grid.BLOCK_STEPS) -> DataFrame:
    """`e_arch_lm` and `trend_nonlinearity`: regressions solved from cross-products.

    Blocks with a short halo add up their cross-product matrices; the summed
    matrices, one small row per series, are solved at the end.
    """
    moments = parts.groupBy("unique_id").agg(
        F.avg("remainder").alias("r_mean"), F.avg("trend").alias("t_mean"), F.stddev_samp("trend").alias("t_std"))
    rows = grid.attach(parts.select("unique_id", "block", "pos", "n", "trend", "remainder"), moments)
    rows = with_halo(rows, ARCH_LAGS, block_steps)
    n_arch, n_poly = ARCH_LAGS + 2, 5

    def products(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        core = group["core"].to_numpy()
        z = (group["remainder"].to_numpy(dtype=float) - group["r_mean"].to_numpy(dtype=float)) ** 2
        scale = group["t_std"].to_numpy(dtype=float)
        x = group["trend"].to_numpy(dtype=float)
        x = np.where(scale > 0, (x - group["t_mean"].to_numpy(dtype=float)) / np.where(scale > 0, scale, 1), x)
        arch = np.zeros((n_arch, n_arch))
        at = np.flatnonzero(core & (np.arange(len(z)) >= ARCH_LAGS))
        if at.size:
            design = np.stack([np.ones(at.size)] + [z[at - k] for k in range(ARCH_LAGS + 1)])
            arch = design @ design.T
        poly = np.zeros((n_poly, n_poly))
        at = np.flatnonzero(core & (np.arange(len(x)) >= 1))
        if at.size:
            lag = x[at - 1]
            design = np.stack([np.ones(at.size), lag, lag ** 2, lag ** 3, x[at]])
            poly = design @ design.T
        return pd.DataFrame({"unique_id": [group["unique_id"].iloc[0]], "n": [group["n"].iloc[0]],
                             "g": [np.concatenate([arch.ravel(), poly.ravel()])]})

    partial = rows.groupBy("unique_id", "block").applyInPandas(products, "unique_id string, n bigint, g array<double>")
    summed = (
        partial.select("unique_id", "n", F.posexplode("g").alias("i", "v"))
        .groupBy("unique_id", "n", "i").agg(F.sum("v").alias("v"))
        .groupBy("unique_id", "n").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("pairs"))
        .select("unique_id", "n", F.col("pairs.v").alias("g"))
    )

    def residual(gram: np.ndarray, columns: list[int], target: int) -> float:
        a = gram[np.ix_(columns, columns)]
        b = gram[columns, target]
        return float(gram[target, target] - b @ np.linalg.lstsq(a, b, rcond=None)[0])

    def solve(batches):
        for batch in batches:
            out = []
            for n, g in zip(batch["n"], batch["g"]):
                g = np.asarray(g, dtype=float)
                arch = g[:n_arch * n_arch].reshape(n_arch, n_arch)
                poly = g[n_arch * n_arch:].reshape(n_poly, n_poly)
                lm = line = None
                if np.isfinite(arch).all() and n > ARCH_LAGS + 1:
                    spread = residual(arch, [0], 1)
                    if spread > 0:
                        lm = 1 - residual(arch, [0, *range(2, n_arch)], 1) / spread
                if np.isfinite(poly).all() and n > 4:
                    straight, curved = residual(poly, [0, 1], 4), residual(poly, [0, 1, 2, 3], 4)
                    if straight > 0 and curved > 0:
                        line = 10 * float(np.log(straight / curved))
                out.append((lm, line))
            yield pd.DataFrame({"unique_id": batch["unique_id"], "e_arch_lm": [o[0] for o in out],
                                "trend_nonlinearity": [o[1] for o in out]})

    return summed.mapInPandas(solve, "unique_id string, e_arch_lm double, trend_nonlinearity double")


def shapiro_w(rows: DataFrame, value: str = "y", name: str = "shapiro_w", block_steps: int = grid.BLOCK_STEPS,
              longest: int | None = None) -> DataFrame:
    """Shapiro-Wilk W of a column of block rows, `(unique_id, name)`; NULL with missing values or without spread.

    The rank of a value is the number of values in the ranges below its own and its place
    there, so each range adds up its scores by itself and no series meets in one task.
    """
    if longest is None:
        longest = rows.agg(F.max("n")).first()[0] or 0
    v = F.col(value)
    good = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    series = rows.groupBy("unique_id").agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.count(F.when(~good, 1)).alias("bad"))
    runs = grid.value_runs(rows.where(good), value, block_steps, longest).groupBy("unique_id", "bucket", "value").agg(
        F.sum("count").alias("count"))
    runs = grid.materialize(runs)  # two readers
    below = Window.partitionBy("unique_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = runs.groupBy("unique_id", "bucket").agg(F.sum("count").alias("total")).select(
        "unique_id", "bucket", F.coalesce(F.sum("total").over(below), F.lit(0)).alias("below"))
    buckets = buckets.join(series.where("bad = 0").drop("bad"), "unique_id")

    def add(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("value")
        n, first = int(group["n"].iloc[0]), int(group["below"].iloc[0]) + 1
        values, counts = group["value"].to_numpy() - group["mean"].iloc[0], group["count"].to_numpy()
        stops = np.cumsum(counts)
        weighted = squares = 0.0
        for at in range(0, int(stops[-1]), grid.BLOCK_STEPS):  # one value may fill many ranks
            places = np.arange(at, min(at + grid.BLOCK_STEPS, int(stops[-1])))
            scores = numerics.normal_scores(first + places, n)
            weighted += float(scores @ values[np.searchsorted(stops, places, side="right")])
            squares += float(scores @ scores)
        ends = {}
        for end, rank in (("e1", 1), ("e2", 2), ("e3", n - 1), ("e4", n)):
            place = rank - first
            ends[end] = values[np.searchsorted(stops, place, side="right")] if 0 <= place < stops[-1] else np.nan
        return pd.DataFrame([{"unique_id": group["unique_id"].iloc[0], "n": n, "weighted": weighted, "squares": squares,
                              "spread": float(counts @ values ** 2), **ends}])

    schema = "unique_id string, n bigint, weighted double, squares double, spread double, e1 double, e2 double, e3 double, e4 double"
    sums = runs.join(buckets, ["unique_id", "bucket"]).groupBy("unique_id", "bucket").applyInPandas(add, schema)
    ends = [f"e{i}" for i in range(1, 5)]
    sums = sums.groupBy("unique_id", "n").agg(
        *(F.sum(c).alias(c) for c in ("weighted", "squares", "spread")), *(F.max(F.nanvl(F.col(c), F.lit(None))).alias(c) for c in ends))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [numerics.shapiro_from_sums(int(r.n), r.weighted, r.squares, r.spread, (r.e1, r.e2, r.e3, r.e4))
                     for r in batch.itertuples()]
            yield pd.DataFrame({"unique_id": batch["unique_id"], name: np.array(found, float)})

    return sums.mapInPandas(solve, f"unique_id string, {name} double").withColumn(name, F.nanvl(F.col(name), F.lit(None)))


def unit_root(rows: DataFrame, value: str = "y", lags: int | None = None, block_steps: int = grid.BLOCK_STEPS) -> DataFrame:
    """Augmented Dickey-Fuller test of block rows, `(unique_id, lags, statistic, p_value, stationarity)`.

    The regression on constant, time, level and lagged differences needs sums of products only.
    A block with a halo of the most lags adds one number per lag, as a product of two lags is that of
    their distance but for the ends of the series; the lags are chosen by AIC unless given. A
    series that is too short, constant, without a solution or not finite has NULL and counts as
    stationary.
    """
    n = F.col("n").cast("double")
    most = F.least(F.ceil(F.lit(12.0) * F.pow(n / 100, 0.25)), F.floor(n / 2) - 3).cast("bigint")
    if lags is not None:
        most = F.when(most >= lags, F.lit(lags)).otherwise(F.lit(-1)).cast("bigint")
    cut = rows.select("unique_id", "pos", F.col("n").cast("bigint").alias("n"), F.col(value).cast("double").alias("v"), most.alias("most"))
    reach = F.greatest(F.lit(0), F.col("most") + 1)
    cut = grid.reblock(cut, "pos", F.greatest(F.lit(block_steps), reach), reach, F.lit(0))

    def add(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        values, most = group["v"].to_numpy(dtype=float), int(group["most"].iloc[0])
        first, size = int(group["pos"].iloc[0]), int(group["n"].iloc[0])
        core = int(group["pos"].to_numpy()[group["core"].to_numpy()][0]) if group["core"].any() else first + len(values)
        good = bool(np.isfinite(values).all())
        sums = numerics.adf_sums(values, first, core, size, most) if good and most >= 0 else np.zeros(1)
        mine = values[core - first:]
        lo, hi = (mine.min(), mine.max()) if good and len(mine) else (None, None)
        return pd.DataFrame({"unique_id": [group["unique_id"].iloc[0]], "n": [size], "most": [most], "good": [good],
                             "lo": [lo], "hi": [hi], "sums": [sums]})

    partial = cut.groupBy("unique_id", "block").applyInPandas(
        add, "unique_id string, n bigint, most bigint, good boolean, lo double, hi double, sums array<double>")
    series, kept = ["unique_id", "n", "most"], [F.min("good").alias("good"), F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    summed = (
        partial.select(*series, "good", "lo", "hi", F.posexplode("sums").alias("i", "v"))
        .groupBy(*series, "i").agg(F.sum("v").alias("v"), *kept)
        .groupBy(*series).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("pairs"), *kept)
        .select(*series, "good", "lo", "hi", F.col("pairs.v").alias("sums"))
    )

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for row in batch.itertuples():
                try:
                    if row.most < 0 or not row.good or not row.lo < row.hi:
                        raise ValueError("no test")
                    used, tau = numerics.adf_from_sums(np.asarray(row.sums, float), row.n, row.most, lags)
                    p = numerics.adf_probability(tau)
                    found.append((row.unique_id, used, tau, p, int(p <= 0.05)))
                except (ValueError, ZeroDivisionError):
                    found.append((row.unique_id, None, None, None, 1))
            yield pd.DataFrame(found, columns=["unique_id", "lags", "statistic", "p_value", "stationarity"]).astype(
                {"lags": "Int64", "statistic": "Float64", "p_value": "Float64"})

    return summed.mapInPandas(solve, "unique_id string, lags bigint, statistic double, p_value double, stationarity bigint")


def sequential_features(parts: DataFrame, extra: dict[str, Callable[[np.ndarray], float]] | None = None,
                        spec: DataFrame | None = None, block_steps: int = grid.BLOCK_STEPS) -> DataFrame:
    """Entropies, W, unit root, Hurst, and any further Python functions of the prepared values.

    The entropies rest on the spectra of the three columns (that of the values may be given),
    W on ranks, the unit root on sums of blocks; for the others a series goes through one task.
    """
    extra = extra or {}
    names = ["trend_hurst", *extra]

    def compute(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        y = group["y"].to_numpy(dtype=float)
        row = {}
        trend, rest = (group[c].to_numpy(dtype=float) for c in ("trend", "remainder"))
        if np.isfinite(rest).all():
            row["trend_hurst"] = numerics.hurst(trend)
        for name, fn in extra.items():
            row[name] = float(fn(y))
        out = {c: row.get(c) for c in names}
        out = {c: None if v is None or not np.isfinite(v) else v for c, v in out.items()}
        return pd.DataFrame([{"unique_id": group["unique_id"].iloc[0], **out}]).astype({c: "float64" for c in names})

    schema = "unique_id string, " + ", ".join(f"`{c}` double" for c in names)
    result = parts.select("unique_id", "pos", "y", "trend", "remainder").groupBy("unique_id").applyInPandas(compute, schema)
    result = result.join(unit_root(parts, block_steps=block_steps).select("unique_id", "stationarity"), "unique_id", "left")
    longest = parts.agg(F.max("n")).first()[0] or 0
    spec = spectrum(parts, "y", block_steps, longest) if spec is None else spec
    for name, own in (("x_entropy", spec), ("e_entropy", spectrum(parts, "remainder", block_steps, longest)),
                      ("seasonal_entropy", spectrum(parts.where("m > 1"), "seasonal", block_steps, longest))):
        result = result.join(spectral_entropy(own, name), "unique_id", "left")
    result = result.join(shapiro_w(parts, "remainder", "e_shapiro_w", block_steps, longest), "unique_id", "left")
    names = ["x_entropy", "e_entropy", "seasonal_entropy", "e_shapiro_w", *names]
    return result.select("unique_id", "stationarity", *[F.nanvl(F.col(c), F.lit(None)).alias(c) for c in names])


def hurst(rows: DataFrame, value: str = "y") -> DataFrame:
    """Rescaled-range exponent of one column, one series per task."""
    def compute(group: pd.DataFrame) -> pd.DataFrame:
        values = group.sort_values("pos")["v"].to_numpy(dtype=float)
        return pd.DataFrame({"unique_id": [group["unique_id"].iloc[0]], "hurst": [numerics.hurst(values)]})

    return rows.select("unique_id", "pos", F.col(value).alias("v")).groupBy("unique_id").applyInPandas(
        compute, "unique_id string, hurst double")


def features(panel: DataFrame, freq: str, decomposition: str = "stl", test_length: int | None = None,
             extra: dict[str, Callable[[np.ndarray], float]] | None = None,
             block_steps: int = grid.BLOCK_STEPS) -> DataFrame:
    """All features, one row per series; the last `test_length` steps if given."""
    df = grid.dense(panel, freq, block_steps)
    if test_length is not None:
        df = _restart(grid.tail(df.where("core"), test_length), freq, block_steps)
    # The statistics, the spectrum and the decomposition read the panel.
    df = grid.materialize(df)
    rows = prepared(df)
    longest = df.agg(F.max("n")).first()[0] or 0
    # The candidate periods and the entropy read the spectrum.
    spec = grid.materialize(spectrum(rows, "y", block_steps, longest))
    periods = grid.materialize(top_periods(period_strength(spec, freq)))
    # Six feature sets read the components; the decomposition runs once.
    parts = grid.materialize(decompose(rows, periods, freq, decomposition, block_steps))
    width = block_width(F.col("m"))
    table = basic_stats(df)
    for other in (
        periods,
        component_features(parts),
        seasonal_corr(parts),
        acf_features(parts, "remainder", "e"),
        block_features(parts, "trend", width, "trend_").drop("trend_lumpiness"),
        block_features(parts, "seasonal", width, "seasonal_").drop("seasonal_stability"),
        gram_features(parts, block_steps),
        sequential_features(parts, extra, spec, block_steps),
    ):
        table = table.join(other, "unique_id", "left")
    seasonal = F.col("m") > 1
    return table.withColumns({c: F.when(seasonal, F.col(c)) for c in SEASONAL}).drop("m", "e_diff1_acf10")


def _restart(df: DataFrame, freq: str, block_steps: int) -> DataFrame:
    """Dense panel of a part of a dense panel."""
    return grid.dense(df.select("unique_id", "ds", "y"), freq, block_steps)


def assemble(table: DataFrame, info: DataFrame, dataset_id: str) -> DataFrame:
    """Add identifiers, put the columns in order, and list the missing features.

    `null_features` names what is missing outside the optional columns; a series
    without a season is not expected to have seasonal columns.
    """
    joined = table.join(info, "unique_id", "left").withColumn("dataset_id", F.lit(dataset_id))
    ordered = [c for c in FEATURE_ORDER if c in joined.columns]
    ordered += [c for c in joined.columns if c not in ordered]
    has_season = F.coalesce(F.col("period1") > 1, F.lit(False)) if "period1" in ordered else F.lit(True)
    gaps = [F.when(F.col(c).isNull() & (has_season if c in SEASONAL else F.lit(True)), c)
            for c in ordered if c not in OPTIONAL]
    return joined.select(*ordered, F.array_compact(F.array(*gaps)).alias("null_features"))


def complete(assembled: DataFrame) -> DataFrame:
    """The rows without missing features."""
    return assembled.where(F.size("null_features") == 0).drop("null_features")


def null_features(assembled: DataFrame) -> DataFrame:
    """Which features were missing, and for how many series."""
    return assembled.select(F.explode("null_features").alias("feature")).groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_series"))
