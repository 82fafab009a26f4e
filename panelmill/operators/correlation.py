"""Pearson correlation between variates of a series, and between whole series.

Both build partial co-moment tables with matrix products over row batches and
merge those; the rows themselves are never paired up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CORRELATION_LIMIT = 0.95
HELD = 2_000_000  # moments a task holds before it passes them on
SPLIT = 256  # groups in which the partial moments of a pair meet first
PARTIAL = ("n double, mean_a double, mean_b double, m_aa double, m_bb double, m_ab double")


def _moments(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pairwise-complete counts, means and centred co-moments of two column sets.

    Columns are shifted by their own mean first, which keeps the sums accurate.
    """
    have_x, have_y = ~np.isnan(x), ~np.isnan(y)
    shift_x = np.where(have_x, x, 0).sum(0) / np.maximum(have_x.sum(0), 1)
    shift_y = np.where(have_y, y, 0).sum(0) / np.maximum(have_y.sum(0), 1)
    x0, y0 = np.where(have_x, x - shift_x, 0), np.where(have_y, y - shift_y, 0)
    mx, my = have_x.astype(float), have_y.astype(float)
    n = mx.T @ my
    safe = np.maximum(n, 1)
    mean_x, mean_y = (x0.T @ my) / safe, (mx.T @ y0) / safe
    m_xx = (x0 ** 2).T @ my - n * mean_x ** 2
    m_yy = mx.T @ (y0 ** 2) - n * mean_y ** 2
    m_xy = x0.T @ y0 - n * mean_x * mean_y
    return n, mean_x + shift_x[:, None], mean_y + shift_y[None, :], m_xx, m_yy, m_xy


FIELDS = ("n", "mean_a", "mean_b", "m_aa", "m_bb", "m_ab")


def _joined(s: Column, x: Column) -> Column:
    """Two moment structs as one."""
    n = s["n"] + x["n"]
    da, db = x["mean_a"] - s["mean_a"], x["mean_b"] - s["mean_b"]
    share = F.try_divide(x["n"], n)
    weight = s["n"] * share
    values = (n, s["mean_a"] + da * share, s["mean_b"] + db * share, s["m_aa"] + x["m_aa"] + da * da * weight,
              s["m_bb"] + x["m_bb"] + db * db * weight, s["m_ab"] + x["m_ab"] + da * db * weight)
    return F.struct(*[v.alias(f) for v, f in zip(values, FIELDS)])


def _merge(partials: DataFrame, keys: list[str]) -> DataFrame:
    """Combine partial moments exactly and turn them into r; NULL for a constant side.

    A pair has one partial per task or stretch. They meet in `SPLIT` groups, and the
    results of those meet again, so that one pair of a very long table is no single group.
    """
    zero = F.struct(*[F.lit(0.0).alias(f) for f in FIELDS])

    def met(df: DataFrame, by: list[str]) -> DataFrame:
        each = F.array_sort(F.collect_list(F.struct(*FIELDS)))
        return df.groupBy(*by).agg(F.aggregate(each, zero, _joined).alias("s")).select(*by, "s.*")

    dealt = partials.withColumn("part", F.pmod(F.xxhash64(*FIELDS), F.lit(SPLIT)))
    merged = met(met(dealt, [*keys, "part"]), keys)

    def varies(s: str, mean: str):
        return F.col(s) > F.col("n") * F.col(mean) * F.col(mean) * 1e-24

    r = F.when((F.col("n") > 1) & varies("m_aa", "mean_a") & varies("m_bb", "mean_b"),
               F.try_divide("m_ab", F.sqrt("m_aa") * F.sqrt("m_bb")))
    return merged.withColumn("r", r).select(*keys, "r")


def _added(s: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The same for rows of moments of many pairs."""
    n = s[0] + x[0]
    da, db = x[1] - s[1], x[2] - s[2]
    share = x[0] / np.maximum(n, 1)
    weight = s[0] * share
    return np.stack([n, s[1] + da * share, s[2] + db * share, s[3] + x[3] + da * da * weight,
                     s[4] + x[4] + db * db * weight, s[5] + x[5] + da * db * weight])


def variate_correlation(wide: DataFrame, series: str, variates: list[str]) -> DataFrame:
    """`(series, a, b, r)` for all variate pairs a < b over pairwise-complete rows.

    Works on the wide rows where they lie; only the co-moments are shuffled.
    """
    names = sorted(variates)
    at_i, at_j = np.triu_indices(len(names), 1)
    first, second = np.array(names)[at_i], np.array(names)[at_j]

    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}

        def rows():
            for key, (n, mean_a, mean_b, aa, bb, ab) in held.items():
                keep = n > 0
                yield pd.DataFrame({
                    "series": key, "a": first[keep], "b": second[keep], "n": n[keep], "mean_a": mean_a[keep],
                    "mean_b": mean_b[keep], "m_aa": aa[keep], "m_bb": bb[keep], "m_ab": ab[keep]})
            held.clear()

        for batch in batches:
            for key, part in batch.groupby("series", sort=False):
                values = part[names].to_numpy(dtype=float)
                new = np.stack([m[at_i, at_j] for m in _moments(values, values)])
                held[key] = _added(held[key], new) if key in held else new
            if len(held) * len(first) > HELD:
                yield from rows()
        yield from rows()

    rows = wide.select(F.col(series).alias("series"), *[F.col(c).cast("double").alias(c) for c in names])
    return _merge(rows.mapInPandas(partials, f"series string, a string, b string, {PARTIAL}"), ["series", "a", "b"])


def correlated_pairs(pairs: DataFrame, limit: float = CORRELATION_LIMIT) -> DataFrame:
    """Pairs with |r| above the limit, r rounded to 4 decimals."""
    return pairs.where(F.abs("r") > limit).withColumn("r", F.round("r", 4))


def correlation_matrix(pairs: DataFrame, wide: DataFrame, series: str, variates: list[str]) -> DataFrame:
    """The full symmetric matrix as rows; 1 on the diagonal of a varying column."""
    spread = wide.groupBy(F.col(series).alias("series")).agg(*[F.var_samp(c).alias(c) for c in variates])
    diagonal = spread.unpivot("series", variates, "a", "v").select(
        "series", "a", F.col("a").alias("b"), F.when(F.col("v") > 0, F.lit(1.0)).alias("r"))
    swapped = pairs.select("series", F.col("b").alias("a"), F.col("a").alias("b"), "r")
    return pairs.unionByName(swapped).unionByName(diagonal)


def cross_series_correlation(df: DataFrame, tile: int = 400, cells: int = 4_000_000,
                             limit: float | None = None) -> DataFrame:
    """`(a, b, r)` between univariate series of equal length, aligned by position.

    Empty unless all series have the same length. Series are hashed into tiles of
    about `tile`; a task multiplies one pair of tiles over one stretch of
    positions, so its size does not depend on the number or length of the series.
    With `limit`, only the pairs with |r| above it; without, every pair.
    """
    lengths = df.where("core").groupBy("unique_id").agg(F.max("n").alias("n"))
    equal = lengths.agg((F.count_distinct("n") == 1) & (F.count("n") > 1))
    tiles = lengths.agg(F.greatest(F.lit(1).cast("bigint"), F.ceil(F.count(F.lit(1)) / tile)))
    stretch = max(1, cells // (2 * tile))
    rows = (
        df.where("core").select(F.col("unique_id").alias("id"), "pos", "y", tiles.scalar().alias("tiles"))
        .where(equal.scalar())
        .withColumn("home", F.pmod(F.xxhash64("id"), F.col("tiles")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)))
        .select("id", "pos", "y", "home", F.least("home", "other").alias("tile_a"),
                F.greatest("home", "other").alias("tile_b"), F.floor(F.col("pos") / stretch).alias("stretch"))
    )

    def multiply(group: pd.DataFrame) -> pd.DataFrame:
        names = np.array(sorted(group["id"].unique()))
        spot = group["pos"].to_numpy()
        values = np.full((spot.max() - spot.min() + 1, len(names)), np.nan)
        column = np.searchsorted(names, group["id"].to_numpy())
        values[spot - spot.min(), column] = group["y"].to_numpy(dtype=float)
        tile_a, tile_b = group["tile_a"].iloc[0], group["tile_b"].iloc[0]
        where = np.zeros(len(names), dtype=np.int64)
        where[column] = group["home"].to_numpy()
        at_i, at_j = np.triu_indices(len(names), 1)
        if tile_a != tile_b:
            mixed = where[at_i] != where[at_j]
            at_i, at_j = at_i[mixed], at_j[mixed]
        n, mean_a, mean_b, aa, bb, ab = (m[at_i, at_j] for m in _moments(values, values))
        keep = n > 0
        return pd.DataFrame({
            "a": names[at_i][keep], "b": names[at_j][keep], "n": n[keep], "mean_a": mean_a[keep],
            "mean_b": mean_b[keep], "m_aa": aa[keep], "m_bb": bb[keep], "m_ab": ab[keep]})

    partials = rows.groupBy("stretch", "tile_a", "tile_b").applyInPandas(multiply, f"a string, b string, {PARTIAL}")
    found = _merge(partials, ["a", "b"])
    return found if limit is None else found.where(F.abs("r") > limit)
