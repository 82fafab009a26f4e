"""Fourier magnitudes of series of any length; a long series is transformed in pieces of bounded size."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.functions import numerics
from panelmill.operators import grid

SPECTRUM = "unique_id string, n bigint, k bigint, f double, magnitude double"
HALF = "unique_id string, n bigint, a bigint, b bigint, t1 bigint, k2 bigint, re double, im double, fre double, fim double"


def split_length(n: int, limit: int) -> tuple[int, int, bool]:
    """`(a, b, chirp)`: n = a * b with b up to `limit`, or else a power of two a * b >= 2 n - 1 for a chirp transform."""
    a = math.isqrt(n)
    while n % a:
        a -= 1
    if n // a <= limit:
        return a, n // a, False
    bits = (2 * n - 2).bit_length()
    return 1 << bits // 2, 1 << bits - bits // 2, True


def _turn(steps: np.ndarray, n: int) -> np.ndarray:
    """exp(-2 pi i steps / n) of whole steps."""
    return np.exp(-2j * np.pi / n * (steps % n))


def _chirp(t: np.ndarray, n: int) -> np.ndarray:
    """exp(-pi i t^2 / n)."""
    return _turn(t * t, 2 * n)


def _rows(frame: dict, values: np.ndarray, name: str = "") -> dict:
    return frame | {f"{name}re": values.real.ravel(), f"{name}im": values.imag.ravel()}


def _columns(rows: DataFrame, limit: int, chirp: bool) -> DataFrame:
    """First pass: the transforms along t2 of the columns t = a t2 + t1, turned by t1 k2 / (a b)."""
    def first(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        n, a, b = (int(group[c].iloc[0]) for c in ("n", "a", "b"))
        width = max(1, limit // b)
        t1 = np.arange(key[1] * width, min(a, (key[1] + 1) * width))
        pos = group["pos"].to_numpy()
        x = np.zeros((len(t1), b), complex)
        x[pos % a - t1[0], pos // a] = group["v"].to_numpy(dtype=float)
        k2 = np.arange(b)
        turn = _turn(t1[:, None] * k2, a * b)
        if chirp:  # the series times its chirp, and the chirp to fold it with, whose end lies before 0
            t = t1[:, None] + a * k2
            x *= _chirp(np.minimum(t, n), n)
            back = np.minimum(t, a * b - t)
            fold = np.where(back < n, _chirp(np.minimum(back, n), n).conj(), 0)
        else:  # a real series: the other half mirrors this one
            k2, turn = k2[:b // 2 + 1], turn[:, :b // 2 + 1]
        frame = {"unique_id": key[0], "n": n, "a": a, "b": b, "t1": np.repeat(t1, len(k2)), "k2": np.tile(k2, len(t1))}
        out = _rows(frame, np.fft.fft(x, axis=1)[:, :len(k2)] * turn)
        out = _rows(out, np.fft.fft(fold, axis=1) * turn, "f") if chirp else out | {"fre": np.nan, "fim": np.nan}
        return pd.DataFrame(out)

    return rows.withColumn("piece", F.expr(f"(pos % a) div greatest(1, {limit} div b)")).groupBy(
        "unique_id", "piece").applyInPandas(first, HALF)


def _matrix(group: pd.DataFrame, row: str, column: str, start: int, count: int, width: int, name: str = "") -> np.ndarray:
    out = np.zeros((count, width), complex)
    out[group[row].to_numpy() - start, group[column].to_numpy()] = group[f"{name}re"].to_numpy() + 1j * group[f"{name}im"].to_numpy()
    return out


def _spectrum_rows(uid: str, n: int, k: np.ndarray, values: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"unique_id": uid, "n": n, "k": k, "f": k / n, "magnitude": np.where(k == 0, 0.0, np.abs(values))})


def _by_k2(half: DataFrame, limit: int):
    return half.withColumn("piece", F.expr(f"k2 div greatest(1, {limit} div a)")).groupBy("unique_id", "piece")


def _direct(half: DataFrame, limit: int) -> DataFrame:
    """Second pass: along t1, which gives k = b k1 + k2."""
    def second(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        n, a, b = (int(group[c].iloc[0]) for c in ("n", "a", "b"))
        start = int(group["k2"].min())
        k2 = np.arange(start, int(group["k2"].max()) + 1)
        values = np.fft.fft(_matrix(group, "k2", "t1", start, len(k2), a), axis=1)
        k = k2[:, None] + b * np.arange(a)
        mirrored = np.minimum(k, n - k)
        mine = (k <= n // 2) | ((k2[:, None] > 0) & (2 * k2[:, None] < b))  # k and n - k have the same k2 otherwise
        return _spectrum_rows(key[0], n, mirrored[mine], values[mine])

    return _by_k2(half, limit).applyInPandas(second, SPECTRUM)


def _folded(half: DataFrame, limit: int) -> DataFrame:
    """Chirp transform: both along t1, multiplied, and back along k1, then along k2."""
    def second(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        n, a, b = (int(group[c].iloc[0]) for c in ("n", "a", "b"))
        start = int(group["k2"].min())
        k2 = np.arange(start, int(group["k2"].max()) + 1)
        x, fold = (np.fft.fft(_matrix(group, "k2", "t1", start, len(k2), a, name), axis=1) for name in ("", "f"))
        t1 = np.arange(a)
        z = np.fft.ifft(x * fold, axis=1) * _turn(k2[:, None] * t1, a * b).conj()
        frame = {"unique_id": key[0], "n": n, "a": a, "b": b, "t1": np.tile(t1, len(k2)), "k2": np.repeat(k2, a)}
        return pd.DataFrame(_rows(frame, z) | {"fre": np.nan, "fim": np.nan})

    def third(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        n, a, b = (int(group[c].iloc[0]) for c in ("n", "a", "b"))
        start = int(group["t1"].min())
        t1 = np.arange(start, int(group["t1"].max()) + 1)
        z = np.fft.ifft(_matrix(group, "t1", "k2", start, len(t1), b), axis=1)
        k = t1[:, None] + a * np.arange(b)
        return _spectrum_rows(key[0], n, k[k <= n // 2], z[k <= n // 2])

    back = _by_k2(half, limit).applyInPandas(second, HALF)
    return back.withColumn("piece", F.expr(f"t1 div greatest(1, {limit} div b)")).groupBy("unique_id", "piece").applyInPandas(
        third, SPECTRUM)


def spectrum(rows: DataFrame, value: str = "y", block_steps: int = grid.BLOCK_STEPS, longest: int | None = None) -> DataFrame:
    """`(unique_id, n, k, f, magnitude)` for the frequencies k / n up to one half. The mean is left out.

    A series of up to `block_steps` steps goes through one task. A longer one of a * b steps is
    transformed in two passes: columns, a turn, rows, with one shuffle between them. A length
    without such factors, a prime for example, is a fold with a chirp: the same passes over a
    power of two, forth and back. A group holds `block_steps` numbers, or one row or column,
    whose length is about the square root of that of the series. A series with a missing or
    non-finite value has NaN magnitudes. `longest`, the steps of the longest series, is counted if not given.
    """
    rows = rows.select("unique_id", "pos", "n", F.col(value).alias("v"))

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        y = group.sort_values("pos")["v"].to_numpy(dtype=float)
        n = len(y)
        size = numerics.magnitudes(y) if np.isfinite(y).all() else np.full(n // 2 + 1, np.nan)
        return pd.DataFrame({"unique_id": group["unique_id"].iloc[0], "n": n, "k": np.arange(len(size)),
                             "f": np.arange(len(size)) / n, "magnitude": size})

    if longest is None:
        longest = rows.agg(F.max("n")).first()[0] or 0
    if longest <= block_steps:
        return rows.groupBy("unique_id").applyInPandas(whole, SPECTRUM)

    rows = grid.materialize(rows)  # three readers
    short = rows.where(F.col("n") <= block_steps).groupBy("unique_id").applyInPandas(whole, SPECTRUM)
    long = rows.where(F.col("n") > block_steps).withColumn("block", F.expr(f"pos div {block_steps}"))

    @F.pandas_udf("a bigint, b bigint, chirp boolean")
    def factors(n: pd.Series) -> pd.DataFrame:
        known = {x: split_length(int(x), block_steps) for x in n.unique()}
        return pd.DataFrame([known[x] for x in n], columns=["a", "b", "chirp"])

    series = long.groupBy("unique_id").agg(F.max("n").alias("length"), F.avg("v").alias("mean"),
                                           F.count(F.when(F.isnan("v") | F.col("v").isNull() | (F.abs("v") == float("inf")), 1)).alias("bad"))
    series = series.withColumn("s", factors("length")).select("unique_id", "mean", "bad", "s.a", "s.b", "s.chirp")
    long = grid.attach(long, series).withColumn(
        "v", F.when(F.col("bad") > 0, F.lit(float("nan"))).otherwise(F.col("v") - F.col("mean"))).drop("block", "mean", "bad")
    direct, chirp = long.where("not chirp"), long.where("chirp")
    return short.unionByName(_direct(_columns(direct, block_steps, False), block_steps)).unionByName(
        _folded(_columns(chirp, block_steps, True), block_steps))
