import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelmill.functions import numerics
from panelmill.operators import features as ft
from panelmill.operators import grid


def season(n, period, rng, noise=0.2):
    t = np.arange(n)
    return 3 * np.sin(2 * np.pi * t / period) + 0.01 * t + noise * rng.normal(size=n)


def test_loess_against_direct_fit(rng):
    def direct(y, span, x):
        n, q = len(y), min(span, len(y))
        left = 0 if q == n else int(np.clip(x - ((q + 1) // 2 - 1), 0, n - q))
        at = np.arange(left, left + q)
        reach = max(x - left, left + q - 1 - x) + max(0, (span - n) // 2)
        r = np.abs(at - x) / reach
        w = np.where(r <= 0.999, np.where(r <= 0.001, 1, (1 - r ** 3) ** 3), 0)
        w = w / w.sum()
        slope = np.polyfit(at, y[at], 1, w=np.sqrt(w))
        return np.polyval(slope, x)

    for n, span in ((9, 13), (13, 13), (50, 13), (50, 31), (700, 301)):
        y = rng.normal(size=n)
        got = numerics.loess(y[None, :], span, extend=1)[0]
        np.testing.assert_allclose(got, [direct(y, span, x) for x in range(-1, n + 1)], atol=1e-8)


def test_decompositions_add_up(rng):
    y = season(500, 24, rng)
    for parts in (numerics.stl(y, 24), numerics.mstl(y, [12, 24])):
        np.testing.assert_allclose(sum(parts), y)
        assert parts[2].std() < 0.3
    trend = np.linspace(0, 1, 300) ** 2
    assert np.abs(numerics.super_smoother(trend + 0.05 * rng.normal(size=300)) - trend).max() < 0.1


def test_tests(rng):
    x = np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0])
    assert numerics.shapiro_w(x) == pytest.approx(0.78881, abs=5e-5)
    assert numerics.shapiro_w(3 * x - 7) == pytest.approx(numerics.shapiro_w(x))
    assert numerics.stationarity(rng.normal(size=500)) == 1
    assert numerics.stationarity(np.cumsum(rng.normal(size=3000))) == 0
    assert numerics.stationarity(np.ones(50)) == 1
    y = rng.normal(size=200).cumsum()
    t, total = np.arange(1, 201), y.cumsum()
    reach = np.array([np.ptp((total - t * total[i] / (i + 1))[:i + 1]) for i in range(200)])
    spread = np.array([y[:i + 1].std() for i in range(200)])
    assert numerics.hurst(y) == pytest.approx(np.polyfit(np.log(t[1:]), np.log(reach[1:] / spread[1:]), 1)[0])


def dickey_fuller(y, lags=None):
    """Lags and t statistic by regressions on the whole design matrix."""
    n, d = len(y), np.diff(y)

    def fit(k, of):
        rows = np.arange(of, n - 1)
        x = np.stack([np.ones(len(rows)), np.arange(1, len(rows) + 1) / len(rows), *[d[rows - j] for j in range(1, of + 1)][:k], y[rows]], 1)
        beta, *_ = np.linalg.lstsq(x, d[rows], rcond=None)
        return x, beta, float(((d[rows] - x @ beta) ** 2).sum())

    if lags is None:
        most = numerics.adf_lags(n)
        m = n - 1 - most
        lags = int(np.argmin([m * (np.log(2 * np.pi) + np.log(fit(k, most)[2] / m) + 1) + 2 * (k + 3) for k in range(most + 1)]))
    x, beta, rest = fit(lags, lags)
    return lags, beta[-1] / np.sqrt(rest / (len(x) - x.shape[1]) * np.linalg.inv(x.T @ x)[-1, -1])


def test_unit_root_in_blocks(make, rng):
    """Statistic and lags of blocks against regressions on whole series; series without a test."""
    walk = rng.normal(size=900).cumsum()
    wave = season(500, 12, rng) + 0.3 * rng.normal(size=500).cumsum()
    short = rng.normal(size=9)
    series = {"walk": walk, "wave": wave, "noise": rng.normal(size=130), "short": short, "tiny": [1.0, 3, 2, 5], "flat": np.ones(60)}
    rows = grid.dense(make(series), "H", 64).persist()
    for lags in (None, 0, 3):
        got = {r.unique_id: r for r in ft.unit_root(rows, lags=lags, block_steps=64).collect()}
        assert set(got) == set(series)
        for name in ("walk", "wave", "noise"):
            used, tau = dickey_fuller(np.asarray(series[name]), lags)
            assert (got[name].lags, got[name].statistic) == (used, pytest.approx(tau, rel=1e-7))
            assert got[name].p_value == pytest.approx(numerics.adf_probability(tau))
            assert got[name].stationarity == (numerics.adf_probability(tau) <= 0.05)
        for name in ("tiny", "flat"):
            assert (got[name].lags, got[name].statistic, got[name].p_value, got[name].stationarity) == (None, None, None, 1)
    whole = {r.unique_id: r.statistic for r in ft.unit_root(rows).collect()}
    for r in ft.unit_root(rows, block_steps=64).collect():
        assert r.statistic == (whole[r.unique_id] and pytest.approx(whole[r.unique_id], rel=1e-9))
    assert ft.unit_root(rows.where("false")).count() == 0
    gaps = rows.withColumn("y", F.when(F.col("pos") != 70, F.col("y")))
    assert {r.unique_id: r.stationarity for r in ft.unit_root(gaps, block_steps=64).collect()}["walk"] == 1


@pytest.fixture(scope="module")
def prepared(make):
    rng = np.random.default_rng(21)
    series = {"a": season(12_000, 24, rng), "b": season(260, 12, rng, 0.5), "c": rng.normal(size=300).cumsum()}
    return series, ft.prepared(grid.dense(make(series), "H", 128)).persist()


def scaled(y):
    return (y - y.mean()) / y.std(ddof=1)


def test_prepared_and_periods(prepared):
    series, rows = prepared
    got = rows.toPandas().sort_values(["unique_id", "pos"])
    for uid, y in series.items():
        np.testing.assert_allclose(got[got.unique_id == uid].y, scaled(y), atol=1e-9)
    top = {r.unique_id: r for r in ft.top_periods(ft.period_strength(ft.spectrum(rows), "H")).collect()}
    assert top["a"].period1 == 24 and top["b"].period1 == 12 and top["b"].p_strength1 == round(top["b"].p_strength1, 3)


@pytest.mark.parametrize("method", ["stl", "mstl"])
def test_blocked_decomposition_is_the_whole_one(prepared, spark, method):
    series, rows = prepared
    periods = spark.createDataFrame([("a", 24, 12 if method == "mstl" else None, None), ("b", 12, None, None), ("c", None, None, None)],
                                    "unique_id string, period1 bigint, period2 bigint, period3 bigint")
    got = ft.decompose(rows, periods, "H", method, block_steps=700).toPandas().sort_values(["unique_id", "pos"])
    if method == "stl":
        assert got[got.unique_id == "a"].block.nunique() > 1
    want = numerics.stl(scaled(series["a"]), 24) if method == "stl" else numerics.mstl(scaled(series["a"]), [12, 24])
    part = got[got.unique_id == "a"]
    for name, values in zip(("trend", "seasonal", "remainder"), want):
        np.testing.assert_allclose(part[name], values, atol=1e-9)
    c = got[got.unique_id == "c"]
    np.testing.assert_allclose(c.trend, numerics.super_smoother(scaled(series["c"])), atol=1e-9)
    assert (c.seasonal == 0).all() and (c.m == 1).all()


def test_any_period_has_its_halo(prepared, spark):
    """17 hours is no candidate period; blocks still give the result of the whole series."""
    series, rows = prepared
    periods = spark.createDataFrame([("a", 17), ("b", None), ("c", None)], "unique_id string, period1 bigint").withColumns(
        {"period2": F.lit(None).cast("bigint"), "period3": F.lit(None).cast("bigint")})
    part = ft.decompose(rows.where("unique_id = 'a'"), periods, "H", block_steps=400).toPandas().sort_values("pos")
    assert part.block.nunique() > 1
    for name, values in zip(("trend", "seasonal", "remainder"), numerics.stl(scaled(series["a"]), 17)):
        np.testing.assert_allclose(part[name], values, atol=1e-9)
    reach = spark.range(2, 600).select(numerics.stl_reach_column(F.col("id"), 11).alias("r")).collect()
    assert [r.r for r in reach] == [numerics.stl_reach(p, 11) for p in range(2, 600)]


@pytest.fixture(scope="module")
def parts(prepared, spark):
    _, rows = prepared
    periods = spark.createDataFrame([("a", 24), ("b", 12), ("c", None)], "unique_id string, period1 bigint")
    df = ft.decompose(rows, periods, "H").persist()
    return df, {u: g.sort_values("pos") for u, g in df.toPandas().groupby("unique_id")}


def as_dict(df):
    return {r.unique_id: r for r in df.collect()}


def test_component_features(parts):
    df, groups = parts
    got = as_dict(ft.component_features(df))
    for uid, g in groups.items():
        y, s, r, t = (g[c].to_numpy(dtype=float) for c in ("y", "seasonal", "remainder", "trend"))
        n = len(y)
        assert got[uid].trend_strength == pytest.approx(np.clip(1 - r.var(ddof=1) / (y - s).var(ddof=1), 0, 1))
        if uid != "c":
            assert got[uid].seasonal_strength == pytest.approx(np.clip(1 - r.var(ddof=1) / (r + s).var(ddof=1), 0, 1))
        loo = (r.var(ddof=1) * (n - 1) - (r - r.mean()) ** 2) / (n - 2)
        assert got[uid].spike == pytest.approx(loo.var(ddof=1))
        q, _ = np.linalg.qr(np.vander(np.arange(n) - (n - 1) / 2, 3, increasing=True))
        coef = q.T @ t * np.sign(q[-1])
        assert got[uid].linearity == pytest.approx(coef[1], rel=1e-6) and got[uid].curvature == pytest.approx(coef[2], rel=1e-5)
        assert got[uid].e_kurtosis == pytest.approx(pd.Series(r).pipe(lambda v: ((v - v.mean()) ** 4).mean() / v.var(ddof=0) ** 2 - 3))


def test_lag_features(parts):
    df, groups = parts
    got = as_dict(ft.acf_features(df, "remainder", "e"))
    for uid, g in groups.items():
        r = g["remainder"].to_numpy(dtype=float)
        for x, names in ((r, ("e_acf1", "e_acf10")), (np.diff(r), ("e_diff1_acf1", "e_diff1_acf10"))):
            d = x - x.mean()
            acf = np.array([(d[k:] * d[:-k]).sum() / ((len(x) - k) * x.var()) for k in range(1, 11)])
            assert got[uid][names[0]] == pytest.approx(acf[0]) and got[uid][names[1]] == pytest.approx((acf ** 2).sum())


def test_gram_features(parts):
    df, groups = parts
    got = as_dict(ft.gram_features(df, block_steps=200))
    for uid, g in groups.items():
        r, t = g["remainder"].to_numpy(dtype=float), scaled(g["trend"].to_numpy(dtype=float))
        z = (r - r.mean()) ** 2
        x = np.column_stack([np.ones(len(z) - 12)] + [z[12 - k:len(z) - k] for k in range(1, 13)])
        e = z[12:] - x @ np.linalg.lstsq(x, z[12:], rcond=None)[0]
        assert got[uid].e_arch_lm == pytest.approx(1 - (e @ e) / ((z[12:] - z[12:].mean()) ** 2).sum(), rel=1e-5, abs=1e-8)
        lag, now = t[:-1], t[1:]
        line = np.column_stack([np.ones(len(lag)), lag])
        u = now - line @ np.linalg.lstsq(line, now, rcond=None)[0]
        cube = np.column_stack([line, lag ** 2, lag ** 3])
        v = u - cube @ np.linalg.lstsq(cube, u, rcond=None)[0]
        assert got[uid].trend_nonlinearity == pytest.approx(10 * np.log((u @ u) / (v @ v)), rel=1e-3, abs=1e-6)


def test_block_and_cycle_features(parts):
    df, groups = parts
    blocks = as_dict(ft.block_features(df, "trend", ft.block_width(F.col("m"))))
    corr = as_dict(ft.seasonal_corr(df))
    for uid, g in groups.items():
        m = int(g["m"].iloc[0])
        w, t = (m if m > 1 else 10), g["trend"].to_numpy(dtype=float)
        cut = t[:len(t) // w * w].reshape(-1, w)
        assert blocks[uid].stability == pytest.approx(cut.mean(1).var(ddof=1))
        assert blocks[uid].lumpiness == pytest.approx(cut.var(1, ddof=1).var(ddof=1), rel=1e-6, abs=1e-15)
        if m > 1:
            s = g["seasonal"].to_numpy(dtype=float)
            r = np.corrcoef(s[:len(s) // m * m].reshape(-1, m))
            assert corr[uid].seasonal_corr == pytest.approx(r[np.triu_indices(len(r), 1)].mean())
    assert "c" not in corr


def test_runs_and_crossings(make, rng):
    y = np.round(rng.normal(size=400).cumsum(), 1)
    y[100:180] = 2.0
    rows = grid.dense(make({"a": y, "flat": np.ones(40)}), "H", 37).where("core")
    runs = as_dict(ft.flat_spots(rows))
    bins = pd.cut(pd.Series(y), bins=10, include_lowest=True, labels=False).to_numpy()
    change = np.flatnonzero(np.diff(bins)) + 1
    assert runs["a"].flat_spots == np.diff(np.concatenate([[0], change, [400]])).max() and runs["flat"].flat_spots == 40
    low = y <= np.median(y)
    assert as_dict(ft.crossing_points(rows))["a"].crossing_points == (low[1:] != low[:-1]).sum()


def test_all_features(make, spark):
    rng = np.random.default_rng(2)
    gaps = season(480, 24, rng)
    gaps[50:60] = np.nan
    panel = make({"x_v": gaps, "x_w": season(480, 12, rng), "x_n": np.full(480, np.nan)})
    info = spark.createDataFrame([(f"x_{v}", "x", v) for v in "vwn"], "unique_id string, series_name string, variate_name string")
    assembled = ft.assemble(ft.features(panel, "H", extra={"top": np.max}), info, "x/H").persist()
    done = as_dict(ft.complete(assembled))
    assert set(done) == {"x_v", "x_w"}
    assert assembled.columns[:len(ft.FEATURE_ORDER)] == ft.FEATURE_ORDER
    assert done["x_v"].period1 == 24 and done["x_v"].length == 480 and done["x_v"].missing_rate == pytest.approx(10 / 480)
    assert done["x_v"].seasonal_strength > 0.9 and done["x_v"].top == pytest.approx(np.nanmax(scaled_with_gaps(gaps)))
    missing = {r.feature for r in ft.null_features(assembled).collect()}
    assert "e_acf1" in missing and "period2" not in missing
    part = as_dict(ft.features(panel, "H", "mstl", test_length=120))
    assert part["x_w"].length == 120 and part["x_w"].seasonal_corr is not None


def scaled_with_gaps(y):
    return (y - np.nanmean(y)) / np.nanstd(y, ddof=1)


def direct_w(values):
    """Royston's W with every weight written out."""
    from statistics import NormalDist

    n, x = len(values), np.sort(values)
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    c, u = m / np.sqrt(m @ m), 1 / np.sqrt(n)
    a1 = np.polyval((*numerics.SHAPIRO_LAST, c[-1]), u)
    a2 = np.polyval((*numerics.SHAPIRO_NEXT, c[-2]), u)
    if n > 5:
        a = m / np.sqrt((m @ m - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * a1 ** 2 - 2 * a2 ** 2))
        a[[0, 1, -2, -1]] = -a1, -a2, a2, a1
    else:
        a = m / np.sqrt((m @ m - 2 * m[-1] ** 2) / (1 - 2 * a1 ** 2))
        a[[0, -1]] = -a1, a1
    return (a @ x) ** 2 / ((x - x.mean()) ** 2).sum()


@pytest.mark.parametrize("steps", [8, 65_536])
def test_w_from_ranges_of_values(make, rng, steps):
    """Ties that fill several ranges, a skewed series, short ones, one without spread and one with a gap."""
    data = {"noise": rng.normal(size=300), "skew": rng.exponential(size=201) ** 3, "ties": rng.integers(0, 3, 157).astype(float),
            "four": np.array([1.0, 5.0, 2.0, 2.5]), "five": np.array([3.0, 1.0, 4.0, 1.5, 9.0]), "six": rng.normal(size=6)}
    rest = {"flat": np.ones(40), "two": np.array([1.0, 2.0]), "gap": np.array([1.0, np.nan, 2.0, 5.0])}
    df = grid.dense(make(data | rest), "H", block_steps=steps).where("core")
    got = {r.unique_id: r.shapiro_w for r in ft.shapiro_w(df, block_steps=steps).collect()}
    for uid, values in data.items():
        assert got[uid] == pytest.approx(direct_w(values), abs=1e-9)
    assert all(got.get(uid) is None for uid in rest)
