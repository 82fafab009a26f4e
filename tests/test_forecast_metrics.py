from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelmill.operators import forecast, grid, metrics, windows

LEVELS = metrics.LEVELS


def brute_seasonal_naive(y, m, origin, horizon):
    history = pd.Series(y[:origin])
    first = history.dropna()
    history = history.ffill().fillna(first.iloc[0] if len(first) else 0.0).to_numpy()
    res = history[m:] - history[:-m] if len(history) > m else np.array([])
    sigma = np.sqrt((res ** 2).sum() / (origin - m)) if origin > m else np.nan
    steps = np.arange(1, horizon + 1)
    at = origin - m + (steps - 1) % m
    point = np.where(at >= 0, history[np.maximum(at, 0)], np.nan)
    spread = sigma * np.sqrt((steps - 1) // m + 1)
    z = np.array([NormalDist().inv_cdf(q) for q in LEVELS])
    out = point[:, None] + spread[:, None] * z[None, :]
    out[:, 4] = point
    return out


def brute_metrics(quantiles, truth, context, m):
    out = dict.fromkeys(metrics.METRICS, np.nan)
    ok = ~np.isnan(truth)
    if not ok.any():
        return out
    q, y = quantiles[ok], truth[ok]
    med = q[:, 4]
    e = np.abs(y - med)
    out["MSE"], out["MAE"] = (e ** 2).mean(), e.mean()
    out["RMSE"] = np.sqrt(out["MSE"])
    with np.errstate(all="ignore"):
        ratio = e / np.abs(y)
        out["MAPE"] = np.nanmean(np.where(np.isfinite(ratio), ratio, np.nan)) if np.isfinite(ratio).any() else np.nan
        ratio = 2 * e / (np.abs(y) + np.abs(med))
        out["sMAPE"] = np.nanmean(np.where(np.isfinite(ratio), ratio, np.nan)) if np.isfinite(ratio).any() else np.nan
    c = context[~np.isnan(context)]
    if len(c) > m:
        scale = np.abs(c[m:] - c[:-m]).mean()
        out["MASE"] = out["MAE"] / scale if scale > 0 else np.nan
    total = np.abs(y).sum()
    if total > 0:
        out["ND"] = e.sum() / total
        out["CRPS"] = np.mean([2 * np.abs((y - q[:, i]) * ((q[:, i] >= y) - lv)).sum() / total for i, lv in enumerate(LEVELS)])
    return out


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(5)
    base = 10 + 3 * np.sin(np.arange(100) * 2 * np.pi / 8) + rng.normal(size=100)
    out = {"full": base.copy(), "gaps": base.copy(), "zeros": np.zeros(100), "late": base.copy(), "nolabel": base.copy(),
           "empty": np.full(100, np.nan), "short": base[:30].copy()}
    out["gaps"][rng.random(100) < 0.3] = np.nan
    out["late"][:78] = np.nan
    out["nolabel"][84:90] = np.nan
    return out


@pytest.mark.parametrize("season, block", [(8, 1000), (8, 20), (1, 16), (26, 64)])
def test_forecasts_and_metrics_match_brute_force(make, series, season, block):
    horizon, test_length = 6, 20
    df = grid.dense(make(series), "H", block, back=season)
    fc = forecast.seasonal_naive(df, season, horizon, test_length)
    labels = windows.test_windows(df.where("core"), horizon, test_length)
    errors = metrics.seasonal_error(df, season, horizon, test_length, block)
    got_fc = fc.toPandas().sort_values(["unique_id", "window_idx", "step"]).set_index(["unique_id", "window_idx"])
    got = metrics.evaluate(fc, labels, errors).toPandas().set_index(["unique_id", "window_idx"])
    for uid, y in series.items():
        start = len(y) - test_length
        for w in range(3):
            origin = start + w * horizon
            want_fc = brute_seasonal_naive(y, season, origin, horizon)
            known = ~np.isnan(want_fc[:, 4])
            rows = got_fc.loc[[(uid, w)]] if (uid, w) in got_fc.index else None
            if not known.any():
                assert rows is None
                continue
            have = np.array([[np.nan if v is None else v for v in q] for q in rows["quantiles"]], dtype=float)
            np.testing.assert_allclose(have, want_fc[known], atol=1e-9)
            if known.all() and origin > season:
                want = brute_metrics(want_fc, y[origin:origin + horizon], y[:origin], season)
                for name, value in want.items():
                    np.testing.assert_allclose(float(got.loc[(uid, w), name]), value, atol=1e-9, err_msg=f"{uid} {w} {name}")


def test_seasonal_error_limits(make):
    df = grid.dense(make({"a": [1.0, 2.0, 4.0, 7.0, 9.0, 9.0]}), "H")
    # context of two points: not longer than the season; of four points: one season fits.
    rows = {r.window_idx: r.seasonal_error for r in metrics.seasonal_error(df, 2, 2, 4).collect()}
    assert rows[0] is None and rows[1] == pytest.approx((3.0 + 5.0) / 2)


def test_windows_and_splits(make):
    df = grid.dense(make({"a": list(map(float, range(30)))}), "H")
    got = windows.test_windows(df, 4, 10).toPandas().sort_values("pos")
    assert list(got.pos) == list(range(20, 28)) and list(got.step) == [1, 2, 3, 4] * 2
    val = windows.val_windows(df, 4, 10, 5).toPandas()
    assert sorted(val.pos) == [15, 16, 17, 18]
    assert windows.train_split(df, 4, 10).count() == 30 - 4 * 3
    assert windows.validation_split(df, 4, 10).count() == 30 - 4 * 2
    assert windows.num_windows(3, 4) == 1
    with pytest.raises(ValueError):
        windows.test_windows(None, 60, 48)


def test_contexts(make, spark):
    df = grid.dense(make({"a": list(map(float, range(12)))}), "H", 5)
    rows = {r.window_idx: r.context for r in windows.context_arrays(df, 2, 4, 3).collect()}
    assert rows == {0: [5.0, 6.0, 7.0], 1: [7.0, 8.0, 9.0]}
    row = spark.createDataFrame([([1.0, 2.0, 3.0],)], "c array<double>").select(
        windows.left_pad_context(F.col("c"), 5, 0.0).alias("p"), windows.truncate_context(F.col("c"), 2).alias("t")).first()
    assert row.p == [0.0, 0.0, 1.0, 2.0, 3.0] and row.t == [2.0, 3.0]


def test_validate_lengths(spark):
    tasks = spark.createDataFrame([("a", 10, 5, 3), ("b", 60, 5, 3), ("c", 101, 5, 3), ("d", 10, 5, 11), ("e", 10, 101, 3)],
                                  "dataset_id string, test_length bigint, val_length bigint, prediction_length bigint")
    lengths = spark.createDataFrame([(d, n) for d in "abcde" for n in (100, 120)], "dataset_id string, n bigint")
    got = {r.dataset_id: r.status for r in windows.validate_lengths(tasks, lengths).collect()}
    assert got == {"a": "ok", "b": "warning", "c": "error", "d": "error", "e": "error"}


def test_quantile_to_interval():
    assert [forecast.quantile_to_interval(q) for q in (0.1, 0.5, 0.6, 0.9)] == [("lo", 80), ("point", 0), ("hi", 20), ("hi", 80)]


def test_samples(make, series):
    df = grid.dense(make({"full": series["full"]}), "H", back=8)
    fc = forecast.seasonal_naive(df, 8, 6, 12)
    samples = forecast.sample_from_quantiles(fc, 50, seed=3)
    again = forecast.sample_from_quantiles(fc.repartition(7), 50, seed=3)
    assert samples.exceptAll(again).isEmpty() and samples.count() == 2 * 6 * 50
    joined = samples.join(fc, ["model", "unique_id", "window_idx", "step"])
    q = F.col("quantiles")
    assert joined.where((F.col("y_hat") < q[0] - 1e-9) | (F.col("y_hat") > q[8] + 1e-9)).isEmpty()
    back = forecast.collect_quantiles(forecast.explode_quantiles(fc))
    assert back.exceptAll(fc.select(back.columns)).isEmpty()
    keys = ["unique_id", "window_idx", "step"]
    pdf = samples.toPandas().groupby(keys).y_hat
    got = forecast.samples_to_quantiles(samples, keys).toPandas().set_index(keys)
    for key, values in pdf:
        np.testing.assert_allclose(got.loc[key, "quantiles"], np.quantile(values, LEVELS))


@pytest.mark.parametrize("layout", ["point", "quantiles", "transposed", "mean_first", "no_median"])
def test_forecaster_layouts(make, series, layout):
    def model(contexts, horizon):
        base = np.array([c[-1] for c in contexts])[:, None, None]
        out = base + np.arange(-4, 5)[None, :, None] + np.zeros((1, 1, horizon))
        if layout == "point":
            return out[:, 4]
        if layout == "transposed":
            return out.transpose(0, 2, 1)
        if layout == "mean_first":
            return np.concatenate([out[:, 4:5], out], axis=1)
        if layout == "no_median":
            return np.delete(out, 4, axis=1)
        return out

    df = grid.dense(make({"full": series["full"], "gaps": series["gaps"]}), "H")
    out = forecast.forecast_with(df, model, 6, 20, context_length=10, pad=0.0, batch_size=2)
    rows = out.toPandas()
    assert len(rows) == 2 * 3 * 6
    spread = 0 if layout == "point" else 4
    for q in rows["quantiles"]:
        assert q[8] - q[4] == pytest.approx(spread) and q[4] - q[0] == pytest.approx(spread)
    checked = forecast.check_forecast_shape(out, 9, 6)
    assert checked.where("NOT ok").isEmpty() and not forecast.check_forecast_shape(out, 9, 7).where("NOT ok").isEmpty()


def test_bad_layout():
    with pytest.raises(ValueError):
        forecast.normalize_output(np.zeros((1, 3, 5)), 9, 4)
    with pytest.raises(ValueError):
        metrics.evaluate(None, None, None, levels=[0.1, 0.9])


@pytest.mark.parametrize("most", [16, 2])
def test_multivariate_forecaster(make, spark, rng, most):
    names = {"p_a": ("p", "a"), "p_b": ("p", "b"), "p_c": ("p", "c"), "q_a": ("q", "a")}
    data = {u: rng.normal(size=40) for u in names}
    data["p_b"][20:34] = np.nan
    data["p_c"] = data["p_c"][:37]  # ends earlier: its windows are its own last steps
    info = spark.createDataFrame([(u, *n) for u, n in names.items()], "unique_id string, series_name string, variate_name string")

    def total(contexts, horizon):
        return [np.repeat(c.sum() + c[:, -1:], horizon, axis=1) for c in contexts]
    df = grid.dense(make(data), "H")
    out = forecast.forecast_multivariate(df, info, total, 4, 8, 6, max_variates=most)
    got = {(r.unique_id, r.window_idx, r.step): r.quantiles for r in out.collect()}
    assert len(got) == 4 * 2 * 4
    groups = [["p_a", "p_b", "p_c"], ["q_a"]] if most == 16 else [["p_a", "p_b"], ["p_c"], ["q_a"]]
    for group in groups:
        for w in (0, 1):
            stack = [forecast.interpolate_missing(data[u][len(data[u]) - 8 + 4 * w - 6:][:6]) for u in group]
            for u, own in zip(group, stack):
                for step in range(1, 5):
                    assert got[(u, w, step)] == pytest.approx([np.sum(stack) + own[-1]] * 9)

    def short(contexts, horizon):
        return [np.zeros((1, horizon)) for _ in contexts]
    with pytest.raises(Exception, match="variates"):
        forecast.forecast_multivariate(df, info, short, 4, 8, 6).collect()


@pytest.mark.parametrize("steps, length, horizon, test_length", [(3, 10, 4, 33), (8, 3, 5, 25), (1000, 7, 2, 19), (2, 50, 3, 60)])
def test_contexts_are_cut_from_slices(make, rng, monkeypatch, steps, length, horizon, test_length):
    """Many slices or one, contexts longer and shorter than a slice, short series, windows without a context."""
    monkeypatch.setattr(windows, "SLICE_STEPS", steps)
    data = {"long": rng.normal(size=140), "exact": rng.normal(size=test_length), "short": rng.normal(size=test_length // 2)}
    data["long"][60:90] = np.nan
    df = grid.dense(make(data), "H", block_steps=16, back=3, ahead=2)
    got = {(r.unique_id, r.window_idx): r.context for r in windows.context_arrays(df, horizon, test_length, length).collect()}
    want = {}
    for uid, values in data.items():
        for w in range(test_length // horizon):
            origin = len(values) - test_length + w * horizon
            own = values[max(0, origin - length):max(0, origin)]
            if len(own):
                want[uid, w] = own
    assert got.keys() == want.keys()
    for key, values in want.items():
        np.testing.assert_array_equal(np.array(got[key], float), values)
    copies = windows.context_slices(df, horizon, test_length, length).groupBy("unique_id", "at").count()
    assert copies.where("count > 2").isEmpty()


def test_long_contexts_shuffle_no_row_more_than_twice(make, rng):
    """Context 4,000 and horizon 24: each step lies in up to 167 contexts."""
    df = grid.dense(make({"s": rng.normal(size=9000)}), "H")
    slices = windows.context_slices(df, 24, 6000, 4000)
    assert slices.count() <= 2 * 9000
    out = forecast.forecast_with(df, lambda contexts, h: np.array([[len(c)] * h for c in contexts]), 24, 6000, 4000)
    rows = out.where("step = 1").collect()
    assert len(rows) == 250
    assert [r.quantiles[0] for r in sorted(rows, key=lambda r: r.window_idx)] == [min(4000, 3000 + 24 * w) for w in range(250)]
