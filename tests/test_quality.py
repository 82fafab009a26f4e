import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelmill.operators import cleanup, correlation, grid, leaderboard, quality


def ar(rng, n=400, phi=0.7):
    y = np.zeros(n)
    for i in range(1, n):
        y[i] = phi * y[i - 1] + rng.normal()
    return np.round(y + 20, 3)


def brute_outliers(values):
    ts = pd.Series(values).ffill().bfill().fillna(0)
    roll = ts.rolling(max(20, len(ts) // 10), center=True, min_periods=1)
    iqr = roll.quantile(0.75) - roll.quantile(0.25)
    whole = ts.quantile(0.75) - ts.quantile(0.25)
    iqr = iqr.replace(0, whole if whole else ts.std() * 1.35)
    dev = (ts - roll.median()).abs() / iqr
    extreme = dev >= 9
    clean = ts.where(~extreme).ffill().bfill()
    if extreme.mean() > 0.05:
        clean = pd.Series(values)
    return (dev > 3) & ~extreme, extreme, clean.where(pd.Series(values).notna())


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(8)
    spike, many = ar(rng), ar(rng)
    spike[57] += 60
    many[rng.permutation(400)[:26]] += 80
    gaps = ar(rng)
    gaps[rng.random(400) < 0.25] = np.nan
    holes = ar(rng)
    holes[5:200] = np.nan
    mostly_flat = np.where(rng.random(400) < 0.9, 5.0, rng.normal(size=400).round(2))
    return {"spike": spike, "many": many, "gaps": gaps, "holes": holes, "noise": rng.normal(size=400), "flat": np.full(400, 7.0),
            "steps": mostly_flat, "empty": np.full(400, np.nan), "short": ar(rng)[:50]}


@pytest.mark.parametrize("block", [10_000, 64])
def test_outliers_match_pandas(make, series, block):
    flagged = quality.flag_outliers(quality.rolling_stats_by_length(grid.dense(make(series), "H", block), block))
    got = flagged.toPandas().sort_values(["unique_id", "pos"])
    cleaned = quality.clean_outliers(flagged).toPandas().sort_values(["unique_id", "ds"])
    for uid, y in series.items():
        transient, extreme, clean = brute_outliers(y)
        rows = got[got.unique_id == uid]
        assert list(rows.extreme) == list(extreme) and list(rows.transient) == list(transient), uid
        np.testing.assert_allclose(cleaned[cleaned.unique_id == uid].y_clean.to_numpy(dtype=float), clean, err_msg=uid)


def test_fixed_window_equals_pandas(make, series):
    df = grid.dense(make({"gaps": series["gaps"]}), "H", 50, back=12, ahead=11)
    got = quality.rolling_stats(df, 24).toPandas().sort_values("pos")
    roll = pd.Series(series["gaps"]).ffill().bfill().rolling(24, center=True, min_periods=1)
    np.testing.assert_allclose(got["median"], roll.median())
    np.testing.assert_allclose(got["iqr"], roll.quantile(0.75) - roll.quantile(0.25), atol=1e-12)


def test_report_cascade(make, series):
    got = {r.unique_id: r for r in quality.quality_report(make(series), "H", missing_limit=0.3, smallest=100).collect()}
    reasons = {u: r.checks for u, r in got.items()}
    assert reasons["spike"] == [] and got["spike"].predictable
    assert reasons["many"] == ["extreme_outliers"]
    assert reasons["gaps"] == []
    assert reasons["holes"] == ["missing_rate"]
    assert reasons["noise"] == ["white_noise"]
    assert reasons["flat"] == ["constant"] and reasons["steps"] == ["constant"]
    assert reasons["empty"] == ["missing_rate"]
    assert reasons["short"] == ["length"]


def test_concentration_and_noise(make, rng):
    y = rng.integers(0, 12, 300).astype(float)
    df = grid.fill_forward_back_zero(grid.dense(make({"a": y, "b": np.full(30, 2.0)}), "H", 32))
    got = {r.unique_id: r for r in quality.value_concentration(df).collect()}
    p = pd.Series(y).value_counts(normalize=True)
    assert got["a"].dominance == pytest.approx(p.iloc[:5].sum())
    assert got["a"].entropy == pytest.approx(-(p * np.log(p + 1e-12)).sum() / np.log(len(p)))
    assert (got["b"].dominance, got["b"].entropy) == (1.0, 0.0)
    noise = {r.unique_id: r.noise_p for r in quality.ljung_box(df).collect()}
    d, n = y - y.mean(), len(y)
    r2 = [((d[k:] * d[:-k]).sum() / (d @ d)) ** 2 / (n - k) for k in range(1, 21)]
    tails = []
    for lags in (10, 20):
        q = n * (n + 2) * sum(r2[:lags])
        term, total = 1.0, 0.0
        for i in range(lags // 2):
            total += term
            term *= q / 2 / (i + 1)
        tails.append(np.exp(-q / 2) * total)
    assert noise["a"] == pytest.approx(min(tails)) and noise["b"] is None


def test_chi2_tail_table(spark):
    row = spark.range(1).select(quality.chi2_tail(F.lit(18.307), 10).alias("a"), quality.chi2_tail(F.lit(31.410), 20).alias("b")).first()
    assert row.a == pytest.approx(0.05, abs=1e-5) and row.b == pytest.approx(0.05, abs=1e-5)


def test_monotonic_across_blocks(spark):
    times = [1, 2, 3, 4, 4, 5, 3, 6]
    rows = [("a", t, i) for i, t in enumerate(times)] + [("b", t, i) for i, t in enumerate(sorted(times))]
    raw = spark.createDataFrame(rows, "unique_id string, t int, ordinal bigint").withColumn("ds", F.timestamp_seconds("t"))
    for size in (2, 3, 100):
        got = {r.unique_id: (r.n_backward, r.monotonic) for r in quality.check_monotonic(raw, block_rows=size).collect()}
        assert got == {"a": (1, False), "b": (0, True)}


def test_dtype(spark):
    df = spark.createDataFrame([("1.5", 2), ("x", 3), (None, 4)], "t string, n int")
    assert quality.check_dtype(df, ["t", "n"]) == {"t": False, "n": True}
    assert quality.numeric_share(df, ["t"]).first().t == 0.5


def test_variate_correlation(spark, rng):
    x = rng.normal(size=(200, 4)) + 1e6
    x[:, 1] = x[:, 0]
    x[:, 3] = 5.1
    x[rng.random(200) < 0.2, 2] = np.nan
    names = ["a", "b", "c", "d"]
    rows = [("s", *[None if np.isnan(v) else float(v) for v in r]) for r in x]
    wide = spark.createDataFrame(rows, "s string, a double, b double, c double, d double").repartition(3)
    pairs = correlation.variate_correlation(wide, "s", names)
    got = {(r.a, r.b): r.r for r in pairs.collect()}
    want = pd.DataFrame(x, columns=names).corr()
    assert got[("a", "b")] == pytest.approx(1.0)
    assert got[("a", "c")] == pytest.approx(want.loc["a", "c"], abs=1e-8)
    assert got[("a", "d")] is None
    assert [(r.a, r.b, r.r) for r in correlation.correlated_pairs(pairs).collect()] == [("a", "b", 1.0)]
    full = correlation.correlation_matrix(pairs, wide, "s", names).collect()
    assert len(full) == 16 and {r.r for r in full if r.a == r.b and r.a != "d"} == {1.0}


@pytest.mark.parametrize("tile, cells", [(400, 10_000), (2, 100)])
def test_cross_series(make, rng, tile, cells):
    data = {f"s{i}": rng.normal(size=60) for i in range(7)}
    data["s3"][4:9] = np.nan
    got = {(r.a, r.b): r.r for r in correlation.cross_series_correlation(grid.dense(make(data), "H"), tile, cells).collect()}
    want = pd.DataFrame(data).corr()
    assert len(got) == 21
    for (a, b), r in got.items():
        assert a < b and r == pytest.approx(want.loc[a, b])
    over = correlation.cross_series_correlation(grid.dense(make(data), "H"), tile, cells, limit=0.1)
    assert {(r.a, r.b) for r in over.collect()} == {k for k, r in got.items() if abs(r) > 0.1}
    data["s0"] = data["s0"][:50]
    assert correlation.cross_series_correlation(grid.dense(make(data), "H")).isEmpty()


def test_cleanup_plan(spark):
    rows = [(f"f{i}", v, not ((v == "bad") or (v == "odd" and i == 3) or i == 4), ["x"], 10, 8) for i in range(5) for v in ("bad", "odd", "ok")]
    report = spark.createDataFrame(rows, "series_name string, variate_name string, predictable boolean, checks array<string>, n bigint, n_obs bigint")
    plan = {(r.action, r.target, r.cause) for r in cleanup.cleanup_plan(report).collect()}
    assert plan == {("drop_variate", "bad", "mostly_failed"), ("drop_series", "f3", "partly_failed"), ("drop_series", "f4", "partly_failed"),
                    ("drop_series", "f4", "all_failed")}
    left = cleanup.drop_series(cleanup.drop_variate(report, ["bad"]), ["f3", "f4"])
    meta, summary, variates = cleanup.recompute(left)
    assert summary.first().num_series == 3 and summary.first().num_observations == 48
    assert {(r.variate_name, r.kept_ratio) for r in variates.collect()} == {("odd", 1.0), ("ok", 1.0)}
    dry = cleanup.dry_run(report, ["bad"], ["f3"]).first()
    assert (dry.series_touched, dry.pairs_removed, dry.observations_removed) == (5, 7, 56)
    made = cleanup.cleanup_plan(report)
    assert sorted(cleanup.apply_plan(report, made).collect()) == sorted(left.collect())
    assert cleanup.apply_plan(report, made).columns == report.columns
    dry = cleanup.dry_run(report, cleanup.targets(made, "drop_variate"), cleanup.targets(made, "drop_series")).first()
    assert (dry.series_touched, dry.pairs_removed, dry.observations_removed) == (5, 9, 72)
    none = made.where("action = 'none'").select("target")
    assert cleanup.drop_variate(report, none).count() == 15 and cleanup.dry_run(report, none).first().pairs_removed == 0
    assert cleanup.drop_marked(report, report).count() == report.where("predictable").count()


SCORES = "model string, dataset_id string, horizon string, MASE double, CRPS double"


def test_leaderboard(spark):
    nan = float("nan")
    rows = [("seasonal_naive", "a/H", "short", 1.0, 2.0), ("m1", "a/H", "short", 0.5, 4.0), ("m2", "a/H", "short", 0.5, None),
            ("seasonal_naive", "b/D", "short", 0.0, nan), ("m1", "b/D", "short", 3.0, 1.0), ("m1", "c/D", "long", 9.0, 9.0)]
    results = spark.createDataFrame(rows, SCORES)
    merged = leaderboard.union_results(results, results.where("model = 'seasonal_naive'"))
    assert merged.count() == len(rows)
    ranked = leaderboard.compute_ranks(merged)
    ranks = {(r.model, r.dataset_id): (r.MASE_rank, r.CRPS_rank) for r in ranked.collect()}
    assert ranks[("m1", "a/H")] == (1.0, 2.0) and ranks[("m2", "a/H")] == (2.0, None) and ranks[("seasonal_naive", "a/H")] == (3.0, 1.0)
    normal = {(r.model, r.dataset_id): (r.MASE, r.CRPS) for r in leaderboard.normalize_by_baseline(ranked).collect()}
    assert normal[("m1", "a/H")] == (0.5, 2.0) and normal[("m1", "b/D")] == (None, None) and ("m1", "c/D") not in normal
    board = leaderboard.overall_leaderboard(ranked)
    top = {r["model"]: r for r in board.collect()}
    assert top["seasonal_naive"]["MASE (norm.)"] == 1.0 and top["seasonal_naive"]["CRPS (norm.)"] == 1.0
    assert top["m1"]["MASE_rank"] == 1.5 and [r["model"] for r in board.collect()] == ["m1", "m2", "seasonal_naive"]
    assert leaderboard.has_baseline(results) and not leaderboard.has_baseline(results, "other")
    assert leaderboard.overall_leaderboard(ranked, baseline="other").isEmpty()


def test_geometric_mean(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 8.0), ("a", None), ("z", 0.0), ("z", 3.0), ("n", -1.0), ("n", 2.0), ("e", None)], "k string, v double")
    got = {r.k: r.g for r in df.groupBy("k").agg(leaderboard.geometric_mean("v").alias("g")).collect()}
    assert got["a"] == pytest.approx(4.0) and got["z"] == 0.0 and got["n"] is None and got["e"] is None


def test_report_counts_what_the_grid_leaves_out(spark, rng):
    ds = pd.date_range("2024-01-01", periods=400, freq="h")
    good = pd.DataFrame({"unique_id": "good", "ds": ds, "y": ar(rng)})
    odd = pd.DataFrame({"unique_id": "odd", "ds": ds, "y": ar(rng)})
    odd.loc[[7, 8], "y"] = [np.inf, -np.inf]
    twice = odd.iloc[[20, 20, 30]]
    late = odd.iloc[[40]].assign(ds=lambda d: d["ds"] + pd.Timedelta(minutes=7))
    panel = spark.createDataFrame(pd.concat([good, odd, twice, late]))
    # pandas' NaN would arrive as NULL
    nan = (F.col("unique_id") == "odd") & (F.col("ds") == F.lit(ds[9]))
    panel = panel.withColumn("y", F.when(nan, float("nan")).otherwise(F.col("y")))
    rows = {r.unique_id: r for r in quality.quality_report(panel, "H").collect()}
    assert (rows["good"].n_duplicates, rows["good"].n_off_grid, rows["good"].n_non_finite) == (0, 0, 0)
    assert (rows["odd"].n_duplicates, rows["odd"].n_off_grid, rows["odd"].n_non_finite) == (3, 1, 3)
    assert rows["odd"].n_obs == 397


def test_early_stop_and_preprocess(make, series):
    panel = make(series)
    whole = {r.unique_id: r for r in quality.quality_report(panel, "H").collect()}
    report, cleaned = quality.preprocess(panel, "H")
    short = {r.unique_id: r for r in report.collect()}
    assert {k: r.checks for k, r in whole.items()} == {k: r.checks for k, r in short.items()}
    stopped = {k for k, r in short.items() if r.noise_p is None}
    assert stopped and all(not short[k].predictable for k in stopped)
    got = cleaned.toPandas()
    assert set(got["unique_id"]) == {k for k, r in short.items() if r.predictable}
    for name, rows in got.groupby("unique_id"):
        want = brute_outliers(series[name])[2]
        np.testing.assert_allclose(rows.sort_values("ds")["y_clean"].to_numpy(float), want.to_numpy(float))


def test_text_values_fail_as_dtype(spark):
    """The first reason and the only one, also where length and missing rate would fail."""
    from datetime import datetime, timedelta

    from panelmill.operators import panel

    start = datetime(2024, 1, 1)
    wide = spark.createDataFrame(
        [("f", start + timedelta(hours=i), str(i % 17 + i / 7), "x" if i == 3 else "1.5", None, f"{i}e0") for i in range(40)],
        "series string, timestamp timestamp, number string, mixed string, empty string, exponent string")
    long = panel.to_panel(wide, ["series"], as_text=True)
    got = {r.unique_id: r for r in quality.quality_report(long, "H", smallest=100).collect()}
    assert got["f_mixed"].checks == ["dtype"] and got["f_mixed"].n_text == 1 and not got["f_mixed"].predictable
    assert got["f_number"].checks == got["f_exponent"].checks == ["length"] and got["f_exponent"].n_text == 0
    assert got["f_empty"].checks == ["length", "missing_rate"]


def test_short_series_share_a_group_of_the_rolling_quartiles(make, rng, capsys):
    """one call of numpy for many series, each with its own frames."""
    series = {f"s{i}": rng.normal(size=size).round(1).tolist() for i, size in enumerate((1, 7, 30, 250, 400, 400))}
    df = grid.dense(make(series), "H")
    stats = quality.rolling_stats_by_length(df)
    stats.explain()
    assert "FlatMapGroupsInPandas [share" in capsys.readouterr().out
    got = stats.toPandas()
    assert len(got) == sum(map(len, series.values()))
    for name, values in series.items():
        own, window = got[got["unique_id"] == name].sort_values("pos"), max(20, len(values) // 10)
        frames = [values[max(0, p - window // 2):p + (window - 1) // 2 + 1] for p in range(len(values))]
        low, middle, high = (np.array([np.percentile(f, q) for f in frames]) for q in (25, 50, 75))
        np.testing.assert_allclose(own["median"], middle, atol=1e-12)
        np.testing.assert_allclose(own["iqr"], high - low, atol=1e-12)


def test_text_series_get_no_costly_checks(spark):
    """a series of labels fails as `dtype`; noise and outliers are not computed for it."""
    days = [datetime.datetime(2024, 1, 1) + datetime.timedelta(days=i) for i in range(60)]
    rows = [("n", d, str(i * i % 17)) for i, d in enumerate(days)] + [("t", d, f"v{i}") for i, d in enumerate(days)]
    report = quality.quality_report(spark.createDataFrame(rows, "unique_id string, ds timestamp, y string"), "D", smallest=10)
    got = {r.unique_id: r for r in report.collect()}
    assert got["t"].checks == ["dtype"] and got["t"].n_text == 60 and got["t"].n == 60 and got["t"].missing_rate == 1.0
    assert got["t"].extreme_ratio is None and got["t"].noise_p is None
    assert got["n"].extreme_ratio is not None and got["n"].n_text == 0


def test_written_rows_are_sized_by_the_steps_too(make, monkeypatch):
    """Rolling quartiles and cleaning must not be left to as few tasks as the session has."""
    panel = make({f"s{i}": [1.0, 2.0, 3.0, 90.0, None, 3.0] * 25 for i in range(20)}, drop_missing=True)

    def stats():
        return quality.rolling_stats(grid.dense(panel, "H", back=10, ahead=10), 21)

    few = stats()
    monkeypatch.setattr(grid, "TASK_STEPS", 100)
    many = stats()
    assert many.rdd.getNumPartitions() >= 20 * 150 // 100 > few.rdd.getNumPartitions()
    cleaned = [quality.clean_outliers(quality.flag_outliers(df)) for df in (few, many)]
    assert sorted(map(tuple, cleaned[0].collect()), key=repr) == sorted(map(tuple, cleaned[1].collect()), key=repr)
