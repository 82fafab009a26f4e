from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelmill.functions import frequency as fq
from panelmill.operators import grid, panel as shape, quality


@pytest.mark.parametrize("alias, base, n", [("H", "H", 1), ("15T", "T", 15), ("5min", "T", 5), ("W-SUN", "W", 1),
                                            ("MS", "M", 1), ("QE", "Q", 1), ("2A-DEC", "A", 2), ("YS", "A", 1)])
def test_parse(alias, base, n):
    freq = fq.parse_freq(alias)
    assert (freq.base, freq.n) == (base, n)


def test_parse_rejects():
    with pytest.raises(ValueError):
        fq.parse_freq("H2")


def test_min_length():
    assert [fq.min_length(a) for a in ("H", "6H", "D", "W", "15T", "W-MON", "XX", "500H")] == [720, 120, 183, 104, 2688, 20, 20, 1]


def test_min_length_column(spark):
    aliases = ["H", "6H", "D", "W", "15T", "W-MON", "XX", "500H", "ME"]
    df = spark.createDataFrame([(a,) for a in aliases], "freq string")
    got = {r.freq: r.m for r in df.withColumn("m", fq.min_length_column(F.col("freq"))).collect()}
    assert got == {a: fq.min_length(a) for a in aliases}


def test_candidates_and_bands():
    assert fq.candidate_periods("6H") == [(2, 1 / 6), (4, 2 / 6), (28, 2.0), (120, 4.0)]
    assert fq.candidate_periods("A") == [(1, 0)]
    period, lo, hi = fq.period_bands("H")[1]
    assert period == 24 and lo < 1 / 24 < hi


def test_seasons_and_horizons():
    assert [fq.seasonality(a) for a in ("H", "6H", "5H", "15T", "D", "MS", "W-MON")] == [24, 4, 1, 96, 1, 12, 1]
    assert fq.seasonality_list("6H") == [4, 28, 1]
    assert fq.freq_seconds("15T") == 900 and fq.freq_seconds("MS") == 0
    assert fq.default_horizon("H", "medium") == 480 and fq.default_horizon("D", m4=True) == 14


@pytest.mark.parametrize("alias, pandas_freq, start", [
    ("B", "B", "2024-01-05"), ("W-SUN", "W-SUN", "2024-01-07"), ("MS", "MS", "2023-11-01"), ("ME", "ME", "2023-11-30"),
    ("QS", "QS", "2023-10-01"), ("15T", "15min", "2024-01-01 00:07"), ("2D", "2D", "2023-12-30"), ("A", "YE", "2001-12-31"),
    ("3MS", "3MS", "2023-02-01")])
def test_grid_follows_calendar(spark, alias, pandas_freq, start):
    days = pd.date_range(start, periods=9, freq=pandas_freq)
    kept = [d.to_pydatetime() for i, d in enumerate(days) if i not in (3, 4, 6)]
    raw = spark.createDataFrame([("a", d, 1.0) for d in kept], "unique_id string, ds timestamp, y double")
    got = [r.ds for r in grid.gap_fill(raw, alias, block_steps=4).orderBy("ds").collect()]
    assert got == [d.to_pydatetime() for d in days]


def test_business_grid_rolls_over_weekends(spark):
    raw = spark.createDataFrame([("a", datetime(2024, 1, 6), 9.0), ("a", datetime(2024, 1, 9), 1.0), ("a", datetime(2024, 1, 13), 9.0)],
                                "unique_id string, ds timestamp, y double")
    rows = grid.gap_fill(raw, "B").orderBy("ds").collect()
    assert [r.ds.day for r in rows] == [8, 9, 10, 11, 12] and [r.y for r in rows] == [None, 1.0, None, None, None]


def test_infer_freq(spark):
    cases = {"h": ("2024-01-01", "h"), "q": ("2024-01-01", "6h"), "b": ("2024-01-01", "B"), "ms": ("2024-01-01", "MS"),
             "me": ("2024-01-31", "ME"), "qs": ("2024-01-01", "QS"), "w": ("2024-01-07", "W-SUN"), "t": ("2024-01-01", "15min")}
    rows = [(u, d.to_pydatetime()) for u, (s, f) in cases.items() for d in pd.date_range(s, periods=30, freq=f)]
    rows += [("x", d.to_pydatetime()) for d in pd.date_range("2024-01-01", periods=30, freq="h").delete(4)]
    got = {r.unique_id: r.freq for r in shape.infer_freq(
        spark.createDataFrame(rows, "unique_id string, ds timestamp"), block_days=7).collect()}
    want = {"h": "H", "q": "6H", "b": "B", "ms": "MS", "me": "ME", "qs": "QS", "w": "W-SUN", "t": "15T", "x": None}
    assert got == want
    times = spark.createDataFrame(rows, "unique_id string, ds timestamp")
    for days, seconds in ((7, 5000), (1, 100_000), (3650, 7200)):  # stretches that end within blocks, and the reverse
        assert {r.unique_id: r.freq for r in shape.infer_freq(times, days, seconds).collect()} == want


def test_timestamp_report(spark):
    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    raw = spark.createDataFrame([("a", at(0), 1.0), ("a", at(1), 1.0), ("a", at(1), 2.0), ("a", at(2, 30), 5.0), ("a", at(4), 1.0)],
                                "unique_id string, ds timestamp, y double")
    row = quality.timestamp_report(raw, "H").first()
    assert (row.n_raw, row.n_duplicates, row.n_off_grid, row.n_filled) == (5, 1, 1, 2)
    filled = grid.gap_fill(raw, "H").orderBy("ds").collect()
    assert [r.y for r in filled] == [1.0, 2.0, None, None, 1.0]


def test_parse_timestamps_and_normalize(spark):
    df = spark.createDataFrame([(1, "2020-01-13 00:00:00"), (2, "13.01.2020 05:30"), (3, "13.01.2020"), (4, "01/13/2020 07:00"), (5, "x")],
                               "k int, Start_Time string")
    moved = shape.normalize_timestamp_column(df)
    assert moved.columns == ["timestamp", "k"]
    got = [r[0] for r in moved.orderBy("k").select(shape.parse_timestamps(F.col("timestamp"))).collect()]
    assert got == [datetime(2020, 1, 13), datetime(2020, 1, 13, 5, 30), datetime(2020, 1, 13), datetime(2020, 1, 13, 7), None]
    with pytest.raises(ValueError):
        shape.normalize_timestamp_column(spark.createDataFrame([(1,)], "k int"))


def test_columns_agree_with_the_functions(spark):
    """Every alias with and without multipliers and anchors; unknown ones are NULL."""
    from pyspark.sql import functions as F

    aliases = [f"{n}{name}{anchor}" for name in fq.ALIASES for n in ("", "1", "4", "15", "60") for anchor in ("", "-DEC")]
    odd = ["", "x", "H1", "1.5H", "-DEC", None, "7"]
    a = F.col("a")
    rows = spark.createDataFrame([(x,) for x in aliases + odd], "a string").select(
        "a", fq.parsed(a).alias("p"), fq.season_of(a).alias("s"), fq.seasons_of(a).alias("l"), fq.seconds_of(a).alias("t"),
        fq.horizon_of(a, F.lit("medium")).alias("h"), fq.horizon_of(a, F.lit("medium"), True).alias("m")).collect()
    got = {r.a: r for r in rows}
    for alias in aliases:
        r, want = got[alias], fq.parse_freq(alias)
        assert (r.p.base, r.p.n) == (want.base, want.n)
        assert (r.s, r.l, r.t) == (fq.seasonality(alias), fq.seasonality_list(alias), fq.freq_seconds(alias))
        assert r.h == fq.default_horizon(alias, "medium")
        assert r.m == (fq.default_horizon(alias, "medium", True) if want.base in fq.M4_HORIZON else None)
    assert all(got[x][1:] == (None,) * 6 for x in odd)


def test_interval_column(spark):
    from pyspark.sql import functions as F

    from panelmill.operators import forecast

    levels = [0.1, 0.25, 0.5, 0.75, 0.9, 0.975]
    got = spark.createDataFrame([(q,) for q in levels], "q double").select("q", forecast.interval_of(F.col("q")).alias("i")).collect()
    assert [(r.i.side, r.i.width) for r in got] == [forecast.quantile_to_interval(r.q) for r in got]
