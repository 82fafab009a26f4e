import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelmill.operators import forecast, grid, metrics, tasks, windows

SCHEMA = "dataset string, task string, horizon bigint, test_length bigint, error_season bigint, model string, season bigint"
ROWS = [  # several tasks and models on one panel, seasons longer than horizons and shorter
    *(("hours", "short", 4, 26, 8, model, season) for model, season in (("own", 8), ("naive", 1), ("long", 16))),
    *(("hours", "long", 13, 26, 8, model, season) for model, season in (("own", 8), ("naive", 1))),
    ("more", "short", 4, 9, 3, "own", 3), ("days", "short", 7, 21, 7, "own", 7), ("days", "short", 7, 21, 7, "naive", 1),
]


def gappy(rng, n, share=0.15):
    y = rng.normal(size=n).cumsum()
    y[rng.random(n) < share] = np.nan
    return y


@pytest.fixture(scope="module")
def panels(make):
    rng = np.random.default_rng(8)
    late = gappy(rng, 70)
    late[:50] = np.nan
    hours = make({"a": gappy(rng, 150), "b": gappy(rng, 43), "short": gappy(rng, 20), "late": late, "empty": np.full(60, np.nan)})
    more = make({"a": gappy(rng, 60), "x_y": rng.normal(size=31)}, start="2023-05-01 00:00:00")
    days = make({"a": gappy(rng, 90), "const": np.ones(60)}, "D")
    return {"hours": ("H", hours), "more": ("H", more), "days": ("D", days)}


def whole(panels, block_steps):
    named = {d: p.withColumn("dataset", F.lit(d)) for d, (_, p) in panels.items()}
    return tasks.dense({"H": named["hours"].unionByName(named["more"]), "D": named["days"]}, {"H": 16, "D": 7}, block_steps)


def seen(rows):
    return {(r.model, r.unique_id, r.window_idx): [*(getattr(r, m) for m in metrics.METRICS), r.missing_steps] for r in rows}


def test_tasks_equal_single_runs(spark, panels):
    """Every task and model of the table, in blocks, against the operators for one task."""
    df = whole(panels, 32).persist()
    got = tasks.evaluate(df, spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert len(got) == len({(r.dataset, r.task, r.model, r.unique_id, r.window_idx) for r in got})
    for dataset, task in {row[:2] for row in ROWS}:
        own = [row for row in ROWS if row[:2] == (dataset, task)]
        _, _, horizon, length, error_season = own[0][:5]
        freq, panel = panels[dataset]
        one = grid.dense(panel, freq, back=16)
        made = None
        for *_, model, season in own:
            part = forecast.seasonal_naive(one, season, horizon, length, model=model)
            made = part if made is None else made.unionByName(part)
        want = seen(metrics.evaluate(made, windows.test_windows(one.where("core"), horizon, length),
                                     metrics.seasonal_error(one, error_season, horizon, length), models=[r[5] for r in own]).collect())
        have = seen(r for r in got if (r.dataset, r.task) == (dataset, task))
        assert have.keys() == want.keys() and want
        for key, values in want.items():
            assert [v is None for v in have[key]] == [v is None for v in values], (dataset, task, key)
            assert [v for v in have[key] if v is not None] == pytest.approx([v for v in values if v is not None]), (dataset, task, key)


def test_plan_does_not_grow_with_tasks(spark, panels):
    def size(rows):
        plan = tasks.evaluate(whole(panels, 4096), spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().optimizedPlan()
        return plan.toString().count("\n")

    more = [(d, f"{t}{i}", h, n, e, f"{m}{i}", s) for i in range(12) for d, t, h, n, e, m, s in ROWS]
    assert size(more) == size(ROWS)


def test_rows_stay_in_their_blocks(spark, panels):
    """Parameters are attached and steps one season earlier found without a shuffle of the panel by dataset or season."""
    df, table = whole(panels, 4096), spark.createDataFrame(ROWS, SCHEMA)
    for made in (tasks.seasonal_naive(df, table), tasks.seasonal_errors(df, table), tasks.labels(df, table)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert exchanges and not [line for line in exchanges if "block#" in line and "season#" in line]
        by_table = [line for line in plan.splitlines() if re.search(r"Join \[dataset#\d+(, season#\d+L)?\]", line)]
        assert by_table and all("BroadcastHashJoin" in line and "BuildRight" in line for line in by_table)


def test_odd_tasks(spark, panels):
    """A horizon that does not fit is an error; no tasks, no rows; unknown datasets have none."""
    df = whole(panels, 4096)
    with pytest.raises(Exception, match="does not fit"):
        tasks.labels(df, spark.createDataFrame([("days", "bad", 30, 21, 7, "own", 7)], SCHEMA)).collect()
    assert tasks.evaluate(df, spark.createDataFrame([], SCHEMA)).isEmpty()
    assert tasks.evaluate(df, spark.createDataFrame([("other", "short", 3, 9, 2, "own", 2)], SCHEMA)).isEmpty()
    with pytest.raises(ValueError):
        metrics.evaluate(None, None, None, models=df)


def test_model_without_forecasts(spark, panels):
    df = whole(panels, 4096)
    table = spark.createDataFrame([*ROWS[-2:], (*ROWS[-1][:5], "silent", 1)], SCHEMA)
    made = tasks.seasonal_naive(df, table.where("model <> 'silent'"))
    rows = tasks.evaluate(df, table, made).where("model = 'silent'").collect()
    assert len(rows) == 2 * 3 and all(r.missing_steps == 7 and r.MAE is None for r in rows)
