"""Queries for splits, nested tables, files and the leaderboard, with check SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill.operators import features as ft
from panelmill.operators import forecast, grid, leaderboard, quality, windows
from panelmill.operators import panel as shape
from panelmill.operators import tasks as task_plans
from panelmill.plans import forecasting as fc
from panelmill.plans.panels import FREQ, SQL, dense_sql, filled_sql, panel
from panelmill.plans.quality import LONG_SQL, PRIORITIES, dense, orders_wide
from panelmill.plans.registry import R, query, rounded
from panelmill.session import work_folder
from panelmill.sources import nested, results, tasks, wide

CONFIG = """
datasets:
  events_hourly/H:
    test_length: 168   # one week
    val_length: 168
    short:
      prediction_length: 24
    medium:
      prediction_length: 48
  orders_daily/D:
    test_length: 365
    val_length: 90
    short:
      prediction_length: 30
  supplier_weekly/W-MON:
    test_length: 52
    val_length: 13
    short:
      prediction_length: 13
  nation_monthly/MS:
    test_length: 48
    val_length: 100
    short:
      prediction_length: 12
    long:
      prediction_length: 60
"""
_CONFIG = tasks.load_config(CONFIG)
_TASK_ROWS = [(i, t[term]["prediction_length"], term, t["test_length"], t["val_length"])
              for i, t in _CONFIG.items() for term in tasks.available_terms(_CONFIG, i)]
TASK_SQL = "tk AS (" + " UNION ALL ".join(
    f"SELECT '{i}' AS dataset_id, '{term}' AS term, {h} AS prediction_length, {t} AS test_length, {v} AS val_length"
    for i, h, term, t, v in _TASK_ROWS) + ")"
_LENGTH_SQL = "ln AS (" + " UNION ALL ".join(
    f"SELECT '{n}/{FREQ[n]}' AS dataset_id, unique_id, count(*) AS n FROM (WITH {dense_sql(n)} SELECT unique_id FROM f) GROUP BY 1, 2"
    for n in ("events_hourly", "orders_daily", "supplier_weekly", "nation_monthly")) + ")"


def task_frame(spark) -> DataFrame:
    return tasks.task_table(spark, _CONFIG)


def all_lengths(spark, sf) -> DataFrame:
    out = None
    for name in ("events_hourly", "orders_daily", "supplier_weekly", "nation_monthly"):
        one = grid.series_bounds(panel(spark, sf, name), FREQ[name]).select(
            F.lit(f"{name}/{FREQ[name]}").alias("dataset_id"), "unique_id", "n")
        out = one if out is None else out.unionByName(one)
    return out


# --- Splits and windows -----------------------------------------------------------

@query("series_length_stats", sql=f"""
WITH {dense_sql('orders_daily')}, ln AS (SELECT unique_id, count(*) AS n FROM f GROUP BY 1)
SELECT min(n) AS min_length, max(n) AS max_length, {R('avg(n)')} AS avg_length, CAST(sum(n) AS BIGINT) AS sum_length FROM ln""")
def series_length_stats(spark, sf):
    out = windows.series_length_stats(grid.series_bounds(panel(spark, sf, "orders_daily"), "D"))
    return out.withColumn("avg_length", rounded("avg_length"))


@query("validate_lengths", sql=f"""
WITH {TASK_SQL}, {_LENGTH_SQL}, ml AS (SELECT dataset_id, min(n) AS min_length FROM ln GROUP BY 1)
SELECT dataset_id, term, min_length, CASE WHEN test_length > min_length OR val_length > min_length OR prediction_length > test_length THEN 'error'
  WHEN test_length > 0.5 * min_length OR val_length > 0.5 * min_length THEN 'warning' ELSE 'ok' END AS status
FROM tk JOIN ml USING (dataset_id)""")
def validate_lengths(spark, sf):
    out = windows.validate_lengths(task_frame(spark), all_lengths(spark, sf))
    return out.select("dataset_id", "term", "min_length", "status")


@query("num_windows", sql=f"""
WITH {TASK_SQL}, {_LENGTH_SQL}
SELECT dataset_id, term, unique_id, CAST(greatest(1, test_length // prediction_length) AS BIGINT) AS n_windows,
       CAST(greatest(1, val_length // prediction_length) AS BIGINT) AS n_val_windows,
       CAST(test_length - prediction_length * greatest(1, test_length // prediction_length) AS BIGINT) AS unscored
FROM tk JOIN ln USING (dataset_id)""")
def num_windows(spark, sf):
    t, h = F.col("test_length"), F.col("prediction_length")
    count = windows.num_windows_column(t, h)
    return task_frame(spark).join(all_lengths(spark, sf), "dataset_id").select(
        "dataset_id", "term", "unique_id", count.alias("n_windows"),
        windows.num_windows_column(F.col("val_length"), h).alias("n_val_windows"), (t - h * count).alias("unscored"))


@query("effective_split", sql=f"""
WITH {TASK_SQL}, {_LENGTH_SQL}
SELECT dataset_id, unique_id, term, CASE WHEN test_length < 500 THEN 'full' ELSE 'test' END AS split,
       CASE WHEN test_length < 500 THEN n ELSE test_length END AS used
FROM tk JOIN ln USING (dataset_id)""")
def effective_split(spark, sf):
    split = windows.effective_split(task_frame(spark), smallest=500).join(all_lengths(spark, sf), "dataset_id")
    return split.select("dataset_id", "unique_id", "term", "split",
                        F.when(F.col("split") == "full", F.col("n")).otherwise(F.col("test_length")).alias("used"))


for _task in ("events_hourly_medium", "orders_daily"):
    query(f"test_windows_{_task}", sql=f"WITH {dense_sql(fc.TASKS[_task][0])},{fc.labels_sql(_task)} "
                                       "SELECT unique_id, window_idx, step, pos, ds, y FROM lab")(
        lambda spark, sf, task=_task: fc.labels_of(fc.task_panel(spark, sf, task, 0), task))


@query("val_windows", sql=f"""
WITH {dense_sql('orders_daily')}
SELECT unique_id, CAST((pos - (n - 455)) // 30 AS BIGINT) AS window_idx, CAST((pos - (n - 455)) % 30 + 1 AS BIGINT) AS step, pos, ds, y
FROM f WHERE pos >= n - 455 AND pos < n - 455 + 90""")
def val_windows(spark, sf):
    return windows.val_windows(dense(spark, sf, "orders_daily"), 30, 365, 90)


@query("train_split", sql=f"WITH {dense_sql('orders_daily')} SELECT unique_id, ds, y FROM f WHERE pos < n - 30 * 13")
def train_split(spark, sf):
    return windows.train_split(dense(spark, sf, "orders_daily"), 30, 365).select("unique_id", "ds", "y")


@query("validation_split", sql=f"WITH {dense_sql('orders_daily')} SELECT unique_id, ds, y FROM f WHERE pos < n - 30 * 12")
def validation_split(spark, sf):
    return windows.validation_split(dense(spark, sf, "orders_daily"), 30, 365).select("unique_id", "ds", "y")


@query("tail", sql=f"WITH {dense_sql('supplier_weekly')} SELECT unique_id, ds, y FROM f WHERE pos >= n - 52")
def tail(spark, sf):
    return grid.tail(dense(spark, sf, "supplier_weekly"), 52).select("unique_id", "ds", "y")


_CONTEXT = """
og AS (SELECT unique_id, n, w AS window_idx, n - 52 + w * 13 AS o FROM (SELECT DISTINCT unique_id, n FROM f), range(4) AS q(w))"""


@query("truncate_context", sql=f"""
WITH {dense_sql('supplier_weekly')},{_CONTEXT}
SELECT og.unique_id, CAST(window_idx AS BIGINT) AS window_idx, f.pos, o - f.pos AS age, y FROM og JOIN f USING (unique_id)
WHERE f.pos < o AND f.pos >= o - 40""")
def truncate_context(spark, sf):
    return windows.context_windows(dense(spark, sf, "supplier_weekly"), 13, 52, 40).select(
        "unique_id", "window_idx", "pos", "age", "y")


@query("left_pad_context", sql=f"""
WITH {dense_sql('supplier_weekly')},{_CONTEXT},
cx AS (SELECT og.unique_id, window_idx, o, count(*) AS have, sum(y) AS total FROM og JOIN f USING (unique_id)
       WHERE f.pos < o AND f.pos >= o - 270 GROUP BY 1, 2, 3)
SELECT unique_id, CAST(window_idx AS BIGINT) AS window_idx, CAST(270 AS BIGINT) AS size, 270 - have AS padded, {R('total', 4)} AS total FROM cx""")
def left_pad_context(spark, sf):
    """Contexts of 270 weeks, padded with 0 where the series starts later."""
    arrays = windows.context_arrays(dense(spark, sf, "supplier_weekly"), 13, 52, 300)
    short = arrays.withColumn("context", windows.truncate_context(F.col("context"), 270))
    padded = windows.left_pad_context(F.col("context"), 270, 0.0)
    total = F.aggregate(padded, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    return short.select("unique_id", "window_idx", F.size(padded).cast("bigint").alias("size"),
                        (F.lit(270) - F.size("context")).cast("bigint").alias("padded"), rounded(total, 4).alias("total"))


# --- Nested tables ------------------------------------------------------------------

@query("build_series_table", sql=f"""
WITH {dense_sql('events_hourly')}
SELECT unique_id AS item_id, min(ds) AS start, 'H' AS freq, count(*) AS n, count(y) AS n_obs,
       {R('sum(CAST(CAST(y AS FLOAT) AS DOUBLE) * (pos + 1))', 1)} AS weighted FROM f GROUP BY 1""")
def build_series_table(spark, sf):
    """One row per event type; the values are summed up with their positions."""
    table = nested.build_univariate(panel(spark, sf, "events_hourly"), "H")
    points = table.select("item_id", "start", "freq", F.posexplode("target").alias("at", "v"))
    return points.groupBy("item_id", "start", "freq").agg(
        F.count(F.lit(1)).alias("n"), F.count("v").alias("n_obs"),
        rounded(F.sum(F.col("v").cast("double") * (F.col("at") + 1)), 1).alias("weighted"))


def _orders_nested(spark, sf, past: int = 0) -> DataFrame:
    long = shape.to_panel(orders_wide(spark, sf), ["series_name"], "timestamp")
    return nested.build_multivariate(long, "D", past_features=past)


_GRID_SQL = f"""{LONG_SQL},
ed AS (SELECT series_name, min(ds) AS lo, max(ds) AS hi FROM l GROUP BY 1),
gd AS (SELECT series_name, v AS variate_name, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS ds FROM ed, (SELECT unnest({PRIORITIES}) AS v)),
nd AS (SELECT gd.series_name, gd.variate_name, gd.ds, l.y FROM gd LEFT JOIN l USING (series_name, variate_name, ds))"""


@query("build_multivariate_table", sql=f"""
WITH {_GRID_SQL}
SELECT series_name AS item_id, CAST(5 AS BIGINT) AS dims, count(*) // 5 AS n, min(ds) AS start, count(y) AS n_obs,
       string_agg(DISTINCT variate_name, '|' ORDER BY variate_name) AS variate_names FROM nd GROUP BY 1""")
def build_multivariate_table(spark, sf):
    table = _orders_nested(spark, sf)
    observed = F.aggregate("target", F.lit(0).cast("bigint"), lambda a, row: a + F.size(F.array_compact(row)))
    return table.select("item_id", F.size("target").cast("bigint").alias("dims"), F.size(F.col("target")[0]).cast("bigint").alias("n"),
                        "start", observed.alias("n_obs"), F.array_join("variate_names", "|").alias("variate_names"))


@query("with_past_features", sql=f"""
WITH {_GRID_SQL} SELECT series_name AS item_id, CAST(3 AS BIGINT) AS k, count(*) // 5 AS n, CAST(0 AS BIGINT) AS n_obs FROM nd GROUP BY 1""")
def with_past_features(spark, sf):
    past = F.col("past_feat_dynamic_real")
    observed = F.aggregate(past, F.lit(0).cast("bigint"), lambda a, row: a + F.size(F.array_compact(row)))
    return _orders_nested(spark, sf, past=3).select(
        "item_id", F.size(past).cast("bigint").alias("k"), F.size(past[2]).cast("bigint").alias("n"), observed.alias("n_obs"))


@query("item_id", sql=f"""
WITH {LONG_SQL} SELECT DISTINCT 'many' AS kind, unique_id, series_name || '_' || variate_name AS item_id FROM l
UNION ALL SELECT DISTINCT 'one_variate', unique_id, series_name FROM l WHERE variate_name = '1-URGENT'
UNION ALL SELECT DISTINCT 'one_file', unique_id, variate_name FROM l WHERE series_name = 'O'""")
def item_id(spark, sf):
    info = shape.uid_info(shape.to_panel(orders_wide(spark, sf), ["series_name"], "timestamp"))
    cases = {"many": info, "one_variate": info.where("variate_name = '1-URGENT'"), "one_file": info.where("series_name = 'O'")}
    out = None
    for kind, part in cases.items():
        named = nested.item_ids(part).withColumn("kind", F.lit(kind))
        out = named if out is None else out.unionByName(named)
    return out


@query("explode_series_table", sql=f"WITH {dense_sql('nation_monthly')} SELECT unique_id, ds, CAST(CAST(y AS FLOAT) AS DOUBLE) AS y FROM f")
def explode_series_table(spark, sf):
    return nested.explode_series_table(nested.build_univariate(panel(spark, sf, "nation_monthly"), "MS"), "MS")


@query("to_univariate", sql=f"""
WITH {_GRID_SQL}
SELECT series_name || '_dim' || CAST(dense_rank() OVER (ORDER BY variate_name) - 1 AS VARCHAR) AS item_id, n, n_obs
FROM (SELECT series_name, variate_name, count(*) AS n, count(y) AS n_obs FROM nd GROUP BY 1, 2)""")
def to_univariate(spark, sf):
    return nested.to_univariate(_orders_nested(spark, sf)).select(
        "item_id", F.size("target").cast("bigint").alias("n"), F.size(F.array_compact("target")).cast("bigint").alias("n_obs"))


@query("nested_lengths", sql=f"WITH {_GRID_SQL} SELECT series_name AS item_id, count(*) // 5 AS n, CAST(5 AS BIGINT) AS dims FROM nd GROUP BY 1")
def nested_lengths(spark, sf):
    return nested.lengths(_orders_nested(spark, sf))


# --- Files -----------------------------------------------------------------------------

@query("read_wide_csv", sql=f"WITH {LONG_SQL} SELECT unique_id, ds, y FROM l")
def read_wide_csv(spark, sf):
    """Write the wide orders as CSV, one folder of files, and read them back."""
    folder = work_folder(spark, "wide")
    named = orders_wide(spark, sf).withColumnsRenamed({"timestamp": "order_date", "series_name": "status"})
    named.write.option("header", True).csv(folder)
    back = wide.read_wide_csv(spark, folder, schema=T.StructType([T.StructField("status", T.StringType())])).drop("series_name")
    return shape.to_panel(back, ["status"], "timestamp").select("unique_id", "ds", "y")


@query("read_wide_csv_headers", sql=f"""WITH {LONG_SQL}
SELECT unique_id, ds, y FROM l WHERE unique_id LIKE 'F_%' AND unique_id <> 'F_1-URGENT' OR unique_id IN ('O_1-URGENT', 'O_5-LOW')""")
def read_wide_csv_headers(spark, sf):
    """Two sets of files with different columns in different order, read by one call."""
    folder = work_folder(spark, "wide")
    rows = orders_wide(spark, sf).withColumnsRenamed({"timestamp": "order_date", "series_name": "status"})
    for status, columns in (("F", PRIORITIES[1:]), ("O", [PRIORITIES[-1], PRIORITIES[0]])):
        rows.where(F.col("status") == status).select("order_date", "status", *[f"`{c}`" for c in columns]).write.option(
            "header", True).csv(f"{folder}/{status}")
    back = wide.read_wide_csv(spark, f"{folder}/*", schema=T.StructType([T.StructField("status", T.StringType())]))
    long = shape.to_panel(back.drop("series_name"), ["status"], "timestamp").select("unique_id", "ds", "y")
    # columns that a file does not have come as NULL rows of its series
    return long.where("unique_id LIKE 'F_%' AND unique_id <> 'F_1-URGENT' OR unique_id IN ('O_1-URGENT', 'O_5-LOW')")


@query("short_series_windows", sql=f"""
WITH {dense_sql("events_6h")}
SELECT unique_id, CAST(n AS BIGINT) AS n, CAST(count(CASE WHEN n >= 119 AND (pos - n + 119) BETWEEN 0 AND 95 THEN 1 END) AS BIGINT) AS steps
FROM f GROUP BY 1, 2""")
def short_series_windows(spark, sf):
    """Test windows per series, and none where the test part does not fit."""
    df = dense(spark, sf, "events_6h")
    labels = windows.test_windows(df.where("core"), 24, 119).groupBy("unique_id").agg(F.count(F.lit(1)).alias("steps"))
    short = windows.short_series(df, 119).withColumn("steps", F.lit(0).cast("bigint"))
    long = df.where("core AND n >= 119").select("unique_id", "n").distinct().join(labels, "unique_id")
    return long.select("unique_id", F.col("n").cast("bigint").alias("n"), "steps").unionByName(
        short.select("unique_id", F.col("n").cast("bigint").alias("n"), "steps"))


@query("write_cleaned", sql=f"WITH p AS ({SQL['orders_daily']}) SELECT unique_id, ds, y, 'orders' AS dataset, 'D' AS freq FROM p")
def write_cleaned(spark, sf):
    folder = work_folder(spark, "cleaned")
    wide.write_cleaned(panel(spark, sf, "orders_daily"), folder, "orders", "D")
    return spark.read.parquet(folder)


@query("write_diagnostics", sql=f"""
WITH {dense_sql('orders_daily')} SELECT unique_id, count(*) AS n, count(y) AS n_obs, 'orders' AS dataset, 'D' AS freq FROM f GROUP BY 1""")
def write_diagnostics(spark, sf):
    folder = work_folder(spark, "diagnostics")
    wide.write_diagnostics(quality.missing_rate(dense(spark, sf, "orders_daily")), folder, "orders", "D")
    return spark.read.json(folder).select("unique_id", "n", "n_obs", "dataset", "freq")


@query("write_features", sql=f"""
WITH {dense_sql('orders_daily')} SELECT unique_id, count(*) AS length FROM f GROUP BY 1""")
def write_features(spark, sf):
    """The second write finds the first one and leaves it alone."""
    folder = work_folder(spark, "features")
    stats = ft.basic_stats(dense(spark, sf, "orders_daily")).select("unique_id", "length")
    wide.write_features(stats, folder, "orders", "D")
    target = wide.write_features(stats.withColumn("length", F.lit(0).cast("bigint")), folder, "orders", "D")
    return spark.read.parquet(target)


# --- Leaderboard --------------------------------------------------------------------------

MODELS = ("seasonal_naive", "naive", "seasonal_naive_long")
BOARD_TASKS = {"events_hourly": "short", "events_hourly_medium": "medium", "orders_daily": "short", "nation_monthly": "short"}


def _season(model: str, task: str) -> int:
    """The baseline uses the season of the task, the long model several of them."""
    m = fc.TASKS[task][1]
    return {"seasonal_naive": m, "naive": 1, "seasonal_naive_long": (2 if m == 12 else 7) * m}[model]


def board_tasks(spark) -> DataFrame:
    """The task table of the board, one row per task and model."""
    rows = []
    for task, term in BOARD_TASKS.items():
        name, m, horizon, test_length, _ = fc.TASKS[task]
        rows += [(name, term, horizon, test_length, m, model, _season(model, task)) for model in MODELS]
    return spark.createDataFrame(rows, "dataset string, task string, horizon bigint, test_length bigint, "
                                       "error_season bigint, model string, season bigint")


def board_grid(spark, sf) -> DataFrame:
    """One dense panel of all datasets of the board."""
    panels, backs = {}, {}
    for task in BOARD_TASKS:
        name, freq = fc.TASKS[task][0], FREQ[fc.TASKS[task][0]]
        backs[freq] = max(backs.get(freq, 1), *(_season(model, task) for model in MODELS))
        panels.setdefault(freq, {})[name] = panel(spark, sf, name).withColumn("dataset", F.lit(name))
    joined = {freq: reduce(DataFrame.unionByName, own.values()) for freq, own in panels.items()}
    return task_plans.dense(joined, backs)


def window_metrics(spark, sf) -> DataFrame:
    """Per-window metrics of all models and tasks, which are rows of one table."""
    scored = task_plans.evaluate(grid.materialize(board_grid(spark, sf)), board_tasks(spark))
    freqs = {name: FREQ[name] for name in sorted({fc.TASKS[task][0] for task in BOARD_TASKS})}
    freq = F.create_map(*(F.lit(x) for pair in freqs.items() for x in pair))[F.col("dataset")]
    return scored.withColumnRenamed("task", "horizon").withColumn("freq", freq)


def _window_metrics_sql() -> str:
    parts = []
    for task, horizon in BOARD_TASKS.items():
        name = fc.TASKS[task][0]
        for model in MODELS:
            parts.append(f"SELECT '{model}' AS model, '{name}' AS dataset, '{FREQ[name]}' AS freq, '{horizon}' AS horizon, * "
                         f"FROM (WITH {fc.metrics_sql(task, _season(model, task))} SELECT * FROM met)")
    return "wm AS (" + " UNION ALL ".join(parts) + ")"


LEVEL_SQL = f"""{_window_metrics_sql()},
dl AS (SELECT model, dataset, freq, horizon, dataset || '/' || freq AS dataset_id, avg("MASE") AS "MASE", avg("CRPS") AS "CRPS",
              avg("MAE") AS "MAE", avg("MSE") AS "MSE" FROM wm GROUP BY 1, 2, 3, 4)"""
RANK_SQL = f"""{LEVEL_SQL},
rk AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, horizon ORDER BY "MASE", model) AS "MASE_rank",
              row_number() OVER (PARTITION BY dataset_id, horizon ORDER BY "CRPS", model) AS "CRPS_rank" FROM dl)"""
NORM_SQL = f"""{RANK_SQL},
nm AS (SELECT rk.model, rk.dataset_id, rk.horizon, rk."MASE" / b."MASE" AS "MASE", rk."CRPS" / b."CRPS" AS "CRPS"
       FROM rk JOIN rk b ON b.model = 'seasonal_naive' AND b.dataset_id = rk.dataset_id AND b.horizon = rk.horizon)"""


def board(spark, sf) -> DataFrame:
    return grid.materialize(leaderboard.dataset_level_results(window_metrics(spark, sf)))


@query("write_read_results", sql=f"""
WITH {fc.metrics_sql('supplier_weekly')}
SELECT 'seasonal_naive' AS model, 'supplier_weekly' AS dataset, 'W-MON' AS freq, 'short' AS horizon, unique_id, window_idx,
       {R('"MAE"')} AS "MAE" FROM met""")
def write_read_results(spark, sf):
    folder = work_folder(spark, "results")
    scored = fc.metrics_of(spark, sf, "supplier_weekly")
    results.write_results(scored, folder, "supplier_weekly", "W-MON", "short")
    back = results.read_results(spark, folder, "seasonal_naive")
    return back.select("model", "dataset", "freq", "horizon", "unique_id", "window_idx", rounded("MAE").alias("MAE"))


@query("write_read_quantiles", sql=f"""
WITH {filled_sql('nation_monthly')},{fc.naive_sql('nation_monthly')}
SELECT 'seasonal_naive' AS model, 'nation_monthly' AS dataset, 'MS' AS freq, 'short' AS horizon, unique_id, window_idx, step, q,
       round(y_hat, 4) AS y_hat FROM (
  SELECT unique_id, window_idx, step, unnest({fc.LEVELS}) AS q, point + spread * unnest({fc.Z}) AS y_hat FROM fc)""")
def write_read_quantiles(spark, sf):
    """Quantile forecasts written in long form under model, dataset, frequency and horizon, and read back."""
    folder = work_folder(spark, "quantiles")
    made = fc.forecasts_of(fc.task_panel(spark, sf, "nation_monthly"), "nation_monthly")
    results.write_results(forecast.explode_quantiles(made), folder, "nation_monthly", "MS", "short")
    return results.read_results(spark, folder, "seasonal_naive").select(
        "model", "dataset", "freq", "horizon", "unique_id", "window_idx", "step", "q", rounded("y_hat", 4).alias("y_hat"))


@query("write_config", sql=f"""
WITH {fc.metrics_sql('supplier_weekly')}
SELECT 'seasonal_naive' AS model, 'supplier_weekly' AS dataset, 'W-MON' AS freq, 'short' AS horizon,
       count(DISTINCT unique_id) AS num_series, CAST(1 AS BIGINT) AS num_variates, count(DISTINCT window_idx) AS num_windows,
       CAST(13 AS BIGINT) AS prediction_length FROM met""")
def write_config(spark, sf):
    """The configuration of a result, written as JSON and read back."""
    folder = work_folder(spark, "config")
    scored = fc.metrics_of(spark, sf, "supplier_weekly")
    results.write_config(scored, folder, "supplier_weekly", "W-MON", "short", {"prediction_length": 13})
    return spark.read.json(folder).select("model", "dataset", "freq", "horizon", "num_series", "num_variates", "num_windows",
                                          "prediction_length")


@query("dataset_level_results", sql=f"""
WITH {LEVEL_SQL} SELECT model, dataset, freq, horizon, dataset_id, {R('"MASE"')} AS "MASE", {R('"CRPS"')} AS "CRPS",
  {R('"MAE"')} AS "MAE", {R('"MSE"', 0)} AS "MSE" FROM dl""")
def dataset_level_results(spark, sf):
    out = leaderboard.dataset_level_results(window_metrics(spark, sf))
    return out.select("model", "dataset", "freq", "horizon", "dataset_id", rounded("MASE").alias("MASE"), rounded("CRPS").alias("CRPS"),
                      rounded("MAE").alias("MAE"), rounded("MSE", 0).alias("MSE"))


@query("union_results", sql=f"WITH {LEVEL_SQL} SELECT model, dataset_id, horizon, {R('\"MASE\"')} AS \"MASE\" FROM dl")
def union_results(spark, sf):
    """Own results joined with the baseline's, which they contain already."""
    own = board(spark, sf)
    merged = leaderboard.union_results(own, own.where(F.col("model") == leaderboard.BASELINE))
    return merged.select("model", "dataset_id", "horizon", rounded("MASE").alias("MASE"))


@query("compute_ranks", sql=f"""
WITH {RANK_SQL} SELECT model, dataset_id, horizon, CAST("MASE_rank" AS DOUBLE) AS "MASE_rank", CAST("CRPS_rank" AS DOUBLE) AS "CRPS_rank" FROM rk""")
def compute_ranks(spark, sf):
    return leaderboard.compute_ranks(board(spark, sf)).select("model", "dataset_id", "horizon", "MASE_rank", "CRPS_rank")


@query("normalize_by_baseline", sql=f"""
WITH {NORM_SQL} SELECT model, dataset_id, horizon, {R('"MASE"')} AS "MASE", {R('"CRPS"')} AS "CRPS" FROM nm""")
def normalize_by_baseline(spark, sf):
    out = leaderboard.normalize_by_baseline(board(spark, sf))
    return out.select("model", "dataset_id", "horizon", rounded("MASE").alias("MASE"), rounded("CRPS").alias("CRPS"))


@query("geometric_mean", sql=f"""
WITH {NORM_SQL} SELECT model, {R('exp(avg(ln("MASE")))')} AS "MASE", {R('exp(avg(ln("CRPS")))')} AS "CRPS" FROM nm GROUP BY 1""")
def geometric_mean(spark, sf):
    normal = leaderboard.normalize_by_baseline(board(spark, sf))
    return normal.groupBy("model").agg(rounded(leaderboard.geometric_mean("MASE")).alias("MASE"),
                                       rounded(leaderboard.geometric_mean("CRPS")).alias("CRPS"))


@query("average_rank", sql=f"""
WITH {NORM_SQL} SELECT model, {R('avg("MASE_rank")')} AS "MASE_rank", {R('avg("CRPS_rank")')} AS "CRPS_rank" FROM rk
WHERE EXISTS (SELECT 1 FROM nm WHERE nm.dataset_id = rk.dataset_id AND nm.horizon = rk.horizon) GROUP BY 1""")
def average_rank(spark, sf):
    ranked = leaderboard.compute_ranks(board(spark, sf))
    out = leaderboard.average_rank(ranked, leaderboard.normalize_by_baseline(ranked))
    return out.select("model", rounded("MASE_rank").alias("MASE_rank"), rounded("CRPS_rank").alias("CRPS_rank"))


@query("overall_leaderboard", sql=f"""
WITH {NORM_SQL}, g AS (SELECT model, exp(avg(ln("MASE"))) AS a, exp(avg(ln("CRPS"))) AS b FROM nm GROUP BY 1),
r AS (SELECT model, avg("MASE_rank") AS c, avg("CRPS_rank") AS d FROM rk GROUP BY 1)
SELECT model, round(a, 3) AS "MASE (norm.)", round(b, 3) AS "CRPS (norm.)", round(c, 3) AS "MASE_rank", round(d, 3) AS "CRPS_rank"
FROM g LEFT JOIN r USING (model) ORDER BY 2, 1""")
def overall_leaderboard(spark, sf):
    return leaderboard.overall_leaderboard(leaderboard.compute_ranks(board(spark, sf)))
