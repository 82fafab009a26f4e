"""Queries for forecasts and their metrics, with check SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.operators import forecast, grid, metrics, windows
from panelmill.plans.panels import FREQ, dense_sql, filled_sql, panel
from panelmill.plans.registry import R, query, rounded

# (panel, season, horizon, test length, validation length)
TASKS = {
    "events_hourly": ("events_hourly", 24, 24, 168, 168),
    "events_hourly_medium": ("events_hourly", 24, 48, 168, 168),
    "orders_daily": ("orders_daily", 7, 30, 365, 90),
    "supplier_weekly": ("supplier_weekly", 1, 13, 52, 13),
    "nation_monthly": ("nation_monthly", 12, 12, 24, 12),
}
MULTIVARIATE_CONTEXT = 48
# The same z-values on both sides.
Z = "[-1.2815515655446004, -0.8416212335729143, -0.5244005127080407, -0.2533471031357997, 0.0, " \
    "0.2533471031357997, 0.5244005127080407, 0.8416212335729143, 1.2815515655446004]"
LEVELS = "[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]"


def task_panel(spark, sf: str, task: str, back: int | None = None) -> DataFrame:
    name, season = TASKS[task][:2]
    return grid.dense(panel(spark, sf, name), FREQ[name], back=season if back is None else back)


def labels_of(df: DataFrame, task: str) -> DataFrame:
    _, _, horizon, test_length, _ = TASKS[task]
    return windows.test_windows(df.where("core"), horizon, test_length)


def forecasts_of(df: DataFrame, task: str, season: int | None = None, model: str = "seasonal_naive") -> DataFrame:
    _, m, horizon, test_length, _ = TASKS[task]
    return forecast.seasonal_naive(df, season or m, horizon, test_length, model=model)


def metrics_of(spark, sf: str, task: str, season: int | None = None, model: str = "seasonal_naive") -> DataFrame:
    """Metrics of a seasonal naive model; the scaled error always uses the task's own season."""
    _, m, horizon, test_length, _ = TASKS[task]
    df = grid.materialize(task_panel(spark, sf, task, back=max(m, season or m)))
    errors = metrics.seasonal_error(df, m, horizon, test_length)
    return metrics.evaluate(forecasts_of(df, task, season, model), labels_of(df, task), errors)


# --- SQL pieces ------------------------------------------------------------

def labels_sql(task: str) -> str:
    name, _, h, t, _ = TASKS[task]
    return f"""
lab AS (SELECT unique_id, CAST((pos - (n - {t})) // {h} AS BIGINT) AS window_idx,
               CAST((pos - (n - {t})) % {h} + 1 AS BIGINT) AS step, pos, n, ds, y
        FROM f WHERE pos >= n - {t} AND (pos - (n - {t})) // {h} < {max(1, t // h)})"""


def naive_sql(task: str, season: int | None = None) -> str:
    """CTE `fc`: point forecast and spread of every step."""
    _, m, h, t, _ = TASKS[task]
    m = season or m
    return f"""
res AS (SELECT unique_id, pos, n, yf, yf - lag(yf, {m}) OVER (PARTITION BY unique_id ORDER BY pos) AS r FROM h),
cum AS (SELECT *, sum(r * r) OVER (PARTITION BY unique_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS ss FROM res),
org AS (SELECT unique_id, n, w AS window_idx, n - {t} + w * {h} AS o
        FROM (SELECT DISTINCT unique_id, n FROM f), range({max(1, t // h)}) AS q(w)),
sig AS (SELECT org.*, sqrt(ss / (o - {m})) AS sigma FROM org JOIN cum ON cum.unique_id = org.unique_id AND pos = o - 1),
fc AS (SELECT sig.unique_id, CAST(window_idx AS BIGINT) AS window_idx, CAST(s AS BIGINT) AS step, yf AS point,
              sigma * sqrt((s - 1) // {m} + 1) AS spread
       FROM sig, range(1, {h} + 1) AS q(s), res
       WHERE res.unique_id = sig.unique_id AND res.pos = o - {m} + (s - 1) % {m})"""


def error_sql(task: str) -> str:
    """CTE `err`: the seasonal error before every origin."""
    _, m, h, t, _ = TASKS[task]
    return f"""
clo AS (SELECT unique_id, pos, n, abs(y - lag(y, {m}) OVER (PARTITION BY unique_id ORDER BY pos)) AS d
        FROM f WHERE y IS NOT NULL),
err AS (SELECT o.unique_id, CAST(o.w AS BIGINT) AS window_idx,
               avg(CASE WHEN clo.pos < o.n - {t} + o.w * {h} THEN d END) AS seasonal_error
        FROM (SELECT DISTINCT unique_id, n, w FROM f, range({max(1, t // h)}) AS q(w)) o
        JOIN clo ON clo.unique_id = o.unique_id GROUP BY 1, 2)"""


def metrics_sql(task: str, season: int | None = None) -> str:
    """CTE `met`: the eight metrics per window."""
    name = TASKS[task][0]
    return f"""{filled_sql(name)},{labels_sql(task)},{naive_sql(task, season)},{error_sql(task)},
pt AS (SELECT unique_id, window_idx, y, abs(y - point) AS e, abs(y) AS ay, abs(point) AS ap,
              list_sum(list_transform(range(1, 10),
                lambda i: 2 * abs((y - (point + list_extract({Z}, i) * spread))
                  * ((CASE WHEN point + list_extract({Z}, i) * spread >= y THEN 1.0 ELSE 0.0 END)
                     - list_extract({LEVELS}, i))))) AS loss
       FROM lab JOIN fc USING (unique_id, window_idx, step) WHERE y IS NOT NULL),
ids AS (SELECT DISTINCT unique_id, window_idx FROM fc),
met AS (SELECT unique_id, window_idx, avg(e * e) AS "MSE", avg(e) AS "MAE", sqrt(avg(e * e)) AS "RMSE",
               avg(CASE WHEN ay > 0 THEN e / ay END) AS "MAPE",
               avg(CASE WHEN ay + ap > 0 THEN 2 * e / (ay + ap) END) AS "sMAPE",
               avg(e) / max(CASE WHEN seasonal_error > 0 THEN seasonal_error END) AS "MASE",
               sum(e) / nullif(sum(ay), 0) AS "ND", sum(loss) / 9 / nullif(sum(ay), 0) AS "CRPS"
        FROM ids LEFT JOIN pt USING (unique_id, window_idx) LEFT JOIN err USING (unique_id, window_idx)
        GROUP BY 1, 2)"""


# --- Forecasts -------------------------------------------------------------

@query("flagship_event_scores", sql=f"""
WITH {metrics_sql('events_hourly')}
SELECT 'seasonal_naive' AS model, unique_id, {R('avg("MASE")')} AS "MASE", {R('avg("CRPS")')} AS "CRPS"
FROM met GROUP BY unique_id""")
def flagship_event_scores(spark, sf):
    """MASE and CRPS of the seasonal naive forecast per event type."""
    scores = metrics.metric_summary(metrics_of(spark, sf, "events_hourly"), ["model", "unique_id"])
    return scores.select("model", "unique_id", rounded("MASE").alias("MASE"), rounded("CRPS").alias("CRPS"))


@query("evaluate_incomplete", sql=f"""
WITH {metrics_sql('events_hourly')}
SELECT unique_id, window_idx, CASE WHEN window_idx % 2 = 0 THEN {R('"MAE"')} END AS "MAE",
       CAST(CASE WHEN window_idx % 2 = 0 THEN 0 WHEN window_idx = 1 THEN 24 ELSE 6 END AS BIGINT) AS missing_steps
FROM met""")
def evaluate_incomplete(spark, sf):
    """A model without window 1 and without the last six steps of the other odd windows."""
    df = grid.materialize(task_panel(spark, sf, "events_hourly"))
    some = forecasts_of(df, "events_hourly").where("window_idx % 2 = 0 OR (window_idx <> 1 AND step <= 18)")
    scored = metrics.evaluate(some, labels_of(df, "events_hourly"), metrics.seasonal_error(df, 24, 24, 168),
                              models=["seasonal_naive"])
    return scored.select("unique_id", "window_idx", rounded("MAE").alias("MAE"), "missing_steps")


@query("ffill_history", sql=f"""
WITH {filled_sql('events_hourly')} SELECT unique_id, ds, yf AS y_hist FROM h""")
def ffill_history(spark, sf):
    return forecast.fill_history(task_panel(spark, sf, "events_hourly", 0)).select("unique_id", "ds", "y_hist")


def _forecast_sql(task: str, season: int | None = None) -> str:
    return f"""
WITH {filled_sql(TASKS[task][0])},{naive_sql(task, season)}
SELECT unique_id, window_idx, step, {R('point', 4)} AS point,
       {R('point - 1.2815515655446004 * spread', 4)} AS q10, {R('point + 1.2815515655446004 * spread', 4)} AS q90
FROM fc"""


def _forecast_columns(df: DataFrame) -> DataFrame:
    q = F.col("quantiles")
    return df.select("unique_id", "window_idx", "step", rounded(q[4], 4).alias("point"),
                     rounded(q[0], 4).alias("q10"), rounded(q[8], 4).alias("q90"))


for _task in ("events_hourly", "orders_daily", "nation_monthly"):
    query(f"seasonal_naive_{_task}", sql=_forecast_sql(_task))(
        lambda spark, sf, task=_task: _forecast_columns(forecasts_of(task_panel(spark, sf, task), task)))


@query("naive_supplier_weekly", sql=_forecast_sql("supplier_weekly", 1))
def naive_supplier_weekly(spark, sf):
    _, _, horizon, test_length, _ = TASKS["supplier_weekly"]
    df = task_panel(spark, sf, "supplier_weekly", 1)
    return _forecast_columns(forecast.naive(df, horizon, test_length))


@query("explode_quantiles", sql=f"""
WITH {filled_sql('events_hourly_medium'.replace('_medium', ''))},{naive_sql('events_hourly_medium')}
SELECT unique_id, window_idx, step, list_extract({LEVELS}, i) AS q,
       {R(f'point + list_extract({Z}, i) * spread', 4)} AS y_hat
FROM fc, range(1, 10) AS k(i)""")
def explode_quantiles(spark, sf):
    long = forecast.explode_quantiles(forecasts_of(task_panel(spark, sf, "events_hourly_medium"), "events_hourly_medium"))
    return long.select("unique_id", "window_idx", "step", "q", rounded("y_hat", 4).alias("y_hat"))


def _inverse_sql() -> str:
    """The value at `u` on the line through the quantiles `qs` of the nine levels."""
    parts = [f"WHEN u <= {i}e0 / 10 THEN qs[{i - 1}] + (qs[{i}] - qs[{i - 1}]) * (u - {i - 1}e0 / 10) / ({i}e0 / 10 - {i - 1}e0 / 10)"
             for i in range(2, 10)]
    return f"CASE WHEN u <= 0.1::DOUBLE THEN qs[1] {' '.join(parts)} ELSE qs[9] END"


@query("sample_from_quantiles", sql=f"""
WITH {filled_sql('events_hourly')},{naive_sql('events_hourly')},
pth AS (SELECT unique_id, window_idx, step, sample, list_transform({Z}, lambda z: point + z * spread) AS qs,
               CAST('0x' || substr(md5(unique_id || ':' || window_idx || ':' || sample || ':7'), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
        FROM fc, range(1, 101) AS k(sample))
SELECT 'seasonal_naive' AS model, unique_id, window_idx, step, sample, {R(_inverse_sql(), 4)} AS y_hat FROM pth""")
def sample_from_quantiles(spark, sf):
    fc = forecasts_of(task_panel(spark, sf, "events_hourly"), "events_hourly")
    return forecast.sample_from_quantiles(fc, samples=100, seed=7).withColumn("y_hat", rounded("y_hat", 4))


_HOURS = "SELECT event_type, hour(ts) AS hour_of_day, value AS y_hat FROM events"


def _value_samples(spark, sf):
    """The recorded values of one hour of the day, taken as samples of one step."""
    return spark.read.parquet(f"{sf}/events.parquet").select(
        "event_type", F.hour("ts").cast("bigint").alias("hour_of_day"), F.col("value").alias("y_hat"))


@query("samples_to_quantiles", sql=f"""
WITH s AS ({_HOURS}), q AS (SELECT event_type, hour_of_day, quantile_cont(y_hat, {LEVELS}) AS qs FROM s GROUP BY 1, 2)
SELECT event_type, hour_of_day, {R('list_extract(qs, 1)')} AS q10, {R('list_extract(qs, 5)')} AS q50,
       {R('list_extract(qs, 9)')} AS q90 FROM q""")
def samples_to_quantiles(spark, sf):
    out = forecast.samples_to_quantiles(_value_samples(spark, sf), ["event_type", "hour_of_day"])
    q = F.col("quantiles")
    return out.select("event_type", "hour_of_day", rounded(q[0]).alias("q10"), rounded(q[4]).alias("q50"),
                      rounded(q[8]).alias("q90"))


@query("sample_mean_median", sql=f"""
SELECT event_type, hour_of_day, {R('avg(y_hat)')} AS sample_mean, {R('quantile_cont(y_hat, 0.5)')} AS sample_median
FROM ({_HOURS}) GROUP BY 1, 2""")
def sample_mean_median(spark, sf):
    out = forecast.sample_mean_median(_value_samples(spark, sf), ["event_type", "hour_of_day"])
    return out.select("event_type", "hour_of_day", rounded("sample_mean").alias("sample_mean"),
                      rounded("sample_median").alias("sample_median"))


@query("unflatten_index", sql="""
SELECT event_id, event_id % 7 AS window_idx, (event_id // 7) // 5 AS series_idx, (event_id // 7) % 5 AS variate_idx
FROM events""")
def unflatten_index(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id")
    return forecast.unflatten_index(events, "event_id", n_windows=7, n_variates=5)


@query("check_forecast_shape", sql=f"""
WITH {filled_sql('nation_monthly')},{naive_sql('nation_monthly')}
SELECT unique_id, window_idx, count(DISTINCT step) AS n_steps, CAST(9 AS BIGINT) AS min_quantiles,
       CAST(9 AS BIGINT) AS max_quantiles, count(DISTINCT step) = 12 AS ok FROM fc GROUP BY 1, 2""")
def check_forecast_shape(spark, sf):
    fc = forecasts_of(task_panel(spark, sf, "nation_monthly"), "nation_monthly")
    return forecast.check_forecast_shape(fc, n_levels=9, horizon=12).drop("model")


def running_mean(contexts: list[np.ndarray], horizon: int) -> np.ndarray:
    """A user forecaster: the mean of the context at every step."""
    return np.repeat(np.array([[c.mean()] for c in contexts]), horizon, axis=1)


def _mean_of_context(name: str, task: str, length: int) -> None:
    _, _, horizon, test_length, _ = TASKS[task]

    @query(name, sql=f"""
WITH {filled_sql(task)},
org AS (SELECT unique_id, n, w AS window_idx, n - {test_length} + w * {horizon} AS o
        FROM (SELECT DISTINCT unique_id, n FROM f), range({test_length // horizon}) AS q(w)),
ctx AS (SELECT org.unique_id, window_idx, pos, y, o,
               last_value(y IGNORE NULLS) OVER b AS fy, last_value(CASE WHEN y IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS fp,
               first_value(y IGNORE NULLS) OVER a AS ny, first_value(CASE WHEN y IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS bp
        FROM org JOIN f ON f.unique_id = org.unique_id AND pos < o AND pos >= o - {length}
        WINDOW b AS (PARTITION BY org.unique_id, window_idx ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
               a AS (PARTITION BY org.unique_id, window_idx ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
imp AS (SELECT unique_id, window_idx, avg(coalesce(y, fy + (ny - fy) * (pos - fp) / nullif(bp - fp, 0), fy, ny, 0.0)) AS m
        FROM ctx GROUP BY 1, 2)
SELECT unique_id, CAST(window_idx AS BIGINT) AS window_idx, CAST(s AS BIGINT) AS step, {R('m')} AS q10, {R('m')} AS q50
FROM imp, range(1, {horizon + 1}) AS q(s)""")
    def run(spark, sf):
        out = forecast.forecast_with(task_panel(spark, sf, task, 0), running_mean, horizon, test_length, context_length=length, model="mean")
        return out.select("unique_id", "window_idx", "step", rounded(F.col("quantiles")[0]).alias("q10"),
                          rounded(F.col("quantiles")[4]).alias("q50"))


_mean_of_context("forecast_with_mean", "supplier_weekly", 60)
_mean_of_context("forecast_with_long_context", "events_hourly", 512)


def half_way(contexts: list[np.ndarray], horizon: int) -> list[np.ndarray]:
    """A multivariate user forecaster: half way between the last value and that of all variates."""
    return [np.repeat((c[:, -1:] + c[:, -1].mean()) / 2, horizon, axis=1) for c in contexts]


@query("forecast_multivariate", sql=f"""
WITH {dense_sql('events_hourly')},
org AS (SELECT unique_id, n, w AS window_idx, n - 168 + w * 24 AS o FROM (SELECT DISTINCT unique_id, n FROM f), range(7) AS q(w)),
lst AS (SELECT org.unique_id, window_idx, coalesce(arg_max(y, pos) FILTER (WHERE y IS NOT NULL), 0.0) AS v
        FROM org JOIN f ON f.unique_id = org.unique_id AND pos < o AND pos >= o - {MULTIVARIATE_CONTEXT} GROUP BY 1, 2),
m AS (SELECT *, avg(v) OVER (PARTITION BY window_idx) AS g FROM lst)
SELECT unique_id, CAST(window_idx AS BIGINT) AS window_idx, CAST(s AS BIGINT) AS step, {R('(v + g) / 2')} AS q50
FROM m, range(1, 25) AS q(s)""")
def forecast_multivariate(spark, sf):
    """The event types as the variates of one series."""
    _, _, horizon, test_length, _ = TASKS["events_hourly"]
    df = task_panel(spark, sf, "events_hourly", 0)
    info = panel(spark, sf, "events_hourly").select(
        "unique_id", F.lit("events").alias("series_name"), F.col("unique_id").alias("variate_name")).distinct()
    out = forecast.forecast_multivariate(df, info, half_way, horizon, test_length, MULTIVARIATE_CONTEXT, model="half_way")
    return out.select("unique_id", "window_idx", "step", rounded(F.col("quantiles")[4]).alias("q50"))


# --- Metrics ---------------------------------------------------------------

# Decimals by the size of the values.
_DIGITS = {"MSE": 0, "MAE": 6, "RMSE": 4}


def _metric_query(name: str, task: str, columns: list[str]) -> None:
    picked = ", ".join(f'{R(chr(34) + c + chr(34), _DIGITS.get(c, 6))} AS "{c}"' for c in columns)

    @query(name, sql=f"WITH {metrics_sql(task)} SELECT unique_id, window_idx, {picked} FROM met")
    def run(spark, sf):
        out = metrics_of(spark, sf, task)
        return out.select("unique_id", "window_idx", *[rounded(c, _DIGITS.get(c, 6)).alias(c) for c in columns])


for _metric in metrics.METRICS:
    _metric_query(f"metric_{_metric.lower()}", "events_hourly", [_metric])
for _task in ("events_hourly_medium", "orders_daily", "supplier_weekly", "nation_monthly"):
    _metric_query(f"window_metrics_{_task}", _task, metrics.METRICS)


@query("seasonal_error", sql=f"""
WITH {dense_sql('orders_daily')},{error_sql('orders_daily')}
SELECT unique_id, window_idx, {R('seasonal_error', 4)} AS seasonal_error FROM err""")
def seasonal_error(spark, sf):
    _, m, horizon, test_length, _ = TASKS["orders_daily"]
    out = metrics.seasonal_error(task_panel(spark, sf, "orders_daily", 0), m, horizon, test_length)
    return out.select("unique_id", "window_idx", rounded("seasonal_error", 4).alias("seasonal_error"))


@query("metric_summary", sql=f"""
WITH {metrics_sql('supplier_weekly')}
SELECT 'seasonal_naive' AS model, """ + ", ".join(
    f'{R(f"avg({chr(34)}{c}{chr(34)})", 4)} AS "{c}"' for c in metrics.METRICS) + " FROM met")
def metric_summary(spark, sf):
    out = metrics.metric_summary(metrics_of(spark, sf, "supplier_weekly"), ["model"])
    return out.select("model", *[rounded(c, 4).alias(c) for c in metrics.METRICS])
