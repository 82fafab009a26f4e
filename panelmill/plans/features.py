"""Queries for the feature operators, with check SQL.

Formulas on components are checked on a decomposition that SQL can also build: a
centred moving average, the mean of each phase, and the rest.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.functions import frequency as fq
from panelmill.functions import numerics
from panelmill.operators import features as ft
from panelmill.operators import grid
from panelmill.operators import panel as shape
from panelmill.plans.panels import FREQ, dense_sql, panel
from panelmill.plans.quality import LINEAR_SQL, dense, orders_wide
from panelmill.plans.registry import R, query, rounded

PERIOD = 7


def prepared(spark, sf, name: str) -> DataFrame:
    return ft.prepared(dense(spark, sf, name))


def prepared_sql(name: str) -> str:
    """CTE `z`: interpolated and scaled."""
    return f"""{dense_sql(name)},{LINEAR_SQL},
mu AS (SELECT unique_id, avg(y) AS m, stddev_samp(y) AS s FROM f GROUP BY 1),
z AS (SELECT unique_id, pos, n, (yl - m) / s AS y FROM lin JOIN mu USING (unique_id))"""


def moving_components(rows: DataFrame, m: int = PERIOD) -> DataFrame:
    half = m // 2
    halo = grid.reblock(rows.drop("block"), "pos", F.lit(grid.BLOCK_STEPS), F.lit(half), F.lit(half))
    smooth = F.avg("y").over(grid.ordered().rowsBetween(-half, half))
    smoothed = halo.withColumn("trend", smooth).where("core").withColumn("phase", F.pmod("pos", F.lit(m)))
    phases = smoothed.groupBy("unique_id", "phase").agg(F.avg(F.col("y") - F.col("trend")).alias("seasonal"))
    return smoothed.join(phases, ["unique_id", "phase"]).select(
        "unique_id", "block", "pos", "n", F.lit(m).cast("bigint").alias("m"), "y", "trend", "seasonal",
        (F.col("y") - F.col("trend") - F.col("seasonal")).alias("remainder"))


def components_sql(name: str = "lineitem_daily", m: int = PERIOD) -> str:
    """CTE `c`: the same components."""
    half = m // 2
    return f"""{prepared_sql(name)},
tr AS (SELECT *, avg(y) OVER (PARTITION BY unique_id ORDER BY pos ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING) AS trend FROM z),
se AS (SELECT *, avg(y - trend) OVER (PARTITION BY unique_id, pos % {m}) AS seasonal FROM tr),
c AS (SELECT *, y - trend - seasonal AS remainder, {m} AS m FROM se)"""


def components(spark, sf) -> DataFrame:
    return moving_components(prepared(spark, sf, "lineitem_daily"))


# --- Raw series ---------------------------------------------------------------

@query("basic_stats", sql=f"""
WITH {dense_sql('orders_daily')}
SELECT unique_id, {R('avg(y)', 3)} AS mean, {R('stddev_pop(y)', 3)} AS std,
       {R('avg(CASE WHEN y IS NULL THEN 1.0 ELSE 0.0 END)')} AS missing_rate, count(*) AS length FROM f GROUP BY 1""")
def basic_stats(spark, sf):
    out = ft.basic_stats(dense(spark, sf, "orders_daily"))
    return out.select("unique_id", rounded("mean", 3).alias("mean"), rounded("std", 3).alias("std"),
                      rounded("missing_rate").alias("missing_rate"), "length")


@query("interpolate_scaled", sql=f"WITH {prepared_sql('orders_daily')} SELECT unique_id, pos, {R('y')} AS y FROM z")
def interpolate_scaled(spark, sf):
    return prepared(spark, sf, "orders_daily").select("unique_id", "pos", rounded("y").alias("y"))


def acf_sql(source: str, value: str, prefix: str) -> str:
    """CTE `ac` over a source with unique_id, pos."""
    def lags(name: str) -> str:
        return ", ".join(f"lag({name}, {k}) OVER w AS {name}{k}" for k in range(1, 11))

    def acf(name: str, k: int) -> str:
        return f"(sum(({name} - m{name}) * ({name}{k} - m{name})) / ((count({name}) - {k}) * max(v{name})))"

    return f"""
a0 AS (SELECT unique_id, pos, {value} AS x, {value} - lag({value}) OVER (PARTITION BY unique_id ORDER BY pos) AS d FROM {source}),
a1 AS (SELECT unique_id, avg(x) AS mx, var_pop(x) AS vx, avg(d) AS md, var_pop(d) AS vd FROM a0 GROUP BY 1),
a2 AS (SELECT unique_id, pos, x, d, {lags('x')}, {lags('d')} FROM a0 WINDOW w AS (PARTITION BY unique_id ORDER BY pos)),
ac AS (SELECT unique_id, {acf('x', 1)} AS {prefix}_acf1, {' + '.join(f"power({acf('x', k)}, 2)" for k in range(1, 11))} AS {prefix}_acf10,
              {acf('d', 1)} AS {prefix}_diff1_acf1, {' + '.join(f"power({acf('d', k)}, 2)" for k in range(1, 11))} AS {prefix}_diff1_acf10
       FROM a2 JOIN a1 USING (unique_id) GROUP BY 1)"""


def _acf_select(prefix: str) -> str:
    return ", ".join(f"{R(f'{prefix}_{c}')} AS {prefix}_{c}" for c in ("acf1", "acf10", "diff1_acf1", "diff1_acf10"))


def _rounded_all(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[rounded(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


@query("acf_features", sql=f"WITH {prepared_sql('supplier_weekly')},{acf_sql('z', 'y', 'x')} SELECT unique_id, {_acf_select('x')} FROM ac")
def acf_features(spark, sf):
    return _rounded_all(ft.acf_features(prepared(spark, sf, "supplier_weekly")))


def _pacf_sql(source: str) -> str:
    steps = [f"""
b0 AS (SELECT unique_id, pos, y AS x0, y - lag(y) OVER w AS x1, y - 2 * lag(y) OVER w + lag(y, 2) OVER w AS x2 FROM {source}
       WINDOW w AS (PARTITION BY unique_id ORDER BY pos)),
bl AS (""" + " UNION ALL ".join(f"SELECT unique_id, {d} AS d, pos, x{d} AS x FROM b0 WHERE pos >= {d}" for d in range(3)) + """),
bc AS (SELECT unique_id, d, pos, x - avg(x) OVER (PARTITION BY unique_id, d) AS x FROM bl),
bp AS (SELECT unique_id, d, x, """ + ", ".join(f"lag(x, {k}) OVER w AS l{k}" for k in range(1, 6)) + """ FROM bc
       WINDOW w AS (PARTITION BY unique_id, d ORDER BY pos)),
s0 AS (SELECT unique_id, d, """ + ", ".join(f"sum(x * l{k}) / sum(x * x) AS r{k}" for k in range(1, 6)) + " FROM bp GROUP BY 1, 2)"]
    for k in range(1, 6):
        top = f"(r{k}" + "".join(f" - f{k - 1}_{j} * r{k - j}" for j in range(1, k)) + ")"
        low = "(1.0" + "".join(f" - f{k - 1}_{j} * r{j}" for j in range(1, k)) + ")"
        steps.append(f"t{k} AS (SELECT *, {top} / {low} AS f{k}_{k} FROM s{k - 1})")
        more = "".join(f", f{k - 1}_{j} - f{k}_{k} * f{k - 1}_{k - j} AS f{k}_{j}" for j in range(1, k))
        steps.append(f"s{k} AS (SELECT *{more} FROM t{k})")
    steps.append("pc AS (SELECT unique_id, d, " + " + ".join(f"power(f{k}_{k}, 2)" for k in range(1, 6)) + " AS p FROM s5)")
    return ",\n".join(steps)


@query("pacf_features", sql=f"""
WITH {prepared_sql('supplier_weekly')},{_pacf_sql('z')}
SELECT unique_id, {R('max(CASE WHEN d = 0 THEN p END)')} AS x_pacf5, {R('max(CASE WHEN d = 1 THEN p END)')} AS diff1x_pacf5,
       {R('max(CASE WHEN d = 2 THEN p END)')} AS diff2x_pacf5 FROM pc GROUP BY 1""")
def pacf_features(spark, sf):
    return _rounded_all(ft.pacf_features(prepared(spark, sf, "supplier_weekly")))


@query("kurtosis", sql=f"WITH {prepared_sql('supplier_weekly')} SELECT unique_id, {R('kurtosis_pop(y)')} AS kurtosis FROM z GROUP BY 1")
def kurtosis(spark, sf):
    return prepared(spark, sf, "supplier_weekly").groupBy("unique_id").agg(rounded(F.kurtosis("y")).alias("kurtosis"))


def block_sql(source: str, value: str, width: str) -> str:
    return f"""
bk AS (SELECT unique_id, pos // {width} AS b, avg({value}) AS mean, var_samp({value}) AS var FROM {source}
       WHERE (pos // {width} + 1) * {width} <= n GROUP BY 1, 2),
bv AS (SELECT unique_id, var_samp(mean) AS stability, var_samp(var) AS lumpiness FROM bk GROUP BY 1)"""


@query("stability", sql=f"WITH {prepared_sql('supplier_weekly')},{block_sql('z', 'y', '13')} SELECT unique_id, {R('stability')} AS stability FROM bv")
def stability(spark, sf):
    out = ft.block_features(prepared(spark, sf, "supplier_weekly"), "y", F.lit(13).cast("bigint"))
    return _rounded_all(out.drop("lumpiness"))


@query("lumpiness", sql=f"WITH {prepared_sql('lineitem_daily')},{block_sql('z', 'y', '10')} SELECT unique_id, {R('lumpiness')} AS lumpiness FROM bv")
def lumpiness(spark, sf):
    out = ft.block_features(prepared(spark, sf, "lineitem_daily"), "y", ft.block_width(F.lit(1)))
    return _rounded_all(out.drop("stability"))


@query("crossing_points", sql=f"""
WITH {prepared_sql('supplier_weekly')}, md AS (SELECT unique_id, quantile_cont(y, 0.5) AS md FROM z GROUP BY 1),
lw AS (SELECT unique_id, pos, y <= md AS low FROM z JOIN md USING (unique_id)),
ch AS (SELECT unique_id, low <> lag(low) OVER (PARTITION BY unique_id ORDER BY pos) AS c FROM lw)
SELECT unique_id, count(CASE WHEN c THEN 1 END) AS crossing_points FROM ch GROUP BY 1""")
def crossing_points(spark, sf):
    return ft.crossing_points(grid.materialize(prepared(spark, sf, "supplier_weekly")))


@query("flat_spots", sql=f"""
WITH {dense_sql('supplier_weekly')},{LINEAR_SQL},
bn AS (SELECT unique_id, pos, greatest(1, ceil((yl - min(yl) OVER s) / (max(yl) OVER s - min(yl) OVER s) * 10)) AS bin FROM lin
       WINDOW s AS (PARTITION BY unique_id)),
rn AS (SELECT unique_id, bin, pos - row_number() OVER (PARTITION BY unique_id, bin ORDER BY pos) AS isle FROM bn),
ln AS (SELECT unique_id, count(*) AS c FROM rn GROUP BY unique_id, bin, isle)
SELECT unique_id, max(c) AS flat_spots FROM ln GROUP BY 1""")
def flat_spots(spark, sf):
    linear = grid.impute_linear(dense(spark, sf, "supplier_weekly"), "v", empty=None)
    return ft.flat_spots(linear.select("unique_id", "block", "pos", "n", "v"), "v")


# --- Spectrum -------------------------------------------------------------------

def spectrum_sql() -> str:
    """CTE `sp`: discrete Fourier magnitudes of the 120-step series."""
    return f"""{prepared_sql('events_6h')},
sp0 AS (SELECT unique_id, n, k, sqrt(power(sum(y * cos(2 * pi() * k * pos / n)), 2) + power(sum(y * sin(2 * pi() * k * pos / n)), 2)) AS a
        FROM z, range(0, 61) AS q(k) WHERE k <= n // 2 GROUP BY 1, 2, 3),
sp AS (SELECT unique_id, n, CAST(k AS BIGINT) AS k, k / n AS f, CASE WHEN k = 0 THEN 0.0 ELSE a END AS magnitude FROM sp0)"""


@query("spectrum", sql=f"WITH {spectrum_sql()} SELECT unique_id, k, {R('magnitude')} AS magnitude FROM sp")
def spectrum(spark, sf):
    return ft.spectrum(prepared(spark, sf, "events_6h")).select("unique_id", "k", rounded("magnitude").alias("magnitude"))


@query("spectrum_in_pieces", sql=f"WITH {spectrum_sql()} SELECT unique_id, k, {R('magnitude')} AS magnitude FROM sp")
def spectrum_in_pieces(spark, sf):
    """The same by two passes over pieces of a series, or by folding with a chirp where its length asks for it."""
    return ft.spectrum(prepared(spark, sf, "events_6h"), block_steps=16).select(
        "unique_id", "k", rounded("magnitude").alias("magnitude"))


def strength_sql() -> str:
    """CTE `ps`: share of the magnitude in each band."""
    bands = " UNION ALL ".join(f"SELECT {i} AS i, {p} AS period, CAST({lo!r} AS DOUBLE) AS lo, CAST({hi!r} AS DOUBLE) AS hi"
                               for i, (p, lo, hi) in enumerate(fq.period_bands("6H")))
    return f"""{spectrum_sql()}, bd AS ({bands}),
ps AS (SELECT unique_id, i, period, coalesce(sum(CASE WHEN f BETWEEN lo AND hi THEN magnitude END), 0) / sum(magnitude) AS strength
       FROM sp, bd WHERE k < n // 2 AND period < n GROUP BY 1, 2, 3)"""


@query("period_strength", sql=f"WITH {strength_sql()} SELECT unique_id, CAST(period AS BIGINT) AS period, {R('strength')} AS strength FROM ps")
def period_strength(spark, sf):
    out = ft.period_strength(ft.spectrum(prepared(spark, sf, "events_6h")), "6H")
    return out.select("unique_id", F.explode("bands").alias("b")).select(
        "unique_id", "b.period", rounded("b.strength").alias("strength"))


def top_sql() -> str:
    ranks = ", ".join(f"max(CASE WHEN rk = {i} THEN CAST(period AS BIGINT) END) AS period{i}, "
                      f"max(CASE WHEN rk = {i} THEN round(strength, 3) END) AS p_strength{i}" for i in (1, 2, 3))
    return f"""{strength_sql()},
pr AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY strength DESC, i) AS rk FROM ps),
tp AS (SELECT unique_id, {ranks} FROM pr GROUP BY 1)"""


def top_periods_of(spark, sf) -> DataFrame:
    return ft.top_periods(ft.period_strength(ft.spectrum(prepared(spark, sf, "events_6h")), "6H"))


@query("top_periods", sql=f"WITH {top_sql()} SELECT * FROM tp")
def top_periods(spark, sf):
    return top_periods_of(spark, sf)


@query("per_series_params", sql=f"""
WITH {top_sql()} SELECT unique_id, period1, count(*) AS n, count(*) // period1 AS cycles FROM z JOIN tp USING (unique_id) GROUP BY 1, 2""")
def per_series_params(spark, sf):
    """Every series with its own period."""
    rows = grid.materialize(prepared(spark, sf, "events_6h"))
    periods = ft.top_periods(ft.period_strength(ft.spectrum(rows), "6H"))
    return grid.attach(rows, periods).groupBy("unique_id", "period1").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "cycles", F.floor(F.col("n") / F.col("period1")).cast("bigint"))


@query("spectral_entropy", sql=f"""
WITH {spectrum_sql()}, pw AS (SELECT unique_id, magnitude * magnitude * (CASE WHEN k BETWEEN 1 AND (n - 1) // 2 THEN 2.0 ELSE 1.0 END) AS p FROM sp),
pn AS (SELECT unique_id, p / sum(p) OVER (PARTITION BY unique_id) AS p FROM pw)
SELECT unique_id, {R('-sum(p * log2(p))')} AS x_entropy FROM pn WHERE p > 0 GROUP BY 1""")
def spectral_entropy(spark, sf):
    return _rounded_all(ft.spectral_entropy(ft.spectrum(prepared(spark, sf, "events_6h"))))


def shapiro_sql() -> str:
    """W of the 6-hour series, with the normal scores of their possible lengths as literals."""
    inverse = NormalDist().inv_cdf
    scores = ", ".join(f"({n}, {i}, {inverse((i - 0.375) / (n + 0.25))!r}::DOUBLE)" for n in range(117, 122) for i in range(1, n + 1))

    def poly(coefficients, end):
        return " + ".join([end, *(f"({c!r}) * power(u, {len(coefficients) - k})" for k, c in enumerate(coefficients))])
    return f"""{prepared_sql('events_6h')}, sc(n, i, m) AS (VALUES {scores}),
rk AS (SELECT unique_id, n, y, row_number() OVER (PARTITION BY unique_id ORDER BY y) AS i FROM z),
ws AS (SELECT rk.*, m, sum(m * m) OVER w AS mm, max(m) OVER w AS top, max(CASE WHEN rk.i = rk.n - 1 THEN m END) OVER w AS second,
              1 / sqrt(rk.n) AS u FROM rk JOIN sc ON sc.n = rk.n AND sc.i = rk.i WINDOW w AS (PARTITION BY unique_id)),
wl AS (SELECT *, {poly(numerics.SHAPIRO_LAST, 'top / sqrt(mm)')} AS a1, {poly(numerics.SHAPIRO_NEXT, 'second / sqrt(mm)')} AS a2 FROM ws),
wa AS (SELECT *, CASE WHEN i = n THEN a1 WHEN i = 1 THEN -a1 WHEN i = n - 1 THEN a2 WHEN i = 2 THEN -a2
              ELSE m / sqrt((mm - 2 * top * top - 2 * second * second) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) END AS a FROM wl)"""


for _name, _steps in (("shapiro_w", grid.BLOCK_STEPS), ("shapiro_w_by_ranges", 16)):
    query(_name, sql=f"""WITH {shapiro_sql()}
SELECT unique_id, {R('power(sum(a * y), 2) / (var_pop(y) * count(*))')} AS shapiro_w FROM wa GROUP BY 1""")(
        lambda spark, sf, steps=_steps: _rounded_all(ft.shapiro_w(
            grid.materialize(ft.prepared(dense(spark, sf, "events_6h", block_steps=steps))), block_steps=steps)))


@query("hurst", sql=f"""
WITH {prepared_sql('events_6h')},
cs AS (SELECT unique_id, pos + 1 AS t, sum(y) OVER w AS s, avg(y) OVER w AS m, stddev_pop(y) OVER w AS sd FROM z
       WINDOW w AS (PARTITION BY unique_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
rg AS (SELECT a.unique_id, a.t, max(b.s - b.t * a.m) - min(b.s - b.t * a.m) AS r, any_value(a.sd) AS sd
       FROM cs a JOIN cs b ON a.unique_id = b.unique_id AND b.t <= a.t WHERE a.t > 1 GROUP BY 1, 2)
SELECT unique_id, {R('regr_slope(ln(r / sd), ln(t))')} AS hurst FROM rg GROUP BY 1""")
def hurst(spark, sf):
    return _rounded_all(ft.hurst(prepared(spark, sf, "events_6h")))


# --- Features of components ---------------------------------------------------------

def _component_query(column: str, sql: str, digits: int = 6) -> None:
    @query(column, sql=f"WITH {components_sql()} SELECT unique_id, {R(sql, digits)} AS {column} FROM c GROUP BY 1")
    def run(spark, sf):
        return _rounded_all(ft.component_features(components(spark, sf)).select("unique_id", column), digits)


_component_query("trend_strength", "greatest(0, least(1, 1 - var_samp(remainder) / var_samp(y - seasonal)))")
_component_query("seasonal_strength", "greatest(0, least(1, 1 - var_samp(remainder) / var_samp(remainder + seasonal)))")
_T = "(pos - (n - 1) / 2)"
_S2 = f"sum({_T} * {_T})"
_component_query("linearity", f"sum(trend * {_T}) / sqrt({_S2})")
_component_query("curvature", f"(sum(trend * {_T} * {_T}) - {_S2} / count(*) * sum(trend)) / "
                              f"sqrt(sum(power({_T}, 4)) - {_S2} * {_S2} / count(*))")


@query("spike", sql=f"""
WITH {components_sql()},
q AS (SELECT unique_id, n, power(remainder - avg(remainder) OVER s, 2) AS d, var_samp(remainder) OVER s AS v FROM c
      WINDOW s AS (PARTITION BY unique_id))
SELECT unique_id, {R('var_samp((v * (n - 1) - d) / (n - 2))', 12)} AS spike FROM q GROUP BY 1""")
def spike(spark, sf):
    return _rounded_all(ft.component_features(components(spark, sf)).select("unique_id", "spike"), 12)


@query("residual_acf", sql=f"WITH {components_sql()},{acf_sql('c', 'remainder', 'e')} SELECT unique_id, {_acf_select('e')} FROM ac")
def residual_acf(spark, sf):
    return _rounded_all(ft.acf_features(components(spark, sf), "remainder", "e"))


@query("seasonal_corr", sql=f"""
WITH {components_sql()},
cy AS (SELECT unique_id, pos // 7 AS c, pos % 7 AS ph, seasonal + 0.3 * trend AS v FROM c WHERE (pos // 7 + 1) * 7 <= n),
pr AS (SELECT a.unique_id, a.c, b.c AS c2, corr(a.v, b.v) AS r FROM cy a JOIN cy b ON a.unique_id = b.unique_id AND a.ph = b.ph AND a.c < b.c
       GROUP BY 1, 2, 3)
SELECT unique_id, {R('avg(r)')} AS seasonal_corr FROM pr GROUP BY 1""")
def seasonal_corr(spark, sf):
    """On a season mixed with some trend, since a pure phase mean repeats exactly."""
    mixed = components(spark, sf).withColumn("seasonal", F.col("seasonal") + 0.3 * F.col("trend"))
    return _rounded_all(ft.seasonal_corr(mixed))


# --- Decomposition and sequential features: rows only -----------------------------------

def _decomposed(spark, sf, name: str, method: str) -> DataFrame:
    rows = grid.materialize(prepared(spark, sf, name))
    periods = ft.top_periods(ft.period_strength(ft.spectrum(rows), FREQ[name]))
    return ft.decompose(rows, periods, FREQ[name], method)


def _loess_sql(source: str, span: int, out: str, extend: int = 0) -> list[str]:
    """CTE `out` `(unique_id, g, i, v)`: a local line with tricube weights over the nearest `span` points at every place `i`
    of the groups `g` of `source` `(unique_id, g, i, v, m)`, which have m points, and `extend` places beyond both ends."""
    beyond = "".join(f" UNION ALL SELECT DISTINCT unique_id, g, m, {place} FROM {source}"
                     for k in range(1, extend + 1) for place in (f"-{k}", f"m + {k - 1}"))
    return [f"{out}a AS MATERIALIZED (SELECT unique_id, g, m, i FROM {source}{beyond})",
            f"{out}b AS (SELECT *, least({span}, m) AS width, greatest({span} - m, 0) // 2 AS extra, "
            f"greatest(0, least(i - ((least({span}, m) + 1) // 2 - 1), m - least({span}, m))) AS lo FROM {out}a)",
            f"{out}c AS (SELECT *, greatest(i - lo, lo + width - 1 - i) + extra AS reach, "
            f"CAST(unnest(generate_series(CAST(lo AS BIGINT), CAST(lo + width - 1 AS BIGINT))) AS BIGINT) AS j FROM {out}b)",
            f"{out}d AS (SELECT c.unique_id, c.g, c.i, c.m, c.j - c.i AS d, s.v, abs(c.j - c.i) / c.reach AS share "
            f"FROM {out}c c JOIN {source} s ON c.unique_id = s.unique_id AND c.g = s.g AND c.j = s.i)",
            f"{out}e AS (SELECT *, CASE WHEN share <= 0.001 THEN 1e0 WHEN share <= 0.999 THEN power(1 - power(share, 3), 3) ELSE 0e0 END AS w FROM {out}d)",
            f"{out}f AS (SELECT unique_id, g, i, any_value(m) AS m, sum(w * v) / sum(w) AS a, sum(w * d) / sum(w) AS cd, "
            f"sum(w * d * d) / sum(w) - power(sum(w * d) / sum(w), 2) AS spread, sum(w * d * v) / sum(w) AS dv FROM {out}e GROUP BY 1, 2, 3)",
            f"{out} AS MATERIALIZED (SELECT unique_id, g, i, CASE WHEN sqrt(greatest(spread, 0)) > 0.001 * (m - 1) "
            f"THEN a - cd / spread * (dv - cd * a) ELSE a END AS v FROM {out}f)"]


def stl_sql(source: str, period: int, out: str, seasonal: int = numerics.STL_SEASONAL_SPAN) -> list[str]:
    """CTE `out` `(unique_id, pos, n, y, trend, seasonal)`: the loops of STL, written out one after another."""
    trend, low = numerics.stl_spans(period, seasonal)
    ctes = [f"{out}t0 AS (SELECT unique_id, pos, n, y, 0e0 AS trend, 0e0 AS seasonal FROM {source})"]

    def mean(table: str, width: int, name: str) -> str:
        return (f"{name} AS (SELECT unique_id, i, v FROM (SELECT unique_id, i, avg(v) OVER w AS v, count(*) OVER w AS c FROM {table} "
                f"WINDOW w AS (PARTITION BY unique_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {width - 1} FOLLOWING)) WHERE c = {width})")

    for k in range(numerics.STL_INNER_LOOPS):
        o, was = f"{out}{k}", f"{out}t{k}"
        ctes.append(f"{o}s AS MATERIALIZED (SELECT unique_id, pos % {period} AS g, pos // {period} AS i, y - trend AS v, "
                    f"count(*) OVER (PARTITION BY unique_id, pos % {period}) AS m FROM {was})")
        ctes += _loess_sql(f"{o}s", seasonal, f"{o}c", 1)
        ctes.append(f"{o}y AS MATERIALIZED (SELECT unique_id, g + (i + 1) * {period} AS i, v FROM {o}c)")
        ctes += [mean(f"{o}y", period, f"{o}m1"), mean(f"{o}m1", period, f"{o}m2"), mean(f"{o}m2", 3, f"{o}m3")]
        ctes.append(f"{o}l AS MATERIALIZED (SELECT unique_id, 0 AS g, i, v, count(*) OVER (PARTITION BY unique_id) AS m FROM {o}m3)")
        ctes += _loess_sql(f"{o}l", low, f"{o}w")
        ctes.append(f"{o}p AS MATERIALIZED (SELECT t.unique_id, 0 AS g, t.pos AS i, t.n AS m, t.y, y.v - w.v AS seasonal, t.y - y.v + w.v AS v "
                    f"FROM {was} t JOIN {o}y y ON t.unique_id = y.unique_id AND y.i = t.pos + {period} "
                    f"JOIN {o}w w ON t.unique_id = w.unique_id AND w.i = t.pos)")
        ctes += _loess_sql(f"{o}p", trend, f"{o}r")
        ctes.append(f"{out}t{k + 1} AS MATERIALIZED (SELECT p.unique_id, p.i AS pos, p.m AS n, p.y, r.v AS trend, p.seasonal "
                    f"FROM {o}p p JOIN {o}r r ON p.unique_id = r.unique_id AND p.i = r.i)")
    return [*ctes, f"{out} AS (SELECT * FROM {out}t{numerics.STL_INNER_LOOPS})"]


@query("stl_weekly", sql=f"""
WITH {prepared_sql('lineitem_daily')}, {", ".join(stl_sql('z', PERIOD, 'd'))}
SELECT unique_id, pos, n, CAST({PERIOD} AS BIGINT) AS m, {R('y')} AS y, {R('trend')} AS trend, {R('seasonal')} AS seasonal,
       {R('y - trend - seasonal')} AS remainder FROM d""")
def stl_weekly(spark, sf):
    """A given period, the week, for every series."""
    rows = prepared(spark, sf, "lineitem_daily")
    week = rows.groupBy("unique_id").agg(
        F.lit(PERIOD).cast("bigint").alias("period1"), *[F.lit(None).cast("bigint").alias(f"period{i}") for i in (2, 3)])
    return _rounded_all(ft.decompose(rows, week, "D").drop("block"))


def mstl_sql(source: str, short: int, long: int) -> str:
    """CTE `ms` `(unique_id, pos, n, y, trend, seasonal)`: two seasons in two rounds, each on what the other leaves."""
    first, second = numerics.mstl_spans(2)
    both = "FROM {0} x JOIN {1} o ON x.unique_id = o.unique_id AND x.pos = o.pos"
    ctes = stl_sql(source, short, "ma", first)
    ctes.append("qb AS MATERIALIZED (SELECT unique_id, pos, n, y - seasonal AS y FROM ma)")
    ctes += stl_sql("qb", long, "mb", second)
    for out, x, o, period, span in (("mc", "mb", "ma", short, first), ("md", "mc", "mb", long, second)):
        ctes.append(f"q{out} AS MATERIALIZED (SELECT x.unique_id, x.pos, x.n, x.y - x.seasonal + o.seasonal AS y {both.format(x, o)})")
        ctes += stl_sql(f"q{out}", period, out, span)
    ctes.append(f"ms AS (SELECT z.unique_id, z.pos, z.n, z.y, x.trend, x.seasonal + o.seasonal AS seasonal "
                f"{both.format('md', 'mc')} JOIN {source} z ON x.unique_id = z.unique_id AND x.pos = z.pos)")
    return ", ".join(ctes)


@query("mstl_day_and_week", sql=f"""
WITH {prepared_sql('events_6h')}, {mstl_sql('z', 4, 28)}
SELECT unique_id, pos, n, CAST(4 AS BIGINT) AS m, {R('y')} AS y, {R('trend')} AS trend, {R('seasonal')} AS seasonal,
       {R('y - trend - seasonal')} AS remainder FROM ms""")
def mstl_day_and_week(spark, sf):
    """Two given periods for every series."""
    rows = prepared(spark, sf, "events_6h")
    both = rows.groupBy("unique_id").agg(*[F.lit(p).cast("bigint").alias(f"period{i + 1}") for i, p in enumerate((4, 28, None))])
    return _rounded_all(ft.decompose(rows, both, "6H", "mstl").drop("block"))


query("stl")(lambda spark, sf: _decomposed(spark, sf, "lineitem_daily", "stl"))
query("mstl")(lambda spark, sf: _decomposed(spark, sf, "events_hourly", "mstl"))


def _line_sql(source: str, span: float | str, out: str) -> str:
    """CTE `out`: a local line through column `v` of `source` over the nearest `span` share of points,
    with the absolute cross-validated residual."""
    return f"""
{out}w AS (SELECT unique_id, pos, n, v, pos - (n - 1) / 2 AS u, greatest(floor(0.5e0 * {span} * n + 0.5e0), 2) AS half FROM {source}),
{out}l AS (SELECT *, greatest(0, least(pos - half, greatest(n - 2 * half - 1, 0))) AS lo FROM {out}w),
{out}s AS (SELECT a.unique_id, a.pos, any_value(a.n) AS n, any_value(a.v) AS v, any_value(a.u) AS u, count(*) AS c, avg(b.u) AS mu,
                  avg(b.v) AS mv, regr_slope(b.v, b.u) AS slope, regr_sxx(b.v, b.u) AS sxx
           FROM {out}l a JOIN {out}l b ON a.unique_id = b.unique_id AND b.pos >= a.lo AND b.pos < a.lo + 2 * a.half + 1 GROUP BY 1, 2),
{out} AS (SELECT unique_id, pos, n, mv + slope * (u - mu) AS fit,
                 abs(v - mv - slope * (u - mu)) / greatest(1 - 1 / c - (u - mu) * (u - mu) / sxx, 1e-8) AS err FROM {out}s)"""


def smoother_sql() -> str:
    """CTE `sm`: the super-smoother of CTE `z`."""
    ctes = ["z0 AS (SELECT unique_id, pos, n, y AS v FROM z)"]
    for i, span in enumerate((0.05, 0.2, 0.5)):
        ctes += [_line_sql("z0", f"{span}e0", f"f{i}"), f"r{i} AS (SELECT unique_id, pos, n, err AS v FROM f{i})",
                 _line_sql(f"r{i}", "0.2e0", f"e{i}")]
    ctes += ["""
best AS (SELECT unique_id, pos, e0.n, CASE WHEN e0.fit <= e1.fit AND e0.fit <= e2.fit THEN 0.05e0 WHEN e1.fit <= e2.fit THEN 0.2e0 ELSE 0.5e0 END AS v
         FROM e0 JOIN e1 USING (unique_id, pos) JOIN e2 USING (unique_id, pos))""",
             _line_sql("best", "0.2e0", "bs"), """
mix AS (SELECT unique_id, pos, bs.n, greatest(0.05e0, least(0.5e0, bs.fit)) AS b, f0.fit AS a0, f1.fit AS a1, f2.fit AS a2
        FROM bs JOIN f0 USING (unique_id, pos) JOIN f1 USING (unique_id, pos) JOIN f2 USING (unique_id, pos)),
mx AS (SELECT unique_id, pos, n, CASE WHEN b <= 0.2e0 THEN a0 + (a1 - a0) * (b - 0.05e0) / (0.2e0 - 0.05e0)
                                      ELSE a1 + (a2 - a1) * (b - 0.2e0) / (0.5e0 - 0.2e0) END AS v FROM mix)""",
             _line_sql("mx", "0.05e0", "sm")]
    return ",".join(ctes)


@query("trend_smooth", sql=f"""
WITH {prepared_sql('nation_monthly')},{smoother_sql()}
SELECT unique_id, pos, z.n AS n, CAST(1 AS BIGINT) AS m, {R('y')} AS y, {R('sm.fit')} AS trend, 0.0::DOUBLE AS seasonal,
       {R('y - sm.fit')} AS remainder FROM z JOIN sm USING (unique_id, pos)""")
def trend_smooth(spark, sf):
    """Series without a season: the super-smoother on each nation's months."""
    rows = prepared(spark, sf, "nation_monthly")
    none = rows.groupBy("unique_id").agg(*[F.lit(None).cast("bigint").alias(f"period{i}") for i in (1, 2, 3)])
    return _rounded_all(ft.decompose(rows, none, "MS").drop("block"))


def _fitted_sql(source: str, target: str, columns: list[str], out: str) -> list[str]:
    """CTEs `out0`, `out1`, ...: `target` and the columns not yet used, without their mean and what the first 0, 1, ...
    columns explain."""
    left = [target, *columns]
    ctes = [f"{out}0 AS (SELECT unique_id, " + ", ".join(
        f"{c} - avg({c}) OVER (PARTITION BY unique_id) AS {c}" for c in left) + f" FROM {source})"]
    for i, used in enumerate(columns):
        left = [c for c in left if c != used]
        ctes.append(f"{out}{i + 1} AS (SELECT unique_id, " + ", ".join(
            f"{c} - sum({c} * {used}) OVER (PARTITION BY unique_id) / sum({used} * {used}) OVER (PARTITION BY unique_id) * {used} AS {c}"
            for c in left) + f" FROM {out}{i})")
    return ctes


def gram_sql() -> str:
    lags = ", ".join(f"lag(zz, {k}) OVER (PARTITION BY unique_id ORDER BY pos) AS l{k}" for k in range(1, ft.ARCH_LAGS + 1))
    names = [f"l{k}" for k in range(1, ft.ARCH_LAGS + 1)]
    return ",\n".join([
        components_sql(),
        "zs AS (SELECT unique_id, pos, power(remainder - avg(remainder) OVER w, 2) AS zz, "
        "(trend - avg(trend) OVER w) / stddev_samp(trend) OVER w AS x FROM c WINDOW w AS (PARTITION BY unique_id))",
        f"al AS (SELECT unique_id, pos, zz, {lags} FROM zs)",
        f"ar AS (SELECT * FROM al WHERE pos >= {ft.ARCH_LAGS})", *_fitted_sql("ar", "zz", names, "a_"),
        "pl AS (SELECT unique_id, pos, x, lag(x) OVER (PARTITION BY unique_id ORDER BY pos) AS p1 FROM zs)",
        "po AS (SELECT unique_id, x, p1, p1 * p1 AS p2, p1 * p1 * p1 AS p3 FROM pl WHERE pos >= 1)",
        *_fitted_sql("po", "x", ["p1", "p2", "p3"], "b_"),
        "aw AS (SELECT unique_id, sum(zz * zz) AS s FROM a_0 GROUP BY 1)",
        f"ae AS (SELECT unique_id, sum(zz * zz) AS e FROM a_{ft.ARCH_LAGS} GROUP BY 1)",
        "bl AS (SELECT unique_id, sum(x * x) AS s FROM b_1 GROUP BY 1)",
        "bc AS (SELECT unique_id, sum(x * x) AS e FROM b_3 GROUP BY 1)"])


@query("gram_features", sql=f"""
WITH {gram_sql()}
SELECT unique_id, {R('1 - ae.e / aw.s')} AS e_arch_lm, {R('10 * ln(bl.s / bc.e)')} AS trend_nonlinearity
FROM aw JOIN ae USING (unique_id) JOIN bl USING (unique_id) JOIN bc USING (unique_id)""")
def gram_features(spark, sf):
    """ARCH statistic of the remainder and nonlinearity of the trend."""
    return _rounded_all(ft.gram_features(grid.materialize(components(spark, sf))))


def unit_root_sql(lags: int) -> str:
    """CTEs up to `uv`: level and difference without what constant, time and lagged differences explain."""
    names = ["t", *[f"d{k}" for k in range(1, lags + 1)]]
    back = ", ".join(f"lag(dy, {k}) OVER (PARTITION BY unique_id ORDER BY pos) AS d{k}" for k in range(1, lags + 1))
    return ",\n".join([
        prepared_sql("events_6h"),
        "df0 AS (SELECT unique_id, pos, y AS lv, lead(y) OVER (PARTITION BY unique_id ORDER BY pos) - y AS dy FROM z)",
        f"dl AS (SELECT unique_id, CAST(pos AS DOUBLE) / 1000 AS t, lv, dy, pos{', ' + back if back else ''} FROM df0)",
        f"dr AS (SELECT * FROM dl WHERE pos >= {lags} AND dy IS NOT NULL)",
        *_fitted_sql("dr", "dy", [*names, "lv"], "u_"),
        f"us AS (SELECT unique_id, sum(lv * dy) AS ld, sum(lv * lv) AS ll, sum(dy * dy) AS dd, count(*) AS m FROM u_{len(names)} GROUP BY 1)"])


for _lags in (0, 4):
    query(f"unit_root_{_lags}_lags", sql=f"""WITH {unit_root_sql(_lags)}
SELECT unique_id, CAST({_lags} AS BIGINT) AS lags, {R(f'ld / ll / sqrt((dd - ld * ld / ll) / (m - {_lags + 3}) / ll)')} AS statistic FROM us""")(
        lambda spark, sf, lags=_lags: _rounded_all(ft.unit_root(ft.prepared(dense(spark, sf, "events_6h", block_steps=32)), lags=lags,
                                                                block_steps=32).select("unique_id", "lags", "statistic")))


@query("unit_root")
def unit_root(spark, sf):
    """Statistic, p-value and verdict, with the number of lags chosen by AIC."""
    return ft.unit_root(prepared(spark, sf, "lineitem_daily"))


@query("sequential_features")
def sequential_features(spark, sf):
    """Stationarity, W, entropies and Hurst, with a user function alongside."""
    return ft.sequential_features(grid.materialize(components(spark, sf)), {"peak": lambda y: y.max()})


def orders_features(spark, sf, method: str) -> tuple[DataFrame, DataFrame]:
    long = shape.to_panel(orders_wide(spark, sf), ["series_name"], "timestamp")
    return ft.features(long.select("unique_id", "ds", "y"), "D", method), shape.uid_info(long)


@query("features_stl")
def features_stl(spark, sf):
    table, info = orders_features(spark, sf, "stl")
    return ft.complete(ft.assemble(table, info, "orders/D"))


@query("features_mstl")
def features_mstl(spark, sf):
    return ft.features(panel(spark, sf, "events_hourly"), "H", "mstl")


@query("assemble_features", sql=f"""
WITH {top_sql()},
st AS (SELECT unique_id, avg(y) AS mean, stddev_pop(y) AS std, avg(CASE WHEN y IS NULL THEN 1.0 ELSE 0.0 END) AS missing_rate,
              count(*) AS length FROM f GROUP BY 1)
SELECT 'events/6H' AS dataset_id, 'events' AS series_name, unique_id AS variate_name, unique_id, {R('mean')} AS mean,
       {R('std', 4)} AS std, missing_rate, length, period1, period2, period3, p_strength1, p_strength2, p_strength3
FROM st JOIN tp USING (unique_id) WHERE unique_id <> 'view'""")
def assemble_features(spark, sf):
    """Statistics and periods with identifiers; one series lacks a mean and is dropped."""
    df = grid.materialize(dense(spark, sf, "events_6h"))
    stats = ft.basic_stats(df).withColumn("mean", F.when(F.col("unique_id") != "view", F.col("mean")))
    periods = ft.top_periods(ft.period_strength(ft.spectrum(ft.prepared(df)), "6H"))
    info = df.select("unique_id").distinct().select(
        "unique_id", F.lit("events").alias("series_name"), F.col("unique_id").alias("variate_name"))
    table = ft.complete(ft.assemble(stats.join(periods, "unique_id", "left"), info, "events/6H"))
    return table.withColumn("mean", rounded("mean")).withColumn("std", rounded("std", 4))
