"""Numerics of one series as numpy arrays: decomposition and tests.

Everything here is sequential along a series and cannot be written as columns.
The functions are called inside grouped tasks; Spark partitions the series.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values ------------------------------------------------------------
STL_SEASONAL_SPAN = 13
STL_INNER_LOOPS = 5
SMOOTHER_SPANS = (0.05, 0.2, 0.5)
# Royston (1995): polynomial coefficients of the two largest weights.
SHAPIRO_LAST = (-2.706056, 4.434685, -2.071190, -0.147981, 0.221157)
SHAPIRO_NEXT = (-3.582633, 5.682633, -1.752461, -0.293762, 0.042981)
# MacKinnon (1994): p-value surface of the Dickey-Fuller statistic with constant
# and trend; below the switch point the small-p polynomial applies.
ADF_MAX, ADF_MIN, ADF_SWITCH = 0.70, -16.18, -2.89
ADF_SMALL = (3.2512, 1.6047, 0.049588)
ADF_LARGE = (2.5261, 0.61654, -0.37956, -0.060285)
# -----------------------------------------------------------------------------


def _tricube(distance: np.ndarray, reach: np.ndarray | float) -> np.ndarray:
    """Local weights; the innermost 0.1 % count fully, the outermost not at all."""
    share = distance / reach
    return np.where(share <= 0.001, 1.0, np.where(share <= 0.999, (1 - share ** 3) ** 3, 0.0))


def _local_linear(at: np.ndarray, left: np.ndarray, span: int, n: int, extra: float) -> np.ndarray:
    """Row of smoothing weights per evaluation point, over `span` points from `left`."""
    points = left[:, None] + np.arange(span)[None, :]
    distance = np.abs(points - at[:, None])
    reach = np.maximum(at - left, left + span - 1 - at)[:, None] + extra
    w = _tricube(distance, reach)
    w /= w.sum(1, keepdims=True)
    centre = (w * points).sum(1, keepdims=True)
    spread = (w * (points - centre) ** 2).sum(1, keepdims=True)
    tilt = (at[:, None] - centre) / np.where(spread > 0, spread, 1.0)
    sloped = w * (1 + tilt * (points - centre))
    return np.where(np.sqrt(spread) > 0.001 * (n - 1.0), sloped, w)


def loess(rows: np.ndarray, span: int, extend: int = 0, total: int | None = None) -> np.ndarray:
    """Local linear smoothing of each row at its own points, and `extend` beyond both ends.

    Away from the ends all points share one symmetric window, where a local line
    equals a weighted mean; only the points near the ends need their own weights.
    Where the points of a window lie within 0.1 % of the whole series, a line is
    not fitted; `total` is the length of that series if the rows are a part of it.
    """
    n = rows.shape[1]
    total = total or n
    if n == 1:
        return np.repeat(rows, 1 + 2 * extend, axis=1)
    width = min(span, n)
    extra = float((span - n) // 2) if span > n else 0.0
    half = (width + 1) // 2
    out = np.empty((rows.shape[0], n + 2 * extend))
    at = np.arange(-extend, n + extend)
    left = np.clip(at - (half - 1), 0, n - width)
    inner = (at - left == half - 1) & (width % 2 == 1) & (extra == 0)
    if inner.any():
        weights = _tricube(np.abs(np.arange(width) - (half - 1.0)), half - 1.0)
        weights /= weights.sum()
        first, last = at[inner][0] - (half - 1), at[inner][-1] + half
        stretch = rows[:, first:last]
        if width > 256:
            size = 1 << (stretch.shape[1] + width).bit_length()
            product = np.fft.irfft(np.fft.rfft(stretch, size, axis=1) * np.fft.rfft(weights, size), size, axis=1)
            out[:, inner] = product[:, width - 1:stretch.shape[1]]
        else:
            windows = np.lib.stride_tricks.sliding_window_view(stretch, width, axis=1)
            out[:, inner] = windows @ weights
    edge = np.flatnonzero(~inner)
    for part in np.array_split(edge, max(1, edge.size * width // 4_000_000)):
        if part.size:
            weights = _local_linear(at[part].astype(float), left[part].astype(float), width, total, extra)
            gather = left[part][:, None] + np.arange(width)[None, :]
            out[:, part] = np.einsum("rpw,pw->rp", rows[:, gather], weights)
    return out


def _moving_mean(x: np.ndarray, width: int) -> np.ndarray:
    total = np.cumsum(np.concatenate([[0.0], x]))
    return (total[width:] - total[:-width]) / width


def stl_spans(period: int, seasonal: int = STL_SEASONAL_SPAN) -> tuple[int, int]:
    """Trend and low-pass spans: the next odd numbers above their lower limits."""
    trend = math.ceil(1.5 * period / (1 - 1.5 / seasonal))
    low = period + 1
    return trend + (trend % 2 == 0), low + (low % 2 == 0)


def stl_reach(period: int, seasonal: int = STL_SEASONAL_SPAN) -> int:
    """How far, in steps, a point of the decomposition depends on its neighbours."""
    trend, low = stl_spans(period, seasonal)
    one_loop = (seasonal // 2 + 1) * period + period + 2 + low // 2 + 1 + trend // 2 + 1
    return (STL_INNER_LOOPS + 1) * one_loop


def stl_reach_column(period: Column, seasonal: int = STL_SEASONAL_SPAN) -> Column:
    """`stl_reach` of a column of periods."""
    trend = F.ceil(period * 1.5 / (1 - 1.5 / seasonal))
    trend = trend + F.when(trend % 2 == 0, 1).otherwise(0)
    low = period + 1 + F.when(period % 2 == 1, 1).otherwise(0)
    one_loop = period * (seasonal // 2 + 2) + F.floor(low / 2) + F.floor(trend / 2) + 4
    return (one_loop * (STL_INNER_LOOPS + 1)).cast("bigint")


def stl(y: np.ndarray, period: int, seasonal: int = STL_SEASONAL_SPAN, start: int = 0,
        total: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend, season and remainder by Cleveland et al. (1990), without robustness weights.

    `y` may be a stretch, from position `start`, of a series of `total` values.
    """
    n = len(y)
    total = total or n
    if period < 2 or n <= period:
        raise ValueError("a season needs a period of 2 or more and a longer series")
    trend_span, low_span = stl_spans(period, seasonal)
    trend = np.zeros(n)
    season = np.zeros(n)
    for _ in range(STL_INNER_LOOPS):
        flat = y - trend
        cycle = np.empty(n + 2 * period)
        alike: dict[tuple[int, int], list[int]] = {}
        for phase in range(period):
            here = (n - phase + period - 1) // period
            whole = (total - (start + phase) % period + period - 1) // period
            alike.setdefault((here, whole), []).append(phase)
        for (here, whole), phases in alike.items():
            smooth = loess(np.stack([flat[p::period] for p in phases]), seasonal, extend=1, total=whole)
            for p, row in zip(phases, smooth):
                cycle[p::period][:here + 2] = row
        low = _moving_mean(_moving_mean(_moving_mean(cycle, period), period), 3)
        low = loess(low[None, :], low_span, total=total)[0]
        season = cycle[period:period + n] - low
        trend = loess((y - season)[None, :], trend_span, total=total)[0]
    return trend, season, y - trend - season


def mstl_spans(count: int) -> list[int]:
    return [7 + 4 * (i + 1) for i in range(count)]


def mstl(y: np.ndarray, periods: list[int], start: int = 0, total: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Several seasons, refined in two passes (Bandara et al. 2021); seasons are summed."""
    spans = mstl_spans(len(periods))
    seasons = [np.zeros(len(y)) for _ in periods]
    rest, trend = y.astype(float), np.zeros(len(y))
    for _ in range(1 if len(periods) == 1 else 2):
        for i, period in enumerate(periods):
            rest = rest + seasons[i]
            trend, seasons[i], _ = stl(rest, period, spans[i], start, total)
            rest = rest - seasons[i]
    season = np.sum(seasons, axis=0)
    return trend, season, y - trend - season


def _running_line(x: np.ndarray, y: np.ndarray, span: float, residuals: bool = False):
    """Local line over the nearest `span` share of points; optionally also the
    absolute cross-validated residual."""
    n = len(y)
    half = max(int(0.5 * span * n + 0.5), 2)
    lo = np.clip(np.arange(n) - half, 0, max(n - 2 * half - 1, 0))
    hi = np.minimum(lo + 2 * half + 1, n)
    shift = x.mean()
    u = x - shift

    def window(v):
        total = np.concatenate([[0.0], np.cumsum(v)])
        return total[hi] - total[lo]

    size = (hi - lo).astype(float)
    mean_x, mean_y = window(u) / size, window(y) / size
    var = np.maximum(window(u * u) - size * mean_x ** 2, 0)
    cov = window(u * y) - size * mean_x * mean_y
    slope = np.where(var > 1e-12, cov / np.where(var > 1e-12, var, 1), 0.0)
    fit = mean_y + slope * (u - mean_x)
    if not residuals:
        return fit
    leverage = 1 / size + np.where(var > 1e-12, (u - mean_x) ** 2 / np.where(var > 1e-12, var, 1), 0.0)
    return fit, np.abs(y - fit) / np.maximum(1 - leverage, 1e-8)


def super_smoother(y: np.ndarray) -> np.ndarray:
    """Friedman (1984): per point the span with the smallest smoothed residual."""
    n = len(y)
    if n < 5:
        return np.full(n, y.mean())
    x = np.arange(1, n + 1, dtype=float)
    fits, errors = [], []
    for span in SMOOTHER_SPANS:
        fit, error = _running_line(x, y, span, residuals=True)
        fits.append(fit)
        errors.append(_running_line(x, error, SMOOTHER_SPANS[1]))
    best = np.array(SMOOTHER_SPANS)[np.argmin(np.stack(errors), axis=0)]
    best = np.clip(_running_line(x, best, SMOOTHER_SPANS[1]), SMOOTHER_SPANS[0], SMOOTHER_SPANS[-1])
    stacked = np.stack(fits)
    upper = np.clip(np.searchsorted(SMOOTHER_SPANS, best), 1, len(SMOOTHER_SPANS) - 1)
    spans = np.array(SMOOTHER_SPANS)
    share = (best - spans[upper - 1]) / (spans[upper] - spans[upper - 1])
    at = np.arange(n)
    mixed = stacked[upper - 1, at] * (1 - share) + stacked[upper, at] * share
    return _running_line(x, mixed, SMOOTHER_SPANS[0])


def magnitudes(y: np.ndarray) -> np.ndarray:
    """|FFT| at the non-negative frequencies k / n, with the mean left out."""
    size = np.abs(np.fft.rfft(y - y.mean()))
    size[0] = 0.0
    return size


def adf_lags(n: int) -> int:
    """Most lags that the unit-root test tries; negative where a series is too short."""
    return min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 3)


def adf_sums(y: np.ndarray, first: int, core: int, n: int, most: int) -> np.ndarray:
    """What steps `core` and later add to the sums that `adf_from_sums` needs.

    `y` holds the steps from `first` on, up to `most + 1` of them before `core`. The sums are those of
    the differences with their lags, of the level with these, of the level, its square and its
    product with time; then come the first and the last `most + 1` values, 0 where they lie elsewhere.
    """
    d, at = np.diff(y), core - first
    begin = [max(at - 1, k) for k in range(most + 1)]
    own = [float(d[s:] @ d[s - k:len(d) - k]) if s < len(d) else 0.0 for k, s in enumerate(begin)]
    level = [float(y[s:-1] @ d[s - k:len(d) - k]) if s < len(d) else 0.0 for k, s in enumerate(begin)]
    mine, places = y[at:], np.arange(core, first + len(y))
    ends = np.zeros((2, most + 1))
    for row, start in zip(ends, (0, n - 1 - most)):
        use = (places >= start) & (places <= start + most)
        row[places[use] - start] = mine[use]
    return np.concatenate([own, level, [mine.sum(), mine @ mine, mine @ places], ends.ravel()])


def adf_products(sums: np.ndarray, n: int, most: int, lags: int) -> np.ndarray:
    """Cross products of constant, time, lagged differences, level and difference over the steps that have `lags` lags.

    Products of two lags are those of their distance without the steps at both ends of the series.
    """
    own, level = sums[:most + 1], sums[most + 1:2 * most + 2]
    total, squares, timed = sums[2 * most + 2:2 * most + 5]
    head, tail = sums[2 * most + 5:].reshape(2, -1)
    whole = n - 1
    m = whole - lags
    d_head, d_tail = np.diff(head), np.diff(tail)
    out = np.zeros((lags + 4, lags + 4))
    place = np.array([lags + 3, *range(2, lags + 2)])  # of the difference and of its lags
    for gap in range(lags + 1):
        early = np.concatenate([[0.0], np.cumsum(d_head[gap:lags] * d_head[:lags - gap])])
        late = np.concatenate([[0.0], np.cumsum((d_tail[gap:] * d_tail[:most - gap])[::-1])])
        near = np.arange(lags + 1 - gap)
        i, j = place[near], place[near + gap]
        out[np.minimum(i, j), np.maximum(i, j)] = own[gap] - early[lags - gap - near] - late[near]
    for k in range(lags + 1):
        before, after = head[lags - k], tail[most - k]  # the differences between them add up
        summed = total - head[:lags - k].sum() - tail[most - k:].sum()
        out[0, place[k]] = after - before
        out[1, place[k]] = (m * after - summed) / m
        out[min(place[k], lags + 2), max(place[k], lags + 2)] = level[k] - head[k:lags] @ d_head[:lags - k]
    early, last = np.arange(lags), tail[-1]
    total, squares = total - head[:lags].sum() - last, squares - head[:lags] @ head[:lags] - last ** 2
    timed = timed - head[:lags] @ early - last * whole - (lags - 1) * total
    out[0, 0], out[0, 1], out[1, 1] = m, (m + 1) / 2, (m + 1) * (2 * m + 1) / (6 * m)
    out[0, -2], out[1, -2], out[-2, -2] = total, timed / m, squares
    return np.triu(out) + np.triu(out, 1).T


def _swept(square: np.ndarray, columns: list[int]) -> Iterator[np.ndarray]:
    """The cross products that are left after one more column is fitted, for each column; one that the others determine is passed over."""
    left = square.copy()
    for j in columns:
        if left[j, j] > 1e-13 * square[j, j]:
            left = left - np.outer(left[:, j], left[j]) / left[j, j]
        yield left


def adf_from_sums(sums: np.ndarray, n: int, most: int, lags: int | None = None) -> tuple[int, float]:
    """Lags and t statistic of the augmented Dickey-Fuller test with constant and trend.

    Without `lags` their number is the one with the least AIC over the steps that have `most` lags:
    the regressions contain one another, so each follows from the one before.
    """
    if lags is None:
        m = n - 1 - most
        square = adf_products(sums, n, most, most)
        steps = islice(_swept(square, [0, 1, most + 2, *range(2, most + 2)]), 2, None)
        left = np.array([max(s[-1, -1], np.finfo(float).tiny) for s in steps])
        lags = int(np.argmin(m * (np.log(2 * np.pi) + np.log(left / m) + 1) + 2 * (np.arange(most + 1) + 3)))
    square = adf_products(sums, n, most, lags)
    *_, left = _swept(square, list(range(lags + 2)))
    spread, freedom = left[-2, -2], n - 1 - lags - (lags + 3)
    if not spread > 1e-13 * square[-2, -2] or freedom < 1:
        raise ValueError("the regression has no solution")
    slope = left[-2, -1] / spread
    variance = max(left[-1, -1] - slope * left[-2, -1], 0.0) / freedom
    if variance == 0:
        raise ZeroDivisionError
    return lags, slope / math.sqrt(variance / spread)


def adf_probability(tau: float) -> float:
    if tau > ADF_MAX:
        return 1.0
    if tau < ADF_MIN:
        return 0.0
    surface = ADF_SMALL if tau <= ADF_SWITCH else ADF_LARGE
    return NormalDist().cdf(sum(c * tau ** i for i, c in enumerate(surface)))


def adf_pvalue(y: np.ndarray) -> float:
    """Augmented Dickey-Fuller test with constant and trend, lags chosen by AIC."""
    n, most = len(y), adf_lags(len(y))
    if most < 0 or np.ptp(y) == 0 or not np.isfinite(y).all():
        raise ValueError("too short, constant or not finite")
    return adf_probability(adf_from_sums(adf_sums(y, 0, 0, n, most), n, most)[1])


def stationarity(y: np.ndarray) -> int:
    """1 where the unit root is rejected at 5 %, or the test cannot run."""
    try:
        return int(adf_pvalue(y) <= 0.05)
    except (ValueError, ZeroDivisionError):
        return 1


_inverse_normal = np.frompyfunc(NormalDist().inv_cdf, 1, 1)


def normal_scores(ranks: np.ndarray, n: int) -> np.ndarray:
    """Blom's approximation of the expected normal order statistics at ranks from 1 to n."""
    low = np.minimum(ranks, n + 1 - ranks)  # so that the scores are symmetric
    scores = _inverse_normal((low - 0.375) / (n + 0.25)).astype(float)
    return np.where(2 * ranks == n + 1, 0.0, np.where(low == ranks, scores, -scores))


def shapiro_from_sums(n: int, weighted: float, squares: float, spread: float, ends: tuple[float, float, float, float]) -> float:
    """Shapiro-Wilk W by Royston (1995) from sums over the ranks; NaN for fewer than 3 points or no spread.

    `weighted` is the sum of scores times values, `squares` that of squared scores, `spread`
    that of squared deviations, `ends` the two smallest and the two largest values.
    """
    if n < 3 or ends[3] - ends[0] <= 0:
        return math.nan
    if n == 3:
        return (ends[3] - ends[0]) ** 2 / 2 / spread
    top, next_top = normal_scores(np.array([n, n - 1]), n).tolist()
    u = 1 / math.sqrt(n)
    last = float(np.polyval((*SHAPIRO_LAST, top / math.sqrt(squares)), u))
    total = last * (ends[3] - ends[0])
    weighted, squares, left = weighted - top * (ends[3] - ends[0]), squares - 2 * top ** 2, 1 - 2 * last ** 2
    if n > 5:
        following = float(np.polyval((*SHAPIRO_NEXT, next_top / math.sqrt(squares + 2 * top ** 2)), u))
        total += following * (ends[2] - ends[1])
        weighted, squares = weighted - next_top * (ends[2] - ends[1]), squares - 2 * next_top ** 2
        left -= 2 * following ** 2
    return (total + weighted * math.sqrt(left / squares)) ** 2 / spread


def shapiro_w(values: np.ndarray) -> float:
    """The same of values at hand."""
    n = len(values)
    if n < 3:
        return math.nan
    x = np.sort(values) - np.mean(values)
    scores = normal_scores(np.arange(1, n + 1), n)
    return shapiro_from_sums(n, float(scores @ x), float(scores @ scores), float(x @ x), (x[0], x[1], x[-2], x[-1]))


def hurst(values: np.ndarray) -> float:
    """Slope of the log rescaled range on log length over all prefixes.

    The range of a prefix is the spread of i -> S(i) - i * mean over its points,
    that is the extent of their convex hull in one direction. Both hulls grow
    from left to right, so each prefix costs one binary search.
    """
    n = len(values)
    if n < 3:
        return math.nan
    t = np.arange(1, n + 1)
    total = np.cumsum(values)
    mean = total / t
    shifted = values - mean[-1]
    first, second = np.cumsum(shifted) / t, np.cumsum(shifted ** 2) / t
    deviation = np.sqrt(np.maximum(second - first ** 2, 0))
    reach = np.empty(n)
    hulls: list[list[tuple[float, float]]] = [[], []]
    for i in range(n):
        extremes = []
        for sign, hull in zip((1.0, -1.0), hulls):
            point = (float(t[i]), sign * float(total[i]))
            while len(hull) > 1 and (hull[-1][1] - hull[-2][1]) * (point[0] - hull[-2][0]) <= \
                    (point[1] - hull[-2][1]) * (hull[-1][0] - hull[-2][0]):
                hull.pop()
            hull.append(point)
            slope = sign * mean[i]
            lo, hi = 0, len(hull) - 1
            while lo < hi:
                mid = (lo + hi) // 2
                if hull[mid + 1][1] - hull[mid][1] > slope * (hull[mid + 1][0] - hull[mid][0]):
                    lo = mid + 1
                else:
                    hi = mid
            extremes.append(hull[lo][1] - slope * hull[lo][0])
        reach[i] = extremes[0] + extremes[1]
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.log(reach / deviation)[1:]
    if not np.isfinite(ratio).all():
        return math.nan
    return float(np.polyfit(np.log(t)[1:], ratio, 1)[0])
