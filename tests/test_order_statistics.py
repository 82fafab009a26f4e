import numpy as np
import pandas as pd
import pytest

from panelmill.functions.order_statistics import RangeSelect, frame_of, frame_parts, inner_ranks
from panelmill.operators import grid, quality


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 500])
def test_kth_of_any_range(rng, n):
    values = rng.integers(0, 20, n).astype(float)
    select = RangeSelect(values)
    start = rng.integers(0, n, 300)
    stop = np.array([rng.integers(a + 1, n + 1) for a in start])
    k = np.array([rng.integers(0, b - a) for a, b in zip(start, stop)])
    want = [np.sort(values[a:b])[i] for a, b, i in zip(start, stop, k)]
    assert select.kth(start, stop, k).tolist() == want
    got = select.quantile(start, stop, 0.25)
    np.testing.assert_allclose(got, [np.quantile(values[a:b], 0.25) for a, b in zip(start, stop)])


def test_ranks_of_shared_values_hold_the_quantiles(rng):
    """What lies outside the shared blocks, and their values of these ranks, are enough."""
    size, n, window = 8, 403, 45
    values = rng.integers(0, 30, n).astype(float)
    for block in range(-(-n // size)):
        first, inner, outer, end = (int(x) for x in frame_parts(block, n, window, size))
        assert first <= inner < outer <= end <= n
        for q in (0.25, 0.5, 0.75):
            low, high = inner_ranks(block, n, window, size, q)
            assert high - low <= 6 * size
            middle = np.sort(values[inner:outer])[low:high + 1]
            array = RangeSelect(np.concatenate([values[first:inner], middle, values[outer:end]]))
            p = np.arange(block * size, min(n, (block + 1) * size))
            a, b = frame_of(p, n, window)
            got = array.quantile(a - first, inner - first + len(middle) + b - outer, q, b - a, low)
            np.testing.assert_allclose(got, [np.quantile(values[x:y], q) for x, y in zip(a, b)])


def expected(values, window):
    rolling = pd.Series(values).rolling(window, center=True, min_periods=1)
    return rolling.median().to_numpy(), (rolling.quantile(0.75) - rolling.quantile(0.25)).to_numpy()


def frame_by_hand(values, window):
    n = len(values)
    a, b = frame_of(np.arange(n), n, window)
    quartiles = np.array([np.quantile(values[i:j], [0.25, 0.5, 0.75]) for i, j in zip(a, b)])
    return quartiles[:, 1], quartiles[:, 2] - quartiles[:, 0]


@pytest.mark.parametrize("steps", [8, 40, 65_536])
def test_rolling_quartiles_do_not_depend_on_blocks(make, rng, steps):
    """Windows far longer than a block, in between, and inside one; ties, trends, a constant stretch and gaps."""
    data = {"noise": rng.normal(size=900), "trend": np.arange(1003.0) + rng.normal(size=1003),
            "ties": rng.integers(0, 3, 777).astype(float), "flat": np.zeros(650), "tiny": rng.normal(size=35)}
    data["flat"][300:310] = 5
    data["noise"][100:300] = 7.0
    df = grid.dense(make(data), "H", block_steps=steps)
    got = quality.rolling_stats_by_length(df, block_steps=steps).toPandas()
    assert len(got) == sum(map(len, data.values()))
    for uid, values in data.items():
        own = got[got["unique_id"] == uid].sort_values("pos")
        assert own["pos"].tolist() == list(range(len(values)))
        window = max(20, len(values) // 10)
        for median, iqr in (expected(values, window), frame_by_hand(values, window)):
            np.testing.assert_allclose(own["median"], median, atol=1e-12)
            np.testing.assert_allclose(own["iqr"], iqr, atol=1e-9)
