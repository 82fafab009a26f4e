import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelmill.operators import features, grid

NA = None


@pytest.fixture(scope="module")
def gappy(make):
    rng = np.random.default_rng(3)
    series = {}
    for i, share in enumerate((0.0, 0.3, 0.9)):
        y = np.round(rng.normal(size=150), 2)
        y[rng.random(150) < share] = np.nan
        y[0] = y[-1] = 1.0
        series[f"s{i}"] = list(y)
    series["lead"] = [NA, NA, NA] + [2.0] * 30 + [NA] * 40 + [5.0, NA, NA]
    series["none"] = [NA] * 20
    return make(series), series


@pytest.mark.parametrize("block, back, ahead", [(16, 0, 0), (16, 5, 0), (10, 3, 2), (7, 0, 3)])
def test_blocks_give_the_whole_series(gappy, block, back, ahead):
    panel, series = gappy
    df = grid.impute_linear(grid.fill_forward_back_zero(grid.dense(panel, "H", block, back, ahead)))
    got = df.where("core").toPandas().sort_values(["unique_id", "pos"])
    for uid, values in series.items():
        y = pd.Series(np.array(values, dtype=float))
        rows = got[got.unique_id == uid]
        assert list(rows.pos) == list(range(len(y))) and (rows.n == len(y)).all()
        np.testing.assert_allclose(rows.y_filled, y.ffill().bfill().fillna(0))
        linear = y.interpolate(limit_direction="both").fillna(0)
        np.testing.assert_allclose(rows.y_linear, linear)
        if y.notna().sum() > 1:
            np.testing.assert_allclose(rows.y_mean, y.mean())
            np.testing.assert_allclose(rows.y_std, y.std())


def test_halo_rows_serve_lags(gappy):
    panel, _ = gappy
    whole = grid.dense(panel, "H").withColumn("lag", F.lag("y", 5).over(grid.ordered()))
    parts = grid.dense(panel, "H", 12, back=5).withColumn("lag", F.lag("y", 5).over(grid.ordered())).where("core")
    a, b = (d.select("unique_id", "pos", "lag").toPandas().sort_values(["unique_id", "pos"]).reset_index(drop=True) for d in (whole, parts))
    # Hours of the epoch cut the default blocks too, so compare where both know the lag.
    pd.testing.assert_frame_equal(b, a)


def test_reblock_repeats_only_the_halo(gappy):
    panel, _ = gappy
    df = grid.dense(panel, "H").where("core").drop("core", "block")
    parts = grid.reblock(df, "pos", F.lit(20), F.lit(4), F.lit(3))
    rows = parts.where("unique_id = 's0'").toPandas()
    assert rows.core.sum() == 150
    spans = rows.groupby("block").pos.agg(["min", "max"])
    assert list(spans.loc[1]) == [16, 42] and list(spans.loc[0]) == [0, 22]


@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_exact_quantiles(make, rng, accuracy):
    values = {"ties": [1.0] * 300 + [2.0] * 300 + [3.0], "wide": list(rng.normal(size=997) ** 3), "one": [4.0], "two": [1.0, 2.0]}
    df = grid.dense(make(values), "H").where("core")
    probs = [0.0, 0.25, 0.5, 0.77, 1.0]
    got = grid.exact_quantiles(df, "y", probs, accuracy=accuracy).toPandas().set_index("unique_id")
    for uid, v in values.items():
        np.testing.assert_allclose(got.loc[uid].to_numpy(dtype=float), np.quantile(v, probs))


def test_standardize_leaves_flat_series(make):
    df = grid.standardize(grid.dense(make({"flat": [3.0] * 5, "move": [1.0, 2.0, 3.0]}), "H"))
    got = df.toPandas()
    assert (got[got.unique_id == "flat"].y_scaled == 3.0).all()
    np.testing.assert_allclose(sorted(got[got.unique_id == "move"].y_scaled), [-1, 0, 1])


def test_bounds_and_tail(make):
    panel = make({"a": [1.0, 2.0, 3.0, 4.0], "b": [1.0]})
    assert {(r.unique_id, r.n, r.n_raw) for r in grid.series_bounds(panel, "H").collect()} == {("a", 4, 4), ("b", 1, 1)}
    assert sorted(r.y for r in grid.tail(grid.dense(panel, "H"), 2).collect()) == [1.0, 3.0, 4.0]


def test_more_steps_are_filled_by_more_tasks(make, monkeypatch):
    """The memory of a task must not grow with the panel."""
    panel = make({f"s{i}": [1.0, None, 3.0] * 50 for i in range(20)}, drop_missing=True)
    few = grid.dense(panel, "H")
    monkeypatch.setattr(grid, "TASK_STEPS", 100)
    many = grid.dense(panel, "H")
    assert many.rdd.getNumPartitions() >= 20 * 149 // 100 > few.rdd.getNumPartitions()
    assert sorted(map(tuple, many.collect()), key=repr) == sorted(map(tuple, few.collect()), key=repr)


def test_later_blocks_are_sized_by_the_steps_too(make, monkeypatch):
    """Blocks with a halo must not be left to as few tasks as the session has."""
    panel = make({f"s{i}": [1.0, None, 3.0] * 50 for i in range(20)}, drop_missing=True)

    def halo():
        rows = features.prepared(grid.dense(panel, "H"))
        return features.with_halo(rows, 2)

    few = halo()
    monkeypatch.setattr(grid, "TASK_STEPS", 100)
    many = halo()
    assert many.rdd.getNumPartitions() >= 20 * 149 // 100 > few.rdd.getNumPartitions()
    assert features.with_halo(grid.materialize(many), 2).rdd.getNumPartitions() == many.rdd.getNumPartitions()
    assert sorted(map(tuple, many.collect()), key=repr) == sorted(map(tuple, few.collect()), key=repr)
