from datetime import datetime

import pytest
from pyspark.sql import functions as F

from panelmill.operators import grid, panel as shape, windows
from panelmill.plans.storage import CONFIG
from panelmill.sources import nested, results, tasks, wide


def test_wide_csv(spark, tmp_path):
    for name, rows in {"item 0": "2024-01-01 00:00,1,2\n2024-01-01 01:00,,4\n", "item_1": "2024-01-01 00:00,5,6\n"}.items():
        (tmp_path / f"{name}.csv").write_text("my_time,v,w\n" + rows)
    (tmp_path / "notes.txt").write_text("x")
    df = wide.read_wide_csv(spark, str(tmp_path))
    assert df.columns == ["series_name", "timestamp", "v", "w"]
    long = shape.to_panel(df, ["series_name"])
    got = {(r.unique_id, r.ds.hour): r.y for r in long.collect()}
    assert got == {("item 0_v", 0): 1.0, ("item 0_v", 1): None, ("item 0_w", 0): 2.0, ("item 0_w", 1): 4.0,
                   ("item_1_v", 0): 5.0, ("item_1_w", 0): 6.0}
    assert shape.uid_info(long).count() == 4
    with pytest.raises(Exception):
        wide.read_wide_csv(spark, str(tmp_path / "missing"))


def test_csv_files_with_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp,x,y\n2024-01-01 00:00:00,1,2\n")
    (tmp_path / "b+c.csv").write_text('timestamp,y,"z, w"\n2024-01-01 00:00:00,3,4\n2024-01-01 01:00:00,n/a,5\n')
    (tmp_path / "d.csv").write_text("timestamp,x,y\n2024-01-01 00:00:00,7,8\n")
    df = wide.read_wide_csv(spark, str(tmp_path))
    assert dict(df.dtypes) == {"series_name": "string", "timestamp": "timestamp", "x": "double", "y": "double", "z, w": "double"}
    got = sorted((r.series_name, r.timestamp.hour, r.x, r.y, r["z, w"]) for r in df.collect())
    assert got == [("a", 0, 1.0, 2.0, None), ("b+c", 0, None, 3.0, 4.0), ("b+c", 1, None, None, 5.0), ("d", 0, 7.0, 8.0, None)]


def test_time_columns_of_many_headers(spark, tmp_path):
    """The same column at other places, other time columns, a header without rows, many files of one header; one scan for all."""
    (tmp_path / "a.csv").write_text("when_date,x\n03.01.2024,1\n")
    (tmp_path / "b.csv").write_text("y,x,my_time\n2,3,2024-01-05 00:00:00\n,,\n")
    (tmp_path / "c.csv").write_text("x,time,extra\n")
    for i in range(30):
        (tmp_path / f"f{i}.csv").write_text(f"y,x,my_time\n{i},,2024-01-06 00:00:00\n")
    df = wide.read_wide_csv(spark, str(tmp_path))
    assert set(df.columns) == {"series_name", "timestamp", "x", "y", "extra"}
    got = {(r.series_name, r.timestamp and r.timestamp.day): (r.x, r.y, r.extra) for r in df.collect()}
    assert got == {("a", 3): (1.0, None, None), ("b", 5): (3.0, 2.0, None), ("b", None): (None, None, None)} | {
        (f"f{i}", 6): (None, float(i), None) for i in range(30)}
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [c0") == 1
    (tmp_path / "z.csv").write_text("p,q\n1,2\n")
    with pytest.raises(ValueError, match="timestamp"):
        wide.read_wide_csv(spark, str(tmp_path))


def test_rewriting_replaces_its_part(spark, tmp_path):
    rows = spark.range(3)
    for dataset in ("p", "q", "p"):
        wide.write_cleaned(rows, str(tmp_path), dataset, "D")
    assert {(r.dataset, r["count"]) for r in spark.read.parquet(str(tmp_path)).groupBy("dataset").count().collect()} == {
        ("p", 3), ("q", 3)}


def test_nested_round_trip(make, spark):
    panel = make({"a": [1.0, None, 3.0, 4.0, 5.0], "b": [None, 2.0]}, freq="MS")
    for chunk in (100, 2):
        table = nested.build_univariate(panel, "MS", chunk)
        assert table.where("item_id = 'a'").count() == (1 if chunk == 100 else 3)
        back = nested.explode_series_table(table, "MS")
        want = grid.gap_fill(panel, "MS")
        assert back.exceptAll(want).isEmpty() and want.exceptAll(back).isEmpty()
        assert {(r.item_id, r.n) for r in nested.lengths(table).collect()} == {("a", 5), ("b", 2)}


def test_multivariate(spark):
    at = lambda d: datetime(2024, 1, d)
    long = spark.createDataFrame([("s", "v", at(1), 1.0), ("s", "v", at(3), 3.0), ("s", "w", at(2), 5.0)],
                                 "series_name string, variate_name string, ds timestamp, y double")
    row = nested.build_multivariate(long, "D", past_features=2).first()
    assert row.target == [[1.0, None, 3.0], [None, 5.0, None]] and row.variate_names == ["v", "w"] and row.start == at(1)
    assert row.past_feat_dynamic_real == [[None] * 3] * 2
    flat = {r.item_id: r.target for r in nested.to_univariate(nested.build_multivariate(long, "D")).collect()}
    assert flat == {"s_dim0": [1.0, None, 3.0], "s_dim1": [None, 5.0, None]}
    bound = {r.chunk: (r.start, r.target) for r in nested.build_multivariate(long, "D", row_values=5).collect()}
    assert bound == {0: (at(1), [[1.0, None], [None, 5.0]]), 1: (at(3), [[3.0], [None]])}


def test_tasks(spark):
    config = tasks.load_config(CONFIG)
    assert config == tasks._plain_mapping(CONFIG)["datasets"]
    assert tasks.available_terms(config, "events_hourly/H") == ["short", "medium"] and tasks.available_terms(config, "x/H") == []
    assert tasks.find_dataset(config, "orders_daily")[0] == "orders_daily/D"
    with pytest.raises(ValueError):
        tasks.find_dataset(config, "nothing")
    with pytest.raises(ValueError):
        tasks.split_dataset_id("a")
    table = tasks.task_table(spark, config)
    assert table.count() == 6
    split = {r.dataset_id: r.split for r in windows.effective_split(table.withColumn("test_length", F.col("test_length") * 4), smallest=500).collect()}
    assert split["events_hourly/H"] == "test" and split["nation_monthly/MS"] == "full"


def test_results(spark, tmp_path):
    path = str(tmp_path / "r")
    assert results.read_results(spark, path) is None
    df = spark.createDataFrame([("m1", "a", 0, 1.0), ("m2", "a", 0, 2.0)], "model string, unique_id string, window_idx bigint, MASE double")
    results.write_results(df, path, "d", "15T", "short")
    results.write_results(df.where("model = 'm1'").withColumn("MASE", F.lit(9.0)), path, "d", "15T", "short")
    got = {r.model: (r.MASE, r.freq) for r in results.read_results(spark, path).collect()}
    assert got == {"m1": (9.0, "15T"), "m2": (2.0, "15T")}
    assert results.read_results(spark, path, "m2").count() == 1
    assert results.result_config(df, {"seasonality": 24}).count() == 2
    for _ in range(2):
        results.write_config(df, str(tmp_path / "c"), "d", "15T", "short", {"seasonality": 24})
    config = spark.read.json(str(tmp_path / "c")).where("model = 'm1'").collect()
    assert [(c.num_series, c.num_variates, c.num_windows, c.seasonality, c.dataset) for c in config] == [(1, 1, 1, 24, "d")]
    two = df.withColumn("variate_name", F.col("model")).withColumn("model", F.lit("m"))
    assert results.result_config(two, {}).first().num_variates == 2
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("no table")
    with pytest.raises(Exception):
        results.read_results(spark, str(tmp_path / "bad")).count()


def test_feature_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0)], "unique_id string, mean double")
    first = wide.write_features(df, str(tmp_path), "d", "H")
    wide.write_features(df.withColumn("mean", F.lit(2.0)), str(tmp_path), "d", "H")
    assert spark.read.parquet(first).first().mean == 1.0 and first.endswith("stl_features/d/H/test")

    def never():
        raise AssertionError("the table exists")
    assert wide.write_features(never, str(tmp_path), "d", "H") == first
    other = wide.write_features(lambda: df, str(tmp_path), "d", "H", split="full")
    assert spark.read.parquet(other).count() == 1
    wide.write_diagnostics(df, str(tmp_path / "j"), "d", "H")
    assert spark.read.json(str(tmp_path / "j")).first().dataset == "d"
