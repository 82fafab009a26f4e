"""Result tables partitioned by model, dataset, frequency and horizon."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

PARTITIONS = ("model", "dataset", "freq", "horizon")


def write_results(df: DataFrame, path: str, dataset: str, freq: str, horizon: str) -> None:
    """Per-window metrics or quantiles of any models; a rerun replaces its own partitions."""
    keyed = df.withColumns({"dataset": F.lit(dataset), "freq": F.lit(freq), "horizon": F.lit(horizon)})
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)


def read_results(spark: SparkSession, path: str, model: str | None = None) -> DataFrame | None:
    """Everything below the folder; tasks that were never written are simply absent.

    A model is selected by partition, so the others are not read. None if there is
    no result at all.
    """
    try:
        df = spark.read.option("basePath", path).parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    df = df.withColumns({c: F.col(c).cast("string") for c in PARTITIONS})
    return df if model is None else df.where(F.col("model") == model)


def result_config(metrics: DataFrame, task: dict) -> DataFrame:
    """Shape of a result: series, variates, windows and the settings of the task.

    Metrics without a `variate_name` are those of single-variate series.
    """
    variates = F.count_distinct("variate_name") if "variate_name" in metrics.columns else F.lit(1).cast("bigint")
    return metrics.groupBy("model").agg(
        F.count_distinct("unique_id").alias("num_series"),
        variates.alias("num_variates"),
        F.count_distinct("window_idx").alias("num_windows"),
    ).withColumns({k: F.lit(v) for k, v in task.items()})


def write_config(metrics: DataFrame, path: str, dataset: str, freq: str, horizon: str, task: dict) -> None:
    """The configuration of a result, as JSON in a folder of its own, partitioned as the result is."""
    keyed = result_config(metrics, task).withColumns({"dataset": F.lit(dataset), "freq": F.lit(freq), "horizon": F.lit(horizon)})
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).json(path)
