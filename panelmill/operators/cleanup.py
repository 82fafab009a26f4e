"""Summaries over series and variates, the cleanup plan, and removals.

The input is a report with one row per `(series_name, variate_name)`: the quality
report joined with the identifiers of `uid_info`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DROP_VARIATE_SHARE = 0.5


def series_meta(report: DataFrame) -> DataFrame:
    """Rows, columns, kept and failed variates, and observations of every series."""
    def names(keep):
        return F.array_sort(F.collect_list(F.when(keep, F.col("variate_name"))))

    return report.groupBy("series_name").agg(
        F.max("n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_cols"),
        names(F.lit(True)).alias("original_columns"),
        names(F.col("predictable")).alias("kept_columns"),
        names(~F.col("predictable")).alias("recommended_drop_columns"),
        F.sum("n_obs").alias("num_observations"),
    )


def dataset_summary(meta: DataFrame, num_series: int | None = None) -> DataFrame:
    """Series and observations of the dataset; `num_series` counts failed inputs too."""
    return meta.agg(
        F.coalesce(F.lit(num_series).cast("bigint"), F.count(F.lit(1))).alias("num_series"),
        F.count(F.lit(1)).alias("success_count"),
        F.coalesce(F.sum("num_observations"), F.lit(0)).alias("num_observations"),
        F.coalesce(F.max("n_rows"), F.lit(0)).alias("max_series_length"),
        F.coalesce(F.min("n_rows"), F.lit(0)).alias("min_series_length"),
        F.coalesce(F.round(F.avg("n_rows"), 2), F.lit(0.0)).alias("avg_series_length"),
    )


def variate_summary(report: DataFrame) -> DataFrame:
    """How many series each variate is in, and in how many it passed."""
    kept = F.count(F.when(F.col("predictable"), 1))
    return report.groupBy("variate_name").agg(
        F.count(F.lit(1)).alias("total"), kept.alias("kept"),
        F.round(kept / F.count(F.lit(1)), 4).alias("kept_ratio"))


def dropped_series(report: DataFrame) -> DataFrame:
    """The failures behind the summary, one row each, with the reasons joined."""
    return report.where("NOT predictable").select(
        "variate_name", "series_name", F.array_join("checks", " | ").alias("reason"))


def cleanup_plan(report: DataFrame) -> DataFrame:
    """`(action, target, cause)`: drop a variate that fails in at least half of its
    series, else drop the series it fails in; drop series without any good variate."""
    share = 1 - F.col("kept") / F.col("total")
    summary = variate_summary(report).withColumn("share", share).where(F.col("share") > 0)
    heavy = summary.where(F.col("share") >= DROP_VARIATE_SHARE).select(
        F.lit("drop_variate").alias("action"), F.col("variate_name").alias("target"), F.lit("mostly_failed").alias("cause"))
    light = summary.where(F.col("share") < DROP_VARIATE_SHARE).select("variate_name")
    partly = report.where("NOT predictable").join(light, "variate_name", "left_semi").select(
        F.lit("drop_series").alias("action"), F.col("series_name").alias("target"), F.lit("partly_failed").alias("cause"))
    passed = report.where("predictable").select("series_name")
    empty = report.join(passed, "series_name", "left_anti").select(
        F.lit("drop_series").alias("action"), F.col("series_name").alias("target"), F.lit("all_failed").alias("cause"))
    return heavy.unionByName(partly).unionByName(empty).distinct()


def targets(plan: DataFrame, action: str) -> DataFrame:
    """What one action of a cleanup plan names; feeds the removals without passing the driver."""
    return plan.where(F.col("action") == action).select("target").distinct()


def _named(names: DataFrame, column: str) -> DataFrame:
    """The first column of a frame of names, as `column`."""
    return names.select(F.col(names.columns[0]).alias(column)).where(F.col(column).isNotNull()).distinct()


def _without(df: DataFrame, column: str, names: list[str] | DataFrame) -> DataFrame:
    if isinstance(names, DataFrame):
        return df.join(_named(names, column), column, "left_anti").select(df.columns)
    return df.where(~F.col(column).isin(names))


def drop_variate(df: DataFrame, names: list[str] | DataFrame) -> DataFrame:
    """Rows of all other variates; `names` is a list, or a frame whose first column holds the names."""
    return _without(df, "variate_name", names)


def drop_series(df: DataFrame, names: list[str] | DataFrame) -> DataFrame:
    """Rows of all other series; `names` as in `drop_variate`."""
    return _without(df, "series_name", names)


def apply_plan(df: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows left when all removals of a cleanup plan are done."""
    return drop_series(drop_variate(df, targets(plan, "drop_variate")), targets(plan, "drop_series"))


def drop_marked(df: DataFrame, report: DataFrame) -> DataFrame:
    """Remove the (series, variate) pairs that failed their checks."""
    failed = report.where("NOT predictable").select("series_name", "variate_name")
    return df.join(failed, ["series_name", "variate_name"], "left_anti")


def dry_run(report: DataFrame, variates: list[str] | DataFrame = (), series: list[str] | DataFrame = (),
            marked: bool = False) -> DataFrame:
    """What a removal would touch: series changed, pairs removed, observations lost."""
    hit = ~F.col("predictable") if marked else F.lit(False)
    for column, names in (("variate_name", variates), ("series_name", series)):
        if isinstance(names, DataFrame):
            flag = f"_{column}"
            report = report.join(_named(names, column).withColumn(flag, F.lit(True)), column, "left")
            hit = hit | F.col(flag).isNotNull()
        else:
            hit = hit | F.col(column).isin(list(names))
    return report.agg(
        F.count_distinct(F.when(hit, F.col("series_name"))).alias("series_touched"),
        F.count(F.when(hit, 1)).alias("pairs_removed"),
        F.coalesce(F.sum(F.when(hit, F.col("n_obs"))), F.lit(0)).alias("observations_removed"),
    )


def recompute(report: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Series, dataset and variate summaries of what is left after a removal."""
    meta = series_meta(report)
    return meta, dataset_summary(meta), variate_summary(report)
