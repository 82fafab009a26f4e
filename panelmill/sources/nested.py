"""The nested series table: one row per item with its values as an array.

A row must stay well below the row size limit, so an item longer than
`chunk_steps` continues in further rows: `chunk` numbers them and `start` is the
time of the first value of the row. Shorter items, the usual case, have chunk 0 only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.functions import frequency as fq
from panelmill.functions.frequency import floor_div
from panelmill.operators import grid

CHUNK_STEPS = 1_000_000
ROW_VALUES = 16_000_000  # values of all variates in one row


def item_ids(info: DataFrame) -> DataFrame:
    """`(unique_id, item_id)`: the file for single-variate files, the variate for a
    single file, else both joined."""
    counts = info.agg(F.count_distinct("series_name").alias("files"), F.count_distinct("variate_name").alias("variates"))
    files, variates = counts.select("files").scalar(), counts.select("variates").scalar()
    name = (
        F.when((files > 1) & (variates == 1), F.col("series_name"))
        .when(files == 1, F.col("variate_name"))
        .otherwise(F.concat_ws("_", "series_name", "variate_name"))
    )
    return info.select("unique_id", name.alias("item_id"))


def _chunks(panel: DataFrame, freq: str, chunk_steps: int) -> DataFrame:
    df = grid.dense(panel, freq, block_steps=min(grid.BLOCK_STEPS, chunk_steps)).where("core")
    return df.withColumn("chunk", floor_div(F.col("pos"), chunk_steps))


def _target(value: str):
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.col(value).cast("float").alias("v"))))
    return F.transform(ordered, lambda p: p["v"])


def build_univariate(panel: DataFrame, freq: str, chunk_steps: int = CHUNK_STEPS) -> DataFrame:
    """Panel to nested, `(item_id, chunk, start, freq, target)`; gaps become NULL values."""
    return _chunks(panel, freq, chunk_steps).groupBy("unique_id", "chunk").agg(
        F.min("ds").alias("start"), _target("y").alias("target")
    ).select(F.col("unique_id").alias("item_id"), "chunk", "start", F.lit(freq).alias("freq"), "target")


def build_multivariate(long: DataFrame, freq: str, chunk_steps: int = CHUNK_STEPS,
                       past_features: int = 0, row_values: int = ROW_VALUES) -> DataFrame:
    """Long rows `(series_name, variate_name, ds, y)` to one row per series with the
    variates as rows of `target`, in name order, on the grid of the whole series.

    A chunk has at most `chunk_steps` steps, and `row_values` values over all variates."""
    parts = long.select(F.concat_ws("\u0001", "series_name", "variate_name").alias("unique_id"),
                        "series_name", "variate_name", "ds", "y")
    # Every variate gets the first and last timestamp of its series, so all share one grid.
    edges = parts.groupBy("series_name").agg(F.min("ds").alias("lo"), F.max("ds").alias("hi"))
    names = parts.select("series_name", "variate_name", "unique_id").distinct()
    frame = names.join(edges, "series_name").select(
        "unique_id", F.explode(F.array("lo", "hi")).alias("ds"), F.lit(None).cast("double").alias("y"))
    widths = names.groupBy("series_name").agg(F.count(F.lit(1)).alias("width"))
    steps = names.join(widths, "series_name").select("unique_id", F.least(
        F.lit(chunk_steps).cast("bigint"), F.greatest(F.lit(1).cast("bigint"), F.floor(row_values / F.col("width")))
    ).alias("steps"))
    df = grid.dense(parts.select("unique_id", "ds", "y").unionByName(frame), freq,
                    block_steps=min(grid.BLOCK_STEPS, chunk_steps)).where("core")
    chunked = grid.attach(df, steps).withColumn("chunk", F.floor(F.col("pos") / F.col("steps")))
    keyed = chunked.withColumns({
        "item_id": F.element_at(F.split("unique_id", "\u0001"), 1),
        "variate": F.element_at(F.split("unique_id", "\u0001"), 2),
    })
    rows = keyed.groupBy("item_id", "variate", "chunk").agg(F.min("ds").alias("start"), _target("y").alias("values"))
    order = F.array_sort(F.collect_list(F.struct("variate", "values")))
    nested = rows.groupBy("item_id", "chunk").agg(F.min("start").alias("start"), order.alias("all")).select(
        "item_id", "chunk", "start", F.lit(freq).alias("freq"),
        F.transform("all", lambda v: v["values"]).alias("target"),
        F.transform("all", lambda v: v["variate"]).alias("variate_names"))
    return with_past_features(nested, past_features) if past_features else nested


def with_past_features(nested: DataFrame, k: int) -> DataFrame:
    """Add `k` all-missing dynamic feature rows as long as the target."""
    size = F.size(F.col("target")[0])
    return nested.withColumn("past_feat_dynamic_real", F.array_repeat(F.array_repeat(F.lit(None).cast("float"), size), k))


def to_univariate(nested: DataFrame) -> DataFrame:
    """One row per dimension of a multivariate table, `item_id` + `_dim` + number."""
    return nested.select("item_id", "chunk", "start", "freq", F.posexplode("target").alias("dim", "values")).select(
        F.concat("item_id", F.lit("_dim"), F.col("dim").cast("string")).alias("item_id"), "chunk", "start", "freq",
        F.col("values").alias("target"))


def explode_series_table(nested: DataFrame, freq: str) -> DataFrame:
    """Nested (univariate) back to the panel; times follow from start and position."""
    f = fq.parse_freq(freq)
    at = fq.units(F.col("start"), f) + F.col("at") * f.stride
    return nested.select("item_id", "start", F.posexplode("target").alias("at", "v")).select(
        F.col("item_id").alias("unique_id"), fq.unit_time(at, f).alias("ds"), F.col("v").cast("double").alias("y"))


def lengths(nested: DataFrame) -> DataFrame:
    """Length and number of dimensions of every item, without reading values."""
    kind = dict(nested.dtypes)["target"]
    multi = kind.startswith("array<array")
    size = F.size(F.col("target")[0]) if multi else F.size("target")
    dims = F.size("target") if multi else F.lit(1)
    return nested.groupBy("item_id").agg(
        F.sum(size).alias("n"), F.max(dims).cast("bigint").alias("dims"))
