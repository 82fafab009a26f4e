"""Wide CSV files in, cleaned tables and diagnostics out."""

from __future__ import annotations

import csv
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill.operators.panel import parse_timestamps, time_column


def read_wide_csv(spark: SparkSession, path: str, pattern: str = "*.csv",
                  schema: T.StructType | None = None) -> DataFrame:
    """All matching files of a folder, `series_name` = file name without extension.

    Columns go by the header of each file, and a column that a file lacks is NULL in its rows.
    Without a schema the time column is parsed and all others become DOUBLE, NULL where a
    value is no number; with one, a column has the type that the schema gives to its name.

    All files are read in one scan by position. A table of headers by file is found in one pass
    over the text and joined to the rows by file; only distinct headers come to the driver.
    """
    text = spark.read.option("pathGlobFilter", pattern).text(path)
    first = text.where("_metadata.file_block_start = 0").select(
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), "value")
    files = first.groupBy("file").agg(F.min_by("value", "line").alias("head"))
    heads = [r.head for r in files.select("head").distinct().orderBy("head").collect()]
    if not heads:
        raise ValueError(f"no file with a header matches {pattern} in {path}")
    names = [next(csv.reader([head]), []) for head in heads]
    width = max(map(len, names))
    plain = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    rows = spark.read.option("header", True).option("enforceSchema", True).option("pathGlobFilter", pattern).schema(plain).csv(path)
    stem = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1), r"\.[^.]*$", "")
    rows = rows.select("*", F.col("_metadata.file_path").alias("file"),
                       F.url_decode(F.replace(stem, F.lit("+"), F.lit("%2B"))).alias("series_name"))
    if len(heads) > 1:
        rows = rows.join(files, "file")
    return _by_header(rows, heads, names, {f.name: f.dataType for f in schema.fields} if schema is not None else {})


def _by_header(rows: DataFrame, heads: list[str], names: list[list[str]], kinds: dict[str, T.DataType]) -> DataFrame:
    """Named columns from the columns `c0`, `c1`, ... of rows whose `head` says what these are."""
    def picked(places: list[int | None]) -> Column:
        """The column at the place that each header gives, NULL where it has none."""
        if len(places) == 1:
            return F.col(f"c{places[0]}")
        value = F.when(F.lit(False), F.lit(None).cast("string"))
        for place in sorted({p for p in places if p is not None}):
            own = [head for head, p in zip(heads, places) if p == place]
            value = value.when(F.col("head").isin(own), F.col(f"c{place}"))
        return value

    # the time column of each header, and its type where the schema gives one
    empty = rows.sparkSession.createDataFrame
    times = []
    for own in names:
        shape = empty([], T.StructType([T.StructField(n, kinds.get(n, T.StringType())) for n in own]))
        times.append(time_column(shape))
    stamp = F.lit(None).cast("timestamp")
    for name in dict.fromkeys(times):
        value = picked([own.index(name) if t == name else None for own, t in zip(names, times)])
        kind = kinds.get(name, T.StringType())
        parsed = parse_timestamps(value) if isinstance(kind, T.StringType) else value.try_cast(kind)
        stamp = F.coalesce(stamp, parsed.cast("timestamp"))
    columns = []
    for name in dict.fromkeys(n for own, t in zip(names, times) for n in own if n != t):
        value = picked([own.index(name) if name in own and name != t else None for own, t in zip(names, times)])
        columns.append(value.try_cast(kinds.get(name, T.DoubleType())).alias(name))
    return rows.select("series_name", stamp.alias("timestamp"), *columns)


def write_cleaned(df: DataFrame, path: str, dataset: str, freq: str, fmt: str = "parquet") -> None:
    """Cleaned long or wide table below `dataset=.../freq=...`; a rerun replaces that part and no other."""
    df.withColumns({"dataset": F.lit(dataset), "freq": F.lit(freq)}).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("dataset", "freq").format(fmt).save(path)


def write_diagnostics(report: DataFrame, path: str, dataset: str, freq: str) -> None:
    """Quality report as JSON lines, one per series, without the series itself."""
    write_cleaned(report, path, dataset, freq, fmt="json")


def write_features(df: DataFrame | Callable[[], DataFrame], path: str, dataset: str, freq: str,
                   decomposition: str = "stl", split: str = "test") -> str:
    """Feature table at a path of its key; left alone when it exists already.

    Building features runs jobs. Given a function that returns the table, nothing of it
    runs when the table exists.
    """
    target = f"{path}/{decomposition}_features/{dataset}/{freq}/{split}"
    spark = SparkSession.active()
    place = spark._jvm.org.apache.hadoop.fs.Path(target)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        (df() if callable(df) else df).write.mode("ignore").parquet(target)
    return target
