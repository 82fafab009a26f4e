"""Helpers that several corpus operators share."""

from __future__ import annotations

import gc
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.session import work_folder

SPACE = r"[\x20\x09-\x0D]+"  # what separates words


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def passing_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, deleted when the application ends."""
    path = work_folder(spark, name)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again.

    It cuts the lineage with files that every executor sees and that outlive any of
    them. The files go when the application ends.
    """
    spark = df.sparkSession
    path = passing_folder(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def words(text: Column | str) -> Column:
    """The words of a text as an array; none for a null text."""
    return F.array_remove(F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), SPACE), "")


def text_bytes(column):
    """The UTF-8 bytes of a string array in a row, and where each text begins (its end last). Nulls are empty."""
    import numpy as np
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


@contextmanager
def without_cycles():
    """No search for reference cycles meanwhile: a task that remembers millions of small objects
    and makes no cycles would have them all walked through again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def by_bytes(batches, place: int, most: int):
    """The batches cut so that the texts in column `place` have `most` bytes together, or one text is longer."""
    import numpy as np

    for batch in batches:
        ends, at = text_bytes(batch.column(place))[1], 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of the edges `(u, v)`: rows `(node, component)`.

    Alternating large-star and small-star until nothing changes; a component is named
    by its smallest node. Each star takes a minimum per node with partial aggregation
    and an equi-join, which a star centre with many edges can be split in. Nodes
    without an edge have no row. No edge collects on the driver: only a count and a
    checksum of each round do.
    """
    edges = (edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
             .distinct())
    edges, before = stored(edges, name), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select(F.col("v"), F.col("v")).distinct())
        before = state
        edges = stored(_small_star(_large_star(edges)), name)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def running(df: DataFrame, order: Sequence[str], sums: Sequence[str], by: str | None, name: str) -> DataFrame:
    """`df` with `<sum>_upto`: running sums of long columns along `order`, this row included.

    The order must be total. With `by`, the first column of `order`, the sums start anew for
    each of its values (null is a value). No window holds a whole group: rows are dealt out by
    ranges of the order, summed within their range, and the sums of the ranges before are added
    from a table with one row per range and group.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    spark = df.sparkSession
    fields = [*df.schema.fields, T.StructField("_range", T.IntegerType()),
              *(T.StructField(f"{s}_upto", T.LongType()) for s in sums)]
    schema, place = T.StructType(fields), df.columns.index(by) if by else None
    at = [df.columns.index(s) for s in sums]

    def add(batches):
        from pyspark import TaskContext

        number, last, so_far = TaskContext.get().partitionId(), object(), [0] * len(at)
        for batch in batches:
            keys = batch.column(place).to_pylist() if by else [0] * batch.num_rows
            values, out = [batch.column(i).to_pylist() for i in at], [[] for _ in at]
            for i, key in enumerate(keys):
                if key != last:
                    last, so_far = key, [0] * len(at)
                for j, v in enumerate(values):
                    so_far[j] += v[i] or 0
                    out[j].append(so_far[j])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([number] * batch.num_rows, pa.int32()), *(pa.array(o, pa.int64()) for o in out)],
                names=[f.name for f in fields])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = stored(dealt.mapInArrow(add, schema), name)
    group = ["_group"]
    rows = rows.withColumn("_group", F.col(by) if by else F.lit(0))
    whole = rows.groupBy("_group", "_range").agg(*(F.max(f"{s}_upto").alias(f"_{s}") for s in sums))
    from pyspark.sql import Window

    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(F.col("_group").alias("_g"), F.col("_range").alias("_r"),
                         *(F.coalesce(F.sum(f"_{s}").over(before), F.lit(0)).alias(f"_{s}") for s in sums))
    joined = rows.join(whole, (F.col("_range") == F.col("_r")) & F.col("_group").eqNullSafe(F.col("_g")), "left")
    keep = [c for c in df.columns]
    return joined.select(*keep, *((F.col(f"{s}_upto") + F.col(f"_{s}")).alias(f"{s}_upto") for s in sums))
