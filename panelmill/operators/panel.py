"""Between wide files and the long panel, and calendar facts of a panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions import frequency as fq

# The layouts tried after the default one.
TIME_LAYOUTS = ("dd.MM.yyyy HH:mm", "dd.MM.yyyy", "MM/dd/yyyy HH:mm")
WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")


def time_column(df: DataFrame) -> str:
    """The first column named or typed as a time."""
    timed = [c for c, kind in df.dtypes
             if "time" in c.lower() or "date" in c.lower() or kind in ("timestamp", "timestamp_ntz", "date")]
    if not timed:
        raise ValueError("no timestamp column: need 'time' or 'date' in a name, or a datetime type")
    return timed[0]


def normalize_timestamp_column(df: DataFrame) -> DataFrame:
    """Rename the first time column to `timestamp` and move it to the front."""
    time = time_column(df)
    rest = [F.col(f"`{c}`") for c in df.columns if c != time]
    return df.select(F.col(f"`{time}`").alias("timestamp"), *rest)


def parse_timestamps(text: Column) -> Column:
    """Default layout first, then the known ones, else NULL; decided per value."""
    tries = [F.try_to_timestamp(text)] + [F.try_to_timestamp(text, F.lit(layout)) for layout in TIME_LAYOUTS]
    return F.coalesce(*tries)


def to_panel(wide: DataFrame, id_cols: list[str], time_col: str = "timestamp",
             var_cols: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """Wide to long, one row per variate and timestamp; missing cells are kept.

    With `as_text` cells stay text, for `quality_report` to find variates that are not numeric.
    """
    variates = var_cols or [c for c in wide.columns if c != time_col and c not in id_cols]
    long = wide.select(*id_cols, time_col, *[F.col(f"`{c}`").cast("string" if as_text else "double").alias(c) for c in variates]).unpivot(
        [*id_cols, time_col], variates, "variate_name", "y")
    return long.select(
        *id_cols, "variate_name", F.concat_ws("_", *id_cols, "variate_name").alias("unique_id"),
        F.col(time_col).alias("ds"), "y")


def uid_info(long: DataFrame) -> DataFrame:
    return long.select("unique_id", "series_name", "variate_name").distinct()


def candidate_table(bounds: DataFrame, freq: str) -> DataFrame:
    """Candidate periods shorter than each series, with their frequency bands."""
    bands = F.array(*[
        F.struct(F.lit(i).alias("rank"), F.lit(p).cast("bigint").alias("period"), F.lit(lo).alias("f_lo"), F.lit(hi).alias("f_hi"))
        for i, (p, lo, hi) in enumerate(fq.period_bands(freq))])
    return bounds.withColumn("band", F.explode(bands)).where(F.col("band.period") < F.col("n")).select(
        *bounds.columns, "band.rank", "band.period", "band.f_lo", "band.f_hi")


def weekly_anchor(panel: DataFrame) -> DataFrame:
    """The weekday (0 = Monday) that occurs most often; the earlier one in a tie."""
    days = panel.groupBy("unique_id", fq.weekday(F.col("ds")).alias("weekday")).agg(F.count(F.lit(1)).alias("c"))
    return days.groupBy("unique_id").agg(F.max_by("weekday", F.col("c") * 10 - F.col("weekday")).alias("weekday"))


def infer_freq(times: DataFrame, block_days: int = 3650, stretch_seconds: int = 65_536) -> DataFrame:
    """Alias of a regular series from its spacing; NULL where it is irregular.

    Distances are taken inside stretches of `stretch_seconds`. The edges of stretches are
    compared within blocks of `block_days`, those of blocks among themselves, so no window
    holds more than a stretch of a per-second series, or the stretches of one block.
    """
    ds = F.col("ds").cast("timestamp")
    rows = times.select("unique_id", ds.alias("ds"), fq.floor_div(fq.days_of(ds), block_days).alias("block"),
                        fq.floor_div(F.unix_seconds(ds), stretch_seconds).alias("stretch"))
    inside = Window.partitionBy("unique_id", "block", "stretch").orderBy("ds")
    within = Window.partitionBy("unique_id", "block").orderBy("stretch")
    across = Window.partitionBy("unique_id").orderBy("block")
    ends = rows.groupBy("unique_id", "block", "stretch").agg(F.max("ds").alias("last"))
    before = ends.groupBy("unique_id", "block").agg(F.max("last").alias("last")).select(
        "unique_id", "block", F.lag("last").over(across).alias("before"))
    ends = ends.join(before, ["unique_id", "block"]).select(
        "unique_id", "block", "stretch", F.coalesce(F.lag("last").over(within), F.col("before")).alias("edge"))
    rows = rows.join(ends, ["unique_id", "block", "stretch"]).withColumn(
        "previous", F.coalesce(F.lag("ds").over(inside), F.col("edge")))
    months = (F.year("ds") - F.year("previous")) * 12 + F.month("ds") - F.month("previous")
    first, last = F.day("ds") == 1, F.col("ds").cast("date") == F.last_day("ds")
    gap = F.unix_seconds("ds") - F.unix_seconds("previous")
    business = F.when(F.weekday("ds") > F.weekday("previous"), gap == 86400 * (F.weekday("ds") - F.weekday("previous"))) \
        .otherwise((F.weekday("previous") == 4) & (F.weekday("ds") == 0) & (gap == 3 * 86400))
    facts = rows.groupBy("unique_id").agg(
        F.min(gap).alias("lo"), F.max(gap).alias("hi"), F.min(months).alias("m_lo"), F.max(months).alias("m_hi"),
        F.min(first).alias("firsts"), F.min(last).alias("lasts"), F.count(F.lit(1)).alias("rows"),
        F.min(business & (gap <= 3 * 86400)).alias("workdays"), F.max(F.weekday("ds")).alias("wd"))

    def named(count: Column, unit: str) -> Column:
        return F.concat(F.when(count > 1, count.cast("bigint").cast("string")).otherwise(""), F.lit(unit))

    def every(seconds: int) -> Column:
        return (F.col("lo") == F.col("hi")) & (F.pmod("lo", F.lit(seconds)) == 0)

    lo, month = F.col("lo"), F.col("m_lo")
    anchor = F.concat(F.lit("W-"), F.array(*[F.lit(d) for d in WEEKDAYS])[F.col("wd")])
    fixed = (
        F.when(F.col("lo") == F.col("hi"),
               F.when(lo == 604800, anchor).when(every(86400), named(lo / 86400, "D"))
               .when(every(3600), named(lo / 3600, "H")).when(every(60), named(lo / 60, "T")).otherwise(named(lo, "S")))
    )
    edge = F.when(F.col("firsts"), "S").when(F.col("lasts"), "E")
    monthly = F.when((F.col("m_lo") == F.col("m_hi")) & (month > 0) & edge.isNotNull(), F.concat(
        F.when(month % 12 == 0, named(month / 12, "Y")).when(month % 3 == 0, named(month / 3, "Q")).otherwise(named(month, "M")),
        edge))
    alias = F.when((F.col("rows") < 3) | (lo <= 0), F.lit(None).cast("string")).otherwise(
        F.coalesce(monthly, fixed, F.when(F.col("workdays"), F.lit("B"))))
    return facts.select("unique_id", alias.alias("freq"))
