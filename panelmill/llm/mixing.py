"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.llm.common import running, stored, table, words
from panelmill.llm.registry import query

WEIGHTS = (5, 2, 1)  # of the sources in their order, repeating
SHARE = 1.5  # of all sizes, what the mix takes
MOST = 2  # times its size, what one source can give
SEED = "mix"


def targets(sizes: DataFrame) -> DataFrame:
    """`(source, source_size, n, target)` from `(source, source_size, n)`, one row per source.

    Weights follow the order of the sources (code points, null last). The level at which the
    uncapped sources share what is left is the largest of the levels met when sources are
    capped one after another in the order of their capacity per weight, so one pass of
    prefix sums finds it. All sums are exact integers.
    """
    named = sizes.select((F.col("source").isNull()).cast("int").alias("last"), "source", "source_size", "n",
                         F.lit(1).cast("long").alias("one"))
    ranked = running(named, ["last", "source"], ["one"], None, "mix-sources")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("one_upto") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    ranked = ranked.withColumn("w", weight.cast("long")).withColumn("room", (MOST * F.col("source_size")).cast("long"))
    ordered = running(ranked.withColumn("ratio", F.col("room") / F.col("w")).drop("one"),
                      ["ratio", "one_upto"], ["room", "w"], None, "mix-levels")
    total = ordered.agg(F.sum("source_size"), F.sum("w")).first()
    if not total[0]:  # nothing to share (no rows, or no words)
        return ordered.select("source", "source_size", "n", F.lit(0.0).alias("target"))
    left = F.lit(SHARE * total[0]) - (F.col("room_upto") - F.col("room"))
    level = ordered.agg(F.max(left / (F.lit(total[1]) - (F.col("w_upto") - F.col("w"))))).first()[0]
    return ordered.select("source", "source_size", "n",
                          F.least(F.col("room").cast("double"), F.lit(level) * F.col("w")).alias("target"))


def mixed(docs: DataFrame) -> DataFrame:
    """Copies of each document in the mix: doc_id, size, source_size, target, copies, taken.

    Within a source the documents stand by size, then doc_id; each expects target /
    source_size copies. The prefix sum of these, plus one random offset per source (a hash of
    seed and name, so reruns agree), crosses integers, and a document is taken once for each
    that it crosses: never more than twice, and since neighbours are alike in size, a source
    misses its target by at most its largest document.

    Size is the number of words; a null text has 0. Null is a source of its own, ordered
    last. An empty table gives no rows. Rows with equal doc_id are documents of their own.
    """
    sized = docs.select("doc_id", "source", F.size(words("text")).cast("long").alias("size"), F.lit(1).cast("long").alias("one"))
    order = ["source", "size", "doc_id"]
    rows = running(sized, order, ["one", "size"], "source", "mix-documents")
    rows = stored(rows.drop("size_upto"), "mix-ranked")
    share = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    share = share.select(F.col("source").alias("of"), "source_size", "target")
    rows = rows.join(share, F.col("source").eqNullSafe(F.col("of")))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(SEED + ":"), F.coalesce("source", F.lit("\0")))), 1, 8), 16, 10).cast("long") / 4294967296.0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)

    def crossed(rank):
        return F.floor(rate * rank + offset)
    copies = F.least(F.lit(MOST), crossed(F.col("one_upto")) - crossed(F.col("one_upto") - 1))
    return rows.withColumn("copies", copies.cast("int")).select(
        "doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
           FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM s),
v AS (SELECT *, CASE (i - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM o),
c AS (SELECT *, sum(2 * source_size) OVER q - 2 * source_size AS room_before, sum(w) OVER q - w AS w_before,
             sum(source_size) OVER () AS all_size, sum(w) OVER () AS all_w
      FROM v WINDOW q AS (ORDER BY CAST(2 * source_size AS DOUBLE) / w, i ROWS UNBOUNDED PRECEDING)),
x AS (SELECT max(({SHARE} * all_size - room_before) / (all_w - w_before)) AS level FROM c),
t AS (SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), (SELECT level FROM x) * w) AS target FROM v),
r AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) AS i FROM d),
z AS (SELECT r.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
             CAST('0x' || substr(md5('{SEED}:' || coalesce(r.source, chr(0))), 1, 8) AS BIGINT) / 4294967296.0 AS u
      FROM r JOIN t ON t.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
       CAST(least(2, floor(rate * i + u) - floor(rate * (i - 1) + u)) AS INTEGER) AS copies,
       CAST(least(2, floor(rate * i + u) - floor(rate * (i - 1) + u)) * size AS BIGINT) AS taken FROM z
"""


@query("op7_mixing", SQL)
def mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixed(table(spark, sf, "documents"))
