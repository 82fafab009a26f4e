"""Rule-based quality filter whose cutoffs carry a guarantee on false rejections. Native DataFrame code only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from panelmill.llm.common import stored, table, words
from panelmill.llm.registry import query

STRATA = ("de", "en", "es", "fr")  # any other language, or none, is the stratum "other"
RISK = 0.02  # of the good documents of a stratum, at most this share is rejected ...
CONFIDENCE = 0.95  # ... in all strata at once with this probability
MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8

#: Scores (higher is worse) and their candidate cutoffs, from lenient to strict.
RULES = {
    "symbols": ("n_symbols / n_words", (3.0, 2.5, 2.0, 1.5, 1.2, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "dup_lines": ("n_dup_lines / n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "repeats": ("n_repeat_words / n_words", (0.28, 0.26, 0.24, 0.22, 0.2, 0.18, 0.16, 0.14, 0.12, 0.1)),
    "long_words": ("word_chars / n_words", (30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 13.0, 12.0, 11.0, 10.0)),
    "short_words": ("-word_chars / n_words", (-1.25, -1.5, -1.75, -2.0, -2.25, -2.5, -2.75, -3.0, -3.25, -3.5)),
}


def _beside(items: Column, field: str) -> Column:
    """The structs of a sorted array whose `field` equals that of a neighbour."""
    def same(x, i, step):
        return F.coalesce(F.get(items, i + step)[field] == x[field], F.lit(False))
    return F.filter(items, lambda x, i: same(x, i, -1) | same(x, i, 1))


def signals(docs: DataFrame) -> DataFrame:
    """Counts over the whole text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines.

    The windows of a text are compared by hash first and by their words where hashes agree,
    all within the row, so nothing is shuffled.
    """
    df = docs.select(
        "doc_id", F.when(F.col("lang").isin(*STRATA), F.col("lang")).otherwise("other").alias("stratum"),
        words("text").alias("ws"),
        F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    df = df.select(
        "doc_id", "stratum", "ws", F.size("ws").cast("long").alias("n_words"), F.array_join("ws", "").alias("joined"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("ws") > WINDOW, F.transform(
            F.sequence(F.lit(1), F.size("ws") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("ws", i, WINDOW)))
        ).alias("hashes"))
    df = df.select(
        "doc_id", "stratum", "ws", "n_words", "n_lines", "n_dup_lines", F.length("joined").cast("long").alias("word_chars"),
        F.regexp_count("joined", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.array_sort(
            F.transform("hashes", lambda h, i: F.struct(h.alias("h"), (i + 1).alias("i"))))).alias("hashes"))
    df = df.withColumn("hashes", _beside(F.col("hashes"), "h"))
    df = df.withColumn("exact", F.array_sort(F.transform(
        "hashes", lambda x: F.struct(F.slice("ws", x["i"], WINDOW).alias("w"), x["i"].alias("i")))))
    df = df.withColumn("at", F.array_sort(F.transform(_beside(F.col("exact"), "w"), lambda x: x["i"])))
    covered = F.aggregate(
        "at", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(x.alias("last"), (s["n"] + F.least(F.lit(WINDOW), x - s["last"])).alias("n")), lambda s: s["n"])
    return df.select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                     F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_lines")


def _log_factorial(x: Column) -> Column:
    """ln x! by Stirling's series, shifted by ten so that its error is below 1e-14."""
    z = x + 11.0
    series = (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi)
    for power, divisor in ((1, 12), (3, -360), (5, 1260), (7, -1680), (9, 1188)):
        series = series + 1 / (divisor * F.pow(z, F.lit(power)))
    for k in range(1, 11):
        series = series - F.ln(x + float(k))
    return series


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), exact, for k <= n p; 1 beyond (never significant).

    Terms fall off geometrically below k, so 60 + 12 sqrt(n p) of them hold all the mass
    that a double can show.
    """
    k, n = k.cast("double"), n.cast("double")
    top = F.exp(_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(p)
                + (n - k) * math.log1p(-p))
    terms = F.least(k, 60 + 12 * F.sqrt(n * p)).cast("int")
    odds = (1 - p) / p
    total = F.aggregate(
        F.sequence(F.lit(0), terms), F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s")),
        lambda a, j: F.struct((a["t"] * (k - j) / (n - k + j + 1) * odds).alias("t"), (a["s"] + a["t"]).alias("s")),
        lambda a: a["s"])
    return F.when(k <= n * p, top * total).otherwise(1.0)


def _scores() -> Column:
    return F.array(*(
        F.struct(F.lit(name).alias("rule"), F.expr(f"try_divide(cast({a} as double), {b})").alias("score"),
                 F.array(*map(F.lit, cutoffs)).alias("cutoffs"))
        for name, (expr, cutoffs) in RULES.items() for a, b in [expr.split(" / ")]))


def certified_cutoffs(seen: DataFrame, labels: DataFrame) -> DataFrame:
    """The strictest safe cutoff per stratum and rule, as one row `(stratum, cutoffs map)` per stratum.

    The labelled documents of quality 1 that pass the base rule are the holdout. The risk of
    a stratum is shared equally by its rules (so their union keeps it), the error probability
    by all strata and rules (Bonferroni); within a rule the cutoffs are tested from lenient to
    strict, each by an exact binomial test at that full level, until the first that fails
    (fixed-sequence testing). Where too few labels exist nothing is certified, and the rule
    rejects nothing.
    """
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1")
    held = seen.where("not base_failed").join(good.select("doc_id"), "doc_id", "left_semi")
    scored = held.select("stratum", F.explode(_scores()).alias("s")).select(
        "stratum", "s.rule", F.size(F.filter("s.cutoffs", lambda c: c < F.col("s.score"))).alias("over"))
    tallies = scored.groupBy("stratum", "rule", "over").agg(F.count("*").alias("n"))
    # per stratum and rule: how many exceed the cutoff of each step, and all
    steps = tallies.groupBy("stratum", "rule").agg(
        F.sum("n").alias("n"), F.collect_list(F.struct("over", "n")).alias("by"))
    step = F.explode(F.sequence(F.lit(1), F.element_at(_literal_map(lambda c: len(c)), F.col("rule"))))
    steps = steps.select("stratum", "rule", "n", "by", step.alias("step")).select(
        "stratum", "rule", "n", "step", F.aggregate(
            F.filter("by", lambda x: x["over"] >= F.col("step")), F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("k"))
    level = (1 - CONFIDENCE) / ((len(STRATA) + 1) * len(RULES))
    tested = steps.withColumn("fails", binomial_tail(F.col("k"), F.col("n"), RISK / len(RULES)) > level)
    passed = tested.withColumn("failed", F.max("fails").over(
        Window.partitionBy("stratum", "rule").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)))
    best = passed.where("not failed").groupBy("stratum", "rule").agg(F.max("step").alias("step"))
    cutoff = F.element_at(F.element_at(_literal_map(lambda c: [float(x) for x in c]), F.col("rule")), F.col("step"))
    return best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", cutoff))).alias("cutoffs"))


def _literal_map(of) -> Column:
    def lit(x):
        return F.array(*map(F.lit, x)) if isinstance(x, list) else F.lit(x)
    return F.create_map(*(c for name, (_, cutoffs) in RULES.items() for c in (F.lit(name), lit(of(cutoffs)))))


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, base rule and verdict of each document: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept.

    A null or empty text has no words and fails the base rule. Repeated rows of a doc_id are
    judged one by one; several labels of one document count as good if any is. Rows without
    doc_id are judged too, and only never serve as holdout.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    seen = stored(signals(docs).withColumn("base_failed", failed), "quality-signals")
    cutoffs = F.broadcast(certified_cutoffs(seen, labels))  # a row per stratum, at most len(STRATA) + 1
    judged = seen.join(cutoffs, "stratum", "left").withColumn("rejected", F.exists(
        _scores(), lambda s: F.coalesce(s["score"] > F.try_element_at("cutoffs", s["rule"]), F.lit(False))))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         (~F.col("base_failed") & ~F.col("rejected")).alias("kept"))


def _sql() -> str:
    level = (1 - CONFIDENCE) / ((len(STRATA) + 1) * len(RULES))
    p = RISK / len(RULES)
    grid = "\nUNION ALL ".join(
        f"SELECT '{name}' AS rule, unnest(range(1, {len(c) + 1})) AS step, unnest([{', '.join(map(str, c))}]::DOUBLE[]) AS cutoff"
        for name, (_, c) in RULES.items())
    scores = "\nUNION ALL ".join(
        f"SELECT doc_id, stratum, base_failed, '{name}' AS rule, CASE WHEN {e.split(' / ')[1]} > 0 THEN "
        f"CAST({e.split(' / ')[0]} AS DOUBLE) / {e.split(' / ')[1]} END AS score FROM seen" for name, (e, _) in RULES.items())
    return rf"""
WITH w AS (
  SELECT doc_id, CASE WHEN lang IN ({', '.join(f"'{s}'" for s in STRATA)}) THEN lang ELSE 'other' END AS stratum,
         coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
lc AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l
       WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) >= 8),
win2 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i + 7], ' ')) AS c FROM win),
rep AS (SELECT doc_id, count(DISTINCT spot) AS n_repeat_words
        FROM (SELECT doc_id, unnest(range(i, i + 8)) AS spot FROM win2 WHERE c > 1) GROUP BY doc_id),
seen AS (
  SELECT w.doc_id, stratum, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(array_to_string(ws, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines,
         len(ws) < {MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {REPEAT_PERCENT} * len(ws) AS base_failed
  FROM w LEFT JOIN lc USING (doc_id) LEFT JOIN rep USING (doc_id)),
sc AS ({scores}),
g AS ({grid}),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1),
t AS (
  SELECT stratum, g.rule, g.step, g.cutoff, CAST(count(*) AS DOUBLE) AS n,
         CAST(count(*) FILTER (WHERE score > cutoff) AS DOUBLE) AS k
  FROM sc JOIN good USING (doc_id) JOIN g USING (rule) WHERE NOT base_failed GROUP BY ALL),
f AS (
  SELECT *, CASE WHEN k > n * {p!r} THEN 1.0 ELSE list_sum([exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1)
         + j * ln({p!r}) + (n - j) * ln(1 - {p!r})) FOR j IN range(0, CAST(k AS BIGINT) + 1)]) END > {level!r} AS fails FROM t),
o AS (SELECT *, max(CAST(fails AS INT)) OVER (PARTITION BY stratum, rule ORDER BY step) AS failed FROM f),
best AS (SELECT stratum, rule, arg_max(cutoff, step) AS cutoff FROM o WHERE failed = 0 GROUP BY stratum, rule),
bad AS (SELECT DISTINCT doc_id FROM sc JOIN best USING (stratum, rule) WHERE score > cutoff)
SELECT seen.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND bad.doc_id IS NULL AS kept
FROM seen LEFT JOIN bad ON bad.doc_id = seen.doc_id
"""


@query("op6_quality_rules", _sql())
def quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_verdicts(table(spark, sf, "documents"), table(spark, sf, "labels"))
