"""How far the term frequencies of the sources of a language lie apart, from exact counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelmill.llm.common import by_bytes, stored, table, text_bytes
from panelmill.llm.registry import query

MIN_DOCS = 10  # documents of a language that a kept term occurs in, at least
SCALE = 1_000_000_000
TOP = 10
CHUNK = 16 << 20  # bytes of text that are counted at once
TERMS_AT_ONCE = 1 << 16  # numbers in a block of the pair sums

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_TERM = np.zeros(256, bool)
_IN_TERM[97:123] = _IN_TERM[65:91] = _IN_TERM[128:] = True

COUNTS = "lang string, source string, term binary, n long, docs long"
SUMS = "lang string, a int, b int, f long"


def radix_order(*keys: np.ndarray) -> np.ndarray:
    """The stable order by `keys`, the first one most significant: 16-bit digits from the lowest up, constant ones skipped."""
    order = np.arange(len(keys[0]))
    for key in reversed(keys):
        top = int(key.max(initial=0)) ^ int(key.min(initial=0))
        for shift in range(0, 8 * key.itemsize, 16):
            if top >> shift:
                digit = ((key >> key.dtype.type(shift)) & key.dtype.type(0xFFFF)).astype(np.uint16)
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _runs(columns: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, length and number of documents of each run of equal rows; documents ascend within a run."""
    new = np.zeros(len(doc), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    other = new.copy()
    other[1:] |= doc[1:] != doc[:-1]
    return first, np.diff(np.append(first, len(doc))), np.add.reduceat(other, first, dtype=np.int64)


def _packed(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Up to 8 bytes from each start as one big-endian number, filled up with zeros. `data` goes on for 8 bytes."""
    view = np.lib.stride_tricks.as_strided(data[:8].view(np.uint64), (len(data) - 7,), (1,))
    shift = (8 * (8 - np.clip(lengths, 0, 8))).astype(np.uint64)
    word = view[starts].byteswap()
    return np.where(shift == 64, np.uint64(0), word >> np.minimum(shift, np.uint64(63)) << np.minimum(shift, np.uint64(63)))


def _unpacked(words: list[np.ndarray]) -> np.ndarray:
    return np.stack(words, axis=1).astype(">u8").view(f"S{8 * len(words)}").ravel()


def count_terms(data: np.ndarray, ends: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Terms of texts that lie in a row in `data` (UTF-8, 8 zero bytes behind it) and end at `ends`.

    Yields `(group, term, count, documents)` arrays, each group and term once. Terms of up to
    8 and 16 bytes are one and two numbers, radix-sorted and counted by runs. Longer ones are
    dealt to buckets of up to 32, 64, ... bytes, which are sorted as bytes.
    """
    inside = _IN_TERM[data]
    edges = np.zeros(len(data) + 1, bool)
    edges[1:-1] = inside[1:] != inside[:-1]
    edges[0] = inside[0]
    edges[ends[ends < len(data)]] |= inside[ends[ends < len(data)]]  # a text's end ends a term, too
    cuts = np.flatnonzero(edges)
    held = cuts[inside[np.minimum(cuts, len(data) - 1)]]
    if not len(held):
        return
    stops = np.append(cuts, len(data))[np.searchsorted(cuts, held) + 1]
    data, lengths = _LOWER[data], stops - held
    doc = np.searchsorted(ends, held, side="right")
    of = group[doc].astype(np.uint32)
    for low, high in ((0, 8), (8, 16)):
        here = np.flatnonzero((lengths > low) & (lengths <= high))
        if not len(here):
            continue
        words = [_packed(data, held[here] + at, lengths[here] - at) for at in range(0, high, 8)]
        order = radix_order(of[here], *words)
        words = [w[order] for w in words]
        g, d = of[here][order], doc[here][order]
        first, n, docs = _runs([g, *words], d)
        yield g[first], _unpacked([w[first] for w in words]).astype(object), n, docs
    long = np.flatnonzero(lengths > 16)
    width = np.int64(1) << np.ceil(np.log2(lengths[long])).astype(np.int64)
    raw = data.tobytes() if len(long) else b""
    for w in np.unique(width).tolist():
        here = long[width == w]
        terms = np.array([raw[a:a + k] for a, k in zip(held[here].tolist(), lengths[here].tolist())], f"S{w}")
        order = np.argsort(terms, kind="stable")
        order = order[np.argsort(of[here][order], kind="stable")]
        terms, g, d = terms[order], of[here][order], doc[here][order]
        first, n, docs = _runs([g, terms], d)
        yield g[first], terms[first].astype(object), n, docs


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, 2, CHUNK):
        data, bounds = text_bytes(batch.column(2))
        names: dict[tuple, int] = {}
        group = np.array([names.setdefault(k, len(names)) for k in zip(*(batch.column(i).to_pylist() for i in (0, 1)))])
        keys = list(names)
        lang, source = (pa.array([k[i] for k in keys], pa.string()) for i in (0, 1))
        for g, term, n, docs in count_terms(np.append(data, np.zeros(8, np.uint8)), bounds[1:], group):
            for i in range(0, len(g), 50_000):
                at = pa.array(g[i:i + 50_000])
                yield pa.RecordBatch.from_arrays(
                    [lang.take(at), source.take(at), pa.array(term[i:i + 50_000], pa.binary()),
                     pa.array(n[i:i + 50_000], pa.int64()), pa.array(docs[i:i + 50_000], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"])


def scaled_share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * count / total) for 0 <= count <= total, by long division: no step exceeds 1000 * total."""
    value, rest = F.lit(0).cast("long"), count
    for _ in range(3):
        grown = rest * 1000
        value, rest = value * 1000 + F.call_function("div", grown, total), grown % total
    return value + 1


def _share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    value, rest = np.zeros(np.broadcast_shapes(count.shape, total.shape), np.int64), count
    for _ in range(3):
        value, rest = value * 1000 + rest * 1000 // total, rest * 1000 % total
    return value + 1


def _divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _pair_sums(batches: Iterator[pa.RecordBatch], totals: dict[str, list[tuple[str, int, int]]]) -> Iterator[pa.RecordBatch]:
    """Per language and pair of its sources (by place in `totals`): the summed divergence of the terms of this task."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lang in sorted(set(langs)):
            own = batch.filter(pa.array([x == lang for x in langs]))
            groups = totals[lang]
            place = {s: i for i, (s, _, _) in enumerate(groups)}
            size = np.array([n + 2 * v for _, n, v in groups], np.int64)[:, None]
            acc = sums.setdefault(lang, np.zeros((len(groups), len(groups)), np.int64))
            step = max(1, TERMS_AT_ONCE // len(groups))
            for lo in range(0, own.num_rows, step):
                lists = own.column(1).slice(lo, step)
                counts = np.zeros((len(groups), len(lists)), np.int64)
                rows = lists.flatten()
                at = np.fromiter(map(place.__getitem__, rows.field(0).to_pylist()), np.int64, len(rows))
                counts[at, np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())] = rows.field(1).to_numpy()
                p = _share(counts + 2, size)
                for g in range(len(groups) - 1):
                    d = p[g + 1:] - p[g]
                    acc[g, g + 1:] += (d * d // (p[g + 1:] + p[g])).sum(axis=1)
    for lang, acc in sums.items():
        a, b = np.triu_indices(len(acc), 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(a), pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(acc[a, b])],
            names=["lang", "a", "b", "f"])


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """Per (lang, source): the summed divergence from each other source of the language (part `pair`)
    and the `top` terms it uses more than the language does (part `term`): lang, source, part,
    item, value, rank.

    Terms are runs of ASCII letters and characters beyond ASCII; A-Z become lower case. A
    language keeps the terms of at least `min_docs` of its documents. With N the count of its
    kept terms, a group gives each of the V kept terms of its language the share
    p = 1 + floor(10^9 (count + 2) / (N + 2 V)); two shares diverge by floor((p - q)^2 / (p + q)).

    Null text, lang and source count as empty. Repeated rows are documents of their own; ties
    go by the bytes of the item; an empty table gives no rows; other columns are not read. A
    group without terms takes part; a language with a single source has no pairs.

    Tasks count their texts in chunks, so a hot source or term arrives summed up, and terms
    meet by (lang, term). The totals of the groups go to all tasks: they are one row per
    source, where part `pair` has a row for each pair of these.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = texts.mapInArrow(_counted, COUNTS).repartition(parts, "lang", "term")
    counts = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = counts.groupBy("lang", "term").agg(
        F.collect_list(F.struct("source", "n")).alias("sources"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    kept = stored(kept.select("lang", F.col("term").cast("string").alias("term"), "sources"), "kept-terms")

    found = kept.select("lang", "term", F.inline("sources"))
    sizes = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    kinds = kept.groupBy("lang").agg(F.count("*").alias("kinds"))
    groups = texts.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(kinds, "lang", "left")
    groups = stored(groups.fillna(0, ["total", "kinds"]), "source-totals")

    totals: dict[str, list] = {}
    for r in groups.orderBy("lang", "source").collect():
        totals.setdefault(r.lang, []).append((r.source, r.total, r.kinds))
    shared = spark.sparkContext.broadcast(totals)
    sums = kept.select("lang", "sources").mapInArrow(lambda it: _pair_sums(it, shared.value), SUMS).groupBy("lang", "a", "b").agg(
        F.sum("f").alias("f"))
    placed = groups.select("lang", "source", (F.row_number().over(
        Window.partitionBy("lang").orderBy("source")) - 1).alias("at"))  # as in `totals`: a row per source
    pairs = placed.alias("x").join(placed.alias("y"), F.expr("x.lang = y.lang and x.at <> y.at")).select(
        F.col("x.lang").alias("lang"), F.col("x.source").alias("source"), F.col("y.source").alias("item"),
        F.least("x.at", "y.at").alias("a"), F.greatest("x.at", "y.at").alias("b"))
    pairs = pairs.join(sums, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item",
                                                               F.coalesce("f", F.lit(0).cast("long")).alias("value"))

    whole = groups.groupBy("lang").agg(F.sum("total").alias("all"))
    used = kept.select("lang", "term", F.aggregate("sources", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("m"),
                       F.inline("sources")).join(groups, ["lang", "source"]).join(whole, "lang")
    p = scaled_share(F.col("n") + 2, F.col("total") + 2 * F.col("kinds"))
    q = scaled_share(F.col("m") + 2, F.col("all") + 2 * F.col("kinds"))
    terms = used.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), p.alias("p"), q.alias("q")).where(
        "p > q").select("lang", "source", "part", "item", _divergence(F.col("p"), F.col("q")).alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return pairs.withColumn("rank", F.row_number().over(by)).unionByName(
        terms.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top))


SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ts
  FROM documents),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs
      FROM (SELECT id, lang, source, unnest(ts) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL HAVING sum(docs) >= {MIN_DOCS}),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n,
             sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source)::HUGEINT AS total
      FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT s.lang, s.source, s.term, s.n, 1 + {SCALE} * (s.n + 2) // (s.total + 2 * v.v) AS p,
             1 + {SCALE} * (k.n + 2) // (v.n + 2 * v.v) AS q
      FROM s JOIN v ON v.lang = s.lang JOIN k ON k.lang = s.lang AND k.term = s.term),
f AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
      FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
r AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
WHERE part = 'pair' OR rank <= {TOP}
"""


@query("op13_source_divergence", SQL)
def source_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return divergence(table(spark, sf, "documents"))
