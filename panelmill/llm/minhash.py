"""Near-duplicate documents by MinHash: universal hash minima, banding, verification, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.llm.common import components, stored, table
from panelmill.llm.registry import query

BANDS, ROWS = 28, 4  # a pair at similarity 0.8 shares no band with probability 4e-7
DIRECT = 32  # buckets up to this size list their pairs; larger ones are compared block by block
BLOCK = 1024
SEED = 20_240_801
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
CHUNK = 1 << 15
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct `width`-word shingles of a text.

    A-Z are lower-cased. Fewer words than `width` make one shingle of the whole sequence;
    no words (or no text) make an empty set.
    """
    parts = (text or b"").translate(LOWER).split()
    if not parts:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    span = min(width, len(parts))
    hashes = np.full(len(parts) - span + 1, span, np.uint64)
    for k in range(span):
        hashes = _mixed(hashes * _MIX + each[k:len(parts) - span + 1 + k])
    return np.unique(hashes)


def _functions() -> tuple[np.ndarray, np.ndarray]:
    """Multiply-add-shift functions on 32-bit keys; their top halves are strongly universal."""
    rng = np.random.default_rng(SEED)
    return (rng.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64), rng.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of every hash function over each set (32 bits each); an empty set has all ones."""
    out = np.full((len(sets), BANDS * ROWS), 0xFFFFFFFF, np.uint32)
    a, b = _functions()

    def flush(rows, chunk, starts):
        keys = np.concatenate(chunk) >> np.uint64(32)
        for k in range(BANDS * ROWS):
            least = np.minimum.reduceat(keys * a[k] + b[k], starts) >> np.uint64(32)
            np.minimum.at(out[:, k], rows, least.astype(np.uint32))

    rows, chunk, starts, size = [], [], [], 0
    for i, one in enumerate(sets):
        for begin in range(0, len(one), CHUNK):  # a very long text fills several chunks
            piece = one[begin:begin + CHUNK]
            rows.append(i)
            starts.append(size)
            chunk.append(piece)
            size += len(piece)
            if size >= CHUNK:
                flush(rows, chunk, starts)
                rows, chunk, starts, size = [], [], [], 0
    if size:
        flush(rows, chunk, starts)
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t, width) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        sig = signatures(sets)
        same = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        bands = np.full((len(sets), BANDS), 0, np.uint64)
        for k in range(ROWS):
            bands = _mixed(bands * _MIX + sig[:, k::ROWS].astype(np.uint64) + np.uint64(k + 1))
        flat = pa.array(bands.view(np.int64).reshape(-1))
        bits = np.packbits((sig & 1).astype(np.uint8), axis=1)[:, :14]
        bits = np.pad(bits, ((0, 0), (0, 2))).copy().view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(same, pa.binary()),
             pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS), pa.int32()), flat),
             pa.array(bits[:, 0]), pa.array(bits[:, 1])],
            names=["doc_id", "n_shingles", "fingerprint", "bands", "bits_a", "bits_b"])


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t, width) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        ends = np.cumsum([0, *(len(s) for s in sets)])
        flat = pa.array((np.concatenate(sets) if sets else np.empty(0, np.uint64)).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)],
                                         names=["rep", "shingles"])


def _similar(percent: int) -> str:
    """SQL: the full sets a.shingles and b.shingles are similar enough."""
    both = "array(size(array_intersect(a.shingles, b.shingles)))"
    return f"exists({both}, x -> 100 * x >= {percent} * (size(a.shingles) + size(b.shingles) - x))"


def _agree(percent: int) -> str:
    """SQL: the packed signatures do not rule the pair out.

    One bit of each minimum differs with probability (1 - s) / 2; the margin is six
    standard deviations at the threshold.
    """
    n, p = BANDS * ROWS, (1 - percent / 100) / 2
    most = int(n * p + 6 * (n * p * (1 - p)) ** 0.5) + 1
    return f"bit_count(a.bits_a ^ b.bits_a) + bit_count(a.bits_b ^ b.bits_b) <= {most}"


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Groups of near-duplicate documents: doc_id, n_shingles, component_id, kept.

    Two documents are linked if the Jaccard similarity of their sets of `width`-word
    shingles is at least `percent` / 100; the component is named by its smallest doc_id,
    which is kept.

    1. Each text becomes universal hash minima, cut into bands. Documents with one and the
       same set are one class, shown by its smallest doc_id.
    2. Within a bucket (equal band) all are compared with the smallest: a star, not all pairs.
       Candidates are confirmed on the full sets; large-star/small-star joins them.
    3. Only members of one bucket that are still in different components remain. Small buckets
       list those pairs; in large ones blocks of the members outside the largest component meet
       blocks of all members, and only links leave. So no shared bucket goes unexamined.

    A null or empty text, or one without words, has an empty set and is linked with nothing.
    Repeated rows of one doc_id count as one document with the larger set. A null doc_id is
    left out. Columns other than doc_id and text are not read.
    """
    base = docs.select("doc_id", "text").where("doc_id is not null")
    found = stored(base.mapInArrow(
        lambda it: _fingerprints(it, width),
        "doc_id long, n_shingles long, fingerprint binary, bands array<long>, bits_a long, bits_b long"), "minhash")
    roots = found.where("fingerprint is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("rep"))
    members = stored(
        found.join(roots, "fingerprint", "left")
        .select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"),
                F.when(F.col("rep") == F.col("doc_id"), F.struct("bands", "bits_a", "bits_b")).alias("sig")), "minhash-classes")
    reps = members.where("sig is not null").select("rep", "sig.*").dropDuplicates(["rep"])
    keyed = reps.select("rep", "bits_a", "bits_b", F.posexplode("bands").alias("band", "hash")).withColumn(
        "key", F.xxhash64("band", "hash"))
    shared = keyed.groupBy("key").agg(F.min("rep").alias("first"), F.count("*").alias("size")).where("size > 1")
    buckets = stored(keyed.drop("hash").join(shared, "key"), "minhash-buckets")

    wanted = buckets.select(F.col("rep").alias("doc_id")).distinct()
    sets = stored(base.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"])
                  .mapInArrow(lambda it: _sets(it, width), "rep long, shingles array<long>"), "minhash-sets")
    stars = buckets.where("rep <> first").select(F.col("first").alias("u"), F.col("rep").alias("v")).distinct()
    links = stored(_confirmed(stars, sets, percent), "minhash-links")
    first = components(links)

    labelled = buckets.join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep"))
    split = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    open_ = stored(labelled.join(split.select("key"), "key", "left_semi"), "minhash-open")
    small = open_.where(f"size <= {DIRECT}")
    pairs = (small.alias("a").join(small.alias("b"), F.expr(
        f"a.key = b.key and a.rep < b.rep and a.component <> b.component and {_agree(percent)}"))
        .select(F.col("a.rep").alias("u"), F.col("b.rep").alias("v")).distinct())
    inside = _across(open_.where(f"size > {DIRECT}"), sets, percent)
    stars_of_first = first.select(F.col("node").alias("u"), F.col("component").alias("v"))
    final = components(stars_of_first.union(_confirmed(pairs, sets, percent)).union(inside))

    documents = members.groupBy("doc_id").agg(F.max(F.struct("n_shingles", "rep")).alias("m")).select("doc_id", "m.*")
    return (documents.join(final.withColumnRenamed("node", "rep"), "rep", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
            .withColumn("kept", F.col("doc_id") == F.col("component_id")))


def _across(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links `(u, v)` between components within large buckets, found on the full sets.

    Of a bucket, the members outside its largest component are compared with all members:
    every pair across components has such a member. Both sides are cut into blocks of about
    `BLOCK` by hash, and a task holds one block of each.
    """
    sizes = rows.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(
        F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all"))
    sizes = sizes.select("key", F.col("top.component").alias("main"),
                         F.ceil(F.col("all") / BLOCK).alias("columns"), F.ceil((F.col("all") - F.col("top.n")) / BLOCK).alias("lines"))
    rows = rows.join(sizes, "key").select("key", "rep", "component", "main", "columns", "lines", F.xxhash64("rep").alias("h"))
    asked = rows.where("component <> main").select(
        "key", "rep", "component", F.expr("pmod(h, lines)").alias("line"),
        F.explode(F.expr("sequence(0, columns - 1)")).alias("column"), F.lit(True).alias("asks"))
    held = rows.select("key", "rep", "component", F.explode(F.expr("sequence(0, lines - 1)")).alias("line"),
                       F.expr("pmod(h, columns)").alias("column"), F.lit(False).alias("asks"))
    group = ["key", "line", "column"]
    blocks = asked.unionByName(held).join(sets, "rep").select(*group, "asks", "rep", "component", "shingles")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (blocks.repartition(parts, *group).sortWithinPartitions(*group, "asks")
            .mapInArrow(lambda it: _block_links(it, percent), "u long, v long").distinct())


def _block_links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of each block, per asking document and component of others, one link if there is any."""
    last, held, asked = None, [], []

    def found():
        if not held or not asked:
            return
        owner = np.repeat(np.arange(len(held)), [len(s) for _, _, s in held])
        values = np.concatenate([s for _, _, s in held])
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        reps, comps = (np.array([h[i] for h in held]) for i in (0, 1))
        sizes = np.array([len(s) for _, _, s in held])
        links = []
        for rep, comp, own in asked:
            lo, hi = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=len(held))
            near = np.flatnonzero((100 * both >= percent * (sizes + len(own) - both)) & (comps != comp))
            _, first = np.unique(comps[near], return_index=True)
            links += [(rep, other) for other in reps[near[first]].tolist()]
        if links:
            u, v = np.array(links).T
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
        asks, reps, comps = (batch.column(i).to_pylist() for i in (3, 4, 5))
        ends, values = batch.column(6).offsets.to_numpy(), batch.column(6).values.to_numpy()
        for i, key in enumerate(keys):
            if key != last:
                yield from found()
                last, held, asked = key, [], []
            (asked if asks[i] else held).append((reps[i], comps[i], values[ends[i]:ends[i + 1]].copy()))
    yield from found()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs `(u, v)` that are similar on their full sets."""
    one = pairs.join(sets.withColumnRenamed("rep", "u"), "u").alias("a")
    return one.join(sets.alias("b"), F.expr(f"a.v = b.rep and {_similar(percent)}")).select("u", "v")


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []
                      WHEN len(ws) = 1 THEN [ws[1]]
                      ELSE list_distinct([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) END AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(sh) AS sh FROM s),
p AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.sh = b.sh AND a.doc_id < b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n_shingles, nb.n_shingles
  HAVING 100 * count(*) >= 80 * (na.n_shingles + nb.n_shingles - count(*))),
l AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
r AS (
  WITH RECURSIVE reach(doc_id, c) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT l.v, reach.c FROM reach JOIN l ON l.u = reach.doc_id)
  SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id)
SELECT n.doc_id, n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN r USING (doc_id)
"""


@query("op8_minhash_near_dedup", SQL)
def minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents"), width=2, percent=80)
