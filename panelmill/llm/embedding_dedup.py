"""Near-duplicate vectors by a pigeonhole over blocks of rotated coordinates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.llm.common import components, stored, table
from panelmill.llm.registry import query

COSINE = 0.93
WIDTH = 8  # coordinates in a block
SEED = 97
SLACK = 1e-9  # for rounding; candidates are verified


def rotation(n: int) -> np.ndarray:
    """A fixed random rotation: it spreads distance evenly over the coordinates."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, n]).standard_normal((n, n)))
    return q * np.sign(np.diag(r))


def _blocks(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Of each vector one row per block: its coordinates, their budget, and a cell of the first two."""
    turned: dict[int, np.ndarray] = {}
    for batch in batches:
        ids, labels, vectors = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        lengths = np.diff(vectors.offsets.to_numpy())
        for n in np.unique(lengths).tolist():
            here = np.flatnonzero(lengths == n)
            own = np.asarray(vectors.take(pa.array(here)).flatten().to_numpy(), np.float64).reshape(-1, n)
            own = own / np.abs(own).max(axis=1, keepdims=True)  # no overflow
            turn = turned.setdefault(n, rotation(n))
            own = (own / np.linalg.norm(own, axis=1, keepdims=True)) @ turn
            for b, at in enumerate(range(0, n, WIDTH)):
                width = min(WIDTH, n - at)
                part = np.zeros((len(here), WIDTH))
                part[:, :width] = own[:, at:at + width]
                budget = 2 * (1 - cosine) * width / n + SLACK
                cells = np.floor(part[:, :2] / np.sqrt(budget)).astype(np.int64)
                columns = [pa.array(ids[here]), pa.array(labels[here]), pa.array(np.full(len(here), n)),
                           pa.array(np.full(len(here), b)), pa.array(cells[:, 0]), pa.array(cells[:, 1]),
                           pa.array(np.full(len(here), budget)), *(pa.array(part[:, k]) for k in range(WIDTH))]
                yield pa.RecordBatch.from_arrays(columns, names=BLOCK_NAMES)


BLOCK_NAMES = ["rep", "label", "n", "block", "cx", "cy", "budget", *(f"x{k}" for k in range(WIDTH))]
BLOCKS = ("rep long, label long, n long, block long, cx long, cy long, budget double, "
          + ", ".join(f"x{k} double" for k in range(WIDTH)))


def _verified(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = [batch.column(i) for i in (2, 3)]
        lengths = np.diff(both[0].offsets.to_numpy())
        keep = np.zeros(batch.num_rows, bool)
        for n in np.unique(lengths).tolist():
            here = np.flatnonzero(lengths == n)
            a, b = (np.asarray(v.take(pa.array(here)).flatten().to_numpy(), np.float64).reshape(-1, n) for v in both)
            a, b = (v / np.abs(v).max(axis=1, keepdims=True) for v in (a, b))
            dot = np.einsum("ij,ij->i", a, b)
            keep[here] = dot / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b)) >= cosine
        kept = batch.filter(pa.array(keep))
        yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["u", "v"])


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Links at or above `cosine` among vectors of equal label: vec_id, n_links, component_id, kept.

    Equal vectors of one label are one class. Unit vectors at that cosine are at most
    sqrt(2 (1 - cosine)) apart, so of the blocks of their rotated coordinates at least one is
    within its share of that squared distance, in proportion to its coordinates. Each block is
    range-joined: cells of the block's first two coordinates, as wide as its range, meet
    themselves and their neighbours, and the join keeps what is in range in the whole block.
    The union of these candidates is verified on the vectors in double precision, so nothing
    is missed and nothing false stays. Links are counted with the sizes of the classes.

    Null labels, null, empty or zero vectors, and vectors with null or non-finite components have no
    links. Vectors of different lengths never link. Rows of equal vec_id are vectors of their own
    that share the result row of the smallest class. A null vec_id is left out.
    """
    base = vectors.select("vec_id", F.col("label").cast("long").alias("label"), "embedding").where("vec_id is not null")
    sound = F.expr("label is not null and size(embedding) > 0 and exists(embedding, x -> x <> 0) and "
                   "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    good = base.where(sound)
    classes = stored(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")),
                     "vector-classes")
    blocks = classes.select("rep", "label", "embedding").mapInArrow(lambda it: _blocks(it, cosine), BLOCKS)
    blocks = stored(blocks, "vector-blocks")
    # a pair of neighbouring cells meets once: each cell looks at itself and at those after it
    steps = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
                                for dx, dy in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1)))))
    probes = (blocks.withColumn("step", steps)
              .withColumn("own", F.expr("step.dx = 0 and step.dy = 0"))
              .withColumn("cx", F.expr("cx + step.dx")).withColumn("cy", F.expr("cy + step.dy")).drop("step", "budget"))
    near = " + ".join(f"(a.x{k} - b.x{k}) * (a.x{k} - b.x{k})" for k in range(WIDTH))
    pairs = (probes.alias("a").join(blocks.alias("b"), F.expr(
        "a.label = b.label and a.n = b.n and a.block = b.block and a.cx = b.cx and a.cy = b.cy and "
        f"(not a.own or a.rep < b.rep) and a.rep <> b.rep and {near} <= b.budget"))
        .select(F.expr("least(a.rep, b.rep)").alias("u"), F.expr("greatest(a.rep, b.rep)").alias("v")).distinct())
    one = pairs.join(classes.select(F.col("rep").alias("u"), F.col("embedding").alias("ue")), "u")
    two = one.join(classes.select(F.col("rep").alias("v"), F.col("embedding").alias("ve")), "v").select("u", "v", "ue", "ve")
    links = stored(two.mapInArrow(lambda it: _verified(it, cosine), "u long, v long"), "vector-links")

    sizes = classes.select("rep", "copies")
    both = links.union(links.select("v", "u"))
    linked = both.join(sizes.withColumnRenamed("rep", "v"), "v").groupBy(F.col("u").alias("rep")).agg(F.sum("copies").alias("more"))
    found = components(links).withColumnRenamed("node", "rep")
    summary = (sizes.join(linked, "rep", "left").join(found, "rep", "left")
               .select("rep", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"),
                       F.coalesce("component", "rep").alias("component_id")))
    of = classes.select("label", "embedding", "rep").withColumnRenamed("label", "l").withColumnRenamed("embedding", "e")
    members = good.join(of, F.expr("label = l and embedding = e")).select("vec_id", "rep").groupBy("vec_id").agg(F.min("rep").alias("rep"))
    return (base.select("vec_id").distinct().join(members, "vec_id", "left").join(summary, "rep", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id") == F.col("component_id")))


SQL = f"""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.x, b.x) >= {COSINE}),
r AS (WITH RECURSIVE reach(vec_id, c) AS (
        SELECT vec_id, vec_id FROM e UNION SELECT l.v, reach.c FROM reach JOIN l ON l.u = reach.vec_id)
      SELECT vec_id, min(c) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM r LEFT JOIN n ON n.u = r.vec_id
"""


@query("op5_embedding_dedup", SQL)
def embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_vectors(table(spark, sf, "embeddings"))
