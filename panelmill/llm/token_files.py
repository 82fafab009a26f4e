"""Token ids on disk: Simple-8b words with escapes and block offsets."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelmill.llm.common import by_bytes, stored, table
from panelmill.llm.registry import query
from panelmill.llm.tokens import TOGETHER, encoder, vocabulary

#: Selector -> (ids in the word, bits of each). Selector 15 is a run of zeros.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20),
             (2, 30), (1, 60))
RUN, RUN_SELECTOR = 240, 15
BLOCK = 1 << 16  # ids in a block; each begins at a word of its own
SHARD = 1 << 18  # ids after which a shard ends, at the end of a document
MAGIC = b"S8B1"
END_ID = 1


def _words(ids: np.ndarray) -> np.ndarray:
    """A block of ids below 2**60 as 64-bit words: a selector in the top four bits, then the ids from the lowest bit up.

    At each place the selector that takes most ids is chosen; ids past the end count as zeros.
    """
    n = len(ids)
    padded = np.concatenate([ids, np.zeros(RUN, np.uint64)])
    jump, chosen = np.ones(n, np.int32), np.full(n, 13, np.uint8)
    total, top = np.zeros(len(padded) + 1, np.int32), int(ids.max(initial=0))
    places = np.arange(n)  # a word of more, narrower ids fits only where the one before fits
    for s, (count, bits) in [*reversed(list(enumerate(SELECTORS[:13]))), (RUN_SELECTOR, (RUN, 0))]:
        if top < 1 << bits:
            jump[:], chosen[:] = count, s
            continue
        np.cumsum(padded >= np.uint64(1 << bits), dtype=np.int32, out=total[1:])
        places = places[total[places + count] == total[places]]
        jump[places], chosen[places] = count, s
        if not len(places):
            break
    starts, i, step = [], 0, jump.tolist()
    while i < n:
        starts.append(i)
        i += step[i]
    at = np.array(starts)
    kinds, out = chosen[at], np.zeros(len(at), np.uint64)
    for s in np.unique(kinds).tolist():
        here = kinds == s
        word = np.full(int(here.sum()), s << 60, np.uint64)
        if s != RUN_SELECTOR:
            count, bits = SELECTORS[s]
            first = at[here]
            for j in range(count):
                word |= padded[first + j] << np.uint64(j * bits)
        out[here] = word
    return out


def encode(ids: np.ndarray) -> bytes:
    """A shard: header, word offset of each block, escaped ids (place and value), words. All little-endian."""
    ids = ids.astype(np.uint64)
    places = np.flatnonzero(ids >= np.uint64(1 << 60))
    escapes = np.stack([places.astype(np.uint64), ids[places]], axis=1)
    ids = np.where(ids >= np.uint64(1 << 60), np.uint64(0), ids)
    blocks = [_words(ids[i:i + BLOCK]) for i in range(0, len(ids), BLOCK)]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    head = MAGIC + struct.pack("<QIQ", len(ids), len(blocks), len(places))
    return b"".join([head, offsets.tobytes(), escapes.astype("<u8").tobytes(), *(b.astype("<u8").tobytes() for b in blocks)])


def decode(data: bytes) -> np.ndarray:
    """The ids of a shard (uint64). All words of a kind are unpacked at once."""
    if data[:4] != MAGIC:
        raise ValueError("not a shard of token ids")
    n, blocks, n_escapes = struct.unpack_from("<QIQ", data, 4)
    at = 24
    offsets = np.frombuffer(data, "<u8", blocks + 1, at).astype(np.int64)
    at += 8 * (blocks + 1)
    escapes = np.frombuffer(data, "<u8", 2 * n_escapes, at).reshape(-1, 2)
    words = np.frombuffer(data, "<u8", int(offsets[-1]), at + 16 * n_escapes)
    kinds = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([*(c for c, _ in SELECTORS), 0, RUN])[kinds]
    upto = np.concatenate([[0], np.cumsum(counts)])
    # the words of block b start at id b * BLOCK
    block = np.repeat(np.arange(blocks), np.diff(offsets))
    place = upto[:-1] - upto[offsets[:-1]][block] + block * BLOCK
    out = np.zeros(n + RUN, np.uint64)
    last = np.minimum((block + 1) * BLOCK, n)
    for s, (count, bits) in enumerate(SELECTORS):
        here = np.flatnonzero(kinds == s)
        if len(here):
            values = (words[here][:, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(bits))) & np.uint64((1 << bits) - 1)
            to = place[here][:, None] + np.arange(count)
            inside = to < last[here][:, None]  # a block's last word may reach past it
            out[to[inside]] = values[inside]
    out = out[:n]
    out[escapes[:, 0].astype(np.int64)] = escapes[:, 1]
    return out


SHARDS = "part int, shard long, start long, doc_ids array<long>, lengths array<long>, data binary"


def _shards(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, number, start, size, held = TaskContext.get().partitionId(), 0, 0, 0, []
    to_ids = encoder(path)

    def flush():
        nonlocal number, start, size, held
        ids = np.concatenate([x for _, a in held for x in (a, [end])]).astype(np.uint64)
        row = pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([start], pa.int64()),
             pa.array([[d for d, _ in held]], pa.list_(pa.int64())),
             pa.array([[len(a) + 1 for _, a in held]], pa.list_(pa.int64())), pa.array([encode(ids)], pa.binary())],
            names=["part", "shard", "start", "doc_ids", "lengths", "data"])
        number, start, size, held = number + 1, start + len(ids), 0, []
        return row

    for batch in by_bytes(batches, 1, TOGETHER):
        ids, bounds = to_ids.texts(batch.column(1))
        for doc, a, b in zip(batch.column(0).to_pylist(), bounds.tolist(), bounds[1:].tolist()):
            held.append((doc, ids[a:b]))
            size += len(held[-1][1]) + 1
            if size >= SHARD:
                yield flush()
    if held:
        yield flush()


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, start, docs, lengths, data in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5))):
            ids = decode(data).astype("<u4")
            bounds = np.cumsum([0, *lengths])
            sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array([part] * len(docs), pa.int32()), pa.array(bounds[:-1] + start),
                 pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                names=["doc_id", "part", "start", "n_tokens", "ids_crc32"])


def write_token_files(docs: DataFrame, path: str | None = None, end: int = END_ID) -> DataFrame:
    """Ids of every text in ascending doc_id order, as a stored table of binary shards (`SHARDS`).

    Documents are dealt out by ranges of doc_id, so that parts, and shards in a part, are in
    order. A null or empty text has the end id alone; a null doc_id comes first; rows with
    equal doc_id stay rows. A shard holds whole documents, one longer than `SHARD` on its own.
    """
    path = path or vocabulary()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    return stored(ordered.mapInArrow(lambda it: _shards(it, path, end), SHARDS), "token-files")


def read_token_files(shards: DataFrame) -> DataFrame:
    """Per document of the shards: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    docs = shards.mapInArrow(_documents, "doc_id long, part int, start long, n_tokens long, ids_crc32 long")
    sizes = shards.select("part", F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x).alias("n")).groupBy(
        "part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return docs.join(sizes, "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


@query("op2_token_files")
def token_files(spark: SparkSession, sf: str) -> DataFrame:
    return read_token_files(write_token_files(table(spark, sf, "documents")))
