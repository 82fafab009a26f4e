"""Documents packed into sequences of fixed length: dominance reduction, then best fit."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelmill.llm.common import by_bytes, passing_folder, stored, table
from panelmill.llm.registry import query
from panelmill.llm.tokens import TOGETHER as TEXTS, encoder, vocabulary

CAPACITY = 2048
TOGETHER = 256  # sequences whose ids a task copies at once
END_ID = 0
PIECES = "doc_id long, piece int, length long, ids binary, part int, ordinal long"
SEQUENCES = "sequence_id long, ids array<int>, doc_ids array<long>, pieces array<int>, lengths array<long>"


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, to_ids, seen = TaskContext.get().partitionId(), encoder(path), Counter()
    kind = np.dtype("<u2" if max(len(to_ids.ends), end + 1) <= 1 << 16 else "<u4")  # wide enough for any id
    for batch in by_bytes(batches, 1, TEXTS):
        rows, (ids, bounds) = [], to_ids.texts(batch.column(1))
        for doc, a, b in zip(batch.column(0).to_pylist(), bounds.tolist(), bounds[1:].tolist()):
            data = np.append(ids[a:b], np.uint32(end)).astype(kind)
            for piece, at in enumerate(range(0, len(data), capacity)):
                own = data[at:at + capacity].tobytes()
                length = len(own) // kind.itemsize
                rows.append((doc, piece, length, own, part, seen[length]))
                seen[length] += 1
        columns = list(zip(*rows)) or [()] * 6
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                         names=["doc_id", "piece", "length", "ids", "part", "ordinal"])


def dominant_sets(counts: np.ndarray, capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Take from `counts` (pieces by length) the sets that some best packing contains, as `(times, ((length, 1), ...))`.

    Martello and Toth's criterion, for the longest piece i first: a feasible set with i that
    can stand for any other one with i is fixed for good.
    * nothing fits beside i: {i};
    * i and j fill the sequence: {i, j}, since any others beside i fit in the place of j;
    * only one more fits: {i, j} with the largest j;
    * only two more fit, and the largest j is at least as long as any two that fit: {i, j}.
    Equal lengths are taken together. What remains satisfies none of these.
    """
    fixed = []
    changed = True
    while changed:
        changed = False
        for i in range(capacity, 0, -1):
            while counts[i]:
                others = counts.copy()
                others[i] -= 1
                lengths = np.flatnonzero(others[:capacity - i + 1])
                if not len(lengths):
                    fixed.append((int(counts[i]), ((i, 1),)))  # as more pieces go, still nothing fits
                    counts[i] = 0
                    changed = True
                    break
                j = int(lengths[-1])
                least = np.repeat(lengths[:3], np.minimum(others[lengths[:3]], 3))[:3]
                room = capacity - i
                two = len(least) > 1 and least[:2].sum() <= room
                three = len(least) > 2 and least.sum() <= room
                if not (j == room or not two or (not three and j >= _best_pair(lengths, room))):
                    break
                times = int(counts[i] // 2 if i == j else min(counts[i], counts[j]))
                fixed.append((times, ((i, 1), (j, 1))))
                counts[i] -= times
                counts[j] -= times
                changed = True
    return fixed


def _best_pair(lengths: np.ndarray, room: int) -> int:
    """The largest sum of two of the lengths (equal ones allowed) within the room."""
    first = lengths[lengths + lengths[0] <= room]
    second = lengths[np.searchsorted(lengths, room - first, side="right") - 1]
    return int((first + second).max())


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Best-fit decreasing over pieces by length: `(times, ((length, copies), ...))`. Equal sequences are one entry."""
    open_: dict[int, list[tuple[int, tuple]]] = {}
    rooms: list[int] = []  # sorted, those in open_

    def put(room, times, content):
        if times:
            if room not in open_:
                insort(rooms, room)
                open_[room] = []
            open_[room].append((times, content))

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                room, times, content = capacity, left, ()
            else:
                room = rooms[k]
                times, content = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[k]
            copies = min(room // length, left)  # a sequence stays the best fit until it is full
            full = min(times, left // copies)
            put(room - copies * length, full, (*content, (length, copies)))
            if content:
                put(room, times - full, content)
            left -= full * copies
    return [entry for room in rooms for entry in open_[room]]


def plan(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Where the pieces of each length go, from the number of pieces by length alone.

    Rows (length, first rank, copies in a sequence, first sequence, offset), sorted; the piece
    with rank r of its length goes to sequence `first + (r - first rank) // copies`.
    """
    counts = counts.copy()
    entries = dominant_sets(counts, capacity) + best_fit(counts, capacity)
    ranks, sequence, rows = Counter(), 0, []
    for times, content in entries:
        offset = 0
        for length, copies in content:
            rows.append((length, ranks[length], copies, sequence, offset))
            ranks[length] += times * copies
            offset += length * copies
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _placed(batches: Iterator[pa.RecordBatch], rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    encoder.cache_clear()  # the worker's remembered chunks are done with
    keys = (rows[:, 0] << 44) + rows[:, 1]
    for batch in batches:
        length, rank = batch.column(2).to_numpy(), batch.column(4).to_numpy()
        row = rows[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
        step = rank - row[:, 1]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:4], pa.array(row[:, 3] + step // row[:, 2]), pa.array(row[:, 4] + step % row[:, 2] * length)],
            names=["doc_id", "piece", "length", "ids", "sequence_id", "offset"])


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequences from placed pieces that are sorted by sequence and offset."""
    def whole(rows):
        sequence = rows.column(4).to_numpy()
        first = np.flatnonzero(np.diff(sequence, prepend=-1))
        starts = np.append(first, len(sequence)).astype(np.int32)
        ends = np.concatenate([[0], np.cumsum(rows.column(2).to_numpy())])[starts].astype(np.int32)
        data = b"".join(rows.column(3).to_pylist())
        ids = np.frombuffer(data, f"<u{len(data) // int(ends[-1])}").astype(np.int32)

        def lists(at, values):
            return pa.ListArray.from_arrays(pa.array(at), values)
        return pa.RecordBatch.from_arrays(
            [pa.array(sequence[first]), lists(ends, pa.array(ids)), *(lists(starts, rows.column(i)) for i in range(3))],
            names=["sequence_id", "ids", "doc_ids", "pieces", "lengths"])

    def wholes(rows):
        first = np.flatnonzero(np.diff(rows.column(4).to_numpy(), prepend=-1))[::TOGETHER].tolist()
        return (whole(rows.slice(a, b - a)) for a, b in zip(first, [*first[1:], rows.num_rows]))

    encoder.cache_clear()
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        sequence = batch.column(4).to_numpy()
        open_ = int(np.searchsorted(sequence, sequence[-1]))  # the last sequence may go on in the next batch
        if open_:
            yield from wholes(batch.slice(0, open_))
        held = batch.slice(open_)
    if held is not None:
        yield whole(held)


def write_sequences(docs: DataFrame, folder: str, path: str | None = None, capacity: int = CAPACITY, end: int = END_ID) -> str:
    """Packs the ids of all documents and writes the sequences to `folder`, Parquet files by ranges of sequence_id.

    A row is a sequence: its `ids`, and the doc_id, piece number and length of each piece in
    the order they lie in it. Texts become ids once. A packing depends on lengths only, so what
    it is planned from is the number of pieces of each length (at most `capacity` numbers), and
    the plan, one row per kind of sequence and length, goes to the tasks. A piece finds its
    place by its rank among the pieces of its length: its number within its task, which the
    same pass counted, plus the pieces of the tasks before.

    A null or empty text is the end id alone. Rows with equal doc_id, or none, are documents
    of their own. An empty table gives no rows. Other columns are not read.
    """
    path, spark = path or vocabulary(), docs.sparkSession
    pieces = stored(docs.select("doc_id", "text").mapInArrow(
        lambda it: _pieces(it, path, capacity, end), PIECES), "pieces")
    tallies = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in tallies.groupBy("length").agg(F.sum("n")).collect():  # at most `capacity` rows
        counts[length] = n
    rows = plan(counts, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # stored, so that its size is known and the join need not shuffle the ids while it is small
    offsets = stored(tallies.select(F.col("part").alias("p"), F.col("length").alias("l"),
                                    F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "piece-offsets")
    ranked = pieces.join(offsets, F.expr("part = p and length = l")).select(
        "doc_id", "piece", "length", "ids", (F.col("ordinal") + F.col("before")).alias("rank"))
    shared = spark.sparkContext.broadcast(rows)
    placed = ranked.mapInArrow(
        lambda it: _placed(it, shared.value),
        "doc_id long, piece int, length long, ids binary, sequence_id long, offset long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed.repartitionByRange(parts, "sequence_id").sortWithinPartitions("sequence_id", "offset").mapInArrow(
        _filled, SEQUENCES).write.parquet(folder)
    return folder


def _read(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    encoder.cache_clear()
    for batch in (b.slice(i, TOGETHER) for b in batches for i in range(0, b.num_rows, TOGETHER)):
        sequence, ids, docs, pieces, lengths = batch.columns
        n = np.diff(docs.offsets.to_numpy())  # pieces in each sequence
        length, piece = lengths.flatten().to_numpy(), pieces.flatten().to_numpy()
        ends = np.cumsum(length)
        begins = ends - length
        first = np.repeat(ids.offsets.to_numpy()[:-1].astype(np.int64) - ids.offsets[0].as_py(), n)
        values = ids.flatten().to_numpy().astype("<u4", copy=False)
        own = [values[a:b] for a, b in zip(begins.tolist(), ends.tolist())]
        yield pa.RecordBatch.from_arrays(
            [docs.flatten(), pa.array(piece), pa.array(piece.astype(np.int64) * capacity), pa.array([len(x) for x in own], pa.int64()),
             pa.array([zlib.crc32(x) for x in own], pa.int64()), pa.array(np.repeat(sequence.to_numpy(), n)),
             pa.array(begins - first),
             pa.ListArray.from_arrays(pa.array(np.append(begins, ends[-1:] if len(ends) else 0).astype(np.int32)),
                                      pa.array(values.view("<i4")))],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"])


def read_sequences(spark: SparkSession, folder: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces in written sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids."""
    return spark.read.schema(SEQUENCES).parquet(folder).mapInArrow(
        lambda it: _read(it, capacity),
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids array<int>")


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END_ID,
           folder: str | None = None) -> DataFrame:
    """The pieces as read from the sequences written to `folder`, or to one that goes when the application ends."""
    folder = folder or passing_folder(docs.sparkSession, "sequences")
    return read_sequences(docs.sparkSession, write_sequences(docs, folder, path, capacity, end), capacity)


@query("op4_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packed(table(spark, sf, "documents")).drop("ids")
