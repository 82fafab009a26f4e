"""Tokens of two tokenizers aligned by the bytes they cover."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.llm.common import by_bytes, stored, table, without_cycles
from panelmill.llm.registry import query

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
MARK = "▁"
CHUNK = 3 << 19  # bytes of text that are aligned at once
REMEMBERED = 40 << 20  # bytes of a memory's generation
ENTRY = 300  # bytes of an entry besides its content
PAIRS = 1 << 22  # pairs of a vocabulary slice that go to all tasks at once
_CUT = re.compile(r"(?<=\S) (?=.)", re.S)

ROWS = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, "
        "pairs array<int>, times array<int>, n_best long, count_sum long")


class Memory:
    """A dictionary in two generations of bounded bytes; the elder one goes when the younger is full."""

    def __init__(self):
        self.now, self.before, self.size = {}, {}, 0

    def get(self, keys: list) -> tuple[list, dict]:
        """What is remembered of each of distinct keys (None: nothing), and the places of those that are not."""
        found = list(map(self.now.get, keys))
        missing: dict = {}
        for i in [i for i, x in enumerate(found) if x is None]:
            key = keys[i]
            if (old := self.before.get(key)) is not None:
                found[i] = self.now[key] = old
            else:
                missing[key] = i
        return found, missing

    def put(self, key, value, size: int) -> None:
        if size > REMEMBERED >> 8:
            return
        if self.size > REMEMBERED:
            self.now, self.before, self.size = {}, self.now, 0
        self.now[key] = value
        self.size += size + ENTRY


def byte_level() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable ones stand for themselves, the others for 256, 257, ..."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and memories of chunks and windows; one per Python worker."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        char = byte_level()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab(with_added_tokens=False).items():
            self.bytes_a[i] = bytes(map(char.__getitem__, token))
        special = self.a.get_added_tokens_decoder()
        for i, token in special.items():
            self.bytes_a[i] = token.content.encode()
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(MARK, " ").encode())
        self.len_a, self.len_b = (np.array(list(map(len, x))) for x in (self.bytes_a, self.bytes_b))
        self.space_a, self.space_b = (np.array([t[:1] == b" " for t in x]) for x in (self.bytes_a, self.bytes_b))
        self.chunks, self.windows = Memory(), Memory()
        top = max(len(self.bytes_a), len(self.bytes_b))
        digits = np.array([str(i).encode() for i in range(top)])
        self.n_digits = np.char.str_len(digits)
        self.digits = np.pad(digits.view(np.uint8).reshape(top, -1), ((0, 0), (0, 1)))  # and a place for what follows

    def encoded(self, chunks: list[str]) -> list[tuple[bytes, bytes, bool]]:
        """Ids (32 bit) of each chunk by both, and whether the bytes of either are a space and the chunk."""
        found, missing = self.chunks.get(chunks)  # the chunks are distinct
        new, put = list(missing), self.chunks.put
        for at in range(0, len(new), 20_000):
            part = new[at:at + 20_000]
            want = [(" " + c).encode() for c in part]
            sides = []
            for ids, names, sizes in (
                    ([e.ids for e in self.a.encode_batch_fast([" " + c for c in part], add_special_tokens=False)],
                     self.bytes_a, self.len_a),
                    (self.b.encode(part, num_threads=1), self.bytes_b, self.len_b)):
                stops = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(stops[-1]))
                data = flat.tobytes()
                upto = np.append(0, np.cumsum(sizes[flat]))[stops]
                own = b"".join(map(names.__getitem__, flat.tolist()))
                same = [own[i:j] == w for i, j, w in zip([0, *upto.tolist()], upto.tolist(), want)]
                stops = (4 * stops).tolist()
                sides.append(([data[i:j] for i, j in zip([0, *stops], stops)], same))
            (a, same_a), (b, same_b) = sides
            for c, x, y, plain in zip(part, a, b, map(and_, same_a, same_b)):
                found[missing[c]] = value = x, y, plain
                put(c, value, len(c) + len(x) + len(y))
        return found

    def chunks_of(self, texts: pa.Array) -> tuple[list[str], list[np.ndarray]]:
        """Distinct chunks of whole texts, and each text as a row of these. Chunk by chunk, a text's ids are those of the whole.

        Neither tokenizer has a token across a space that follows something else than white
        space, so a text may be cut there. Most texts are cut at every space; those with white
        space before a space, or at their ends, are cut more carefully.
        """
        lists = pc.split_pattern(texts.cast(pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        chunks, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        odd = np.array([not c or c[-1].isspace() for c in chunks], bool)
        rows = np.split(codes, np.cumsum(lists.value_lengths().to_numpy())[:-1])
        odd_texts = np.add.reduceat(odd[codes].astype(np.int64), np.append(0, np.cumsum(lists.value_lengths().to_numpy())[:-1]))
        place = {c: i for i, c in enumerate(chunks)} if odd_texts.any() else {}
        for k in np.flatnonzero(odd_texts).tolist():
            parts = _CUT.split(texts[k].as_py())
            rows[k] = np.array([place.setdefault(c, len(place)) for c in parts])
        return chunks + list(place)[len(chunks):], rows

    def align(self, texts: pa.Array) -> list[tuple | None]:
        """Per text (not empty): tokens of A, of B, groups, links and groups as text; None where the
        bytes of a space and the text cannot be had from both."""
        chunks, rows = self.chunks_of(texts)
        found = self.encoded(chunks)
        whole = np.array([x[2] for x in found])
        for k in [] if whole.all() else [k for k, r in enumerate(rows) if not whole[r].all()]:  # judged by all their bytes
            rows[k] = np.array([len(chunks)])
            chunks.append(texts[k].as_py())
            found += self.encoded(chunks[-1:])  # a chunk of its own, so it may be there twice
        whole = np.array([x[2] for x in found])
        known = np.zeros(len(chunks), bool)
        for r in rows:
            known[r] |= whole[r[0]]
        used = np.flatnonzero(known)
        if not len(used):
            return [None] * len(rows)
        number = np.cumsum(known) - 1
        a, b = ([found[c][own] for c in used.tolist()] for own in (0, 1))
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) // 4 for x in (a, b))
        windows, ends = self.aligned(*(np.frombuffer(b"".join(x), np.int32) for x in (a, b)))
        until = np.cumsum([1 + len(chunks[c].encode()) for c in used.tolist()])
        stops = np.searchsorted(ends, until) + 1  # a chunk is one window or several
        links, groups, n = zip(*windows)
        n_links = np.add.reduceat(np.fromiter(map(len, links), np.int64, len(links)) // 4, np.append(0, stops[:-1]))
        n_groups = np.add.reduceat(np.array(n), np.append(0, stops[:-1]))
        codes = np.frombuffer(b"".join(links), np.int32)
        if len(windows) > len(used):
            groups = [b";".join(groups[i:j]) for i, j in zip([0, *stops.tolist()], stops.tolist())]
        starts, out = np.cumsum(n_links) - n_links, []
        for r in rows:
            if not whole[r[0]]:
                out.append(None)
                continue
            r = number[r]
            size = n_links[r]
            before = np.cumsum(size) - size
            own = codes[np.repeat(starts[r] - before, size) + np.arange(int(size.sum()))]
            out.append((int(n_a[r].sum()), int(n_b[r].sum()), int(n_groups[r].sum()), own,
                        b";".join(map(groups.__getitem__, r.tolist()))))
        return out

    def windows_of(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> Iterator[tuple[bytes, bytes, int]]:
        """Links (codes `a * vocabulary of b + b`, 32 bit), groups as text and their number, of windows that lie in a row."""
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        side = np.zeros(int(ends_a[-1]) + 1, np.int8)
        side[ends_a] = 1
        side[ends_b] += 2
        side = side[np.flatnonzero(side)]  # stretches between ends: each is the overlap of one token of A and one of B
        in_a, in_b = side & 1, side >> 1
        at_a, at_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        links = a[at_a] * np.int32(len(self.bytes_b)) + b[at_b]
        stop_a, stop_b = np.cumsum(n_a), np.cumsum(n_b)
        upto = np.flatnonzero(in_a) + 1
        n_links = np.diff(upto[stop_a - 1], prepend=0)
        both = side == 3
        group = np.cumsum(both) - both
        group_a, group_b = group[np.flatnonzero(in_a)], group[np.flatnonzero(in_b)]
        # as text: a group's tokens of A, then those of B
        size_a, size_b = np.bincount(group_a), np.bincount(group_b)
        place_a = np.arange(len(a)) + (np.cumsum(size_b) - size_b)[group_a]
        place_b = np.arange(len(b)) + np.cumsum(size_a)[group_b]
        ids, after = np.empty(len(a) + len(b), np.int32), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = a, b
        after[place_a[np.cumsum(size_a) - 1]] = ord("|")
        last = place_b[np.cumsum(size_b) - 1]
        after[last] = ord(";")
        after[place_b[stop_b - 1]] = 0
        digits, n = self.digits[ids], self.n_digits[ids]
        digits[np.arange(len(ids)), n] = after
        n = n + (after > 0)
        text = digits[np.arange(digits.shape[1]) < n[:, None]].tobytes()
        text_stops = np.cumsum(n)[place_b[stop_b - 1]].tolist()
        groups = np.diff(group_b[stop_b - 1] + 1, prepend=0).tolist()
        data, stops = links.tobytes(), (4 * np.cumsum(n_links)).tolist()
        return zip((data[i:j] for i, j in zip([0, *stops], stops)),
                   (text[i:j] for i, j in zip([0, *text_stops], text_stops)), groups)

    def aligned(self, a: np.ndarray, b: np.ndarray) -> tuple[list[tuple[bytes, bytes, int]], np.ndarray]:
        """The windows of texts that lie in a row, and the byte at which each ends."""
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        shared = np.zeros(int(ends_a[-1]) + 1, np.int8)
        shared[ends_a] = 1
        shared[ends_b] += 1
        # a shared end before a space-marked token of both is an anchor, and so is the end of all
        anchor_a = (shared[ends_a] == 2) & np.append(self.space_a[a[1:]], True)
        anchor_b = (shared[ends_b] == 2) & np.append(self.space_b[b[1:]], True)
        to_a, to_b = np.flatnonzero(anchor_a) + 1, np.flatnonzero(anchor_b) + 1
        if len(to_a) != len(to_b) or (ends_a[to_a - 1] != ends_b[to_b - 1]).any():
            raise ValueError("the tokens of the two tokenizers cover different bytes")
        n_a, n_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        number = np.arange(len(to_a))
        of_a, of_b = np.repeat(number, n_a), np.repeat(number, n_b)
        keys = np.full(len(a) + len(b) + len(number), -1, np.int32)
        keys[np.arange(len(a)) + (to_b - n_b)[of_a] + of_a] = a
        keys[np.arange(len(b)) + to_a[of_b] + of_b + 1] = b
        stops = (4 * (to_a + to_b + number + 1)).tolist()
        data = keys.tobytes()
        keys = [data[i:j] for i, j in zip([0, *stops], stops)]
        place: dict = {}
        own = [place.setdefault(k, len(place)) for k in keys]
        found, missing = self.windows.get(list(place))
        if missing:
            first = np.unique(np.array(own), return_index=True)[1]
            here = first[list(missing.values())]  # in ascending order
            new = np.zeros(len(keys), bool)
            new[here] = True
            put = self.windows.put
            for (key, i), value in zip(missing.items(), self.windows_of(a[new[of_a]], b[new[of_b]], n_a[here], n_b[here])):
                found[i] = value
                put(key, value, len(key) + len(value[0]) + len(value[1]))
        return [found[i] for i in own] if len(place) < len(keys) else found, ends_a[to_a - 1]


@cache
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


def _aligned(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str, with_groups: bool) -> Iterator[pa.RecordBatch]:
    both = tokenizers(path_a, path_b)
    for batch in by_bytes(batches, 1, CHUNK):
        with without_cycles():
            rows = _rows(batch, both, with_groups)
        yield rows


def _rows(batch: pa.RecordBatch, both: Tokenizers, with_groups: bool) -> pa.RecordBatch:
    none = np.zeros(0, np.int32)
    rows = [(0, 0, 0, 0, "", "", none, none)] * batch.num_rows
    texts = batch.column(1)
    given = np.flatnonzero(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
    for k, found in zip(given.tolist(), both.align(texts.take(pa.array(given))) if len(given) else ()):
        if found is not None:
            n_a, n_b, n_groups, codes, text = found
            pairs, times = np.unique(codes, return_counts=True)
            rows[k] = (n_a, n_b, n_groups, len(codes), hashlib.sha256(text).hexdigest(),
                       text.decode() if with_groups else None, pairs, times.astype(np.int32))
    n_a, n_b, n_groups, n_links, digest, groups, pairs, times = zip(*rows)
    bounds = np.cumsum([0, *map(len, pairs)]).astype(np.int32)
    zeros = pa.array(np.zeros(len(rows), np.int64))
    return pa.RecordBatch.from_arrays(
        [batch.column(0), *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)), pa.array(digest, pa.string()),
         pa.array(groups, pa.string()), *(pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(x)))
                                          for x in (pairs, times)), zeros, zeros],
        names=[c.split()[0] for c in ROWS.split(", ")])


def _documents_of_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs, n = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], names=["pair", "n"])


def _scored(batches: Iterator[pa.RecordBatch], pairs: np.ndarray, counts: np.ndarray, best: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Adds what the links of a slice of all pairs (sorted) make up."""
    for batch in batches:
        lists, times = batch.column("pairs"), batch.column("times").flatten().to_numpy().astype(np.int64)
        codes = lists.flatten().to_numpy()
        at = np.minimum(np.searchsorted(pairs, codes), max(len(pairs) - 1, 0))
        times = np.where(pairs[at] == codes, times, 0) if len(pairs) else 0 * times
        upto = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        columns = list(batch.columns)
        for name, of in (("n_best", best), ("count_sum", counts)):
            sums = np.concatenate([[0], np.cumsum(times * of[at] if len(pairs) else times)])
            place = batch.schema.get_field_index(name)
            columns[place] = pa.array(columns[place].to_numpy() + sums[upto[1:]] - sums[upto[:-1]])
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, with_groups: bool = False) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if
    asked for, `groups`, the text `a1,a2|b1;a3|b2,b3` of the ids that lie between shared ends.

    A is a byte-level vocabulary of the `tokenizers` library and reads a space and the text, B
    one of `sentencepiece`, which adds the space itself. After both have tokenised a text as a
    whole, the shared ends before space-marked tokens cut it into windows; the alignment of a
    window is worked out once for its ids and remembered. Two tokens whose bytes overlap are a
    link; its count is the number of documents that hold the two ids linked anywhere in the
    table, and it is best if no other count of its A id is higher.

    Null and empty texts, and those whose bytes either tokenizer changes, have zeros and empty
    strings. Rows with equal or null doc_id are documents of their own; other columns are not
    read. An empty table gives no rows.

    Counts are summed by pair of ids, so no group of documents meets in a task. The table of
    pairs goes to the tasks in slices of at most `PAIRS` pairs (or those of one A id), as many
    as the pairs need; their number is bounded by the vocabularies, not by the documents.
    """
    import public_tokenizers

    spark = docs.sparkSession
    path_a, path_b = path_a or public_tokenizers.path(VOCABULARY_A), path_b or public_tokenizers.path(VOCABULARY_B)
    names = tokenizers(path_a, path_b)
    wide = len(names.bytes_b)
    if len(names.bytes_a) * wide > 1 << 31:
        raise ValueError("the vocabularies are too large for pairs of 31 bits")
    rows = stored(docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        lambda it: _aligned(it, path_a, path_b, with_groups), ROWS), "alignments")
    counts = rows.select("pairs").mapInArrow(_documents_of_pairs, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = stored(counts.withColumn("a", F.expr(f"pair div {wide}").cast("int")), "pair-counts")
    by_id = sorted((r.a, r.n) for r in counts.groupBy("a").agg(F.count("*").alias("n")).collect())  # a row per id of A at most
    slices, held = [], 0
    for a, n in by_id:
        if not slices or held + n > PAIRS:
            slices.append([a, a])
            held = 0
        slices[-1][1], held = a, held + n
    for low, high in slices:
        own = counts.where(F.col("a").between(low, high)).select("a", "pair", "n").toArrow().sort_by("pair")
        a, pairs, n = (own.column(i).to_numpy() for i in range(3))
        first = np.flatnonzero(np.diff(a, prepend=-1))
        best = n == np.repeat(np.maximum.reduceat(n, first), np.diff(np.append(first, len(n))))
        shared = spark.sparkContext.broadcast((pairs, n, best))
        rows = rows.mapInArrow(lambda it, shared=shared: _scored(it, *shared.value), ROWS)
        if len(slices) > 1:
            rows = stored(rows, "scored-alignments")
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return rows.select(*kept, *(["groups"] if with_groups else []))


@query("op12_token_alignment")
def token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return align(table(spark, sf, "documents"))
