"""Toxic passages: maximum-scoring segments of token log-odds, and scores of documents calibrated by extreme values."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.llm.common import by_bytes, stored, table, without_cycles
from panelmill.llm.registry import query

SAMPLE = 200_000  # labelled documents that are learned from, at most: those with the smallest hashes of doc_id
CELLS = 1 << 20  # cells that words, and as many that word beginnings, are counted in by their hashes
BEGINNING = 4  # characters of a word's beginning
PRIOR = 2.0  # documents that a beginning's prior, and a word's, counts as
DEVIATIONS = 1.64  # standard deviations by which a share is drawn towards that of all documents
DRIFT = 0.1  # taken off the score of every token, so that it falls through clean text
STEP, BINS = 0.05, 240  # of the histogram of token scores, which begins at -BINS / 2 * STEP
SIGNIFICANT = 0.05  # chance passages in a clean document that a significant passage may be one of
THRESHOLD = 0.3
CHUNK = 2 << 20
KEPT = 300_000  # words remembered
SHINGLE = 3  # words in a row whose hashes tell copies
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)  # odd numbers
STRIPPED = " \t\n\r\x0b\x0c.,;:!?|()[]{}\"'*#"

SCORED = "doc_id long, toxic int, n_words long, score double, log_p double, starts array<int>, ends array<int>, evalues array<double>"


class Model(NamedTuple):
    """Documents with each cell by label, documents of each label, and the calibration (None before it is known)."""

    words: np.ndarray  # 2 x CELLS: clean, toxic
    beginnings: np.ndarray
    documents: np.ndarray  # clean, toxic
    calibration: tuple[float, float, float] | None = None  # lambda, K, exponent of toxic documents


def tokens(text: str) -> list[str]:
    """Lower-case words; white space separates them, and punctuation around them goes. An empty one stays a token."""
    return [w.strip(STRIPPED) for w in text.lower().split()]


def cells(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    n = len(words)
    return (np.fromiter((zlib.crc32(w.encode()) % CELLS for w in words), np.int64, n),
            np.fromiter((zlib.crc32(w[:BEGINNING].encode()) % CELLS for w in words), np.int64, n))


def _drawn(toxic: np.ndarray, clean: np.ndarray, prior: np.ndarray | float, base: float) -> np.ndarray:
    """The posterior share of toxic documents under a Dirichlet prior, drawn towards the base share by its deviation."""
    n = toxic + clean + PRIOR
    share = (toxic + PRIOR * prior) / n
    error = DEVIATIONS * np.sqrt(share * (1 - share) / (n + 1))
    return np.where(share > base, np.maximum(share - error, base), np.minimum(share + error, base))


def token_scores(model: Model, at: np.ndarray, begin: np.ndarray, left_out: int | None = None) -> np.ndarray:
    """Log-odds of toxic documents for tokens by their cells, less the drift.

    The prior of a word is the share of its beginning, whose own prior is the share of all
    documents. With `left_out`, a label, one document of it that holds all these tokens does not count.
    """
    clean, toxic = (model.words[k][at].astype(float) - (left_out == k) for k in (0, 1))
    clean_b, toxic_b = (model.beginnings[k][begin].astype(float) - (left_out == k) for k in (0, 1))
    documents = np.maximum(model.documents - [left_out == 0, left_out == 1], 0.1)
    base = documents[1] / documents.sum()
    prior = _drawn(np.maximum(toxic_b, 0), np.maximum(clean_b, 0), base, base)
    share = np.clip(_drawn(np.maximum(toxic, 0), np.maximum(clean, 0), prior, base), 1e-6, 1 - 1e-6)
    return np.log(share / (1 - share)) - np.log(base / (1 - base)) - DRIFT


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments `(start, end, score)`, ends exclusive, by Ruzzo and Tompa's linear scan.

    Runs of tokens without a positive score are one step each.
    """
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    before = np.concatenate([[0.0], np.cumsum(scores)])
    # start, end, sum before the start, sum at the end, and the last earlier one that begins lower
    found: list[tuple[int, int, float, float, int]] = []
    for i, left, right in zip(positive.tolist(), before[positive].tolist(), before[positive + 1].tolist()):
        start, j = i, len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]  # those between begin no lower
            if j < 0 or found[j][3] >= right:
                break
            start, _, left, _, lower = found[j]
            del found[j:]
            j = lower
        found.append((start, i + 1, left, right, j))
    return [(a, b, r - left) for a, b, left, r, _ in found]


def decay(histogram: np.ndarray) -> float:
    """Karlin and Altschul's lambda: the positive root of the mean of exp(lambda s) = 1 over clean tokens."""
    values = (np.arange(BINS) + 0.5 - BINS / 2) * STEP
    share = histogram / max(histogram.sum(), 1)
    if not (share * values).sum() < 0 or not share[values > 0].any():
        return 1.0
    low, high = 0.0, 1.0
    while (share * np.exp(high * values)).sum() < 1 and high < 64:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if (share * np.exp(middle * values)).sum() < 1 else (low, middle)
    return high


def log_p(n: int, scores: np.ndarray, rate: float, size: float) -> tuple[float, np.ndarray]:
    """Natural logarithm of the chance that clean text of n tokens has passages as good as these, and the
    number of passages by chance as good as each (E-value).

    For the r best, Karlin and Altschul's sum statistics: exp(-T) T^(r-1) / (r! (r-1)!) with T
    the summed normalised scores; the best r counts, each r with the weight 2^-r.
    """
    normal = rate * np.sort(scores)[::-1] - np.log(size * max(n, 1))
    evalues = np.exp(-(rate * scores - np.log(size * max(n, 1))))
    best, total, factorials = 0.0, 0.0, 0.0
    for r, x in enumerate(normal.tolist(), 1):
        total += x
        if x <= 0 and r > 1:
            break
        factorials += np.log(r) + (np.log(r - 1) if r > 1 else 0.0)
        if r == 1:
            single = -np.expm1(-np.exp(-total)) if total > -30 else 1.0
            best = min(best, (np.log(single) if single > 0 else -total) + np.log(2))
        elif total > r - 1:
            best = min(best, -total + (r - 1) * np.log(total) - factorials + r * np.log(2))
    return min(best, 0.0), evalues


def probability(log_ps: np.ndarray, base: float, exponent: float) -> np.ndarray:
    """The posterior of a toxic document: its p-value is Beta(exponent, 1), that of a clean one uniform."""
    odds = np.log(base / (1 - base) * exponent) + (exponent - 1) * log_ps
    return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the smallest hash of their `SHINGLE` words in a row, which most near copies have in common."""
    for batch in by_bytes(batches, 1, CHUNK):
        keys = []
        for text in batch.column(1).to_pylist():
            words = [zlib.crc32(w.encode()) for w in tokens(text)]
            words += [0] * (SHINGLE - len(words))
            runs = np.lib.stride_tricks.sliding_window_view(np.array(words, np.uint64), SHINGLE) @ MIX
            keys.append(int(((runs ^ (runs >> np.uint64(29))) * MIX[0]).min() >> np.uint64(1)))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=[*batch.schema.names, "key"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each cell by label, summed up in the task (kind 0: words, 1: beginnings, 2: documents)."""
    counts = np.zeros((3, 2, CELLS), np.int64)
    for batch in by_bytes(batches, 0, CHUNK):
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[2, toxic, 0] += 1
            for kind, at in enumerate(cells(list(set(tokens(text))))):
                np.add.at(counts[kind, toxic], np.unique(at), 1)
    for kind, label in np.ndindex(3, 2):
        at = np.flatnonzero(counts[kind, label])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(at), kind, np.int32)), pa.array(np.full(len(at), label, np.int32)), pa.array(at),
             pa.array(counts[kind, label, at])], names=["kind", "toxic", "cell", "n"])


def _left_out(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Of each labelled document, scored without itself: its label, tokens, segment scores and histogram of token scores."""
    for batch in by_bytes(batches, 0, CHUNK):
        rows = []
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            scores = token_scores(model, *cells(tokens(text)), left_out=toxic)
            places = np.clip(scores / STEP + BINS / 2, 0, BINS - 1).astype(int)
            rows.append((toxic, len(scores), [s for *_, s in segments(scores)], np.bincount(places, minlength=BINS)))
        toxic, n, found, histograms = zip(*rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(toxic, pa.int32()), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.float64())),
             pa.array([h.tolist() for h in histograms], pa.list_(pa.int64()))], names=["toxic", "n", "found", "histogram"])


def _sums(batches: Iterator[pa.RecordBatch], rate: float, size: float | None) -> Iterator[pa.RecordBatch]:
    """Sums over documents for the size K (of clean ones, if `size` is None) or the exponent (of toxic ones)."""
    number, total = 0, 0.0
    for batch in batches:
        for toxic, n, found in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if size is None and not toxic and n:
                number, total = number + 1, total + n * np.exp(-rate * max(found, default=0.0))
            elif size is not None and toxic:
                number, total = number + 1, total - log_p(n, np.array(found), rate, size)[0]
    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([total])], names=["number", "total"])


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of the labelled documents whose crc32(doc_id) mod 4 is not 2, of at most `sample` labels.

    Of documents with one label that are copies by their smallest hash, the one with the
    smallest doc_id is learned from: many copies of one toxic text would make all its words toxic. Counts and calibration have a bounded size (`CELLS`, `BINS`); only these reach the driver.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out("doc_id")).groupBy("doc_id").agg(
        F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    taught = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(
        F.broadcast(known), "doc_id")  # `sample` rows at most
    taught = taught.mapInArrow(_keyed, "doc_id long, text string, label int, key long").groupBy("label", "key").agg(
        F.min(F.struct("doc_id", "text")).alias("first"))
    taught = stored(taught.select("first.text", "label"), "taught")
    counts = np.zeros((3, 2, CELLS), np.int64)
    summed = taught.mapInArrow(_counted, "kind int, toxic int, cell long, n long").groupBy("kind", "toxic", "cell").agg(F.sum("n").alias("n"))
    rows = summed.toArrow()
    counts[tuple(rows.column(i).to_numpy() for i in range(3))] = rows.column(3).to_numpy()
    model = Model(counts[0].astype(np.int32), counts[1].astype(np.int32), counts[2, :, 0] + np.array([0.9, 0.1]))  # one more document, a tenth of it toxic

    shared = spark.sparkContext.broadcast(model)
    seen = stored(taught.mapInArrow(
        lambda it: _left_out(it, shared.value), "toxic int, n long, found array<double>, histogram array<long>"), "left-out-scores")
    bins = seen.where("toxic = 0").select(F.posexplode("histogram").alias("bin", "n")).groupBy("bin").agg(F.sum("n")).collect()
    histogram = np.zeros(BINS)
    for place, n in bins:
        histogram[place] = n
    rate = decay(histogram)
    found = seen.select("toxic", "n", "found")

    def over(size):
        row = found.mapInArrow(lambda it: _sums(it, rate, size), "number long, total double").agg(F.sum("number"), F.sum("total")).first()
        return row[0] or 0, row[1] or 0.0
    number, total = over(None)
    size = number / total if number and total > 0 else 1.0  # maximum likelihood of K under the extreme-value law
    number, total = over(size)
    exponent = min(number / total, 0.5) if number and total > 0 else 0.5
    return model._replace(calibration=(rate, size, exponent))


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    known: dict[str, float] = {}
    for batch in by_bytes(batches, 1, CHUNK):
        with without_cycles():
            out = _scores(batch, model, known)
        yield out


def _scores(batch: pa.RecordBatch, model: Model, known: dict[str, float]) -> pa.RecordBatch:
    """A scored batch; `known` remembers the scores of words."""
    rate, size, exponent = model.calibration
    texts = [(text or "").lower().split() for text in batch.column(1).to_pylist()]
    words = list(chain.from_iterable(texts))
    found = list(map(known.get, words))
    new = list({w for w, s in zip(words, found) if s is None})
    if new:
        if len(known) > KEPT:
            known.clear()
        scored = dict(zip(new, token_scores(model, *cells([w.strip(STRIPPED) for w in new])).tolist()))
        found = [scored[w] if s is None else s for w, s in zip(words, found)]
        known.update((w, s) for w, s in scored.items() if len(w) < 100)
    found = np.array(found, float)
    stops, rows = np.cumsum([len(t) for t in texts]).tolist(), []
    for i, j in zip([0, *stops], stops):
        passages = segments(found[i:j])
        chance, evalues = log_p(j - i, np.array([s for *_, s in passages]), rate, size)
        real = [(a, b, e) for (a, b, _), e in zip(passages, evalues.tolist()) if e <= SIGNIFICANT]
        rows.append((j - i, chance, [a for a, *_ in real], [b for _, b, _ in real], [e for *_, e in real]))
    n, chances, starts, ends, evalues = zip(*rows)
    scores = probability(np.array(chances), model.documents[1] / model.documents.sum(), exponent)
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array((scores >= THRESHOLD).astype(np.int32)), pa.array(n, pa.int64()), pa.array(scores),
         pa.array(np.array(chances)), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())),
         pa.array(evalues, pa.list_(pa.float64()))], names=[c.split()[0] for c in SCORED.split(", ")])


def held_out(doc_id: Column | str) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4: labels of these rows are not learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, toxic (score >= `THRESHOLD`), n_words, score, log_p and the significant
    passages: starts, ends (tokens, exclusive) and evalues.

    Tokens score their log-odds of toxic labels: a Dirichlet prior that rests on the beginnings
    of words, whose own prior is the share of toxic documents, drawn towards that share where
    documents are few. One linear scan finds every maximal scoring segment of the whole text.
    On labelled clean documents, each scored without itself, the extreme-value law of such
    segments is fitted; it gives a passage its expected number by chance and a document a
    p-value over all its passages, and Bayes' rule with the p-values of toxic documents a score.

    Null and empty texts have no tokens, hence no passages and the lowest score. Labels that
    differ count as toxic if any is; rows with equal or null doc_id are scored one by one (a
    null one is never learned from). Without labels every score is low. Other columns are not read.
    """
    model = learned(docs, labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(lambda it: _scored(it, shared.value), SCORED)


@query("op11_toxicity")
def toxic_documents(spark: SparkSession, sf: str) -> DataFrame:
    scored = toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.col("toxic").alias("predicted"), "n_words",
                         F.size("starts").alias("n_passages"))
