"""Masked pseudo-likelihood of documents under a bidirectional window network trained on the corpus."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.llm.common import stored, table
from panelmill.llm.registry import query

VOCABULARY = 32_768  # words with an entry of their own
SINGLE, BANDS, TAILS = 40, 15, 8  # classes of one word, of words of like frequency, of rarer words by length
CLASSES = 1 + SINGLE + BANDS + TAILS  # 0 stands for what is beyond either end of a text
SIDE, HIDDEN = 2, 24
STEP, RATE = 8192, 0.05  # positions in a step, learning rate
SEED = 31
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _hashes(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Signed 64-bit hashes of the lower-cased words of a text, and which tail class each would have."""
    words = (text or b"").translate(LOWER).split()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)
    return hashes, np.minimum(np.fromiter(map(len, words), np.int64, len(words)) // 3, TAILS - 1)


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, size = [], 0
        texts = batch.column(0).cast(pa.binary())
        for i in range(len(texts)):
            found.append(np.stack(_hashes(texts[i].as_py())))
            size += found[-1].shape[1]
            if size > 1 << 20 or i == len(texts) - 1:
                hashes, tails = np.concatenate(found, axis=1)
                keys, first, n = np.unique(hashes, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(tails[first].astype(np.int32)), pa.array(n)], names=["word", "tail", "n"])
                found, size = [], 0


@dataclass
class Vocabulary:
    """Frequent words by sorted hash with their class and ln p(word | class); ln p(class).

    `tail_within` is the ln p(word | class) of a tail word that is counted once; ln of its count comes on top.
    """

    words: np.ndarray
    classes: np.ndarray
    within: np.ndarray
    tail_within: np.ndarray
    prior: np.ndarray

    def __call__(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        return self.numbered(text)[:2]

    def numbered(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class and ln p(word | class) of each word of a text, the latter without ln of the counts of the
        tail words; the hashes of these."""
        hashes, tails = _hashes(text)
        if not len(self.words):
            return (tails + CLASSES - TAILS).astype(np.uint8), self.tail_within[tails], hashes
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        known = self.words[at] == hashes
        return (np.where(known, self.classes[at], tails + CLASSES - TAILS).astype(np.uint8),
                np.where(known, self.within[at], self.tail_within[tails]), hashes[~known])


def word_counts(docs: DataFrame) -> DataFrame:
    """How often each word of the corpus occurs, and the tail class it would have."""
    return stored(docs.select("text").mapInArrow(_tallies, "word long, tail int, n long")
                  .groupBy("word").agg(F.min("tail").alias("tail"), F.sum("n").alias("n")), "word-counts")


def vocabulary(docs: DataFrame, counts: DataFrame | None = None) -> Vocabulary:
    """`VOCABULARY` words come to the driver, of the others sums by tail class; their own counts stay in `counts`."""
    counts = word_counts(docs) if counts is None else counts
    top = counts.orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()
    words, n = np.array([r.word for r in top], np.int64), np.array([r.n for r in top], np.float64)
    classes = np.arange(1, len(words) + 1)
    rest = np.cumsum(n[SINGLE:])
    if len(rest):
        classes[SINGLE:] = 1 + SINGLE + np.minimum((rest - n[SINGLE:]) / rest[-1] * BANDS, BANDS - 1).astype(np.int64)
    mass = np.zeros(CLASSES)
    np.add.at(mass, classes, n)
    within = np.log(n) - np.log(mass[classes])
    for row in counts.groupBy("tail").agg(F.sum("n").alias("n")).collect():
        mass[CLASSES - TAILS + row.tail] = row.n
    for r in top:  # what has an entry is not in the tail
        mass[CLASSES - TAILS + r.tail] -= r.n
    prior = np.log((mass + 1) / (mass.sum() + CLASSES))
    order = np.argsort(words)
    return Vocabulary(words[order], classes[order], within[order], -np.log(np.maximum(mass[CLASSES - TAILS:], 1)), prior)


def _numbered(batches: Iterator[pa.RecordBatch], vocab: Vocabulary) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        texts, line, within, rare, times = batch.column(1).cast(pa.binary()), [], [], [], []
        for i in range(len(texts)):
            classes, inside, hashes = vocab.numbered(texts[i].as_py())
            line.append(classes.tobytes())
            within.append(float(inside.sum()))
            found, n = np.unique(hashes, return_counts=True)
            rare.append(found)
            times.append(n)
        ends = pa.array(np.cumsum([0, *map(len, rare)]), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(row, row + len(texts))), batch.column(0), pa.array(line, pa.binary()), pa.array(within, pa.float64()),
             *(pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *x]))) for x in (rare, times))],
            names=["row", "doc_id", "classes", "within", "rare", "times"])
        row += len(texts)


def numbered(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Each text as classes, a byte a word, with the sum of ln p(word | class) as far as `vocab` knows it, and its tail words."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    return stored(docs.select("doc_id", "text").mapInArrow(
        lambda it: _numbered(it, shared.value),
        "row long, doc_id long, classes binary, within double, rare array<long>, times array<long>"), "numbered")


def tail_sums(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """Sum of ln count over the tail words of each text that has any: row, tail_sum.

    The words that are frequent enough to crowd a task have an entry in the vocabulary and are not among them.
    """
    return texts.selectExpr("row", "inline(arrays_zip(rare, times))").join(
        counts.select(F.col("word").alias("rare"), F.ln("n").alias("ln_n")), "rare").groupBy("row").agg(
        F.sum(F.col("times") * F.col("ln_n")).alias("tail_sum"))


class WindowNetwork:
    """p(class of a word | classes of the SIDE words on either side): a table per place, tanh, softmax."""

    SHAPES = ((2 * SIDE, CLASSES, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,))

    def __init__(self, weights: np.ndarray):
        self.flat = weights.astype(np.float32)
        parts = np.split(self.flat, np.cumsum([int(np.prod(s)) for s in self.SHAPES])[:-1])
        self.inner, self.inner_bias, self.outer, self.bias = (p.reshape(s) for p, s in zip(parts, self.SHAPES))

    @classmethod
    def start(cls, prior: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        parts = [rng.normal(0, 0.1, s) for s in cls.SHAPES]
        parts[1], parts[3] = np.zeros(HIDDEN), prior
        return np.concatenate([p.ravel() for p in parts])

    def forward(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = self.inner_bias + self.inner[0][around[0]]
        for p in range(1, 2 * SIDE):
            hidden += self.inner[p][around[p]]
        np.tanh(hidden, out=hidden)
        scores = hidden @ self.outer
        scores += self.bias
        scores -= scores.max(axis=1, keepdims=True)
        scores -= np.log(np.exp(scores).sum(axis=1, keepdims=True))
        return hidden, scores

    def train(self, around: np.ndarray, target: np.ndarray, squares: np.ndarray) -> None:
        """One Adagrad step; `squares` holds the sums of squared gradients."""
        hidden, scores = self.forward(around)
        delta = np.exp(scores)
        delta[np.arange(len(target)), target] -= 1
        back = (delta @ self.outer.T) * (1 - hidden * hidden)
        inner = np.empty(self.inner.shape, np.float32)
        for p in range(2 * SIDE):
            inner[p] = _ONE[around[p]].T @ back
        gradient = np.concatenate([inner.ravel(), back.sum(0), (hidden.T @ delta).ravel(), delta.sum(0)]) / len(target)
        squares += gradient * gradient
        self.flat -= RATE * gradient / (np.sqrt(squares) + 1e-6)


_ONE = np.eye(CLASSES, dtype=np.float32)


def windows(classes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Classes around each word, and of the word, of several texts in a row."""
    gap = np.zeros(SIDE, np.uint8)
    line = np.concatenate([gap, *(x for c in classes for x in (c, gap))])
    lengths = np.array([len(c) for c in classes])
    starts = SIDE + np.concatenate([[0], np.cumsum(lengths + SIDE)[:-1]])
    at = np.arange(lengths.sum()) + np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return np.stack([line[at + d] for d in range(-SIDE, SIDE + 1) if d]), line[at]


def _trained(batches: Iterator[pa.RecordBatch], prior: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Weights after one pass over the texts of this task, times their number of words."""
    net = WindowNetwork(WindowNetwork.start(prior))
    squares, total, held, size = np.zeros_like(net.flat), 0, [], 0

    def learn():
        around, target = windows(held)
        for i in range(0, len(target), STEP):
            net.train(around[:, i:i + STEP], target[i:i + STEP], squares)

    for batch in batches:
        for classes in batch.column(0):
            held.append(np.frombuffer(classes.as_py(), np.uint8))
            size += len(held[-1])
            if size >= STEP:
                learn()
                total, held, size = total + size, [], 0
    if size:
        learn()
        total += size
    if total:
        yield pa.RecordBatch.from_arrays(
            [pa.array([(net.flat.astype(np.float64) * total).tolist()]), pa.array([total], pa.int64())], names=["weights", "words"])


def trained(docs: DataFrame, vocab: Vocabulary) -> WindowNetwork:
    """The network after one pass over the whole corpus."""
    return trained_on(numbered(docs, vocab), vocab.prior)


def trained_on(texts: DataFrame, prior: np.ndarray) -> WindowNetwork:
    """The network after one pass over numbered texts: every task trains on its part, weights are averaged by words."""
    parts = stored(texts.select("classes").mapInArrow(lambda it: _trained(it, prior), "weights array<double>, words long"),
                   "network-parts")
    rows = parts.select("words", F.posexplode("weights").alias("place", "w")).groupBy("place").agg(
        (F.sum("w") / F.sum("words")).alias("w")).collect()  # one row per weight
    weights = WindowNetwork.start(prior)
    for row in rows:
        weights[row.place] = row.w
    return WindowNetwork(weights)


def score(net: WindowNetwork, classes: np.ndarray, within: np.ndarray) -> float:
    """Sum of ln p(word | both sides) over a text."""
    return float(within.sum()) + class_score(net, classes)


def class_score(net: WindowNetwork, classes: np.ndarray) -> float:
    """Sum of ln p(class | both sides) over a text."""
    if not len(classes):
        return 0.0
    around, target = windows([classes])
    total = 0.0
    for i in range(0, len(target), STEP):
        _, scores = net.forward(around[:, i:i + STEP])
        total += float(scores[np.arange(scores.shape[0]), target[i:i + STEP]].sum(dtype=np.float64))
    return total


def _scored(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    net = WindowNetwork(weights)
    for batch in batches:
        lines = [np.frombuffer(x.as_py(), np.uint8) for x in batch.column(2)]
        sums = [class_score(net, line) + within for line, within in zip(lines, batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(map(len, lines), pa.int64()), pa.array(sums, pa.float64())],
            names=["row", "doc_id", "n_tokens", "known"])


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """Score of each whole text: doc_id, n_tokens, log_prob, mean_log_prob.

    p(word | both sides) = p(class | window) p(word | class). The classes and p(word | class) come
    from exact counts of all words of the corpus, p(class | window) from a network trained on
    every position of every text. `log_prob` is the sum over all words. Every word has the count
    of its own: frequent ones from a table of `VOCABULARY` entries that every task holds, the
    others by a join of the counted words with the tail words of the texts.

    A null or empty text has 0 words, log_prob 0 and no mean. Rows are scored one by one, so
    repeated or null doc_ids stay rows of their own. An empty corpus gives no rows. How the
    input is split into tasks changes the averaged weights slightly; the same split gives
    the same scores.
    """
    counts = word_counts(docs)
    vocab = vocabulary(docs, counts)
    texts = numbered(docs, vocab)
    weights = trained_on(texts, vocab.prior).flat
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    scored = texts.select("row", "doc_id", "classes", "within").mapInArrow(
        lambda it: _scored(it, shared.value), "row long, doc_id long, n_tokens long, known double")
    scored = scored.join(tail_sums(texts, counts), "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("tail_sum", F.lit(0.0))).alias("log_prob"))
    return scored.withColumn("mean_log_prob", F.try_divide("log_prob", "n_tokens"))


@query("op1_lm_scoring")
def lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    return pseudo_likelihood(table(spark, sf, "documents"))
