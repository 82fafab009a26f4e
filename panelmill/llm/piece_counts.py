"""Numbers of word pieces by a longest-match automaton, without building the pieces."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.llm.common import table
from panelmill.llm.registry import query

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"  # begins a word
KEPT = 1_000_000  # words that a worker remembers


class LongestMatch:
    """Greedy longest-match-first over a vocabulary, in time linear in the word.

    A trie of the pieces. Where a node has no child for the next character, its failure link
    leads to the node of what remains after the pieces that greedy matching takes from the
    node's string, and `popped` is how many these are. A character that no piece is made of
    alone costs its UTF-8 bytes.
    """

    def __init__(self, pieces: Iterable[str]):
        words = set(pieces) - {""}
        self.children: list[dict[str, int]] = [{}]
        weight: list[int] = [0]  # tokens of a node's string if it is a piece
        for word in sorted(words | {c for w in words for c in w}):
            at = 0
            for c in word:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    weight.append(0)
                at = self.children[at][c]
            weight[at] = 1 if word in words else len(word.encode())
        n = len(self.children)
        self.link, self.popped, self.rest = [-1] * n, [0] * n, [0] * n
        order = deque([0])
        while order:
            parent = order.popleft()
            for c, node in self.children[parent].items():
                if weight[node]:
                    self.link[node], self.popped[node] = 0, weight[node]
                else:
                    at, count = self.link[parent], self.popped[parent]
                    while c not in self.children[at]:  # ends at the root, which has every character
                        at, count = self.link[at], count + self.popped[at]
                    self.link[node], self.popped[node] = self.children[at][c], count
                self.rest[node] = self.popped[node] + self.rest[self.link[node]]
                order.append(node)

    def count(self, word: str) -> int:
        """Pieces of a word."""
        at, total = 0, 0
        for c in word:
            while (to := self.children[at].get(c)) is None and at:
                total += self.popped[at]
                at = self.link[at]
            if to is None:
                total += len(c.encode())
            else:
                at = to
        return total + self.rest[at]


@cache
def automaton(path: str) -> tuple[LongestMatch, dict[bytes, int]]:
    """The automaton of a vocabulary file, and the counts of words seen, one per Python worker."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return LongestMatch(pieces), {}


def _counted(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    matcher, known = automaton(path)
    for batch in batches:
        words_of, tokens_of = [], []
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            words = (text or b"").split()
            counts = list(map(known.get, words))
            if None in counts:
                if len(known) > KEPT:
                    known.clear()
                for word in {w for w, c in zip(words, counts) if c is None}:
                    known[word] = matcher.count(MARK + word.decode())
                counts = [known[w] if c is None else c for w, c in zip(words, counts)]
            words_of.append(len(words))
            tokens_of.append(sum(counts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words_of, pa.int64()), pa.array(tokens_of, pa.int64())],
                                         names=["doc_id", "n_words", "n_tokens"])


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Greedy word-piece length of each whole text: doc_id, n_words, n_tokens.

    Words are what ASCII white space separates. A null or empty text has 0 of both. Rows with
    equal or null doc_id are counted one by one; other columns are not read. Nothing is
    shuffled.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        lambda it: _counted(it, path), "doc_id long, n_words long, n_tokens long")


@query("op10_token_counts")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts(table(spark, sf, "documents"))
