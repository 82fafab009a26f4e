import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from panelmill.llm import token_alignment
from panelmill.llm.token_alignment import VOCABULARY_A, VOCABULARY_B, align, byte_level

SCHEMA = "doc_id long, text string, pairs string, n_a int, a string"


@pytest.fixture(scope="module")
def whole():
    """Ids and bytes of a whole text by both libraries, each called on the whole text."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path(VOCABULARY_A))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=public_tokenizers.path(VOCABULARY_B))
    char = byte_level()

    def of_a(text):
        return [(i, bytes(char[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]

    def of_b(text):
        return [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode())
                for i in b.encode(text) for p in [b.id_to_piece(i)]]
    return of_a, of_b


def brute(rows, whole):
    docs, seen = [], Counter()
    for doc_id, text, *_ in rows:
        a, b = ((f(text) for f in whole) if text else ([], []))
        want = (" " + (text or "")).encode()
        if any(b"".join(x for _, x in side) != want for side in (a, b)):
            docs.append((doc_id, [], [], [], ""))
            continue

        def spans(side):
            at = 0
            for i, x in side:
                yield i, at, at + len(x)
                at += len(x)
        a, b = list(spans(a)), list(spans(b))
        links, lo = [], 0
        for i, s, e in a:  # B's tokens ascend, so the scan starts where the last one began
            while b[lo][2] <= s:
                lo += 1
            k = lo
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = [";".join("|".join(",".join(str(i) for i, s, e in side if lo <= s < hi) for side in (a, b))
                           for lo, hi in zip([0, *cuts], cuts))] if len(cuts) < 400 else [None]
        docs.append((doc_id, a, b, links, groups[0] if groups[0] is None else hashlib.sha256(groups[0].encode()).hexdigest(), len(cuts)))
        seen.update(set(links))
    top = Counter()
    for (i, _), n in seen.items():
        top[i] = max(top[i], n)
    return [(d[0], len(d[1]), len(d[2]), d[5] if d[1] else 0, len(d[3]), sum(seen[x] == top[x[0]] for x in d[3]),
             sum(seen[x] for x in d[3]), d[4]) for d in docs]


ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b", "  a   b  ", "a \n b", "a\n\n\nb\n", "\ta\t b", "don't can't 's x's", "a  b 　c",
       "<|endoftext|> <s>x</s> <unk> <0x41>", "a▁b", "x ▁ y", "café café", "中文 \U0001f600\U0001f468‍\U0001f469 ok",
       "1234567 12 345", "\x00 \x1c \x85   z", "word " * 300, "nospace" * 900, "Straße über   Größe", "...!!!", "=" * 70, "é" * 50]


def test_alignment_against_brute_force(spark, whole):
    rng = random.Random(5)
    vocabulary = ["the", "reading", "unlyhe", "Schlüssel", "école", "42", "(x)", "foo\nbar", "a.b@c.de", "\U0001f600"]
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(ODD)]
    rows += [(100 + i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 40))), None, None, None) for i in range(60)]
    rows += [rows[-1], rows[-1], (None, "the end", None, None, None)]
    got = align(spark.createDataFrame(rows, SCHEMA).repartition(3), with_groups=True).collect()
    key = lambda r: tuple(map(repr, r))
    want = sorted(brute(rows, whole), key=key)
    have = sorted((tuple(r)[:8] for r in got), key=key)
    assert len(have) == len(want)
    for h, w in zip(have, want):
        assert h[:7] == w[:7] and (w[7] is None or h[7] == w[7])
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in got if r.n_a)


def test_small_slices_and_memories_change_nothing(spark, monkeypatch):
    rows = [(i, t, None, None, None) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    want = sorted(map(tuple, align(docs).collect()))
    monkeypatch.setattr(token_alignment, "PAIRS", 60)
    assert sorted(map(tuple, align(docs).collect())) == want


def test_empty_table(spark):
    assert align(spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_texts_of_the_tables(spark, whole):
    """The ids of real texts, chunk by chunk, are those of the libraries on the whole text."""
    both = token_alignment.tokenizers(*map(public_tokenizers.path, (VOCABULARY_A, VOCABULARY_B)))
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r.text]
    chunks, rows = both.chunks_of(pa.array([*texts, *filter(None, ODD)]))
    ids = both.encoded(chunks)
    for text, row in zip([*texts, *filter(None, ODD)], rows):
        for own, side in enumerate(f(text) for f in whole):
            assert np.frombuffer(b"".join(ids[c][own] for c in row), np.int32).tolist() == [i for i, _ in side]
