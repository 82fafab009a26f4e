import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from panelmill.llm import source_divergence
from panelmill.llm.source_divergence import count_terms, divergence, radix_order

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, total long, value string"


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, min_docs, top):
    groups, seen, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups[lang, source].update(terms(text))
        seen[lang].update(set(terms(text)))
        langs[lang].add(source)
    out = []
    for lang, sources in langs.items():
        kept = [t for t, n in seen[lang].items() if n >= min_docs]

        def share(counts):
            total = sum(counts[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // total for t in kept}
        whole = share(sum((groups[lang, s] for s in sources), Counter()))
        own = {s: share(groups[lang, s]) for s in sources}

        def f(p, q):
            return (p - q) ** 2 // (p + q)
        for s in sources:
            pairs = [(o, sum(f(own[s][t], own[o][t]) for t in kept)) for o in sources - {s}]
            used = [(t, f(own[s][t], whole[t])) for t in kept if groups[lang, s][t] and own[s][t] > whole[t]]
            for part, items, most in (("pair", pairs, None), ("term", used, top)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


@pytest.mark.parametrize("chunk", [16 << 20, 300])
def test_divergence_against_brute_force(spark, monkeypatch, chunk):
    """Short, long and non-ASCII terms, nulls, empty texts, repeated rows, ties, clashing columns, groups without terms."""
    monkeypatch.setattr(source_divergence, "CHUNK", chunk)
    rng = random.Random(2)
    words = ["a", "B", "être", "Straße", "exactly8", "exactly16letters", "x" * 17, "y" * 40, "ÀÉ" * 9, "z" * 33, "don't", "zz9zz", "中文"]
    rows = [(i, rng.choice([" ", "\n", "-", "3", "\x00"]).join(rng.choices(words, k=rng.randrange(0, 30))), rng.choice(["en", "fr"]),
             rng.choice(["s1", "s2", "s3", "Z"]), "t", 1, 1, "v") for i in range(160)]
    rows += rows[:5] + [(None, None, "en", "s9", None, None, None, None), (7, "", None, None, None, None, None, None),
                        (8, "only here", "", "q", None, None, None, None), (9, "w" * 70_000 + " a", "en", None, None, None, None, None)]
    got = divergence(spark.createDataFrame(rows, SCHEMA).repartition(3), 3, 4).collect()
    assert sorted(map(tuple, got)) == brute(rows, 3, 4)


def test_divergence_of_nothing(spark):
    assert divergence(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([(1, "a b c", "en", "s")], "doc_id long, text string, lang string, source string")
    assert divergence(one).count() == 0


def test_radix_order_is_stable(rng):
    a, b = rng.integers(0, 5, 3000).astype(np.uint32), rng.integers(0, 2**63, 3000).astype(np.uint64) >> np.uint64(rng.integers(0, 60))
    assert (radix_order(a, b) == np.lexsort([b, a])).all()
    assert radix_order(np.zeros(0, np.uint64)).size == 0


def test_terms_end_with_their_text():
    data = np.frombuffer(b"abcdef" + b"ab" + bytes(8), np.uint8)
    got = [(g.tolist(), t.tolist(), n.tolist(), d.tolist())
           for g, t, n, d in count_terms(data, np.array([2, 2, 6, 8]), np.array([0, 0, 1, 0]))]
    assert got == [([0, 1], [b"ab", b"cdef"], [2, 1], [2, 1])]


def test_shares_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    rows = [(0, 7), (7, 7), (3 * 10**14, 9 * 10**14 + 1), (9 * 10**14, 9 * 10**14 + 1)]
    df = spark.createDataFrame(rows, "c long, t long")
    want = [1 + 10**9 * c // t for c, t in rows]
    assert [r.p for r in df.select(source_divergence.scaled_share(F.col("c"), F.col("t")).alias("p")).collect()] == want
    counts, totals = (np.array(x) for x in zip(*rows))
    assert source_divergence._share(counts, totals).tolist() == want
