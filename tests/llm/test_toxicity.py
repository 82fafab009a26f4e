import random
import zlib

import numpy as np
import pytest

from panelmill.llm import toxicity as tox

SCHEMA = "doc_id long, text string, lang string, score double, toxic string, starts int"
LABELS = "doc_id long, quality int, toxic int"


def recursive(scores, start=0):
    """Maximal segments by their definition: the best segment, then those left and right of it."""
    best, upto = None, np.concatenate([[0.0], np.cumsum(scores)])
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = upto[j] - upto[i]
            if s > 0 and (best is None or s > best[2]):
                best = (i, j, s)
    if best is None:
        return []
    i, j, s = best
    return recursive(scores[:i], start) + [(start + i, start + j, s)] + recursive(scores[j:], start + j)


def test_segments_against_their_definition(rng):
    for _ in range(150):
        scores = rng.normal(-0.3, 1.0, rng.integers(0, 25))
        got = tox.segments(scores)
        want = recursive(scores)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2] for g in got], [w[2] for w in want])
    assert tox.segments(np.zeros(5)) == [] == tox.segments(np.zeros(0))


def test_decay_is_the_root():
    histogram = np.zeros(tox.BINS)
    histogram[tox.BINS // 2 - 10], histogram[tox.BINS // 2 + 9] = 90, 10
    values = (np.arange(tox.BINS) + 0.5 - tox.BINS / 2) * tox.STEP
    rate = tox.decay(histogram)
    assert (histogram / 100 * np.exp(rate * values)).sum() == pytest.approx(1)
    assert tox.decay(np.zeros(tox.BINS)) == 1.0


def test_p_values_fall_with_passages_and_rise_with_length():
    few, many = (tox.log_p(500, np.array([6.0] * k), 1.2, 0.1)[0] for k in (1, 4))
    assert many < few < 0
    assert tox.log_p(50, np.array([6.0]), 1.2, 0.1)[0] < tox.log_p(50_000, np.array([6.0]), 1.2, 0.1)[0]
    assert tox.log_p(0, np.zeros(0), 1.2, 0.1)[0] == 0
    scores = tox.probability(np.array([0.0, -5.0, -200.0, -9000.0]), 0.1, 0.02)
    assert (np.diff(scores) >= 0).all() and 0 <= scores[0] < 0.01 and 0.99 < scores[-1] <= 1


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    voc, bad = [f"w{i}" for i in range(600)], ["scoundrel", "Villain!", "rascal"]
    rows, labels = [], []
    for i in range(700):
        words = rng.choices(voc, k=rng.randrange(20, 200))
        toxic = i % 7 == 0
        for _ in range(4 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), "en", None, "x", 1))
        labels.append((i, 1, int(toxic)))
    copied = " ".join(rng.choices(voc, k=120) + bad)
    rows += [(1000 + i, copied, "en", None, None, None) for i in range(150)]  # a toxic text in many copies
    labels += [(1000 + i, 1, 1) for i in range(150)]
    rows += [(2000, None, None, None, None, None), (2001, "", None, None, None, None), (2002, " \n\t", None, None, None, None),
             (2003, ". , !", None, None, None, None), (None, "rascal villain scoundrel rascal", None, None, None, None),
             (2004, "w1 " * 60_000, "en", None, None, None), rows[0], rows[0]]
    labels += [(None, 1, 1), (2001, None, None), (3, 1, 0), (2000, 1, 0), (5000, 1, 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(labels, LABELS), rows


def test_held_out_documents(spark, corpus):
    docs, labels, rows = corpus
    got = tox.toxicity(docs, labels).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    held = [r for r in got if r.doc_id is not None and r.doc_id < 700 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 100
    wrong = [r.doc_id for r in held if (r.score >= 0.3) != (r.doc_id % 7 == 0)]
    assert len(wrong) <= 0.03 * len(held)
    for r in got:
        assert 0 <= r.score <= 1 and r.toxic == (r.score >= 0.3)
        words = tox.tokens(texts[r.doc_id] or "")
        assert r.n_words == len(words) and all(0 <= a < b <= len(words) for a, b in zip(r.starts, r.ends))
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].toxic == 0 and not by_id[i].starts for i in (2000, 2001, 2002, 2003, 2004))
    assert by_id[None].toxic == 1  # its words are all toxic
    assert sum(by_id[i].toxic for i in range(700) if i % 7) <= 20  # the copied text did not taint its words
    passages = {w.lower().strip("!") for i in range(0, 700, 7) for a, b in zip(by_id[i].starts, by_id[i].ends)
                for w in tox.tokens(texts[i])[a:b]}
    assert {"scoundrel", "villain", "rascal"} <= passages
    again = tox.toxicity(docs.repartition(5), labels).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_without_labels_or_documents(spark, corpus):
    docs, labels, _ = corpus
    none = tox.toxicity(docs, labels.where("false")).collect()
    assert none and not any(r.toxic for r in none)
    assert tox.toxicity(docs.where("false"), labels).count() == 0


def test_held_out_rule(spark):
    rows = [(i,) for i in [*range(200), None, 10**17]]
    got = spark.createDataFrame(rows, "doc_id long").select("doc_id", tox.held_out("doc_id").alias("h")).collect()
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_accuracy_on_a_table(spark):
    """Documents whose labels were held out."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = tox.toxicity(docs, labels).where(tox.held_out("doc_id")).join(
        labels.select("doc_id", labels.toxic.alias("label")), "doc_id").collect()
    clean = [r.score for r in rows if not r.label]
    assert sum(s >= 0.3 for s in clean) <= 0.05 * len(clean)
    toxic = [r.score for r in rows if r.label]
    assert sum(s >= 0.3 for s in toxic) >= 0.6 * len(toxic)

