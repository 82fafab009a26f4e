import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from panelmill.llm import (captures, embedding_dedup, lm_scoring, minhash, mixing, packing, personal_data, piece_counts,
                           quality_rules, token_files)
from panelmill.llm.common import components, running
from panelmill.llm.tokens import Encoder, vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars int, rep long, size int, part int, component string"
WORDS = re.compile(r"[^ \t-\r]+")


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and very long texts, repeated rows, ties, clashing column names."""
    rng = random.Random(4)
    words = [f"word{i}" for i in range(400)]

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))
    base = text(60)
    texts = [None, "", "  \n\t", "one", base, base, base.upper(), base + " tail", text(6000), text(30), text(30), text(200),
             "mail me: a.b@example.com or +1 (555) 123-4567, card 4111 1111 1111 1111 at 10.0.0.1 " + text(30)]
    rows = [(i, t, "en" if i % 2 else None, ["a", "b", None][i % 3], None, 7, 1, 1, "x") for i, t in enumerate(texts)]
    rows += [rows[4], (None, text(25), "de", "b", None, 7, 1, 1, "x"), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, 1 if i != 9 else 0, 0) for i in range(12)] + [(3, 0, 0), (None, 1, 0), (5, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def groups(sets, linked):
    """Smallest member of each component, by brute force."""
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if linked(sets[a], sets[b]):
                u, v = find(a), find(b)
                parent[max(u, v)] = min(u, v)
    return {i: find(i) for i in ids}


def shingles(text, width):
    words = re.findall(WORDS, "".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1)) or frozenset([tuple(words)] if words else [])


def jaccard(a, b):
    both = len(a & b)
    return bool(a and b) and 100 * both >= 80 * (len(a) + len(b) - both)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(0, i) for i in range(300, 400)] + [
        (i, i + 1) for i in range(500, 540)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    near = defaultdict(set)
    for u, v in edges:
        near[u].add(v)
        near[v].add(u)
    nodes = {x for u, v in edges if u != v for x in (u, v)}
    want = groups({n: n for n in nodes}, lambda a, b: b in near[a])
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_running_sums(spark):
    rows = [("a", i, i % 7) for i in range(500)] + [(None, i, 1) for i in range(20)] + [("b", 3, None)]
    got = running(spark.createDataFrame(rows, "g string, i long, x long").repartition(5), ["g", "i"], ["x"], "g", "t").collect()
    for r in got:
        assert r.x_upto == sum(x or 0 for g, i, x in rows if g == r.g and i <= r.i)
    assert len(got) == len(rows)


@pytest.mark.parametrize("limits", [(32, 1024), (3, 8)])
def test_minhash_against_brute_force(spark, monkeypatch, limits):
    """Families of near copies; with the small limits large buckets and several blocks occur."""
    monkeypatch.setattr(minhash, "DIRECT", limits[0])
    monkeypatch.setattr(minhash, "BLOCK", limits[1])
    rng = random.Random(3)
    voc = [f"w{i}" for i in range(2000)]
    texts = []
    for _ in range(3):
        base = [rng.choice(voc) for _ in range(100)]
        for _ in range(35):
            d = list(base)
            for _ in range(rng.choice([0, 1, 3, 5, 8, 10])):
                d[rng.randrange(len(d))] = rng.choice(voc)
            texts.append(" ".join(d))
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (902, "One"), (903, "onE"), (904, " \n ")]
    rng.shuffle(rows)
    got = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    sets = {i: shingles(t, 2) for i, t in rows}
    assert {i: r.component_id for i, r in got.items()} == groups(sets, jaccard)
    assert all(r.n_shingles == len(sets[i]) and r.kept == (i == r.component_id) for i, r in got.items())


def test_minhash_odd_rows(spark, docs):
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    assert sorted(got) == list(range(13))
    assert [got[i].component_id for i in (4, 5, 6, 7)] == [4] * 4
    assert got[0].n_shingles == got[2].n_shingles == 0 and got[3].n_shingles == 1
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((4, 20))
    rows = []
    for i in range(160):
        v = centre[i % 4] + rng.standard_normal(20) * rng.choice([0.05, 0.2, 0.4])
        rows.append((i, [float(x) for x in np.float32(v)], int(i % 3), "x"))
    rows += [(200 + k, rows[0][1], 0, "x") for k in range(5)] + [(300, [0.0] * 20, 0, ""), (301, None, 0, ""), (302, [], 0, ""),
             (303, [1.0] * 19 + [float("nan")], 0, ""), (304, [1.0] * 19 + [None], 0, ""), (305, rows[0][1], None, ""),
             (306, [2 * x for x in rows[0][1]], 0, ""), (307, [1.0, 2.0], 0, ""), (308, [2.0, 4.0], 0, ""),
             (309, [float("inf")] * 20, 0, ""), (None, rows[0][1], 0, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, copies string")
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(df).collect()}

    def sound(r):
        v = r[1]
        return r[2] is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    unit = {r[0]: (r[2], np.array(r[1]) / np.linalg.norm(r[1])) for r in rows if r[0] is not None and sound(r)}

    def linked(a, b):
        return a[0] == b[0] and len(a[1]) == len(b[1]) and a[1] @ b[1] >= 0.93
    want = groups(unit, linked)
    for r in rows[:-1]:
        i = r[0]
        assert got[i].component_id == want.get(i, i)
        assert got[i].n_links == sum(linked(unit[i], u) for j, u in unit.items() if j != i) if i in unit else got[i].n_links == 0
    assert len(got) == len(rows) - 1
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"\D", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
            if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return sorted(out)


def test_personal_data_against_brute_force(spark):
    rng = random.Random(8)
    bits = ["a.b", "@", "x-y", ".", "com", " ", "1", "22", "255", "256", "+", "(", ")", "-", "4111111111111111", "_", "%", "é", "🙂",
            "10.1.2.3", "a@b.c", "+1 555 123 4567", "000", "4111-1111-1111-1111", "\n", "word "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    texts += ["4" * 3000, "a" * 50000, "1 " * 5000, "+1" + "(" * 500 + "2", None, "", "call (555) 123-4567"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "a@b.c", 1)], "doc_id long, text string, base int")
    for r in personal_data.personal_data(df).collect():
        t = "a@b.c" if r.doc_id is None else texts[r.doc_id] or ""
        want = base_spans(t)
        written = ",".join(f"{personal_data.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest(), t
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in want) for j in range(4)]
        assert set(filter(None, written.split(","))) <= set(r.spans.split(","))
    assert personal_data.personal_data(df.limit(0)).count() == 0


def test_labelers_and_classifier(spark):
    """EM separates sound from unsound candidates, and a national number near a keyword is found."""
    truth = personal_data.reliabilities({(1, 1, 0, 1): 80, (1, 1, 1, 1): 30, (1, -1, 0, -1): 40, (-1, -1, 0, -1): 25, (1, 1, 0, 0): 10})
    assert truth[(1, 1, 0, 1)] > 0.9 and truth[(1, -1, 0, -1)] < 0.1
    assert personal_data.reliabilities({}) == {}
    rows = [(i, f"please call +1 555 123 {1000 + i} today") for i in range(40)]
    rows += [(100 + i, f"my phone (555) 123-{1000 + i}, thanks") for i in range(40)]
    rows += [(200 + i, f"serial x555-123-{1000 + i}x") for i in range(40)]
    got = {r.doc_id: r.spans for r in personal_data.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == "phone:9:23" and got[0] == "phone:12:27" and got[200] == ""


def test_redaction(spark, docs):
    got = {r.doc_id: r for r in personal_data.redacted(docs.select(*corpus_pipeline.COLUMNS)).collect()}
    assert got[12].text.startswith("mail me: [EMAIL] or [PHONE], card [CARD] at [IP] ")
    assert got[12].n_chars == len(got[12].text) and got[0].text is None and got[1].text == ""


def rule_counts(text):
    words = re.findall(WORDS, text or "")
    lines = [x for x in (text or "").split("\n") if re.search(WORDS, x)]
    spots = defaultdict(list)
    for i in range(len(words) - 7):
        spots[tuple(words[i:i + 8])].append(i)
    covered = {i + j for at in spots.values() if len(at) > 1 for i in at for j in range(8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), len(lines) - len(set(lines)), len(covered))


def test_quality_against_brute_force(spark, docs, labels):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "b#", "|", "cc\n", "d\n"]) for _ in range(rng.randrange(80))) for _ in range(60)]
    texts += [None, "", "x " * 5000, "é🙂 ü"]
    df = spark.createDataFrame([(i, t, "en", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, ws int")
    got = {r.doc_id: r for r in quality_rules.quality_verdicts(df, labels).collect()}
    for i, t in enumerate(texts):
        n, *rest = rule_counts(t)
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == (n, *rest), t
        assert got[i].base_failed == (n < 20 or 100 * rest[-1] > 30 * n)
        assert got[i].kept == (not got[i].base_failed)  # few labels: nothing is certified
    assert quality_rules.quality_verdicts(docs, labels).count() == docs.count()
    assert quality_rules.quality_verdicts(docs, labels.limit(0)).count() == docs.count()
    assert quality_rules.quality_verdicts(docs.limit(0), labels).count() == 0


def test_cutoffs_hold_their_risk(spark):
    """Good texts of English reach 4 % symbols per word, junk has many; other languages have too few labels."""
    rng = random.Random(6)

    def text(symbols):
        return " ".join(f"w{rng.randrange(9999)}x{i}" + ("#" if i < symbols else "") for i in range(50))
    rows = [(i, text(rng.choice([0, 0, 1, 2])), "en") for i in range(2500)] + [(5000 + i, text(40), "en") for i in range(200)]
    rows += [(9000 + i, text(40), "fr") for i in range(20)]
    labels = [(i, 1, 0) for i in range(2500)] + [(5000 + i, 0, 0) for i in range(100)]
    df, seen = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(
        labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality_rules.quality_verdicts(df, seen).collect()}
    assert sum(not got[i] for i in range(2500)) <= 0.02 * 2500
    assert not any(got[5000 + i] for i in range(200)) and all(got[9000 + i] for i in range(20))


def test_binomial_tail(spark):
    from math import comb

    from pyspark.sql import functions as F

    cases = [(0, 10, 0.1), (3, 100, 0.05), (0, 2000, 0.004), (2, 3000, 0.004), (40, 20000, 0.004), (9, 10, 0.1)]
    for k, n, p in cases:
        got = spark.range(1).select(quality_rules.binomial_tail(F.lit(k), F.lit(n), p).alias("x")).first().x
        want = sum(comb(n, j) * p**j * (1 - p)**(n - j) for j in range(k + 1)) if k <= n * p and n < 1000 else None
        if k > n * p:
            assert got == 1.0
        elif want is not None:
            assert got == pytest.approx(want, rel=1e-10)
        else:
            from fractions import Fraction
            q = Fraction(p)
            assert got == pytest.approx(float(sum(comb(n, j) * q**j * (1 - q)**(n - j) for j in range(k + 1))), rel=1e-9)


def test_mixing(spark, docs):
    rng = random.Random(7)
    rows = [(i, "w " * rng.randrange(40), rng.choices(["a", "b", "c", None], [50, 10, 5, 5])[0], 3) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, one int").repartition(6)
    got = mixing.mixed(df).collect()
    assert got and sorted(got) == sorted(mixing.mixed(df.repartition(2)).collect())
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        source = rows[r.doc_id][2]
        assert r.size == len(rows[r.doc_id][1].split()) and r.taken <= 2 * r.size
        sizes[source] += r.size
        taken[source] += r.taken
        target[source] = r.target
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert all(target[s] <= 2 * sizes[s] and abs(taken[s] - target[s]) <= 40 for s in sizes)
    assert mixing.mixed(docs).count() == docs.count() and mixing.mixed(docs.limit(0)).count() == 0
    assert all(r.taken == 0 for r in mixing.mixed(docs.where("doc_id < 3")).collect())


def test_encoder_equals_library(docs):
    encode = Encoder(vocabulary())
    texts = ["don't WE'VE 's", "a\x1cb c", "É́ x", "<|endoftext|> a", "Σας İstanbul", "a b\x85d", "日本語 テキスト", "a\x00b",
             "12a ١٢", "ﬁ ①", "🙂!!", ""] + [r.text for r in docs.collect() if r.text]
    for t in [*texts, *texts]:
        assert encode(t.encode()).tolist() == encode.whole.encode(t, add_special_tokens=False).ids


def test_encoder_remembers_words_without_their_stops():
    encode = Encoder(vocabulary())
    long = "x" * 100
    text = f"Über über. ÜBER, a. a, Été é. <i, {long}. b.. “c, d.\u0338 e,\xa0f."
    assert encode(text.encode()).tolist() == encode.whole.encode(text, add_special_tokens=False).ids
    assert {b"a", b".", b","} <= set(encode.chunks[0])
    assert not {b"a.", b"a,", long.encode()} & set(encode.chunks[0])


def test_texts_cut_together_keep_their_own_ids():
    encode = Encoder(vocabulary())
    texts = ["gone", "ab", "cd", None, "", "x.", " y. Z", ".", "a, <|endoftext|>Über. B", "<", "|x|> IT'S", " \n", "É", "e", None]
    for column in (pa.array(texts).slice(1), pa.array(texts, pa.large_string()).slice(1)):
        ids, bounds = encode.texts(column)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [
            encode.whole.encode(t or "", add_special_tokens=False).ids for t in texts[1:]]
    ids, bounds = encode.texts(pa.array([], pa.string()))
    assert len(ids) == 0 and bounds.tolist() == [0]


def test_sequences_are_copied_a_few_at_a_time():
    n = packing.TOGETHER * 2 + 5
    rows = pa.RecordBatch.from_arrays(
        [pa.array(range(n)), pa.array([0] * n, pa.int32()), pa.array([3] * n), pa.array([np.arange(i, i + 3, dtype="<u2").tobytes() for i in range(n)]),
         pa.array(range(n)), pa.array([0] * n)], names=["doc_id", "piece", "length", "ids", "sequence_id", "offset"])
    filled = list(packing._filled(iter([rows])))
    assert max(b.num_rows for b in filled) <= packing.TOGETHER
    whole = pa.Table.from_batches(filled).combine_chunks().to_batches()
    read = list(packing._read(iter(whole), 2048))
    assert max(b.num_rows for b in read) <= packing.TOGETHER
    read = pa.Table.from_batches(read)
    assert read["doc_id"].to_pylist() == list(range(n)) and read["offset"].to_pylist() == [0] * n
    assert read["ids"].to_pylist() == [[i, i + 1, i + 2] for i in range(n)]


def test_word_coding_round_trip():
    rng = np.random.default_rng(1)
    for k in range(40):
        ids = rng.integers(0, 2**int(rng.integers(1, 64)), 90_000, dtype=np.uint64)
        ids[rng.random(len(ids)) < rng.choice([0, 0.3, 0.99])] = 0
        ids = ids[:int(rng.integers(0, len(ids)))]
        assert (token_files.decode(token_files.encode(ids)) == ids).all()
    assert len(token_files.encode(np.zeros(240 * 50, np.uint64))) == 24 + 16 + 8 * 50


def test_token_files(spark, docs):
    encode = Encoder(vocabulary()).whole.encode
    got = token_files.read_token_files(token_files.write_token_files(docs)).orderBy("start").collect()
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    start, ids_seen = 0, []
    for r in got:
        assert r.start == start
        start += r.n_tokens
        if r.doc_id is not None:
            ids = [*encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1]
            assert r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
            ids_seen.append(r.doc_id)
    assert ids_seen == sorted(ids_seen) and len(got) == docs.count()
    assert token_files.read_token_files(token_files.write_token_files(docs.limit(0))).count() == 0


def test_packing(spark, docs):
    encode = Encoder(vocabulary()).whole.encode
    got = packing.packed(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    for doc, text in texts.items():
        ids = np.array([*encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == doc})
        assert pieces == [(k, at, len(ids[at:at + 2048]), zlib.crc32(ids[at:at + 2048].tobytes()))
                          for k, at in enumerate(range(0, len(ids), 2048))]
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for content in sequences.values():
        content.sort()
        assert content[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(content, content[1:]))
        assert sum(n for _, n in content) <= 2048
    assert packing.packed(docs.limit(0)).count() == 0


def test_sequences_hold_all_ids(spark, docs, tmp_path):
    """Each document's ids come back whole from the files; files hold ranges of sequences."""
    encode, folder = Encoder(vocabulary()).whole.encode, str(tmp_path / "sequences")
    got = packing.packed(docs, folder=folder).collect()
    rows = spark.read.parquet(folder).selectExpr("*", "_metadata.file_name AS file").collect()
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    found, spans = defaultdict(list), defaultdict(list)
    for r in rows:
        spans[r.file].append(r.sequence_id)
        assert len(r.ids) == sum(r.lengths) <= 2048
        at = 0
        for doc, piece, n in zip(r.doc_ids, r.pieces, r.lengths):
            found[doc].append((piece, r.sequence_id, at, r.ids[at:at + n]))
            at += n
    ends = sorted((min(x), max(x)) for x in spans.values())
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
    def key(x):
        return (x[0] is None, *x[1:]) if x[0] is None else x
    assert sorted(((d, *x) for d in found if d is not None for x in found[d]), key=key) == sorted(
        (r.doc_id, r.piece, r.sequence_id, r.offset, r.ids) for r in got if r.doc_id is not None)
    for d in docs.where("doc_id is not null").dropDuplicates(["doc_id"]).collect():
        whole = [*encode(d.text or "", add_special_tokens=False).ids, 0]
        once = {piece: ids for piece, _, _, ids in found[d.doc_id]}
        assert [i for piece in sorted(once) for i in once[piece]] == whole
    assert sum(map(len, found.values())) == len(got)


def optimum(lengths, capacity):
    """Fewest sequences, by search."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for r in {room for room in rooms if room >= lengths[i]}:
            k = rooms.index(r)
            place(i + 1, [*rooms[:k], r - lengths[i], *rooms[k + 1:]])
        place(i + 1, [*rooms, capacity - lengths[i]])
    place(0, [])
    return best[0]


def test_dominance_keeps_the_optimum():
    rng = random.Random(9)
    for _ in range(150):
        capacity = rng.choice([10, 20, 50])
        lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 10))]
        counts = np.bincount(lengths, minlength=capacity + 1)
        left = counts.copy()
        fixed = packing.dominant_sets(left, capacity)
        rest = [n for n in range(1, capacity + 1) for _ in range(left[n])]
        assert sum(t for t, _ in fixed) + (optimum(rest, capacity) if rest else 0) == optimum(lengths, capacity)
        rows = packing.plan(counts, capacity)
        assert set(rows[:, 0].tolist()) == set(lengths)


def test_archives(spark):
    big = "<p>" + "x" * 1200 + "</p>\r\n\r\nWARC/1.1\r\n\r\n é"
    rows = [(5, "http://www.a.example/x?b=1#f", big, "r"), (9, "https://a.example:443/X?b=1", big, "r"), (7, None, big, "r"),
            (1, "http://b.example/ a\n", "small", "r"), (2, "http://b.example/", "small", "r"), (3, "http://[bad", None, "r"),
            (4, "", "", "r"), (None, "http://c.example/", big, "r"), (9, "https://a.example/x", big, "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string").repartition(3)
    path = captures.write_archives(pages, records=2)
    got = captures.capture_index(spark, path).orderBy("capture_seq").collect()
    assert [r.capture_seq for r in got] == list(range(len(rows)))
    order = [(r.urlkey.encode(), r.captured, -1 if r.page_id is None else r.page_id) for r in got]
    assert order == sorted(order)
    html = {r[0]: (r[2] or "").encode() for r in rows}
    for r in got:
        assert r.payload_bytes == len(html[r.page_id]) and r.payload_digest == hashlib.sha1(html[r.page_id]).hexdigest()
        assert (r.record_type, r.refers_to) == (("revisit", 9) if html[r.page_id] == big.encode() and r.page_id != 9 else ("response", None))
    empty = captures.write_archives(pages.limit(0))
    assert captures.capture_index(spark, empty).count() == 0


def test_loser_tree():
    rng = random.Random(2)
    for k in range(0, 12):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(k)]
        assert list(captures.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def greedy(word, pieces):
    n = 0
    while word:
        size = next((k for k in range(min(len(word), 24), 0, -1) if word[:k] in pieces), 0)
        n += 1 if size else len(word[0].encode())
        word = word[max(size, 1):]
    return n


def test_piece_counts_against_greedy(spark, docs):
    rng = random.Random(3)
    for _ in range(60):
        pieces = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 25))}
        automaton = piece_counts.LongestMatch(pieces)
        for _ in range(60):
            word = "".join(rng.choice("abcdé") for _ in range(rng.randrange(0, 25)))
            assert automaton.count(word) == greedy(word, pieces), (word, pieces)
    from sentencepiece import SentencePieceProcessor
    import public_tokenizers
    model = SentencePieceProcessor(model_file=public_tokenizers.path(piece_counts.VOCABULARY))
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    texts = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id is not None}
    for r in piece_counts.token_counts(docs).collect():
        if r.doc_id is not None:
            words = re.findall(WORDS, texts[r.doc_id])
            assert (r.n_words, r.n_tokens) == (len(words), sum(greedy("▁" + w, pieces) for w in words))
    assert piece_counts.token_counts(docs.limit(0)).count() == 0


def test_pseudo_likelihood(spark, docs):
    """Word order that repeats is learnt: held-out texts in that order score above their shuffles and above the prior."""
    rng = random.Random(1)
    chain = [f"t{i}" for i in range(30)]

    def text():
        at, out = rng.randrange(30), []
        for _ in range(60):
            out.append(chain[at])
            at = (at + 1) % 30
        return out
    train = spark.createDataFrame([(i, " ".join(text())) for i in range(600)], "doc_id long, text string").repartition(2)
    vocab = lm_scoring.vocabulary(train)
    net = lm_scoring.trained(train, vocab)
    good, mixed, prior = 0.0, 0.0, 0.0
    for _ in range(20):
        words = text()
        classes, within = vocab(" ".join(words).encode())
        good += lm_scoring.score(net, classes, within)
        prior += within.sum() + vocab.prior[classes].sum()
        rng.shuffle(words)
        mixed += lm_scoring.score(net, *vocab(" ".join(words).encode()))
    assert good > prior + 100 and good > mixed + 100
    # against a loop over the positions
    classes, within = vocab("t1 t2 nothere t3 T4".encode())
    line, total = [0, 0, *classes.tolist(), 0, 0], float(within.sum())
    for i in range(len(classes)):
        around = [line[i], line[i + 1], line[i + 3], line[i + 4]]
        hidden = np.tanh(net.inner_bias + sum(net.inner[p][c] for p, c in enumerate(around)))
        z = hidden @ net.outer + net.bias
        total += z[classes[i]] - np.log(np.exp(z).sum())
    assert lm_scoring.score(net, classes, within) == pytest.approx(total, rel=1e-4)
    got = {r.doc_id: r for r in lm_scoring.pseudo_likelihood(docs).collect() if r.doc_id is not None}
    assert got[0].n_tokens == 0 and got[0].log_prob == 0 and got[0].mean_log_prob is None and got[8].n_tokens == 6000
    assert lm_scoring.pseudo_likelihood(docs.limit(0)).count() == 0


def test_every_word_has_its_count(spark, monkeypatch):
    """Of tail words of one length in the same place, one that occurs five times as often is five times as likely."""
    monkeypatch.setattr(lm_scoring, "VOCABULARY", 3)
    texts = ["the cat sat twiggy the cat", "the cat sat gibber the cat"] + ["the cat sat"] * 20 + ["twiggy", "twiggy twiggy", "twiggy", None]
    df = spark.createDataFrame([(i % 25, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in lm_scoring.pseudo_likelihood(df).collect() if r.doc_id != 0 or r.n_tokens}
    assert got[0].n_tokens == got[1].n_tokens == 6
    assert got[0].log_prob - got[1].log_prob == pytest.approx(np.log(5), rel=1e-9)
    counts = lm_scoring.word_counts(df)
    vocab = lm_scoring.vocabulary(df, counts)
    classes, within, rare = vocab.numbered(b"twiggy gibber")  # all words of their class
    assert len(rare) == 2 and classes[0] == classes[1]
    assert sum(np.exp(within + np.log([5, 1]))) == pytest.approx(1)


def test_pipeline(spark, docs, labels, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, str(tmp_path))
        assert name == "best_fit_packing" or df.columns == list(corpus_pipeline.COLUMNS)
        kept.append([r.doc_id for r in df.select("doc_id").collect()])
    assert set(kept[0]) == {4, 5, 6, 7, 8, 9, 10, 11, 12} and sorted(kept[1]) == [4, 8, 9, 10, 11, 12]
    assert sorted(kept[2]) == sorted(kept[1]) and max(Counter(kept[3]).values()) <= 2
    assert set(kept[4]) == set(kept[3])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept[4])
