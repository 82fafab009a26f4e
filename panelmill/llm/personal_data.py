"""Personal data: fixed base patterns, and further spans by weak supervision. Native DataFrame code only."""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.llm.common import table
from panelmill.llm.registry import query

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 50
ACCEPT = 0.95  # probability from which the span classifier adds a span

#: The base patterns, written so that each text is read once: runs are possessive, and a match starts
#: at the start of its run or where the last one ended, which is where the leftmost match starts too.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What the labelers look at besides: written-out addresses, IPv6, dotted card numbers, national phone numbers.
CANDIDATES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:@|\x20?(?:\(at\)|\[at\])\x20?)[A-Za-z0-9-]++"
             r"(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}(?![0-9.])|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:]))",
    "card": r"(?<![0-9])(?<![0-9][\x20.-])[0-9](?:[\x20.-]?[0-9]){11,18}+(?![\x20.-]?[0-9])",
    "phone": r"(?:\+[0-9][\x20().0-9-]{6,20}[0-9]|(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4})(?![0-9.-])",
}
#: A text without this has no candidate of the kind.
GATES = {"email": r"@|[(\[]at[)\]]", "ip": r"[0-9]\.[0-9]|:[0-9A-Fa-f]{1,4}:", "card": "[0-9]", "phone": "[0-9]"}
SPEAKS_FOR = {
    "email": "mail|contact|kontakt|correo|courriel|write to|reach", "ip": r"\bip\b|address|host|server|adresse|dirección",
    "card": "card|visa|master|credit|debit|karte|carte|tarjeta", "phone": "phone|tel|call|fax|mobile|whatsapp|ruf|móvil",
}
SPEAKS_AGAINST = r"version|isbn|issn|order|invoice|serial|\bid\b|\bno\.|section|chapter|\bv\.?$"

_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
_FOUND = "array<struct<start:bigint,end:bigint,m:string,before:string,after:string>>"


def _occurrences(text: Column, pattern: str, gate: str) -> Column:
    """All matches with their places in code points and what stands beside them."""
    hit = F.when(text.rlike(gate), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    gaps = F.split(text, pattern, -1)
    # the matches and the gaps between them alternate
    around = F.transform(hit, lambda m, i: F.struct(
        m.alias("m"), F.length(F.get(gaps, i)).cast("long").alias("gap"), F.right(F.get(gaps, i), F.lit(24)).alias("before"),
        F.left(F.get(gaps, i + 1), F.lit(8)).alias("after")))
    placed = F.aggregate(
        around, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_FOUND).alias("out")),
        lambda s, x: F.struct(
            (s["at"] + x["gap"] + F.length(x["m"])).alias("at"),
            F.concat(s["out"], F.array(F.struct(
                (s["at"] + x["gap"]).alias("start"), (s["at"] + x["gap"] + F.length(x["m"])).alias("end"),
                x["m"].alias("m"), x["before"].alias("before"), x["after"].alias("after")))).alias("out")),
        lambda s: s["out"])
    return F.when(F.size(hit) > 0, placed).otherwise(F.array().cast(_FOUND))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits of a string pass the Luhn check."""
    digits = F.reverse(_digits(m))
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(digits))), F.lit(0),
        lambda s, i: s + F.instr(F.when(i % 2 == 1, F.lit("0123456789")).otherwise(F.lit("0516273849")),
                                 F.substring(digits, i, F.lit(1))) - 1)
    return (F.length(digits) > 0) & (total % 10 == 0)


def _passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return luhn(m)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """The spans of the fixed patterns as an array of (start, kind number, end), in order."""
    def of(kind):
        good = F.filter(_occurrences(text, BASE[kind], GATES[kind]), lambda x: _passes(kind, x["m"]))
        return F.transform(good, lambda x: F.struct(
            x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")))
    return F.array_sort(F.concat(*map(of, KINDS)))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _described(kind: str, x: Column) -> Column:
    """A candidate with the votes of the four labelers and the features of the span classifier."""
    m, before, after = x["m"], F.lower(x["before"]), x["after"]
    n = F.length(_digits(m))
    form = {"email": _vote(m.rlike(r"^[^@ ]+@[^@ ]+\.[A-Za-z]{2,}$"), m.rlike(r"\.[0-9]+$|^[.%+-]")),
            "ip": _vote(m.rlike(r"^[0-9.]+$"), F.lit(False)),
            "card": _vote(m.rlike(r"^[0-9]{12,19}$|^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$"), m.rlike(r"\.")),
            "phone": _vote(m.startswith("+"), F.lit(False))}[kind]
    sound = {"email": _vote(m.rlike(r"[A-Za-z]{2,}$"), m.rlike(r"[0-9-]$")),
             "ip": _vote(_passes("ip", m) & m.rlike("[0-9]{2}") | m.contains(":") & m.rlike("[0-9]") & m.rlike("[A-Fa-f]"), ~m.contains(":")),
             "card": _vote(luhn(m) & ~m.rlike(r"^0|^(.)\1*$"), F.lit(True)),
             "phone": _vote(n.between(9, 15), F.lit(True))}[kind]
    gazetteer = _vote(before.rlike(SPEAKS_FOR[kind]), before.rlike(SPEAKS_AGAINST))
    context = _vote(before.rlike(r"(^|[\s(\[<:;,])$") & after.rlike(r"^($|[\s)\]>:;,.!?])"),
                    before.rlike(r"[\p{L}\p{N}_/=#-]$") | after.rlike(r"^[\p{L}\p{N}_/=#-]"))
    features = F.array(
        F.concat(F.lit("digits:"), F.least(n, F.lit(20)).cast("string")), F.concat(F.lit("sound:"), sound.cast("string")),
        F.concat(F.lit("marks:"), F.least(F.lit(4), F.length(F.regexp_replace(m, "[A-Za-z0-9]", ""))).cast("string")),
        F.concat(F.lit("form:"), form.cast("string")), F.concat(F.lit("word:"), gazetteer.cast("string")),
        F.concat(F.lit("sides:"), context.cast("string")))
    return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"),
                    F.array(form, sound, gazetteer, context).alias("votes"), features.alias("features"))


def candidates(text: Column) -> Column:
    def of(kind):
        return F.transform(_occurrences(text, CANDIDATES[kind], GATES[kind]), lambda x: _described(kind, x))
    return F.concat(*map(of, KINDS))


def reliabilities(tally: dict[tuple[int, ...], int]) -> dict[tuple[int, ...], float]:
    """The probability that a span with these votes is personal data, by expectation-maximisation.

    Labelers vote 1, -1 or 0 (no opinion), independently given the truth; their confusion
    tables and the share of true spans are estimated from how often each vote pattern occurs.
    It starts from labelers that are right four times in five. All sums run over vote patterns.
    """
    if not tally:
        return {}
    n = len(next(iter(tally)))
    share = 0.5
    table_ = [{y: {v: 0.6 if v == y else 0.15 if v == -y else 0.25 for v in (1, -1, 0)} for y in (1, -1)} for _ in range(n)]
    truth: dict[tuple[int, ...], float] = {}
    for _ in range(ROUNDS):
        for votes in tally:
            yes = math.log(share) + sum(math.log(table_[j][1][v]) for j, v in enumerate(votes))
            no = math.log(1 - share) + sum(math.log(table_[j][-1][v]) for j, v in enumerate(votes))
            truth[votes] = 1 / (1 + math.exp(min(700.0, no - yes)))
        total = sum(tally.values())
        positive = sum(c * truth[v] for v, c in tally.items())
        share = (positive + 1) / (total + 2)
        for j in range(n):
            for v in (1, -1, 0):
                here = [(c, truth[votes]) for votes, c in tally.items() if votes[j] == v]
                table_[j][1][v] = (sum(c * t for c, t in here) + 1) / (positive + 3)
                table_[j][-1][v] = (sum(c * (1 - t) for c, t in here) + 1) / (total - positive + 3)
    return truth


def span_classifier(docs: DataFrame) -> dict[str, float]:
    """Log-odds of each `kind|feature`, and of each `kind|`, from all candidate spans of the corpus.

    The spans are counted by kind, votes and features, which have few values by design, so
    the table that EM and the classifier work on does not grow with the corpus.
    """
    counted = docs.select(F.explode(candidates(F.col("text"))).alias("c")).groupBy("c.kind", "c.votes", "c.features").agg(
        F.count("*").alias("n")).collect()
    weights: dict[str, float] = {}
    for kind in KINDS:
        rows = [(tuple(r.votes), r.features, r.n) for r in counted if r.kind == kind]
        tally: dict[tuple[int, ...], int] = defaultdict(int)
        for votes, _, n in rows:
            tally[votes] += n
        truth = reliabilities(tally)
        yes, no = sum(truth[v] * n for v, _, n in rows), sum((1 - truth[v]) * n for v, _, n in rows)
        weights[f"{kind}|"] = math.log((yes + 1) / (no + 1))
        split: dict[str, list[float]] = defaultdict(lambda: [0.5, 0.5])
        for votes, features, n in rows:
            for f in features:
                split[f][0] += truth[votes] * n
                split[f][1] += (1 - truth[votes]) * n
        for f, (a, b) in split.items():
            weights[f"{kind}|{f}"] = math.log(a / (yes + 1)) - math.log(b / (no + 1))
    return weights


def added_spans(text: Column, base: Column, weights: dict[str, float]) -> Column:
    """Candidates that the classifier accepts, no labeler of soundness rejects, and no base span overlaps."""
    odds = F.create_map(*(F.lit(x) for pair in sorted(weights.items()) for x in pair))

    def score(c):
        return F.aggregate(c["features"], F.coalesce(F.try_element_at(odds, F.concat(c["kind"], F.lit("|"))), F.lit(-9.0)),
                           lambda s, f: s + F.coalesce(F.try_element_at(odds, F.concat(c["kind"], F.lit("|"), f)), F.lit(0.0)))
    good = F.filter(candidates(text), lambda c: (F.element_at(c["votes"], 2) >= 0)
                    & (score(c) >= math.log(ACCEPT / (1 - ACCEPT)))
                    & ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    number = F.create_map(*(F.lit(x) for k, kind in enumerate(KINDS) for x in (kind, k)))
    return F.transform(good, lambda c: F.struct(c["start"].alias("start"), F.element_at(number, c["kind"]).alias("kind"),
                                                c["end"].alias("end")))


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_spans(docs: DataFrame) -> DataFrame:
    """`docs` with `base` and `spans`: arrays of (start, kind number, end) in code points, in order.

    One pass over the corpus counts the candidate spans and trains the classifier; another
    finds the spans of each row within the row. A null or empty text has none. No row is
    dropped or merged.
    """
    weights = span_classifier(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumn("base", base_spans(text))
    return df.withColumn("spans", F.array_sort(F.concat("base", added_spans(text, F.col("base"), weights))))


def personal_data(docs: DataFrame) -> DataFrame:
    """Digest per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = find_spans(docs.select("doc_id", "text"))

    def count(k):
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    counts = map(count, range(len(KINDS)))
    return found.select("doc_id", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
                        _written(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """`docs` with every span in `text` replaced by its kind in brackets, and `n_chars` to match.

    Overlapping spans are replaced together, under the kind of the first. A null text stays null.
    """
    found = find_spans(docs)
    tags = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    out = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda s, x: F.struct(
            F.greatest(s["at"], x["end"]).alias("at"),
            F.when(x["start"] >= s["at"], F.concat(s["out"], F.array(
                F.substring(F.col("text"), s["at"].cast("int") + 1, (x["start"] - s["at"]).cast("int")),
                F.get(tags, x["kind"])))).otherwise(s["out"]).alias("out")),
        lambda s: F.concat(F.array_join(s["out"], ""), F.substring(
            F.col("text"), s["at"].cast("int") + 1, F.length(F.col("text")))))
    text = F.when(F.size("spans") > 0, out).otherwise(F.col("text"))
    return (found.withColumn("text", text).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
            .select(*docs.columns))


@query("op9_personal_data")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return personal_data(table(spark, sf, "documents"))
