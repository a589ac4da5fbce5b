"""Personal data in texts: patterns, and weakly supervised extra spans. DataFrame functions only.

Base spans come from four patterns (email, ip, card, phone). Candidates of further kinds (`EXTRA`) get the votes of
four labelers: the kind's own format test, a gazetteer of the words before it, the characters around it, and the
variety of its characters. Vote and feature patterns are counted over all documents; the counts (a few hundred rows
at most, whatever the input) go through expectation-maximisation, which estimates how reliable each labeler is, and
their posteriors train a naive Bayes span classifier. Its decision for each pattern goes back as a map literal.

Spans are kind, start and end in code points, end exclusive. Loops over groups are written as runs of one character
class (separators that belong to a run are marked first, with a character that the text itself cannot then hold), so
that Java's matcher needs no stack for long runs, and a match may only begin where a run does, so that it needs no
quadratic time.

Defined results: null and empty text have no spans (the digest of the empty string); repeated rows give repeated
results; a candidate that overlaps a base span or an earlier candidate is dropped. Empty tables give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import bind, running_sums, stored, table

BASE = ("email", "ip", "card", "phone")
EXTRA = ("iban", "local_phone", "national_id", "secret")
MARK, OTHER = "\ue000", "\ue001"
ROUNDS = 50
VOTES = ("format", "words", "around", "variety")
FEATURES = ("size", "digits")

# Words whose presence shortly before a candidate speaks for it, by kind, and words that speak against any of them.
GAZETTEER = {
    "iban": "iban|account|konto|compte|cuenta|bank|banque|banco",
    "local_phone": "phone|tel|telefon|call|fax|mobile|cell|handy",
    "national_id": "ssn|social|security|insurance|id",
    "secret": "token|secret|password|passwd|pwd|key|apikey|auth|bearer|credential|credentials",
}
AGAINST = "sha|sha1|sha256|md5|commit|hash|digest|checksum|isbn|version|order|invoice|uuid"


def located(text: Column, pattern: str) -> Column:
    """All matches of a pattern that never matches the empty string, with their places in code points."""
    def spans(pieces: Column, found: Column) -> Column:
        before = F.transform(F.slice(pieces, 1, F.size(found)), lambda p: F.length(p))
        sizes = F.transform(found, lambda m: F.length(m))
        starts = running_sums(F.zip_with(before, sizes, lambda p, m: p + m))
        return F.zip_with(F.zip_with(starts, before, lambda s, p: s + p), found,
                          lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("match")))

    return bind(F.split(text, pattern, -1),
                lambda pieces: bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                                    lambda found: spans(pieces, found)))


def _guarded(condition: Column, spans: Column) -> Column:
    return F.when(condition, spans).otherwise(F.array().cast("array<struct<start:int,end:int,match:string>>"))


def _clean(text: Column) -> Column:
    return F.translate(text, MARK, OTHER)


def emails(text: Column) -> Column:
    marked = F.regexp_replace(_clean(text), r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", MARK)
    local = f"A-Za-z0-9._%+{MARK}-"
    pattern = f"(?:\\G|(?<![{local}]))[{local}]++@[A-Za-z0-9-]++{MARK}[A-Za-z0-9{MARK}-]++"
    return _guarded(F.contains(text, F.lit("@")), bind(marked, lambda t: located(t, pattern)))


def ips(text: Column) -> Column:
    pattern = r"(?:\G|(?<![0-9]))[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
    def small(part: Column) -> Column:
        value = F.regexp_replace(part, "^0+(?=[0-9])", "")
        return (F.length(value) <= 3) & (value.cast("int") <= 255)

    return F.filter(_guarded(text.rlike(r"[0-9]\.[0-9]"), located(text, pattern)),
                    lambda s: F.forall(F.split(s["match"], r"\."), small))


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def cards(text: Column) -> Column:
    marked = F.regexp_replace(_clean(text), r"(?<=[0-9])[\x20-](?=[0-9])", MARK)
    found = _guarded(text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
                     bind(marked, lambda t: located(t, f"[0-9][0-9{MARK}]++")))
    return F.filter(found, lambda s: bind(
        F.translate(s["match"], MARK, ""),
        lambda d: F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False)))


def phones(text: Column) -> Column:
    found = _guarded(F.contains(text, F.lit("+")), located(text, r"\+[0-9][\x20().0-9-]+[0-9]"))
    return F.filter(found, lambda s: F.length(F.regexp_replace(s["match"], "[^0-9]", "")).between(8, 15))


CANDIDATES = {
    "iban": (r"[A-Z]{2}[0-9]{2}[A-Z0-9]{7}", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b"),
    "local_phone": (r"[0-9]{3}[\x20.-][0-9]{4}", r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])"),
    "national_id": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "secret": (r"[A-Za-z0-9+/_-]{20}", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?![A-Za-z0-9+/_-])"),
}


def _format(kind: str, match: Column) -> Column:
    """1 where the kind's own test passes, -1 where it fails, 0 where it can't tell."""
    if kind == "iban":
        turned = F.concat(F.substring(match, F.lit(5), F.length(match)), F.substring(match, 1, 4))
        numbers = F.regexp_replace(turned, "([A-Z])", "<$1>")
        for i in range(26):
            numbers = F.replace(numbers, F.lit(f"<{chr(65 + i)}>"), F.lit(str(10 + i)))
        rest = F.aggregate(F.split(numbers, ""), F.lit(0),
                           lambda a, d: F.when(d == "", a).otherwise((a * 10 + d.cast("int")) % 97))
        return F.when(rest == 1, 1).otherwise(-1)
    if kind == "national_id":
        bad = match.rlike(r"^(?:000|666|9)") | match.rlike(r"-00-") | match.rlike(r"-0000$")
        return F.when(bad, -1).otherwise(1)
    if kind == "local_phone":
        return F.when(match.rlike(r"^\(?[01]"), 0).otherwise(1)
    both = match.rlike("[0-9]") & match.rlike("[A-Za-z]")
    return F.when(~both, -1).when(F.length(match) >= 32, 1).otherwise(0)


def _votes(kind: str, text: Column, span: Column) -> Column:
    before = F.lower(F.substring(text, F.greatest(F.lit(1), span["start"] - 31),
                                 F.least(F.lit(32), span["start"])))
    after = F.substring(text, span["end"] + 1, F.lit(1))
    match = span["match"]
    words = F.when(before.rlike(rf"\b(?:{AGAINST})\b\W*$"), -1).when(
        before.rlike(rf"(?:\b|_)(?:{GAZETTEER[kind]})\b"), 1).otherwise(0)
    around = F.when(before.rlike(r"[=:\"'`]\s*$") | after.isin('"', "'", "`"), 1).when(
        before.rlike(r"[/.\\@#]$") | after.isin("/", ".", "@"), -1).otherwise(0)
    kinds = F.size(F.array_distinct(F.split(match, "")))
    variety = F.when(kinds >= 8, 1).when(kinds <= 4, -1).otherwise(0)
    digits = F.length(F.regexp_replace(match, "[^0-9]", ""))
    return F.struct(F.lit(kind).alias("kind"), span["start"].alias("start"), span["end"].alias("end"),
                    F.concat_ws("|", F.lit(kind), _format(kind, match), words, around, variety,
                                F.least(F.lit(4), F.floor(F.length(match) / 10)),
                                F.floor(4 * digits / F.length(match))).alias("pattern"))


def _apart(span: Column, others: Column) -> Column:
    return ~F.exists(others, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))


def _named(kind: str) -> Column:
    return F.transform(f"__{kind}", lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"),
                                                       s["end"].alias("end")))


def _voted(kind: str, text: Column, spans: Column) -> Column:
    return F.transform(spans, lambda s: _votes(kind, text, s))


def number_of(kind: str) -> Column:
    return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `base_spans` (kind, start, end by kind as listed, then start) and `weak_spans` (with their vote
    pattern). Store what is needed of it before train(), so that every text is searched once."""
    value = F.coalesce(F.col(text), F.lit(""))
    finders = (emails(value), ips(value), cards(value), phones(value))
    out = docs.withColumns({f"__{kind}": spans for kind, spans in zip(BASE, finders)})
    out = out.withColumn("base_spans", F.flatten(F.array(*[_named(kind) for kind in BASE])))
    found = []
    for kind, (quick, pattern) in CANDIDATES.items():
        spans = _guarded(value.rlike(quick), located(value, pattern))
        free = F.filter(spans, lambda s: _apart(s, F.col("base_spans")))
        found.append(_voted(kind, value, free))
    out = out.withColumn("__weak", F.concat(*found))  # of overlapping candidates the first kind listed stays
    out = out.withColumn("weak_spans", F.filter("__weak", lambda s: _apart(
        s, F.filter("__weak", lambda o: o["kind"] < s["kind"]))))
    return out.drop("__weak", *[f"__{kind}" for kind in BASE])


def _expectation_maximisation(rows: list[tuple[tuple[str, ...], int]]) -> list[float]:
    """Posterior of each pattern (kind, votes...) being personal data; votes are independent given the truth."""
    prior = {key[0]: 0.5 for key, _ in rows}
    start = {"1": (0.7, 0.2), "0": (0.25, 0.4), "-1": (0.05, 0.4)}
    chance = [{vote: list(p) for vote, p in start.items()} for _ in VOTES]
    posterior: list[float] = []
    for _ in range(ROUNDS):
        posterior = []
        for key, _n in rows:
            odds = math.log(prior[key[0]] / (1 - prior[key[0]]))
            odds += sum(math.log(c[v][0] / c[v][1]) for c, v in zip(chance, key[1:]))
            posterior.append(1 / (1 + math.exp(-max(-500.0, min(500.0, odds)))))
        for kind in prior:
            total = sum(n for key, n in rows if key[0] == kind)
            prior[kind] = (1 + sum(p * n for p, (key, n) in zip(posterior, rows) if key[0] == kind)) / (2 + total)
        for j, table_ in enumerate(chance):
            for vote in table_:
                for side in (0, 1):
                    weights = [(p if side == 0 else 1 - p) * n for p, (_, n) in zip(posterior, rows)]
                    own = sum(w for w, (key, _) in zip(weights, rows) if key[1 + j] == vote)
                    # the start counts as 20 spans, which keeps "true" the side that labelers vote for
                    table_[vote][side] = (own + 20 * start[vote][side]) / (sum(weights) + 20)
    return posterior


def train(spans: DataFrame) -> dict[str, float]:
    """Probability of each pattern that occurs in `weak_spans`, by the naive Bayes classifier."""
    counts = spans.select(F.explode("weak_spans.pattern").alias("pattern")).groupBy("pattern").count().collect()
    rows = sorted((tuple(r["pattern"].split("|")), r["count"]) for r in counts)
    voted: dict[tuple[str, ...], int] = {}
    for key, n in rows:
        voted[key[:1 + len(VOTES)]] = voted.get(key[:1 + len(VOTES)], 0) + n
    truth = dict(zip(voted, _expectation_maximisation(list(voted.items()))))
    sides = [0.0, 0.0]
    likely: dict[tuple[int, str], list[float]] = {}
    for key, n in rows:
        p = truth[key[:1 + len(VOTES)]]
        for side, weight in enumerate((p * n, (1 - p) * n)):
            sides[side] += weight
            for j, part in enumerate(key):
                likely.setdefault((j, part), [1.0, 1.0])[side] += weight
    out = {}
    for key, _ in rows:
        odds = math.log((sides[0] + 1) / (sides[1] + 1))
        odds += sum(math.log((likely[j, part][0] / (sides[0] + 2)) / (likely[j, part][1] / (sides[1] + 2)))
                    for j, part in enumerate(key))
        out["|".join(key)] = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
    return out


def all_spans(spans: DataFrame) -> DataFrame:
    """`spans` of with_spans() with `found`: base spans, then the candidates the classifier takes, by kind and start."""
    taken = sorted(p for p, chance in train(spans).items() if chance >= 0.5)
    accepted = F.filter("weak_spans", lambda s: s["pattern"].isin(taken)) if taken else F.slice("weak_spans", 1, 0)
    extra = F.transform(F.array_sort(F.transform(accepted, lambda s: F.struct(s["kind"], s["start"], s["end"]))),
                        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return spans.withColumn("found", F.concat("base_spans", extra)).drop("weak_spans")


def text_of(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(docs: DataFrame) -> DataFrame:
    """docs with every span of `text` replaced by its kind in angle brackets (overlapping spans: by the first one's),
    and n_chars counted anew where the text changed."""
    spans = all_spans(stored(with_spans(docs), "spans"))
    def cover(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        return F.when((F.size(done) > 0) & (s["start"] < F.coalesce(F.try_element_at(done, F.lit(-1))["end"], F.lit(0))),
                      F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(
                          F.concat(done, F.array(s)))

    ordered = F.array_sort(F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    kind = "array<struct<start:int,end:int,kind:string>>"
    merged = F.aggregate(ordered, F.array().cast(kind), cover)
    out = spans.withColumn("__merged", merged)
    gaps = F.transform("__merged", lambda s, i: F.concat(
        F.substring("text", F.when(i == 0, 1).otherwise(F.element_at("__merged", F.greatest(i, F.lit(1)))["end"] + 1),
                    s["start"] - F.when(i == 0, 0).otherwise(F.element_at("__merged", F.greatest(i, F.lit(1)))["end"])),
        F.lit("<"), F.upper(s["kind"]), F.lit(">")))
    text = F.concat(F.array_join(gaps, ""), F.substring("text", F.element_at("__merged", -1)["end"] + 1, F.length("text")))
    text = F.when(F.size("__merged") > 0, text).otherwise(F.col("text"))
    return (out.withColumn("__text", text)
            .withColumn("n_chars", F.when(F.size("__merged") > 0, F.length("__text")).otherwise(F.col("n_chars")).cast("long"))
            .withColumn("text", F.col("__text")).select(*docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of personal data of every document."""
    found = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = all_spans(stored(found.select("doc_id", "base_spans", "weak_spans"), "spans"))
    counts = [number_of(kind) for kind in BASE]
    return spans.select("doc_id", *counts, F.sha2(text_of(F.col("base_spans")), 256).alias("base_sha256"),
                        text_of(F.col("found")).alias("spans"))
