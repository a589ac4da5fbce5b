"""Secrets in texts, found by a trigram inverted index. DataFrame functions only on the data's path.

Every rule is a regular expression. From its syntax tree a Boolean query of trigrams is derived (`trigram_query`): an OR
of clauses, each an AND of trigrams that every match must hold. An inverted index holds, for the trigrams that the
rules name, which documents contain them (texts are lower-cased for it, which only adds candidates). Postings are
intersected per clause; documents that meet a clause of a rule are its candidates and only these are searched for
it. A rule without mandatory trigrams scans every text while the index is built.

Spans are kind, start and end in code points, end exclusive, by start, then kind in the order of the rules. A rule can
ask for a least length of a group; matches that fail it are dropped and not retried. Matches of one kind don't overlap;
spans of two kinds may.

Postings are keyed by a 64-bit hash of id and text. Two rows that share it (repeated rows, or by chance) share
candidates, which cannot change a result, as every candidate row is searched itself.

Defined results: null and empty texts have no spans (the digest of the empty string); null ids and repeated rows give a
row each; equal starts go by the order of the rules; very long texts are searched whole, in linear time (patterns begin
at fixed letters or at the start of a run, and runs are one character class). Only doc_id and text are read, so other
columns can have any name. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from re import _parser as syntax

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import bind, stored, table
from lectern.llm.pii import located

MOST_CLAUSES = 64  # of a query; parts that would go beyond are left out of it, which only adds candidates
MOST_TEXTS = 32  # alternatives of a piece that are followed letter by letter


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` (read alike by Python and Java) whose group `group` has `least` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base kinds. Runs that are too short to pass are left to the pattern where that changes nothing.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Published formats of further secrets.
FORMATS = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("forge_token", r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("payment_key", r"(?<![A-Za-z0-9_])[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Rule("bearer", r"(?i)\bbearer\x20+[A-Za-z0-9._~+/=-]{16,}"),
    Rule("url_login", r"://[^\s/:@]++:[^\s/:@]++@"),
)
RULES = BASE + FORMATS

Query = list[frozenset[str]]  # OR of ANDs of trigrams; the empty AND is always true
ALWAYS: Query = [frozenset()]


def _least(clauses: Iterable[frozenset[str]]) -> Query:
    """The clauses without those that another one implies."""
    out: Query = []
    for clause in sorted(set(clauses), key=lambda c: (len(c), sorted(c))):
        if not any(kept <= clause for kept in out):
            out.append(clause)
    return out


def _both(left: Query, right: Query) -> Query:
    if len(left) * len(right) > MOST_CLAUSES:
        return max(left, right, key=lambda q: min(map(len, q)))
    return _least(x | y for x in left for y in right)


def _of_texts(texts: set[str]) -> Query:
    """Every match holds one of the texts, letter by letter."""
    return _least(frozenset(t[i:i + 3] for i in range(len(t) - 2)) for t in texts)


def _analysed(nodes: Iterable) -> tuple[set[str] | None, Query]:
    """The texts a sequence can match (None: too many to list), and the trigrams besides these that a match must hold."""
    texts: set[str] | None = {""}
    query, listed = ALWAYS, True
    for node in nodes:
        piece, needs = _one(str(node[0]), node[1])
        query = _both(query, needs)
        if piece is not None and texts is not None and len(texts) * len(piece) <= MOST_TEXTS:
            texts = {t + p for t in texts for p in piece}
            continue
        listed = False
        query = _both(query, _of_texts(texts)) if texts is not None else query
        texts = piece if piece is not None and len(piece) <= MOST_TEXTS else {""}
    if listed:
        return texts, query
    return None, _both(query, _of_texts(texts))


def _one(kind: str, value) -> tuple[set[str] | None, Query]:
    if kind == "LITERAL":
        return {chr(value).lower()}, ALWAYS
    if kind == "IN":
        letters = {chr(v).lower() for k, v in value if str(k) == "LITERAL"}
        return (letters, ALWAYS) if all(str(k) == "LITERAL" for k, _ in value) else (None, ALWAYS)
    if kind == "SUBPATTERN":
        return _analysed(value[-1])
    if kind == "ATOMIC_GROUP":
        return _analysed(value)
    if kind == "BRANCH":
        parts = [_analysed(branch) for branch in value[1]]
        if all(texts is not None for texts, _ in parts):
            texts = set().union(*(t for t, _ in parts))
            if len(texts) <= MOST_TEXTS and all(query == ALWAYS for _, query in parts):
                return texts, ALWAYS
        query = _least(c for texts, needs in parts for c in (_both(needs, _of_texts(texts)) if texts is not None else needs))
        return None, query if len(query) <= MOST_CLAUSES else ALWAYS
    if kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        low, high, part = value
        texts, needs = _analysed(part)
        if low == 0:
            return (texts | {""} if high == 1 and texts is not None and needs == ALWAYS else None), ALWAYS
        if low == high == 1:
            return texts, needs
        return None, _both(needs, _of_texts(texts)) if texts is not None else needs
    if kind in ("AT", "ASSERT", "ASSERT_NOT"):
        return {""}, ALWAYS
    return None, ALWAYS  # any other piece says nothing about letters


def trigram_query(pattern: str) -> Query:
    """Clauses of lower-cased trigrams, one of which every match of the pattern holds; ALWAYS if none are mandatory."""
    texts, query = _analysed(syntax.parse(pattern))
    query = _both(query, _of_texts(texts)) if texts is not None else query
    return ALWAYS if frozenset() in query else query


def spans_of(rule: Rule, text: Column) -> Column:
    """Spans (start, kind number is added by the caller, end) of a rule in a text."""
    found = located(text, rule.pattern)
    if rule.least:
        found = F.filter(found, lambda s: F.length(F.regexp_extract(s["match"], rule.pattern, rule.group)) >= rule.least)
    return found


EMPTY = "array<struct<start:int,rule:int,end:int>>"


def _numbered(number: int, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("rule"), s["end"].alias("end")))


def _key() -> Column:
    return F.xxhash64("doc_id", "text")


def indexed(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row a document: key, doc_id, the rules' trigrams that it holds, and the spans of rules without trigrams."""
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted(set().union(*(c for q in queries for c in q)))
    full = [(n, r) for n, (r, q) in enumerate(zip(rules, queries)) if q == ALWAYS]
    text = F.coalesce("text", F.lit(""))
    held = bind(F.lower(text), lambda low: F.filter(F.array(*map(F.lit, grams)).cast("array<string>"),
                                                    lambda g: F.contains(low, g)))
    scanned = F.concat(*[_numbered(n, spans_of(r, text)) for n, r in full]) if full else F.array()
    return docs.select(_key().alias("key"), "doc_id", held.alias("grams"), scanned.cast(EMPTY).alias("scanned"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """key and `rules`, the numbers of the rules whose trigrams a document holds: intersected postings."""
    bits = [F.struct(F.lit(g).alias("gram"), F.lit(n).alias("rule"), F.lit(c).alias("clause"), F.lit(1 << i).alias("bit"),
                     F.lit((1 << len(clause)) - 1).alias("all"))
            for n, r in enumerate(rules) if (query := trigram_query(r.pattern)) != ALWAYS
            for c, clause in enumerate(query) for i, g in enumerate(sorted(clause))]
    if not bits:
        return index.select("key", F.array().cast("array<int>").alias("rules")).limit(0)
    clauses = index.sparkSession.range(1).select(F.inline(F.array(*bits)))  # as many rows as the rules have trigrams
    postings = index.select("key", F.explode("grams").alias("gram"))
    met = (postings.join(F.broadcast(clauses), "gram").groupBy("key", "rule", "clause", "all")
           .agg(F.bit_or("bit").alias("held")).where("held = all"))
    return met.groupBy("key").agg(F.collect_set("rule").alias("rules"))


def found(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and `spans` (start, rule, end) of every row, by start, then rule."""
    index = stored(indexed(docs, rules), "trigrams")
    hits = stored(candidates(index, rules), "candidates")
    searched = [(n, r) for n, r in enumerate(rules) if trigram_query(r.pattern) != ALWAYS]
    asked = docs.select(_key().alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text")).join(hits, "key")
    scanned = [(n, r) for n, r in enumerate(rules) if (n, r) not in searched]
    parts = [F.when(F.array_contains("rules", n), _numbered(n, spans_of(r, F.col("text")))).otherwise(F.array().cast(EMPTY))
             for n, r in searched] + [_numbered(n, spans_of(r, F.col("text"))) for n, r in scanned]
    parts = parts or [F.array().cast(EMPTY)]
    return asked.select("doc_id", F.array_sort(F.concat(*parts).cast(EMPTY)).alias("spans")).union(
        index.join(hits, "key", "left_anti").select("doc_id", F.array_sort("scanned")))


def number_of(rule: int) -> Column:
    return F.size(F.filter("spans", lambda s: s["rule"] == rule))


def text_of(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["rule"]], s["start"], s["end"])), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of secrets of every document."""
    rows = found(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [number_of(n).cast("long").alias(f"n_{r.kind}") for n, r in enumerate(BASE)]
    base = F.filter("spans", lambda s: s["rule"] < len(BASE))
    return rows.select("doc_id", *counts, F.sha2(text_of(base, RULES), 256).alias("base_sha256"),
                       text_of(F.col("spans"), RULES).alias("spans"))
