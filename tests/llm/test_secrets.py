from __future__ import annotations

import hashlib
import random
import re

from lectern.llm import secrets

#: The contract's own patterns and tests, searched over whole texts.
PATTERNS = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A,
               lambda m: len(m.group(2)) >= 6),
    "access": (r"AKIA[A-Z0-9]+", 0, lambda m: len(m.group()) >= 20),
    "hex": (r"[0-9a-f]+", 0, lambda m: len(m.group()) >= 24),
}


def base(text):
    order = list(PATTERNS)
    found = sorted((m.start(), order.index(kind), m.end()) for kind, (p, flags, fits) in PATTERNS.items()
                   for m in re.finditer(p, text or "", flags) if fits(m))
    return [f"{order[k]}:{s}:{e}" for s, k, e in found]


def full(text):
    """All rules by a plain scan of the whole text."""
    out = [(m.start(), n, m.end()) for n, r in enumerate(secrets.RULES)
           for m in re.finditer(r.pattern, text or "", re.A) if len(m.group(r.group)) >= r.least]
    return [f"{secrets.RULES[n].kind}:{s}:{e}" for s, n, e in sorted(out)]


SAMPLES = [
    "password: hunter22", "PassWord='abc", "token==abcdef", "api_key = \"ABC/def+12\"", "apikey:xyzxyz token=short secret = longenough",
    "🙂 secret: 'abcdef' é", "AKIA" + "A1" * 8, "AKIA" + "A1" * 7 + "A", "xAKIAAKIA" + "B" * 16, "a" * 23, "b" * 24, "0f" * 40 + "g",
    "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "ghp_" + "a1" * 18, "xoxb-1234567890-abc", "AIza" + "Q" * 35,
    "sk_live_" + "1" * 16, "rk_test_" + "9z" * 9, "eyJhbGciOiJI.eyJzdWIiOiIx.abcdefgh12", "Authorization: Bearer abcdefghijklmnopqrst",
    "https://user:pass@host.org/x", "http://host:80/a@b", "token token: : abcdef", "tokenpassword=abcdef.abcdef", "passwd \t= abcdef",
    "ſecret: abcdefg toKen: abcdefg", "İ password=abcdef12 secret:deadbeefdeadbeefdeadbeef0", "secret:" + " " * 50 + "abcdef", "key", "",
]


def rows_of(docs):
    return secrets.found(docs).select("doc_id", secrets.text_of(secrets.F.col("spans"), secrets.RULES).alias("s")).collect()


def test_equal_to_a_plain_scan(documents):
    rng = random.Random(11)
    parts = SAMPLES + ["tok", "en", "=", ":", " ", '"', "'", "a", "AKIA", "ghp_", "0", "://", "@", "é", "🙂", "\n", "pass", "word"]
    texts = SAMPLES + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    found = {r["doc_id"]: r["s"] for r in rows_of(documents(list(enumerate(texts))))}
    for i, text in enumerate(texts):
        assert found[i] == ",".join(full(text)), text
        kept = [s for s in found[i].split(",") if s.split(":")[0] in PATTERNS]
        assert kept == base(text), text


def test_trigram_queries():
    query = secrets.trigram_query
    assert query("AKIA[A-Z0-9]+") == [frozenset({"aki", "kia"})]
    assert query("[0-9a-f]{24,}") == secrets.ALWAYS and query("ab?c") == secrets.ALWAYS and query("a.cde?") == secrets.ALWAYS
    assert set(query("(?:abc|xyzw)+d")) == {frozenset({"abc"}), frozenset({"xyz", "yzw"})}
    assert set(query("api_?key")) == {frozenset({"api", "pik", "ike", "key"}), frozenset({"api", "pi_", "i_k", "_ke", "key"})}
    assert query("x(?:abc)*yzzz") == [frozenset({"yzz", "zzz"})]
    assert query("(?:abc|.)def") == [frozenset({"def"})]
    assert query("[ab]cd") and set(query("[ab]cd")) == {frozenset({"acd"}), frozenset({"bcd"})}


def test_every_match_meets_its_query():
    """What the index may skip: a text with a match holds all trigrams of a clause."""
    for text in SAMPLES:
        low = text.lower()
        for rule in secrets.RULES:
            if re.search(rule.pattern, text, re.A):
                assert any(all(g in low for g in clause) for clause in secrets.trigram_query(rule.pattern)), (rule.kind, text)


def test_only_candidates_are_searched(documents):
    docs = documents([(1, "password: hunter22"), (2, "no such thing"), (3, "pass the word as token")])
    hits = {r["key"]: r["rules"] for r in secrets.candidates(secrets.indexed(docs)).collect()}
    keys = {r["doc_id"]: r["key"] for r in secrets.indexed(docs).collect()}
    assert hits[keys[1]] == [0] and keys[2] not in hits and hits[keys[3]] == [0]


def test_query_and_odd_rows(spark, documents, odd_documents, tmp_path):
    rows = [(1, SAMPLES[26]), (2, None), (None, "token: abcdefgh"), (4, "token: abcdefgh"), (4, "token: abcdefgh"), (5, "")]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = secrets.query(spark, str(tmp_path)).collect()
    assert len(found) == 6 and sum(r["n_assign"] for r in found) == 4
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and by_id[2]["spans"] == ""
    assert by_id[1]["base_sha256"] == hashlib.sha256(",".join(base(SAMPLES[26])).encode()).hexdigest()
    mixed = "hex " + "0f" * 12 + " AKIA" + "A1" * 8 + " token=abcdef " + "ab" * 20 + " secret: abcdefg AKIA" + "B2" * 8
    documents([(1, mixed)]).write.parquet(f"{tmp_path}/more/documents.parquet")
    one = secrets.query(spark, f"{tmp_path}/more").first()
    assert [one["n_assign"], one["n_access"], one["n_hex"]] == [sum(s.startswith(k) for s in base(mixed)) for k in PATTERNS] == [2, 2, 2]
    names = {n: secrets.F.lit("x") for n in ("key", "grams", "rules", "spans", "scanned", "gram", "rule")}
    assert len(rows_of(odd_documents.withColumns(names))) == 11 and not rows_of(odd_documents.limit(0))


def test_long_runs_need_neither_stack_nor_quadratic_time(documents):
    texts = ["token" + " " * 300_000, "0f" * 200_000, "eyJ" * 150_000 + ".", "://" + "a" * 300_000, "://a:" * 60_000,
             "AKIA" * 80_000, "password=" + "a" * 300_000, "-----BEGIN " + "A " * 100_000, "bearer " * 60_000]
    found = {r["doc_id"]: r["s"] for r in rows_of(documents(list(enumerate(texts))))}
    assert found[1] == "hex:0:400000" and found[6] == "assign:0:300009,hex:9:300009"
    assert found[5] == "access:0:320000"
