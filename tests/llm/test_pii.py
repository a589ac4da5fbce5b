from __future__ import annotations

import hashlib
import random
import re

import pytest

from lectern.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = int(c) * (1 + i % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def passes(kind: str, match: str) -> bool:
    digits = re.sub("[^0-9]", "", match)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in match.split(".")),
            "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}[kind]()


def base(text: str | None) -> list[str]:
    return [f"{kind}:{m.start()}:{m.end()}" for kind, pattern in PATTERNS.items()
            for m in re.finditer(pattern, text or "") if passes(kind, m.group())]


def spans(docs):
    rows = pii.all_spans(pii.stored(pii.with_spans(docs.select("doc_id", "text")), "spans"))
    return rows.select("doc_id", *[pii.number_of(k) for k in pii.BASE], pii.text_of(pii.F.col("base_spans")).alias("base"),
                       pii.text_of(pii.F.col("found")).alias("found")).collect()


FIXED = [
    "a@b.c%d@e.f", "a@b..c", "x.@y.z.w-", "@b.c a@b", "a@b.c.d@e.f", "é🙂 me@host.org 🙂 10.0.0.255 256.1.1.1 1.2.3.4.5",
    "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111 4111  1111 1111 1111", "4111111111111112",
    "+1 (017) 555-7713 +12 +1234567 +123456789012345 +1234567890123456", "+1 415 555 2671.", "4111 1111 1111 1111 5",
    "1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6-7-8-9-0", " 41111111 1111 1111 a@b.c", "a@b.c" * 3,
]


def test_base_spans_match_the_patterns(documents):
    rng = random.Random(2)
    alphabet = "a1.@+-( )9🙂%é4"
    texts = FIXED + ["".join(rng.choice(alphabet) for _ in range(60)) for _ in range(300)]
    found = {r["doc_id"]: r for r in spans(documents(list(enumerate(texts))))}
    for i, text in enumerate(texts):
        want = base(text)
        assert found[i]["base"] == ",".join(want), text
        for kind in PATTERNS:
            assert found[i][f"n_{kind}"] == sum(w.startswith(kind + ":") for w in want)


def test_long_runs_need_neither_stack_nor_quadratic_time(documents):
    texts = ["1 " * 50_000, "9" * 200_000, "a@" + "b." * 50_000 + "c", "a" * 200_000 + "@", "1.2.3.4 " * 5_000]
    found = spans(documents(list(enumerate(texts))))
    assert {r["doc_id"]: r["n_ip"] for r in found}[4] == 5_000
    assert {r["doc_id"]: r["n_email"] for r in found}[2] == 1


def test_weak_spans(documents):
    secret = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(i, f'some words token = "{secret[i % 7:]}{secret[:i % 7]}" and more') for i in range(40)]
    rows += [(100 + i, "prose with-a-long-hyphenated-compound-word and internationalisations") for i in range(40)]
    rows += [(200, "see commit " + "0" * 40), (201, f"me@{'x' * 30}.org"), (202, "ssn 123-45-6789"), (203, "token = '" + secret * 15 + "'")]
    found = {r["doc_id"]: r["found"] for r in spans(documents(rows))}
    assert all(found[i].startswith("secret:20:") for i in range(40))
    assert not any(found[100 + i] for i in range(40)) and not found[200]
    assert found[203] == "secret:9:609"
    assert found[201].count(":") == 2 and found[202] == "national_id:4:15"


def test_digest_of_the_query(spark, documents, tmp_path):
    documents([(1, FIXED[5]), (2, None), (None, "me@host.org")]).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in pii.query(spark, str(tmp_path)).collect()}
    assert found[1]["base_sha256"] == hashlib.sha256(",".join(base(FIXED[5])).encode()).hexdigest()
    assert found[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and found[2]["spans"] == ""
    assert found[None]["n_email"] == 1


def test_masked(documents):
    rows = [(1, "🙂 a@b.c and 10.0.0.1."), (2, "nothing"), (3, None), (4, "+1.2.3.4567 890"), (5, "a@b.c a@b.c")]
    found = {r["doc_id"]: r for r in pii.masked(documents(rows)).collect()}
    assert found[1]["text"] == "🙂 <EMAIL> and <IP>." and found[1]["n_chars"] == len(found[1]["text"])
    assert found[2]["text"] == "nothing" and found[3]["text"] is None and found[3]["n_chars"] is None
    assert found[5]["text"] == "<EMAIL> <EMAIL>"
    for i in (1, 4):
        assert not base(found[i]["text"])


def test_odd_rows(odd_documents):
    assert len(spans(odd_documents)) == 11
    assert pii.masked(odd_documents).columns == odd_documents.columns
    assert pii.masked(odd_documents).where("text <> ''").count() == odd_documents.where("text <> ''").count()
    assert len(spans(odd_documents.limit(0))) == 0 and pii.masked(odd_documents.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_running_sums(spark, n):
    from lectern.llm.common import running_sums

    values = [i % 7 for i in range(n)]
    got = spark.createDataFrame([(values,)], "v array<int>").select(running_sums(pii.F.col("v")).alias("s")).first()["s"]
    assert got == [sum(values[:i]) for i in range(n)]
