from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def good(kind, text):
    d = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and luhn(d)
    return 8 <= len(d) <= 15 if kind == "phone" else True


def brute(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if good(k, m[0])] for k, p in PATTERNS.items()}


TRICKY = [
    "a@b.c_d@e.f x@y@z.io ..@-.- a@b a@b. a@b.c",
    "1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.255 1.2.3 9999.1.1.1.1 000000000000000000000000000001.2.3.4",
    "4111 1111-1111 1111 4111111111111112 41111111111111111111 5 6  7 4111  1111 1111 1111 378282246310005 0000000000000000",
    "+1 (441) 555-3597 +12 +1....2 +1234567 +12345678 +123456789012345 +1234567890123456 +1 2 3 4 5 6 7 8) ++1 441 555 3597",
    "\U0001f600é a@b.co \U0001f600 10.0.0.1 ß +49 30 1234567",
    "@" * 300 + "1." * 300 + "+1" * 100,
    "x" * 20_000 + " " + "1" * 20_000 + " " + "+1" + " " * 20_000,
    " ".join(f"u{i}@h{i}.example.com" for i in range(700)),
    "token = \"0123456789abcdef0123456789abcdef01234567\"",
    "",
    None,
]


def check(df, rows):
    got = {}
    for r in df.collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, text in rows:
        want = brute(text)
        said = ",".join(f"{k}:{s}:{e}" for k in PATTERNS for s, e in want[k])
        assert got[i], i
        for r in got[i]:
            if (r.base_sha256, r.n_email) == (hashlib.sha256(said.encode()).hexdigest(), len(want["email"])):
                break
        else:
            raise AssertionError((i, text[:80] if text else text, said[:200], got[i]))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(want[k]) for k in PATTERNS]
        assert set(said.split(",")) - {""} <= set(r.spans.split(","))


def test_base_spans_match_plain_patterns(docs, odd):
    for df in (docs, odd):
        found = pii.find(df)
        assert found.count() == df.count()
        check(found, [(r.doc_id, r.text) for r in df.collect()])


def test_tricky_texts(spark):
    rows = list(enumerate(TRICKY))
    df = spark.createDataFrame(rows, "doc_id int, text string")
    check(pii.find(df), rows)


def test_added_spans_are_ordered_and_clear_of_base_ones(spark):
    rows = pii.with_candidates(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).cache()
    model = pii.fit(rows)
    assert model.trees and model.thresholds
    for r in pii.with_spans(rows, model).select("_base", "_all").collect():
        base, every = [tuple(x) for x in r["_base"]], [tuple(x) for x in r["_all"]]
        assert every == sorted(every) and set(base) <= set(every)
        added = sorted((s, e) for k, s, e in set(every) - set(base))
        assert all(a[1] <= b[0] for a, b in zip(added, added[1:]))
        assert not any(s < e2 and s2 < e for s, e in added for _, s2, e2 in base)


def test_secrets_are_added(spark):
    text = "call token = \"%s\" now"
    rows = [(i, text % hashlib.sha1(str(i).encode()).hexdigest()) for i in range(60)]
    rows += [(100 + i, f"plain words and {i} numbers, id {10**15 + i * 7919}") for i in range(60)]
    found = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(found[i] == "secret:14:54" for i in range(60))


def test_sql_and_numpy_scores_agree(spark, docs):
    rows = pii.with_candidates(docs)
    model = pii.fit(rows)
    from pyspark.sql import functions as F

    flat = rows.select(F.explode("_cands").alias("x")).select("x.*").withColumn("s", F.expr(model.sql("x").replace("x.", "")))
    got = flat.toPandas()
    assert np.allclose(got.s, model.score(got[pii.NAMES].to_numpy()))


def test_redaction(odd, none):
    got = {r.doc_id: r.text for r in pii.redact(odd).collect()}
    assert got[1] == "Mail [EMAIL] or [PHONE] now." and got[2] is None and got[3] == "" and got[8].startswith("one two three")
    assert any("card [CARD] and [IP]" in (r.text or "") for r in pii.redact(odd).collect())
    assert pii.redact(odd).columns == odd.columns
    assert pii.redact(none).count() == 0 and pii.find(none).count() == 0


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_running_sums(spark, n):
    df = spark.range(1).selectExpr(f"transform(sequence(1, {n + 1}), x -> cast(x as bigint)) as w").selectExpr(f"slice(w, 1, {n}) as w")
    got = df.selectExpr(pii.running_sums("w") + " as s").first().s
    assert list(got) == [sum(range(1, i + 1)) for i in range(n)]


def test_the_main_path_runs_no_python(docs):
    rows = pii.with_candidates(docs)
    plan = pii.with_spans(rows, pii.fit(rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_redacting_keeps_clashing_columns_apart(spark):
    names = ["_t", "_base", "_all", "_more", "_sorted", "_clear", "_cands", "_pii_t", "_pii_n", "c0", "c1", "a b"]
    rows = spark.createDataFrame([(1, "Mail bob@mail.example.com now."), (2, None)], "doc_id int, text string")
    rows = rows.select(*(F.lit(f"own {n}").alias(n) for n in names), "doc_id", "text")
    out = {r.doc_id: r for r in pii.redact(rows).collect()}
    assert pii.redact(rows).columns == rows.columns
    assert out[1].text == "Mail [EMAIL] now." and out[2].text is None
    assert all(out[i][n] == f"own {n}" for i in (1, 2) for n in names)
