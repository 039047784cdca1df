"""Base spans against plain retry-free scans; learned additions; native plan."""

import hashlib
import random
import re

from hrsight.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def brute(text):
    t = text or ""
    out = []
    for k, p in BASE.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m.group())
            if k == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if k == "card" and not (14 <= len(d) <= 19 and luhn(d)):
                continue
            if k == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), list(BASE).index(k), m.end()))
    return sorted(out)


def written(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


TEXTS = [
    None, "", "mail a.b+c@x-y.example.com now", "a@b.c_d@e.f", "a@b@c.d e@f", "x@y.z.", "@a.b", "a@.b.c", "é😀 ü@x.de a@b.co",
    "1.2.3.4.5.6.7.8", "300.1.2.3.4.5.6", "10.0.0.255, 0010.1.1.1 1.2.3", "..1.2.3.4..", "9" * 60 + ".1.1.1",
    "4111 1111 1111 1111", "4111-1111-1111-1111x", "4111  1111 1111 1111 1111", "5500005555555559 4242 4242 4242 4242",
    "0" * 14 + " " + "0" * 5, "0" * 14 + "  " + "0" * 15, "12345678901234567890", "1 2 3 4 5 6 7 8 9 0 1 2 3 4", "378282246310005-",
    "+1 (736) 555-2678", "+1 (736) 555-2678 +44 20 7946 0958.", "++1234567890", "+1 2", "+123456789012345678", "call +49-30-123456-",
    "+1(((((((", "1-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1", "a" * 5000 + "@" + "b" * 5000, "7 " * 4000, "1." * 3000, "+1" * 2000,
    "name@host.org 192.168.0.1 +1 (212) 555-0100 4012888888881881", "version 1.2.3.4 order 4012888888881881",
]


def test_base_spans_equal_plain_scans(spark):
    rng = random.Random(8)
    alphabet = "01249.@+- ()ab_"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 80))) for _ in range(400)]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, c string, base int")
    for r in pii.find(frame).collect():
        got = [(x.start, x.kind, x.stop) for x in r.base]
        assert got == brute(texts[r.doc_id]), texts[r.doc_id]
        for a in r.added:
            assert not any(b.start < a.stop and a.start < b.stop for b in r.base)


def test_many_matches_in_one_text(spark):
    text = " ".join(f"u{i}@mail.example.com" for i in range(3000))
    got = pii.find(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert [(x.start, x.kind, x.stop) for x in got.base] == brute(text)


def test_added_spans(spark):
    rows = [(i, f"please call me at (212) 555-01{i:02d} today") for i in range(40)]
    rows += [(100 + i, f"my login password=hunter{i:04d}abc thanks") for i in range(40)]
    rows += [(200 + i, f"section 21{i % 10}-555-01{i:02d}77 of the text") for i in range(20)]
    rows += [(300 + i, f"write to u{i}@mail.example.com or +1 (212) 555-01{i:02d}") for i in range(40)]
    got = {r.doc_id: [pii.KINDS[x.kind] for x in r.added] for r in pii.find(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert sum(got[i] == ["local_phone"] for i in range(40)) >= 38
    assert sum(got[100 + i] == ["secret"] for i in range(40)) >= 38
    assert not any(got[300 + i] for i in range(40))


def test_whole_table_and_native_plan(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = pii.op1(spark, sf)
    for r in out.collect():
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(written(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in want) for k in range(4)]
        assert {x for x in written(want).split(",") if x} <= set(r.spans.split(","))
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())


def test_nulls_repeats_and_empty(spark):
    frame = spark.createDataFrame([(None, "a@b.co"), (1, "a@b.co"), (1, "a@b.co"), (2, None)], "doc_id int, text string")
    assert sorted(len(r.base) for r in pii.find(frame).collect()) == [0, 1, 1, 1]
    assert pii.find(frame.limit(0)).count() == 0
