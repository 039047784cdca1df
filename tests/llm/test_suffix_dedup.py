"""Repeated passages against all windows by brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from hrsight.llm import suffix_dedup


def brute(rows, length, keep_first=False):
    seen = Counter()
    firsts = {}
    raws = [(d, b"" if t is None else t.encode()) for d, t in rows]
    for d, r in sorted(raws):
        for i in range(len(r) - length + 1):
            seen[r[i:i + length]] += 1
            firsts.setdefault(r[i:i + length], (d, i))
    out = []
    for d, r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            w = r[i:i + length]
            if seen[w] > 1 and not (keep_first and firsts[w] == (d, i)):
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i in range(len(r)) if gone[i] and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((d, len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def made_rows():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    passages = [text(n) for n in (20, 30, 31, 60, 200, 500)]
    rows = [(i, text(rng.randrange(0, 300)) + "".join(rng.choice(passages) + text(rng.randrange(0, 60)) for _ in range(rng.randrange(0, 3))))
            for i in range(60)]
    rows += [(70, None), (71, ""), (72, "x" * 29), (73, "x" * 30), (74, "y" * 31), (75, "ab" * 100), (76, "ba" * 120)]
    rows += [(80 + i, rows[4][1]) for i in range(5)]
    return rows


@pytest.mark.parametrize("group", [4096, 3])
@pytest.mark.parametrize("keep_first", [False, True])
def test_against_all_windows(spark, monkeypatch, group, keep_first):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    rows = made_rows()
    frame = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id bigint, text string, runs string")
    got = suffix_dedup.remove_repeats(frame, length=30, gram=8, keep_first=keep_first)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect())
    assert got == brute(rows, 30, keep_first)


def test_long_texts_in_stretches(monkeypatch):
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 100, 5000, dtype=np.uint8).tobytes()
    want = defaultdict(set)
    for stretch in (1 << 21, 700):
        monkeypatch.setattr(suffix_dedup, "STRETCH", stretch)
        doc, key, _, first, last = suffix_dedup.anchors([raw, b"short", raw[:1000]], 50, 12)
        for d, k, a, b in zip(doc, key, first, last):
            for s in range(a, b + 1):
                want[d, s].add(k)
        assert len(want) == 5000 - 49 + 1000 - 49
    assert all(len(x) == 1 for x in want.values())


def test_suffix_order_is_byte_order():
    rng = np.random.default_rng(2)
    buf = rng.integers(0, 3, 400, dtype=np.uint8)
    rank = suffix_dedup.ranks(buf, 50)
    raw = buf.tobytes()
    for i in range(0, 340, 7):
        for j in range(0, 340, 11):
            a, b = raw[i:i + 50], raw[j:j + 50]
            assert (rank[i] > rank[j], rank[i] < rank[j]) == (a > b, a < b)


def test_whole_table_and_edges(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = sorted(tuple(r) for r in suffix_dedup.op2(spark, "/root/testdata/sf0.001").collect())
    assert got == brute(rows, 400)
    empty = spark.createDataFrame([], "doc_id int, text string")
    assert suffix_dedup.remove_repeats(empty).count() == 0
    odd = spark.createDataFrame([(None, "p" * 500), (1, "p" * 500), (2, "q" * 450), (2, "q" * 450)], "doc_id int, text string")
    got = {(r.doc_id, r.n_removed) for r in suffix_dedup.remove_repeats(odd, keep_first=False).collect()}
    assert got == {(None, 0), (1, 500), (2, 450)}
