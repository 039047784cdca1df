"""Alignment of two tokenizers against whole-text encoding and plain loops."""

import hashlib
from collections import Counter, defaultdict
from itertools import accumulate

import public_tokenizers
import pytest

from hrsight.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "\n b", "a\n b", "a \nb c", "don't we're I'll 'tis", "x <|endoftext|> y",
    "été, où? çа́ ß.", "日本語 テキスト、です。 漢字", "tab\tb \t c", "1,234.5 +1 (736) 555-2678", "a b   c", "word. " * 50,
    "𝔘𝔫𝔦 😀😀 ée", "A" * 3000, "HEL!! LO?? %%% ***", "a.b. c,d, e;f;\n\n\ng  ", "ªº µ ǅ.", "same text here", "same text here",
    "x one.\nTwo!!\nThree%%%, four\n\nfive\nsix \nseven\r\neight x*y w/ z\n|a b|\n", "▁x", " ▁", "a▁b c", "a\x00b",
    "﻿x", "é é", "🧿🧿 世界", "<0x41> <s> </s> <unk>", "x🧿y", "ﬅ ﬁ", "  x", " x  　 y", "x " + "🧿" * 5 + "é", "ǅé.\n\n x",
    "ñ.\nÉa", "end.\n", "word\x0bother\x0cnext\x1fend \x85 x", "🧿\n世é,é;\n\n",
]


@pytest.fixture(scope="module")
def both():
    return align.Pair(A, B)


def whole(both, text):
    """(ids of A, ids of B, groups, links) of a text by encoding it whole."""
    if not text:
        return [], [], [], []
    a, b = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(both.a_bytes[i] for i in a) != raw or b"".join(both.b_bytes[i] for i in b) != raw:
        return [], [], [], []
    ends_a = list(accumulate(len(both.a_bytes[i]) for i in a))
    ends_b = list(accumulate(len(both.b_bytes[i]) for i in b))
    groups, begin = [], 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        groups.append("|".join(",".join(str(i) for i, e in zip(ids, ends) if begin < e <= cut)
                               for ids, ends in ((a, ends_a), (b, ends_b))))
        begin = cut
    links, first = [], 0
    for i, s, e in zip(a, [0, *ends_a], ends_a):
        while ends_b[first] <= s:
            first += 1
        j = first
        while j < len(b) and (ends_b[j - 1] if j else 0) < e:
            links.append((i, b[j]))
            j += 1
    return a, b, groups, links


def brute(both, rows):
    made = [(k, *whole(both, t)) for k, t in rows]
    count = Counter(p for *_, links in made for p in set(links))
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    return sorted(((k, len(a), len(b), len(g), len(x), sum(count[p] == most[p[0]] for p in x), sum(count[p] for p in x),
                    hashlib.sha256(";".join(g).encode()).hexdigest() if a else "", ";".join(g)) for k, a, b, g, x in made), key=str)


def test_units_equal_whole_texts(both):
    assert both.cut and both.fine
    for _ in range(2):
        for t, got in zip(TEXTS, both.documents(TEXTS, True)):
            a, b, groups, links = whole(both, t)
            assert got[:4] == (len(a), len(b), len(groups), len(links)), t
            assert got[7] == ";".join(groups), t
            assert Counter(dict(zip(got[5].tolist(), got[6].tolist()))) == Counter(x * both.base + y for x, y in links)


def test_cache_and_stretches_change_nothing(both, monkeypatch):
    monkeypatch.setattr(align, "YOUNG", 5)
    monkeypatch.setattr(align, "PARTS", 7)
    monkeypatch.setattr(align, "STRETCH", 7)
    made = align.Pair(A, B)
    for t, got in zip(TEXTS, made.documents(TEXTS, True)):
        assert got[7] == ";".join(whole(both, t)[2]), t


def test_without_cuts(both):
    made = align.Pair(A, B)
    made.cut = made.fine = False
    for t, got in zip(TEXTS, made.documents(TEXTS, True)):
        assert got[7] == ";".join(whole(both, t)[2]), t


def test_coarse_cuts():
    assert align.coarse_cuts([(0, 2), (2, 3), (3, 5)]) == [(2, 1), (3, 2), (5, 3)]
    assert align.coarse_cuts([(0, 2), (2, 5), (2, 5), (5, 6)]) == [(2, 1), (5, 3), (6, 4)]
    assert align.coarse_cuts([(0, 1), (1, 1), (1, 1), (1, 4), (4, 5)]) == [(1, 1), (4, 4), (5, 5)]


@pytest.mark.parametrize("table", [align.TABLE, 40, 0])
def test_rows(spark, both, table):
    rows = [(i if i != 4 else None, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id bigint, text string, uid int, codes string, n_a string")
    got = align.align(docs.repartition(3), A, B, with_groups=True, table=table).collect()
    assert sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.groups)
                   for r in got), key=str) == brute(both, rows)


def test_counts_of_a_task_are_flushed(spark, both, monkeypatch):
    monkeypatch.setattr(align, "HELD", 3)
    made = align.Counts(both.code)
    import numpy as np

    seen = Counter()
    for i in range(20):
        if made.add(np.arange(i, i + 4, dtype=both.code)):
            for codes, n in made.blocks():
                seen.update(dict(zip(codes.tolist(), n.tolist())))
    for codes, n in made.blocks():
        seen.update(dict(zip(codes.tolist(), n.tolist())))
    assert seen == Counter(x for i in range(20) for x in range(i, i + 4))


def test_whole_table(spark, both):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute(both, [(r.doc_id, r.text) for r in docs.collect()])
    got = align.align(docs, A, B).collect()
    assert sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got),
                  key=str) == [w[:8] for w in want]
    assert align.align(docs.limit(0), A, B).count() == 0
