"""MinHash near duplicates against all pairs on full shingle sets."""

import random
import re

import numpy as np

from hrsight.llm import near_dup
from hrsight.llm.textnp import gram_hashes, words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def shingles(text, k=3, lower=True):
    w = WORD.findall(lowered(text or "") if lower else text or "")
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k=3, percent=85, lower=True):
    sets = [shingles(t, k, lower) for _, t in rows]
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    index = {}
    for i, s in enumerate(sets):
        near = {j for x in s for j in index.get(x, ())}
        for j in near:
            n = len(s & sets[j])
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                label[b] = a
        for x in s:
            index.setdefault(x, []).append(i)
    comp = {}
    for i, (d, _) in enumerate(rows):
        comp[top(i)] = min(comp.get(top(i), d), d)
    return sorted((d, len(sets[i]), comp[top(i)], d == comp[top(i)]) for i, (d, _) in enumerate(rows))


def test_words_and_shingles_equal_python():
    texts = ["", None, "A b\tC\x0bd  é", " x ", "\n\n", "one", "one two", "aa bb cc aa bb cc", "tail\x0c"]
    h, first, start, end = words_of(texts, lower=True)
    seen = {}
    for i, t in enumerate(texts):
        w = WORD.findall(lowered(t or ""))
        own = h[first[i]:first[i + 1]].tolist()
        assert len(own) == len(w)
        for a, b in zip(w, own):
            assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen)
    g, begin = gram_hashes(h, first, 3)
    for i, t in enumerate(texts):
        assert len(set(g[begin[i]:begin[i + 1]].tolist())) == len(shingles(t))


def made_rows():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows, doc = [], 0
    for base in range(12):
        text = [rng.choice(vocab) for _ in range(rng.choice([4, 12, 60, 200]))]
        for copy in range(rng.choice([1, 2, 6, 25])):
            t = list(text)
            for _ in range(rng.randrange(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            rows.append((doc, " ".join(t)))
            doc += 1
    rows += [(doc + i, t) for i, t in enumerate([None, "", " \t", "a", "A", "a b", "a  b", "c", "x y z", "x y z q", "x y z"])]
    rng.shuffle(rows)
    return rows


def test_against_all_pairs(spark):
    rows = made_rows()
    frame = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id bigint, text string, n_shingles string, kept int")
    got = sorted(tuple(r)[:4] for r in near_dup.near_duplicates(frame).collect())
    assert got == brute(rows)


def test_star_of_copies_that_are_unlike_each_other(spark):
    """Copies link to their original only: the component needs the right centre."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows = [(100, " ".join(base))]
    for i in range(40):
        t = list(base)
        for p in rng.sample(range(len(t)), 2):
            t[p] = f"edit{i}_{p}"
        rows.append((i, " ".join(t)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = near_dup.near_duplicates(frame).collect()
    assert {r.component_id for r in got} == {0}
    assert sorted(tuple(r)[:4] for r in got) == brute(rows)


def test_no_link_is_left_to_chance(spark, monkeypatch):
    """Whatever the random centres miss, the comparison across components finds."""
    rng = random.Random(21)
    rows = []
    for g in range(3):
        base = [f"g{g}b{i}" for i in range(100)]
        for i in range(120):
            t = base[:rng.choice([90, 93, 96, 100])]
            for p in rng.sample(range(len(t)), rng.randrange(0, 5)):
                t[p] = f"edit{rng.randrange(30)}"
            rows.append((len(rows), " ".join(t)))
    stars, rounds = near_dup._stars, []

    def first_only(placed, draws, percent):
        rounds.append(1)
        return stars(placed, draws, percent) if len(rounds) == 1 else stars(placed, draws, percent).limit(0)

    monkeypatch.setattr(near_dup, "_stars", first_only)
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    got = sorted(tuple(r)[:4] for r in near_dup.near_duplicates(
        spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == brute(rows)


def test_form_letters_do_not_all_meet(spark, monkeypatch):
    """Letters of one template that are not similar enough share buckets of bands, but no index shingle; real copies
    among them are still found."""
    rng = random.Random(33)
    template = [f"t{i}" for i in range(180)]
    rows = []
    for i in range(400):
        t = template + [f"own{i}_{j}" for j in range(30)]
        rows.append((2 * i, " ".join(t)))
        if i % 80 == 0:
            t[rng.randrange(100)] = "edit"
            rows.append((2 * i + 1, " ".join(t)))
    meetings, met = near_dup._meetings, []

    def counted(few, many):
        out = meetings(few, many)
        met.append(out.count())
        return out

    monkeypatch.setattr(near_dup, "_meetings", counted)
    got = sorted(tuple(r)[:4] for r in near_dup.near_duplicates(
        spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == brute(rows)
    assert met and sum(met) < 1000


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (7, "A B C D"), (8, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(
        spark.createDataFrame(rows, "doc_id int, text string")).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (5, 2, 5, True), (5, 2, 5, True), (7, 2, 5, False), (8, 0, 8, True)], key=str)
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id int, text string")).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in near_dup.op9(spark, "/root/testdata/sf0.01").collect())
    assert got == brute(rows)


def test_densified_signatures_have_no_gap():
    sets = [np.array([7], dtype=np.uint64), np.arange(1000, dtype=np.uint64)]
    sig = near_dup.signatures(sets, 160)
    assert (sig != near_dup._EMPTY).all() and len(set(sig[0].tolist())) == 1
