"""Phrase collocations against plain counting, paths of the graph, words against a regular expression."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from hrsight.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces_of(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
        yield re.findall(r"[^\x20\x09]+", piece)


def brute(rows, least, share=80, top=2000):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        n[lang] += 0
        for ws in pieces_of(text):
            n[lang] += len(ws)
            for size in range(1, 5):
                f[lang].update(tuple(ws[i:i + size]) for i in range(len(ws) - size + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in cand.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    longer[p[i:i + size]] = max(longer[p[i:i + size]], a)
        found = []
        for p, a in cand.items():
            if longer[p] and 100 * longer[p] >= share * a:
                continue
            score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), " ".join(p), a, counts[p[:k]], counts[p[k:]], score))
        for rank, (_, _, _, phrase, a, left, right, score) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase, a, left, right, n[lang], score))
    return sorted(out)


def made(frame, **options):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases.collocations(frame, **options).collect())


def sample(seed, texts=120):
    rng = random.Random(seed)
    names = ["The", "the", "É", "é", "of", "x-y", "日本", "a'b", "new", "york"]
    rows = []
    for i in range(texts):
        ws = [rng.choice(names) for _ in range(rng.randint(0, 40))]
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n"]) for w in ws)
        if i % 3 == 0:
            text += " one two three four five six seven eight nine ten" + rng.choice([" of", "", " new york"])
        rows.append((text, rng.choice(["en", "en", "fr", None, "und"])))
    return rows


SCHEMA = "text string, lang string"


@pytest.mark.parametrize("least", [2, 5, 30])
def test_against_plain_counting(spark, least):
    rows = sample(least)
    assert made(spark.createDataFrame(rows, SCHEMA).repartition(5), least=least) == brute(rows, least)


def test_top_and_ties(spark):
    rows = [(f"{a} {b}. {a} {b}", "en") for a in "abcdef" for b in "uvwxyz"] + [("a u", "en")]
    assert made(spark.createDataFrame(rows, SCHEMA), least=2, top=7) == brute(rows, 2, top=7)


def test_bounded_arrays_and_stretches(spark, monkeypatch):
    rows = sample(9) + [("long " * 500 + "text. " * 300 + "of new york " * 200, "en")]
    want = phrases.words([t for t, _ in rows], [str(x) for _, x in rows])
    monkeypatch.setattr(phrases, "STRETCH", 64)
    got = phrases.words([t for t, _ in rows], [str(x) for _, x in rows])
    for a, b in zip(want[:6], got[:6]):
        assert (np.asarray(a) == np.asarray(b)).all()
    sums, seen = phrases.Sums(2, phrases.U64), Counter()
    monkeypatch.setattr(phrases, "HELD", 10)
    rng = np.random.default_rng(1)
    want = Counter()

    def take(rare=False):
        keys, n = sums.taken(rare)
        for a, b, m in zip(*keys.tolist(), n.tolist()):
            seen[a, b] += m

    for _ in range(30):
        keys = rng.integers(0, 6, (2, 12)).astype(phrases.U64)
        want.update(zip(*keys.tolist()))
        if sums.add(keys, np.ones(12, np.int64)):
            take(rare=True)
    take()
    assert seen == want


def test_words_equal_the_pattern():
    texts = ["", "a", "A b.C,d  e\tf", "x\x0by\x0cz\r\nw", "É é ÉÀ", ".,;:!?", "a" * 70000 + " b " + "A" * 70000, " 日本 語 "]
    h, piece, start, stop, owner, marks, whole = phrases.words(texts, ["en"] * len(texts))
    want = [(i, w) for i, t in enumerate(texts) for p in pieces_of(t) for w in p]
    assert [(o, phrases.lowered(whole[s:e]).decode()) for o, s, e in zip(owner.tolist(), start, stop)] == want
    codes = {}
    for c, (_, w) in zip(h.tolist(), want):
        assert codes.setdefault(w, c) == c
    assert len(set(codes.values())) == len(codes)
    other = phrases.words(texts, ["fr"] * len(texts))[0]
    assert not set(other.tolist()) & set(h.tolist())


def test_paths(spark):
    """One passage 6 times, a part of it twice more: three paths, inner nodes only where all occurrences go on."""
    texts = ["a b c d e f g h"] * 6 + ["b c d e f"] * 2
    src = spark.createDataFrame([(t, "en") for t in texts], SCHEMA)
    pairs = phrases.sieve(src, 2, 0)
    rows = phrases.emitted(src, pairs, phrases.sieve(src, 2, 0, pairs), 0)
    names = {r.c1: r.word for r in rows.where("n = 0").collect()}
    frequent = phrases.flows(rows, 2)
    got = {(" ".join(names[w] for w in r.words), r.n) for r in phrases.contigs(frequent).collect()}
    assert got == {("a b c d", 6), ("b c d e f", 8), ("d e f g h", 6)}
    counts = {" ".join(names[w] for w in (r.c1, r.c2, r.c3, r.c4) if w): r.n for r in frequent.collect()}
    assert counts["a"] == 6 and counts["b c"] == 8 and counts["f"] == 8 and counts["e f g h"] == 6 and counts["f g h"] == 6


def test_colliding_fingerprints_take_another_seed(spark, monkeypatch):
    real = phrases.words

    def colliding(texts, langs, seed=0):
        h, *rest = real(texts, langs, seed)
        if seed == 0 and len(h):
            h[h == real(["york"], ["en"], 0)[0][0]] = real(["zork"], ["en"], 0)[0][0]
        return h, *rest

    rows = [("new york new york. new zork", "en")] * 4
    frame = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    src = frame.select("text", "lang")
    monkeypatch.setattr(phrases, "words", colliding)
    full = np.full(1 << phrases.SIEVE_BITS - 3, 255, np.uint8)
    once = phrases.emitted(src, full, full, 0)
    assert once.where("n = 0").groupBy("c1").count().where("count > 1").count() == 1
    assert made(frame, least=2) == brute(rows, 2)


def test_edges(spark):
    rows = [(None, "en"), ("", None), ("  \t ", "fr"), (". , ;", "en"), ("one", None), ("two words", "und")] + [("two words", None)] * 3
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, phrase string, n int")
    assert made(frame, least=2) == brute(rows, 2)
    assert made(frame.limit(0)) == []
    assert made(spark.createDataFrame([(None, None)], SCHEMA)) == []


def test_memory_of_a_batch_is_bounded():
    """The arrays of words are those of a small part of a batch, whatever its rows."""
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(3)
    names = [f"w{i}" for i in range(2000)]
    texts = [" ".join(rng.choices(names, k=300)) if i % 50 else None for i in range(5000)]
    langs = [f"l{i % 3}" for i in range(5000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(langs)], names=["text", "lang"])
    table = np.full(1 << phrases.SIEVE_BITS - 3, 255, np.uint8)
    met = []
    tracemalloc.start()
    for part, of in phrases._parts([batch]):
        h, piece, *_ = phrases.words(part, of)
        linked = phrases.frequent_links(h, piece, table)
        phrases.longest_grams(h, linked, *(phrases.frequent_grams(h, linked, n, table)[0] for n in (3, 4)))
        met += [hash(x) for x in zip(part, of)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert met == [hash(x) for x in zip(texts, langs)]
    assert peak < 70e6
