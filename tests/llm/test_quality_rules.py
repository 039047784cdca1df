"""Text statistics against plain Python; the learned list; native plan."""

import random
import re
from collections import Counter

from hrsight.llm import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    t = text or ""
    w = WORD.findall(t)
    lines, seen, dup = t.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    often = Counter(grams)
    covered = {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


TEXTS = [None, "", "  \t\n", "one", "a b c d e a b c d e", "a b c d e\na b c d e\n\n\n \n \n", "x " * 50, "#*$%&|<> ok &&&",
         "é ü 😀 日本語 wörter", "a b c d e f g h a b c d e f g h i j a b c d", "same line here\nsame line here\n same line here",
         "one\x0btwo\x0cthree\rfour", "1 2 3 4 5 6 2 3 4 5 6 7 1 2 3 4 5"]


def test_statistics(spark):
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, n_words string")
    for r in quality_rules.statistics(frame).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == counts(texts[r.doc_id]), texts[r.doc_id]


def test_whole_table_base_and_native_plan(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = quality_rules.op6(spark, sf)
    for r in out.collect():
        n = counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0])
        assert not (r.kept and r.base_failed)
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())


def test_learns_planted_rules(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        junk = i % 3 == 0
        words = [rng.choice(["ha", "river", "stone", "cloud", "letter", "answer"]) + str(rng.randrange(999)) for _ in range(40)]
        if junk:
            words = [w + "%%%" for w in words] if i % 2 else [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, 0 if junk else 1))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = quality_rules.judge(docs, spark.createDataFrame(labels, "doc_id bigint, quality int"))
    assert 1 <= len(out._hrsight_rules) <= 10
    wrong = sum(r.kept == (labels[r.doc_id][1] == 0) for r in out.collect())
    assert wrong <= 9


def test_no_labels_repeats_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(None, text), (1, text), (1, text), (2, "few words")], "doc_id int, text string")
    none = spark.createDataFrame([], "doc_id int, quality int")
    got = sorted((str(r.doc_id), r.kept) for r in quality_rules.judge(docs, none).collect())
    assert got == [("1", True), ("1", True), ("2", False), ("None", True)]
    assert quality_rules.judge(docs.limit(0), none).count() == 0
    odd = spark.createDataFrame([(1, 0), (1, 1), (None, 0), (2, None)], "doc_id int, quality int")
    assert quality_rules.judge(docs, odd).count() == 4
