"""Decontamination against all item-sized windows; native plan."""

import re
from collections import Counter

from pyspark.sql import functions as F

from hrsight.llm import decontaminate

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bag(w, k):
    return Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def brute(docs, items, k=5, percent=80):
    out = {}
    for d, t in docs:
        w = WORD.findall((t or "").lower())
        hit = set()
        for item, text in items:
            x = WORD.findall((text or "").lower())
            if not x or not w:
                continue
            s = min(k, len(x))
            want = bag(x, s)
            for a in range(max(1, len(w) - len(x) + 1)):
                have = bag(w[a:a + len(x)], s)
                common = sum((want & have).values())
                if common and 100 * common >= percent * (sum(want.values()) + sum(have.values()) - common):
                    hit.add(item)
                    break
        out[d] = ",".join(str(i) for i in sorted(hit))
    return out


PASSAGE = "The quick brown fox jumps over the lazy dog while seven wizards vex bold quacking daft zebras near my big old house".split()
ITEMS = [(1, " ".join(PASSAGE)), (2, "short one here"), (3, None), (4, ""), (5, "a a a a a a a a"),
         (6, " ".join(f"w{i}" for i in range(60))), (7, "alpha beta gamma delta epsilon zeta")]


def docs():
    noise = [f"n{i}" for i in range(30)]
    edit = list(PASSAGE)
    edit[0] = "Some"
    middle = list(PASSAGE)
    middle[10] = "other"
    long_edit = [f"w{i}" for i in range(60)]
    long_edit[30] = "x"
    return [(1, " ".join(noise + PASSAGE + noise)), (2, "\n".join(PASSAGE).upper()), (3, " ".join(noise + edit + noise)),
            (4, " ".join(noise + middle + noise)), (5, " ".join(long_edit)), (6, "it is a Short  one\there now"), (7, None), (8, ""),
            (9, "a " * 40), (10, " ".join(PASSAGE[:-1])), (11, " ".join(PASSAGE[:12])), (12, " ".join(noise)),
            (13, " ".join(noise + PASSAGE + [f"w{i}" for i in range(60)])), (14, "alpha beta gamma delta epsilon"),
            (15, " ".join(noise[:5] + PASSAGE[:9] + ["inserted"] + PASSAGE[9:] + noise))]


def test_against_all_windows(spark):
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in docs()], "doc_id bigint, text string, items string, m int")
    items = spark.createDataFrame([(i, t, 3) for i, t in ITEMS], "item_id bigint, text string, doc_id int")
    got = {r.doc_id: r for r in decontaminate.contamination(frame, items).collect()}
    want = brute(docs(), ITEMS)
    assert {d: r["items"] for d, r in got.items()} == want
    assert all(r.contaminated == bool(r["items"]) for r in got.values())


def found(spark, docs, items):
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = decontaminate.contamination(frame, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    return {r.doc_id: r["items"] for r in rows}


def test_best_window_between_two_offsets(spark):
    """Words inserted in the middle and edits at both ends: no shared shingle lies where the item has it."""
    docs, items = [], []
    for i in range(4):
        w = [f"i{i}w{j}" for j in range(100)]
        items.append((i, " ".join(w)))
        edited = ["a", "b", "c"] + w[3:50] + [f"new{j}" for j in range(6)] + w[50:97] + ["d", "e", "f"]
        docs.append((i, " ".join([f"n{j}" for j in range(20)] + edited + [f"n{j}" for j in range(20)])))
    want = brute(docs, items)
    assert all(want.values()) and found(spark, docs, items) == want


def test_similar_windows_whose_words_differ_much(spark):
    """The shingles are similar enough, the words (each occurrence counted) are not."""
    docs, items = [], []
    for i in range(8):
        w = [f"i{i}w{j}" for j in range(90)]
        items.append((i, " ".join(w + [f"r{i}"] * 10)))
        docs.append((i, " ".join([f"n{j}" for j in range(20)] + w + [f"x{i}y{j}" for j in range(10)])))
    docs.append((20, " ".join(("p q " * 3 + "s t ") * 40)))  # a shingle counts as often as the item has it
    items += [(20, "p q p q p q s t p q"), (21, "p q p q p q p q p q p q")]
    want = brute(docs, items)
    assert all(want[i] for i in range(8)) and found(spark, docs, items) == want


def test_nulls_repeats_and_empty(spark):
    text = " ".join(PASSAGE)
    frame = spark.createDataFrame([(None, text), (1, text), (1, text), (1, "other text"), (2, None)], "doc_id int, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = sorted((str(r.doc_id), r.contaminated) for r in decontaminate.contamination(frame, items).collect())
    assert got == [("1", False), ("1", True), ("1", True), ("2", False), ("None", False)]
    assert decontaminate.contamination(frame.limit(0), items).count() == 0
    assert {r.contaminated for r in decontaminate.contamination(frame, items.limit(0)).collect()} == {False}


def test_whole_table_and_native_plan(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    keys = {g for _, t in items for g in bag(WORD.findall(t.lower()), 5)}
    rows_hit = [(d, t) for d, t in rows if any(g in keys for g in bag(WORD.findall(t.lower()), 5))]
    want = {d: "" for d, _ in rows} | brute(rows_hit, items)
    out = decontaminate.op8(spark, sf)
    assert {r.doc_id: r["items"] for r in out.collect()} == want
    assert any(want.values())
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())


def test_blocks_cover_the_fingerprint(spark):
    row = spark.range(1).select(decontaminate.blocks(F.lit(-1).cast("bigint"), 16).alias("b"),
                                decontaminate.simhash(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("h")).first()
    assert sum(bin(b.value).count("1") for b in row.b) == 64 and len(row.b) == 17
    assert row.h != 0
