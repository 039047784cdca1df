"""Every stage of the pipeline against brute force on its own input; then the whole run."""

import os
import sys

import pytest
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus_pipeline as cp  # noqa: E402
import test_decontaminate as contam  # noqa: E402
import test_line_dedup as lines  # noqa: E402
import test_near_dup as near  # noqa: E402
import test_quality_rules as rules  # noqa: E402
import test_tokens as tokens  # noqa: E402

from hrsight.llm.tasks import saved  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """[(name, rows before, rows after)] of each stage, rows as they are written."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = []
    for name, stage in cp.STAGES:
        after = saved(stage(spark, docs, SF), "test-stage")
        out.append((name, docs.collect(), after.collect(), docs.columns, after.columns))
        docs = after
    return {x[0]: x[1:] for x in out}


def texts(rows):
    return {r.doc_id: r.text for r in rows}


def test_columns_stay(stages):
    for name, (_, _, before, after) in stages.items():
        assert name == "packing" or before == after


def test_quality_rules_reject_what_the_base_rejects(stages):
    before, after = (texts(x) for x in stages["quality_rules"][:2])
    assert set(after) < set(before) and all(before[d] == t for d, t in after.items())
    for d, t in after.items():
        n = rules.counts(t)
        assert n[0] >= 10 and 100 * n[4] <= 20 * n[0]


def test_quality_rules_keep_good_labels(spark, stages):
    after = texts(stages["quality_rules"][1])
    good = [r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()]
    lost = [d for d in good if d not in after]
    before = texts(stages["quality_rules"][0])
    base = [d for d in lost if rules.counts(before[d])[0] < 10 or 100 * rules.counts(before[d])[4] > 20 * rules.counts(before[d])[0]]
    assert len(lost) - len(base) <= 0.05 * len(good)


def test_lines(stages):
    before, after = (texts(x) for x in stages["line_dedup"][:2])
    gone = lines.brute(list(before.items()))
    want = {}
    for d, t in before.items():
        left = "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone[d])
        if left.strip() or not gone[d]:
            want[d] = left
    assert after == want
    assert all(r.n_chars == len(r.text) for r in stages["line_dedup"][1] if gone[r.doc_id])


def test_near_duplicates(stages):
    before, after = (texts(x) for x in stages["near_duplicates"][:2])
    want = {d for d, _, _, kept in near.brute(list(before.items()), k=5, percent=80) if kept}
    assert set(after) == want


def test_decontamination(spark, stages):
    before, after = (texts(x) for x in stages["decontamination"][:2])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    keys = {g for _, t in items for g in contam.bag(contam.WORD.findall(t.lower()), 5)}
    some = [(d, t) for d, t in before.items() if any(g in keys for g in contam.bag(contam.WORD.findall(t.lower()), 5))]
    hit = {d for d, x in contam.brute(some, items).items() if x}
    assert set(after) == set(before) - hit


def test_packing(stages):
    before, rows = texts(stages["packing"][0]), stages["packing"][1]
    tokens.check_packed(rows, before, Tokenizer.from_file(tokens.PATH))


def test_run_and_odd_rows(spark, tmp_path):
    folder = str(tmp_path)
    good = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(6)]
    rows = [(1, good[0], "en", "s", 5), (2, good[0], "en", "s", 5), (None, good[1], None, None, None), (3, None, "en", "s", 0),
            (4, "", "en", "s", 0), (5, good[2], None, "s", None), (5, good[2], None, "s", None), (6, good[3] + "\n" + good[2], "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint") \
        .write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality bigint, toxic bigint").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, good[4])], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = cp.run(spark, folder).collect()
    assert {r.doc_id for r in got} == {1, None, 5, 6}
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint") \
        .write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    assert cp.run(spark, folder).count() == 0
