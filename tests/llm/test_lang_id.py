"""Language identification: n-gram counts against plain loops, nearest centroid against loops, held-out accuracy."""

import zlib
from collections import Counter

import numpy as np
import pytest

from hrsight.llm import lang_id

TEXTS = ["", "a", "Ab", "été où?", "one two  three", "x-y 12 z", "日本語 テキスト", "12 34", "\n\t", "end.", "word " * 30, "ÀÉ ab", None, "a" * 50]


def plain_counts(text):
    """Counts of the byte n-grams of words and their boundaries, by bucket."""
    data = (text or "").lower().encode()
    seq = [0x20]
    for b in data:
        if 0x61 <= b <= 0x7A or b >= 0x80:
            seq.append(b)
        elif seq[-1] != 0x20:
            seq.append(0x20)
    if seq[-1] != 0x20:
        seq.append(0x20)
    out = Counter()
    for n in lang_id.SIZES:
        for i in range(len(seq) - n + 1):
            w = seq[i:i + n]
            if (n > 2 and 0x20 in w[1:-1]) or w == [0x20, 0x20]:
                continue
            h = n
            for b in w:
                h = (h * 0x01000193 + b) % (1 << 32)
            out[(h * 2654435761 % (1 << 32)) >> 20] += 1
    return out


def test_counts_equal_plain_loops():
    got = lang_id.bucket_counts(TEXTS)
    for t, row in zip(TEXTS, got):
        assert {int(i): int(row[i]) for i in np.flatnonzero(row)} == dict(plain_counts(t)), t
    for t, row in zip(TEXTS, got):
        assert (lang_id.bucket_counts([t])[0] == row).all()


def test_stretches_change_nothing(monkeypatch):
    want = lang_id.bucket_counts(TEXTS)
    monkeypatch.setattr(lang_id, "STRETCH", 9)
    assert (lang_id.bucket_counts(TEXTS) == want).all()


def test_clusters_and_radii():
    rng = np.random.default_rng(3)
    axes = np.eye(20, dtype=np.float32)[[0, 5, 9]]
    x = np.abs(np.repeat(axes, 40, axis=0) + rng.normal(0, 0.05, (120, 20))).astype(np.float32)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    c = lang_id.clustered(x, 3)
    assert sorted(np.argmax(c, axis=1).tolist()) == [0, 5, 9]
    assert len(lang_id.clustered(np.repeat(x[:1], 5, axis=0), 3)) == 1
    r = lang_id.radii(np.full(10, 0.2), np.full(10, 6))
    assert r[5] == 1.0 and r[6] == pytest.approx(0.21) and r[7] == r[6]


def rows_of(spark, sf="/root/testdata/sf0.01"):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def model(spark):
    return lang_id.train(rows_of(spark))


def test_held_out_accuracy_and_nearest_centroid(spark, model):
    docs = rows_of(spark)
    truth = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    got = lang_id.identify(docs, model, reject=False).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {k for k in truth if zlib.crc32(str(k).encode()) % 3 == 1}
    assert np.mean([r.lang_pred == truth[r.doc_id][0] for r in held]) > 0.97
    for r in got[:40]:
        v = np.zeros(lang_id.DIMS)
        for b, n in plain_counts(truth[r.doc_id][1]).items():
            v[b] = (1 + np.log(n)) * model.idf[b]
        v /= np.sqrt(v @ v)
        near = [float(v @ c) for c in model.centroids]
        k = int(np.argmax(near))
        assert r.lang_pred == model.languages[model.owner[k]] and r.score == pytest.approx(near[k], abs=1e-4)


def test_document_frequencies(spark):
    rows = [(t,) for t in TEXTS] * 3
    n, df = lang_id.document_frequencies(spark.createDataFrame(rows, "text string").repartition(4))
    want = Counter(b for t in TEXTS for b in plain_counts(t))
    assert n == len(rows) and {int(i): int(df[i]) for i in np.flatnonzero(df)} == {b: 3 * c for b, c in want.items()}


def test_rejects_what_is_like_no_language(spark, model):
    docs = spark.createDataFrame([(1, "xqzj vvkw zzqx " * 60)], "doc_id bigint, text string")
    r = lang_id.identify(docs, model).first()
    assert r.rejected and r.lang_pred == "und" and lang_id.identify(docs, model, reject=False).first().lang_pred in model.languages


def test_learning_rows_only(spark):
    """Held-out rows, null ids and null languages change nothing."""
    def label(i):
        return "aa" if i % 2 else "bb"

    words = {"aa": "lala mulo tari pero ", "bb": "krz ptak szcz wrzo "}
    rows = [(i, words[label(i)] * (2 + i % 5), label(i), 0) for i in range(60)]
    other = [(i, words["aa"], "cc", 0) for i in range(100, 200) if zlib.crc32(str(i).encode()) % 3 == 1]
    other += [(None, words["bb"], "dd", 0), (7000, "xyz", None, 0)]
    schema = "doc_id bigint, text string, lang string, score int"
    one = lang_id.train(spark.createDataFrame(rows, schema))
    two = lang_id.train(spark.createDataFrame(rows + other, schema))
    assert one.languages == two.languages == ["aa", "bb"]
    assert np.allclose(one.centroids, two.centroids) and np.allclose(one.idf, two.idf)


def test_edges(spark, model):
    rows = [(1, None), (2, ""), (3, "12 -- 34"), (None, "the and of"), (3, "…"), (4, "ab"), (4, "ab"), (5, "😀")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, lang_pred string, rejected int")
    got = sorted(lang_id.identify(docs, model, reject=False).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [r.lang_pred == "und" for r in got] == [True, True, True, True, False, False, True, False]
    assert all(0 <= r.score <= 1 for r in got) and not any(r.rejected for r in got if r.lang_pred == "und")
    assert got[-1].held_out is False
    assert lang_id.identify(docs.limit(0), model).count() == 0
    empty = lang_id.train(spark.createDataFrame([], "doc_id bigint, text string, lang string"))
    assert {r.lang_pred for r in lang_id.identify(docs, empty).collect()} == {"und"}


def test_too_many_languages(spark):
    docs = spark.createDataFrame([(i, "text", f"l{i}") for i in range(30)], "doc_id bigint, text string, lang string")
    with pytest.raises(ValueError):
        lang_id.train(docs, max_languages=5)
