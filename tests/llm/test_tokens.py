"""Token counts, packing and coded ids against plain whole-text encoding."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hrsight.llm import encode, packing, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "\n b", "a\n b", "a \nb c", "don't we're I'll 'tis", "x <|endoftext|> y",
    "x<|endoftext|>. y", "été, où? çа́ ß.", "日本語 テキスト、です。 漢字", "tab\tb \t c", "1,234.5 +1 (736) 555-2678", "a b   c",
    "word. " * 50, "𝔘𝔫𝔦 😀😀 ée", "A" * 3000, "HEL!! LO?? %%% ***", "a.b. c,d, e;f;\n\n\ng  ", "ªº µ ǅ.", "z" * 20 + "." * 40,
    "same text here", "same text here",
    "x one.\nTwo!!\nThree%%%, four\n\nfive\nsix \nseven\r\neight x*y w/ z\n|a b|\n", "don't.\nCan't x's' it''s \"q\"", "a×b ÷ Ÿž ɏɐ ŉ",
    "e.g.\nU.S.A. 3rd\n4th c++ <|endoftext|>\nEnd <|endoftext|", "µ.\nª, º! ß?\nÅ#", "word\x0bother\x0cnext\x1fend \x85 x",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 4 else None, t, "extra", i) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string, start bigint")


@pytest.mark.parametrize("what", ["ids", "lengths"])
def test_units_equal_whole_texts(library, what):
    made = encode.Encoder(PATH, what)
    assert made.units
    for _ in range(2):
        for t, got in zip(TEXTS, made.encode(TEXTS)):
            ids = library.encode(t or "", add_special_tokens=False).ids
            assert (got if what == "lengths" else np.frombuffer(got, made.width).tolist()) == (
                len(ids) if what == "lengths" else ids), t


def test_cache_generations_change_nothing(library, monkeypatch):
    monkeypatch.setattr(encode, "YOUNG", 5)
    made = encode.Encoder(PATH, "lengths")
    for _ in range(3):
        assert made.encode(TEXTS) == [len(library.encode(t or "", add_special_tokens=False).ids) for t in TEXTS]


def test_counts(spark, docs, library):
    got = sorted((r for r in token_counts.token_counts(docs, PATH, limit=40).collect()), key=lambda r: (r.n_bytes, r.n_tokens))
    want = sorted(((len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for t in TEXTS))
    assert [(r.n_bytes, r.n_tokens) for r in got] == want
    assert all(r.over_limit == (r.n_tokens > 40) for r in got)
    assert token_counts.token_counts(docs.limit(0), PATH).count() == 0


def check_packed(rows, texts, library, max_tokens=1024):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for k, t in texts.items():
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        at = 0
        for r in sorted(by_doc[k], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= max_tokens
    return by_seq


def test_packing_whole_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = packing.pack(docs.withColumn("sequence_id", docs["doc_id"]), PATH).collect()
    by_seq = check_packed(rows, texts, library)
    total = sum(r.length for r in rows)
    assert len(by_seq) * 1024 - total < 1024 * max(1, docs.rdd.getNumPartitions()) + 1


def test_packing_edges(spark, docs, library):
    rows = packing.pack(docs.where("doc_id is not null"), PATH, max_tokens=16, max_segments=3).collect()
    by_seq = check_packed(rows, {i: t for i, t in enumerate(TEXTS) if i != 4}, library, 16)
    assert max(len(x) for x in by_seq.values()) <= 3
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_packing_limits_on_loss(spark, library):
    rows = [(i, "prompt words here " * (i % 5), "answer " * (1 + i * 7 % 40)) for i in range(120)]
    frame = spark.createDataFrame(rows, "doc_id bigint, prompt string, text string").coalesce(1)
    got = packing.pack(frame, PATH, prompt_col="prompt", max_tokens=64, max_segments=4, max_loss=40, with_ids=True).collect()
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        by_seq[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    assert all(sum(r.length for r in x) <= 64 and len(x) <= 4 and sum(r.loss_tokens for r in x) <= 40 for x in by_seq.values())
    for i, p, t in rows:
        ids = library.encode(p, add_special_tokens=False).ids if p else []
        ids = ids + library.encode(t, add_special_tokens=False).ids + [0]
        assert [x for r in sorted(by_doc[i], key=lambda r: r.start) for x in r.ids] == ids
    whole = packing.pack(frame, PATH, prompt_col="prompt", max_tokens=256, max_segments=8, max_loss=200, cut=False).collect()
    assert len(whole) == len(rows)
