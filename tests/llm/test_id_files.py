"""Length-limited Huffman files: code properties, bit round trips, whole tables."""

import heapq
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hrsight.llm import id_files
from hrsight.llm.tasks import new_folder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def huffman_cost(counts):
    heap = [c for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    return cost


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 10_000), min_size=2, max_size=200))
def test_lengths_are_optimal_and_prefix_free(counts):
    counts = np.array(counts, dtype=np.int64)
    if (counts > 0).sum() < 2:
        return
    free = id_files.code_lengths(counts, 40)
    assert int((free * counts).sum()) == huffman_cost(counts.tolist())
    bits = max(8, int(np.ceil(np.log2((counts > 0).sum()))))
    limited = id_files.code_lengths(counts, bits)
    assert limited.max() <= bits
    assert sum(2.0 ** -int(x) for x in limited if x) == 1.0


def test_limit_binds():
    counts = np.array([int(1.7 ** i) + 1 for i in range(40)], dtype=np.int64)
    limited = id_files.code_lengths(counts, 8)
    assert limited.max() == 8 and id_files.code_lengths(counts, 30).max() > 8
    with pytest.raises(ValueError):
        id_files.code_lengths(np.ones(300, dtype=np.int64), 8)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300), min_size=1, max_size=1500), min_size=1, max_size=5))
def test_round_trip_of_blocks(blocks):
    ids = [np.array(b, dtype=np.int64) for b in blocks]
    counts = np.bincount(np.concatenate(ids))
    lengths = id_files.code_lengths(counts, 10)
    codes, _ = id_files.canonical(lengths)
    made = [id_files.encode_bits(b, codes, lengths) for b in ids]
    back = id_files.decode_bits([m[0] for m in made], [m[1] for m in made], [len(b) for b in ids],
                                id_files.decode_table(lengths, 10), 10)
    assert np.array_equal(back, np.concatenate(ids))


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tok = Tokenizer.from_file(PATH)
    path = new_folder(spark, "test-ids")
    id_files.write_ids(docs.withColumn("part", docs["source"]), path, PATH)
    got = {r.id: r for r in id_files.read_ids(spark, path).collect()}
    start = 0
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        g = got[r.doc_id]
        assert (g.start, g.n_tokens, g.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        assert bytes(g.ids) == ids.tobytes()
        start += len(ids)
    order = [x for r in spark.read.parquet(f"{path}/blocks").orderBy("part", "block").collect() for x in r.ids]
    assert order == sorted(order)


def test_edges(spark):
    tok = Tokenizer.from_file(PATH)
    rows = [(3, None), (1, ""), (2, "a b" * 30_000), (2, "twice"), (2, "twice"), (None, "no id")]
    path = new_folder(spark, "test-ids")
    id_files.write_ids(spark.createDataFrame(rows, "doc_id int, text string"), path, PATH)
    got = sorted((r.start, r.id, r.n_tokens) for r in id_files.read_ids(spark, path).collect())
    assert [g[1] for g in got] == [None, 1, 2, 2, 2, 3]
    assert sorted(g[2] for g in got) == sorted(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    empty = new_folder(spark, "test-ids")
    id_files.write_ids(spark.createDataFrame([], "doc_id int, text string"), empty, PATH)
    assert id_files.read_ids(spark, empty).count() == 0
