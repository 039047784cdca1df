"""Token ids in files: canonical length-limited Huffman code from global counts.

Writing: texts are encoded once into a table of ids in the shared folder; the
counts of all ids (one row for each id of the vocabulary at most) give code
lengths by package-merge, limited to `max_bits`; ids are then dealt by document
id, in ascending order, and coded.

Format, a Parquet folder: `blocks`, each with whole documents that hold about
`BLOCK` ids (one longer document is one block): part and block number, ids
before the block within its part, the documents' ids and lengths, the packed
bits, and the bit offset of every `STEP`-th id. A block needs nothing but the
code lengths to be decoded, and its checkpoints let a reader start at any of
those offsets; the decoder here runs from all of them at once, one table
look-up a step. `code` holds the code lengths, one row.

Defined results: a null or empty text is the end id alone; repeated document
ids are written one after the other; rows with a null id come first; other
columns are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hrsight.llm.encode import encoder
from hrsight.llm.tasks import _arrow_schema, _array, drop, new_folder, pieces, saved, ship

BLOCK, STEP = 1 << 15, 1 << 9


# ---- the code ----

def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Package-merge: optimal code lengths of at most `max_bits` for the ids with a count (0 for others)."""
    out = np.zeros(len(counts), dtype=np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} ids need more than {max_bits} bits")
    order = used[np.lexsort((used, counts[used]))]
    weights = counts[order].astype(np.float64 if counts.sum() > 1 << 52 else np.int64)
    leaves = np.ones(len(order), dtype=bool)
    levels, now, is_leaf = [], weights, leaves
    for _ in range(max_bits):
        levels.append(is_leaf)
        pairs = now[: len(now) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((weights, pairs))
        by = np.argsort(both, kind="stable")
        now, is_leaf = both[by], by < len(weights)
    take = 2 * len(order) - 2
    depth = np.zeros(len(order), dtype=np.int64)
    for is_leaf in reversed(levels):
        chosen = int(is_leaf[:take].sum())
        depth[:chosen] += 1
        take = 2 * (take - chosen)
    out[order] = depth
    return out


def canonical(lengths: np.ndarray):
    """(code of each id, ids in code order): codes ascend by (length, id)."""
    ids = np.flatnonzero(lengths)
    ids = ids[np.lexsort((ids, lengths[ids]))]
    codes = np.zeros(len(lengths), dtype=np.uint64)
    code, last = 0, 0
    for i in ids.tolist():
        n = int(lengths[i])
        code <<= n - last
        codes[i] = code
        code, last = code + 1, n
    return codes, ids


def decode_table(lengths: np.ndarray, max_bits: int):
    """(id, length) of the code that each `max_bits`-bit window begins with."""
    codes, ids = canonical(lengths)
    width = lengths[ids].astype(np.int64)
    span = np.left_shift(1, max_bits - width)
    at = codes[ids].astype(np.int64) << (max_bits - width)
    sym, size = np.zeros(1 << max_bits, dtype=np.uint32), np.ones(1 << max_bits, dtype=np.uint8)
    where = np.repeat(at - np.concatenate(([0], np.cumsum(span)[:-1])), span) + np.arange(span.sum())
    sym[where], size[where] = np.repeat(ids, span), np.repeat(width, span)
    return sym, size


def encode_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray):
    """(bytes, bit offset of every STEP-th id)."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    begin = ends - n
    total = int(ends[-1]) if len(ends) else 0
    words = np.zeros(total // 32 + 2, dtype=np.uint64)
    # each code within a 64-bit window that begins at its 32-bit word
    value = codes[ids] << (np.uint64(64) - (begin & 31).astype(np.uint64) - n.astype(np.uint64))
    word = begin >> 5
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(word) else word
    if len(word):
        joined = np.bitwise_or.reduceat(value, first)
        at = word[first]
        words[at] |= joined >> np.uint64(32)
        words[at + 1] |= joined & np.uint64(0xFFFFFFFF)
    raw = words.astype(">u4").tobytes()[: (total + 7) // 8]
    return raw, begin[::STEP].astype("<u4")


def decode_bits(raws, offsets, counts, table, max_bits):
    """Ids of several blocks: all checkpoints of all blocks advance together, one id a step."""
    sym, size = table
    joined = np.frombuffer(b"".join(raws) + b"\0" * 8, dtype=np.uint8)
    base = np.concatenate(([0], np.cumsum([len(r) for r in raws])))[:-1] * 8
    at = np.concatenate([b + o.astype(np.int64) for b, o in zip(base, offsets)])
    lanes = np.concatenate([np.minimum(STEP, c - np.arange(0, c, STEP)) for c in counts])
    out = np.zeros((len(at), STEP), dtype=np.uint32)
    order = np.argsort(-lanes, kind="stable")
    at, live = at[order], lanes[order]
    windows = np.ndarray(len(joined) - 3, dtype=">u4", buffer=joined.data, strides=(1,))
    down = 32 - max_bits
    mask = (1 << max_bits) - 1
    n = len(at)
    for step in range(STEP):
        while n and live[n - 1] <= step:
            n -= 1
        if not n:
            break
        p = at[:n]
        w = (windows[p >> 3].astype(np.int64) >> (down - (p & 7))) & mask
        out[:n, step] = sym[w]
        at[:n] = p + size[w]
    back = np.empty_like(out)
    back[order] = out
    return back[np.arange(STEP) < lanes[:, None]]


# ---- writing and reading ----

def write_ids(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
              end_id: int = 0, max_bits: int = 16) -> None:
    """Encode every text (and an end id) and write the files described above to `path`."""
    spark = docs.sparkSession
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    id_type = src.schema["id"].dataType.simpleString()

    made = f"id {id_type}, width int, ids binary, counts binary"
    schema = _arrow_schema(spark, made)

    def tokenise(batches):
        """A row for each text; at the end one with the counts of all ids of the task."""
        tok = encoder(tokenizer, "ids")
        width = tok.width.itemsize
        end = np.array([end_id], dtype=tok.width).tobytes()
        seen = np.zeros(0, dtype=np.int64)

        def rows(ids, width, raw, counts):
            return pa.RecordBatch.from_arrays([_array(c, f.type) for c, f in zip((ids, width, raw, counts), schema)], schema=schema)

        for batch in batches:
            for part, texts in pieces(batch, "text"):
                got = [x + end for x in tok.encode(texts)]
                n = np.bincount(np.frombuffer(b"".join(got), dtype=tok.width), minlength=len(seen))
                n[: len(seen)] += seen
                seen = n
                yield rows(part.column(0), [width] * len(got), got, [None] * len(got))
        some = np.flatnonzero(seen)
        yield rows([None], [None], [None], [np.stack([some, seen[some]]).astype("<i8").tobytes()])

    def unpack(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays(list(map(pa.array, np.frombuffer(raw, "<i8").reshape(2, -1))), names=["sym", "n"])

    ship(spark)
    table = saved(src.mapInArrow(tokenise, made), "ids", compression="zstd")
    rows = (table.where("counts IS NOT NULL").select("counts").mapInArrow(unpack, "sym bigint, n bigint")
            .groupBy("sym").agg(F.sum("n").alias("n")).collect())  # one row for each id of the vocabulary at most
    counts = np.zeros(max((r.sym for r in rows), default=0) + 1, dtype=np.int64)
    for r in rows:
        counts[r.sym] = r.n
    while (counts > 0).sum() > 1 << max_bits:
        max_bits += 1
    lengths = code_lengths(counts, max_bits)
    spark.createDataFrame([(max_bits, bytearray(lengths.tobytes()))], "max_bits int, lengths binary").coalesce(1) \
        .write.parquet(f"{path}/code")
    ddl = (f"part int, block int, before bigint, n_ids bigint, ids array<{id_type}>, sizes array<bigint>, "
           "checkpoints binary, bits binary")
    schema = _arrow_schema(spark, ddl)
    shared = spark.sparkContext.broadcast(lengths)

    def code(batches):
        length = shared.value
        codes, _ = canonical(length)
        part, number, before = TaskContext.get().partitionId(), 0, 0
        keys, held, size = [], [], 0

        def block():
            nonlocal number, before, keys, held, size
            ids = np.concatenate(held)
            bits, marks = encode_bits(ids, codes, length)
            cols = [[part], [number], [before], [len(ids)], [keys], [[len(x) for x in held]], [marks.tobytes()], [bits]]
            number, before = number + 1, before + len(ids)
            keys, held, size = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

        for batch in batches:
            for key, width, raw in zip(*(c.to_pylist() for c in batch.columns)):
                keys.append(key)
                held.append(np.frombuffer(raw, dtype=f"<u{width}"))
                size += len(held[-1])
                if size >= BLOCK:
                    yield block()
        if keys:
            yield block()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table.where("width IS NOT NULL").select("id", "width", "ids").repartitionByRange(parts, "id").sortWithinPartitions("id").mapInArrow(code, ddl) \
        .write.option("compression", "none").parquet(f"{path}/blocks")
    drop(table)


def read_ids(spark, path: str, with_ids: bool = True) -> DataFrame:
    """Per document, decoded from the files: id, start (ids before it), n_tokens, ids_crc32, ids (little-endian u32 bytes).

    Without `with_ids` the decoded ids end in their checksum and aren't handed on."""
    head = spark.read.parquet(f"{path}/code").first()
    table = spark.sparkContext.broadcast((head.max_bits, np.frombuffer(bytes(head.lengths), dtype=np.uint8)))
    blocks = spark.read.parquet(f"{path}/blocks")
    id_type = blocks.schema["ids"].dataType.elementType.simpleString()
    ddl = f"id {id_type}, part int, within bigint, n_tokens bigint, ids_crc32 bigint, ids binary"
    schema = _arrow_schema(spark, ddl)
    ship(spark)

    def read(batches):
        max_bits, lengths = table.value
        ready = decode_table(lengths, max_bits)
        for batch in batches:
            got = batch.to_pydict()
            begin = 0
            while begin < batch.num_rows:
                end, size = begin, 0
                while end < batch.num_rows and (end == begin or size + got["n_ids"][end] <= 1 << 21):
                    size += got["n_ids"][end]
                    end += 1
                flat = decode_bits(got["bits"][begin:end], [np.frombuffer(c, dtype="<u4") for c in got["checkpoints"][begin:end]],
                                   got["n_ids"][begin:end], ready, max_bits)
                rows, at = [], 0
                for b in range(begin, end):
                    within = got["before"][b]
                    for key, n in zip(got["ids"][b], got["sizes"][b]):
                        raw = flat[at:at + n].astype("<u4").tobytes()
                        rows.append((key, got["part"][b], within, n, zlib.crc32(raw), raw if with_ids else None))
                        at, within = at + n, within + n
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                begin = end

    per_part = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # one row for each written part: an ordered running sum over so few rows
    offsets = per_part.selectExpr("part", "sum(n) OVER (ORDER BY part) - n AS base")
    docs = blocks.select("part", "before", "n_ids", "ids", "sizes", "checkpoints", "bits").mapInArrow(read, ddl)
    return docs.join(F.broadcast(offsets), "part").select(
        "id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def op4(spark, sf_dir):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = new_folder(spark, "id-files")
    write_ids(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_ids(spark, path, with_ids=False).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")
