"""Packing by vector bin packing with a dot-product heuristic.

An example is a vector (tokens, segments, loss-bearing tokens); a sequence has
a limit for each. The sequence being filled takes, of all waiting examples that
fit, the one whose demand has the largest dot product with what the sequence
has left (both as shares of the limits). When none fits and cutting is allowed,
the best one is cut so that the sequence becomes full. Full-length stretches of
long examples are sequences of their own.

Each task packs what it reads, with a pool of at most `POOL` waiting examples
that goes on from batch to batch, so there is no shuffle, memory is bounded and
a task leaves at most one sequence unfilled. Sequence numbers are the task's
partition number and a counter, so a retried task gives the same ones.

Loss-bearing tokens: all ids of an example that come after its prompt and are
not the first of their piece (nothing in the sequence's piece predicts those).

Defined results: a null or empty text is the end id alone; every row is packed,
repeated rows as examples of their own; other columns are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hrsight.llm.encode import encoder
from hrsight.llm.tasks import _arrow_schema, pieces, ship

POOL = 512


class Packer:
    """Fills sequences one after the other from a bounded pool of waiting examples."""

    def __init__(self, part, max_tokens, max_segments, max_loss, cut):
        self.limits = np.array([max_tokens, max_segments, max_loss], dtype=np.float64)
        self.max_tokens, self.max_loss, self.cut = max_tokens, max_loss, cut
        self.number = part << 33
        self.items: list = [None] * (POOL + 1)  # [key, ids, next position, prompt ids]
        self.need = np.zeros((POOL + 1, 3))
        self.waits = np.zeros(POOL + 1, dtype=bool)
        self.free = list(range(POOL, -1, -1))
        self.rows: list = []

    @staticmethod
    def loss(item, length):
        """Loss-bearing tokens among the item's next `length` ids."""
        return max(0, length - max(1, item[3] - item[2]))

    @staticmethod
    def longest(item, tokens, loss):
        """The most ids of the item that keep within tokens and loss."""
        _, ids, at, prompt = item
        return int(min(len(ids) - at, tokens, max(1, prompt - at) + loss))

    def place(self, item, length, offset):
        key, ids, at, _ = item
        piece = ids[at:at + length]
        lost = self.loss(item, length)
        self.rows.append((key, at, length, zlib.crc32(piece.tobytes()), len(ids), self.number, offset, lost, piece))
        item[2] += length
        return np.array([length, 1, lost], dtype=np.float64)

    def update(self, slot):
        """The slot's demand after its item changed; a finished item leaves the pool."""
        item = self.items[slot]
        rest = len(item[1]) - item[2]
        if rest:
            self.need[slot] = rest, 1, self.loss(item, rest)
            self.waits[slot] = True
        else:
            self.items[slot] = None
            self.waits[slot] = False
            self.free.append(slot)

    def add(self, key, ids, prompt=0):
        """Take an example; full-length stretches of a long one become sequences at once."""
        item = [key, ids, 0, prompt]
        while (rest := len(ids) - item[2]) >= self.max_tokens or rest and not self.cut and self.loss(item, rest) > self.max_loss:
            self.place(item, self.longest(item, self.max_tokens, self.max_loss), 0)
            self.number += 1
        if rest:
            if not self.free:
                self.fill(POOL // 2)
            slot = self.free.pop()
            self.items[slot] = item
            self.update(slot)

    def fill(self, low):
        """Fill sequences until at most `low` examples wait."""
        share = self.limits * self.limits
        while len(self.items) - len(self.free) > low:
            left, offset = self.limits.copy(), 0
            while True:
                score = self.need @ (left / share)
                fits = self.waits & (self.need <= left).all(axis=1)
                whole = fits.any()
                if not whole and not (self.cut and left[0] >= 1 and left[1] >= 1):
                    break
                slot = int(np.argmax(np.where(fits if whole else self.waits, score, -1.0)))
                item = self.items[slot]
                length = len(item[1]) - item[2] if whole else self.longest(item, left[0], left[2])
                left -= self.place(item, length, offset)
                offset += length
                self.update(slot)
                if not whole or len(self.free) == len(self.items):
                    break
            self.number += 1

    def take(self):
        rows, self.rows = self.rows, []
        return rows


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
         prompt_col: str | None = None, end_id: int = 0, max_tokens: int = 1024, max_segments: int = 64,
         max_loss: int = 1024, cut: bool = True, with_ids: bool = False) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens (and its ids).

    `prompt_col` names a text that comes before `text_col` and bears no loss.
    Without `cut` only examples longer than a limit are divided.
    """
    cols = [F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")]
    if prompt_col is not None:
        cols.append(F.col(f"`{prompt_col}`").alias("prompt"))
    src = docs.select(*cols)
    id_type = src.schema["id"].dataType.simpleString()
    ddl = (f"id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
           "offset bigint, loss_tokens bigint" + (", ids array<bigint>" if with_ids else ""))
    schema = _arrow_schema(docs.sparkSession, ddl)
    ship(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        tok = encoder(tokenizer, "ids")
        packer = Packer(TaskContext.get().partitionId(), max_tokens, max_segments, max_loss, cut)

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for part, texts in pieces(batch, "text"):
                keys = part.column(0).to_pylist()
                made = tok.encode(texts)
                before = tok.encode(part.column(2).to_pylist()) if prompt_col is not None else [b""] * len(texts)
                for key, head, ids in zip(keys, before, made):
                    ids = np.frombuffer(head + ids, dtype=tok.width).astype("<u4")
                    n = len(head) // tok.width.itemsize
                    packer.add(key, np.append(ids, np.uint32(end_id)), n)
                if packer.rows:
                    yield batch_of(packer.take())
        packer.fill(0)
        if packer.rows:
            yield batch_of(packer.take())

    return src.mapInArrow(run, ddl).withColumnRenamed("id", id_col)


def op10(spark, sf_dir):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
