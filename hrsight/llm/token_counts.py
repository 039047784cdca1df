"""Token counts per document by a map-side two-tier lookup.

First tier: a compact table of the corpus' most frequent text units and their
token counts, broadcast to all tasks. It is built from a pass over all texts in
which each task counts its units under a fixed memory bound and passes on only
its heaviest ones, so no unit of text is shuffled beyond these short lists.
Second tier: units that the table lacks are encoded by the library and kept in
a cache of the Python worker. The table's size is fixed, so the broadcast has a
proven bound; it decides only how often a worker has to encode, never a count.

Defined results: null and empty texts have 0 bytes and 0 tokens; every row is
returned, repeated rows repeatedly; no other column is looked at.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hrsight.llm.encode import encoder
from hrsight.llm.tasks import map_arrow, ship

#: Units in the broadcast table, units that a task passes on, units that a task counts at a time.
TABLE, PASSED, COUNTED = 1 << 16, 1 << 12, 1 << 18


def frequent_units(texts: DataFrame, path: str) -> tuple[str, bytes]:
    """(blank-joined units, one count byte each): at most TABLE units over the whole corpus."""

    def heavy(batches):
        seen = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    seen.update(t.split(" "))
                    if len(seen) > COUNTED:
                        seen = Counter(dict(seen.most_common(COUNTED // 4)))
        top = [(p, n) for p, n in seen.most_common(PASSED) if p and not p[-1].isspace()]
        import pyarrow as pa

        yield pa.RecordBatch.from_pydict({"unit": [p for p, _ in top], "n": [n for _, n in top]},
                                         schema=pa.schema([("unit", pa.string()), ("n", pa.int64())]))

    ship(texts.sparkSession)
    rows = (texts.mapInArrow(heavy, "unit string, n bigint").groupBy("unit").agg(F.sum("n").alias("n"))
            .orderBy(F.desc("n"), "unit").limit(TABLE).select("unit").collect())
    units = [r.unit for r in rows]
    known = encoder(path, "lengths")
    counts = [min(known.tok.encode(" " + u, add_special_tokens=False).__len__(), 255) for u in units]
    kept = [(u, c) for u, c in zip(units, counts) if c < 255]
    return " ".join(u for u, _ in kept), bytes(c for _, c in kept)


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 512) -> DataFrame:
    """Per input row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    id_type = src.schema["id"].dataType.simpleString()
    first = None
    if encoder(tokenizer, "lengths").units:
        first = docs.sparkSession.sparkContext.broadcast(frequent_units(src.select("text"), tokenizer))

    def count(batch, texts):
        known = encoder(tokenizer, "lengths")
        if first is not None and not known.young:
            units, lengths = first.value
            if lengths:
                known.load(units.split(" "), lengths)
        yield {"id": batch.column(0), "n_bytes": [0 if t is None else len(t.encode()) for t in texts],
               "n_tokens": np.array(known.encode(texts), dtype=np.int64)}

    out = map_arrow(src, "text", count, f"id {id_type}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op7(spark, sf_dir):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
