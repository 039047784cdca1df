"""The corpus pipeline: stages over `documents`, each by one of the operators in hrsight.llm.

`STAGES` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a frame. `run` applies them in order, writing each stage's rows as
Parquet to the shared folder and reading them back as the next stage's docs.
All stages but the last return the columns of `docs`.

Rows are told apart by document id and text; rows with a null id go through
every filter (only the quality rules, which need no id, can reject them).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from hrsight.llm import decontaminate, line_dedup, near_dup, packing, quality_rules
from hrsight.llm.tasks import fresh, saved


def without(docs, gone, text):
    """The rows of `docs` whose (doc_id, hash of `text`) isn't in `gone` (doc_id, text_hash)."""
    mark = fresh(docs, "row_hash")
    keys = gone.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    rows = docs.withColumn(mark, F.xxhash64(text))
    same = rows["doc_id"].eqNullSafe(keys["gone_id"]) & (rows[mark] == keys["gone_hash"])
    return rows.join(keys, same, "left_anti").drop(mark)


def quality(spark, docs, sf_dir):
    """Documents that the base rules or the learned decision list reject go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality_rules.judge(docs, labels)
    return without(docs, judged.where(~F.col("kept")), F.col("text"))


def lines(spark, docs, sf_dir):
    """Later copies of lines (up to one word of difference) go; so does a document of which nothing is left."""
    out = line_dedup.dedup_lines(docs)
    cut = out.columns[-1]
    blank = F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")) == 0
    out = out.where(~(blank & (F.size(cut) > 0)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(cut) > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
                             .otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_duplicates(spark, docs, sf_dir):
    """Of every group of near duplicates (five-word shingles, similarity 0.8) the document with the smallest id stays."""
    found = near_dup.near_duplicates(docs, k=5, percent=80, bands=40)
    return without(docs, found.where(~F.col("kept")), F.col("text"))


def decontaminated(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(docs, benchmark)
    return without(docs, found.where("contaminated"), F.lower("text"))


def packed(spark, docs, sf_dir):
    """Sequences of at most 1024 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: The stages hold a learned rule list and near-duplicate search: not expressible in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
