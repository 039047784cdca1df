"""Near-equal lines by a deletion-neighbourhood join, keeping the earliest.

Lines are compared word by word; the edit bound is one word inserted, deleted or
replaced. All variants of a line within the bound are emitted as hashed keys: the
line itself, and the line without its word p, for every p. Equal keys join:

* two lines without their word p, same p and same rest: one word replaced;
* a whole line and another without one word: one word inserted or deleted.

Those are all pairs within the bound, each by a key of at most one deletion on
either side. A key needs only its earliest members, so a group of any size is a
map-side aggregation, not a list of pairs; each line's earliest partner is then
verified by the exact word edit distance on the texts.

Two steps keep the number of variants small. Equal lines are one row first. And
of two lines within the bound, the first or the last h = floor(n / 2) words of
the shorter are equal, so only lines that share such a half with another line
(exact: no pair is lost) emit their variants at all.

A line is removed if an equal line, or a line within the bound, first occurs
earlier: in a document with a smaller id, or further up in the same document.
Decisions are taken on the input, not on what is left.

Defined results: lines end at \\n; equal lines (the same words) are found at any
length, near ones only among lines of at least `min_words` words (five: one word
of five is the similarity of 0.8); a line without words always stays; null and empty texts have no line to remove; rows with a null id are neither
compared nor changed; rows that repeat an id and a text are one document, other
texts of the same id come one after the other in the order of their xxhash64.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hrsight.llm.tasks import LAID_OUT, drop, fresh, map_arrow, saved
from hrsight.llm.textnp import _BASE, _INV, U64, mix64, powers, words_of


def _lines(texts):
    """(text number, line number, line) of every line that is not empty."""
    return [(i, j, x) for i, t in enumerate(texts) if t for j, x in enumerate(t.split("\n")) if x]


def _sequence(h):
    """Running polynomial over a word sequence's fingerprints: run[j] - run[i] covers words i..j-1."""
    with np.errstate(over="ignore"):
        return np.concatenate((np.zeros(1, dtype=U64), np.cumsum(h * powers(_BASE, len(h)))))


def _part(run, first, last, size):
    """Fingerprints of the word ranges first..last, each normalised to start at 0."""
    with np.errstate(over="ignore"):
        return mix64((run[last] - run[first]) * powers(_INV, len(run))[first] + mix64(size.astype(U64)))


def _line_rows(docs, min_words):
    """One row for each line with words: its fingerprint, its place, and the keys of its halves (none for a short line)."""

    def split(batch, texts):
        rows = _lines(texts)
        h, first, _, _ = words_of([r[2] for r in rows])
        n = np.diff(first)
        keep = np.flatnonzero(n)
        f, n = first[keep], n[keep]
        run = _sequence(h)
        half = n // 2
        tag = lambda x, size, side: mix64(x + mix64(size.astype(U64) * U64(2) + U64(side))).view(np.int64)
        cols = []
        for size in (half, half - (n % 2 == 0)):  # a line of 2h words also meets lines of 2h - 1
            cols.append(tag(_part(run, f, f + size, size), size, 0))
            cols.append(tag(_part(run, f + n - size, f + n, size), size, 1))
        keys = np.stack(cols, axis=1).reshape(-1, 4).tolist()
        ids, copies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        yield {"hash": _part(run, f, f + n, n).view(np.int64), "id": [ids[rows[k][0]] for k in keep],
               "copy": [copies[rows[k][0]] for k in keep], "line": [rows[k][1] for k in keep],
               "halves": [[] if m < min_words else k if m % 2 == 0 else k[:2] for k, m in zip(keys, n.tolist())]}

    id_type = docs.schema["id"].dataType.simpleString()
    return map_arrow(docs, "text", split, f"hash bigint, id {id_type}, copy bigint, line int, halves array<bigint>", LAID_OUT)


def _variants(batch, texts):
    """Keys of each line: whole (place -1) and without word p."""
    h, first, _, _ = words_of(texts)
    run, n = _sequence(h), np.diff(first)
    line = np.repeat(np.arange(len(texts)), n + 1)
    place = np.arange(len(line)) - np.repeat(np.concatenate(([0], np.cumsum(n + 1)))[:-1], n + 1) - 1
    f, end = first[line], first[line] + n[line]
    cut = place >= 0
    gone = np.where(cut, f + place, end)
    with np.errstate(over="ignore"):
        inv = powers(_INV, len(run) + 1)
        after = (run[end] - run[np.minimum(gone + 1, end)]) * inv[1]  # what follows moves up by one
        total = (run[gone] - run[f] + np.where(cut, after, U64(0))) * inv[f]
        key = mix64(total + mix64((n[line] - cut).astype(U64)))
    hashes = np.array(batch.column(0).to_pylist(), dtype=np.int64)
    yield {"key": key.view(np.int64), "place": place, "hash": hashes[line]}


def kept_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5) -> DataFrame:
    """(id, copy, lines): the numbers of the lines with words that stay; `copy` is xxhash64 of the text."""
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("copy"),
                      F.col(f"`{text_col}`").alias("text")).where("id IS NOT NULL AND text != ''")
    rows = saved(_line_rows(src, min_words), "line_rows")
    lines = saved(rows.groupBy("hash").agg(F.min(F.struct("id", "copy", "line")).alias("at")), "lines")
    halves = rows.select("hash", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("hash").alias("lo"), F.max("hash").alias("hi")).where("lo != hi").select("half")
    wanted = saved(halves.join(shared, "half", "left_semi").select("hash").distinct().join(lines, "hash"), "wanted")
    drop(rows)
    per_doc = wanted.groupBy("at.id", "at.copy").agg(F.collect_list(F.struct("hash", F.col("at.line").alias("line"))).alias("lines"))

    def cut_out(batch, texts):
        got = [(w["hash"], t.split("\n")[w["line"]]) for t, ws in zip(texts, batch.column(1).to_pylist()) for w in ws]
        yield {"hash": [g[0] for g in got], "body": [g[1] for g in got]}

    bodies = map_arrow(src.join(per_doc, ["id", "copy"]).select("text", "lines"), "text", cut_out, "hash bigint, body string")
    bodies = saved(bodies.groupBy("hash").agg(F.min("body").alias("body")), "bodies")
    variants = saved(map_arrow(bodies, "body", _variants, "key bigint, place int, hash bigint", LAID_OUT), "variants")
    # a key that one variant has joins nothing
    met = variants.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    keys = saved(variants.join(met, "key", "left_semi").join(wanted, "hash"), "met")
    drop(variants)
    # the earliest member of every key: of the lines without word p, for each p, and of the whole lines
    best = saved(keys.groupBy("key", "place").agg(F.min(F.struct("at", "hash")).alias("best")), "earliest")
    cut, whole = best.where("place >= 0"), best.where("place < 0").select("key", "best")
    replaced = keys.where("place >= 0").join(cut, ["key", "place"])
    longer = keys.where("place >= 0").join(whole, "key")
    shorter = keys.where("place < 0").join(cut.groupBy("key").agg(F.min("best").alias("best")), "key")
    partner = reduce(DataFrame.unionByName, [x.where("best.at < at").select("hash", "best") for x in (replaced, longer, shorter)])
    partner = partner.groupBy("hash").agg(F.min("best").alias("best")).select("hash", F.col("best.hash").alias("other"))
    pairs = partner.join(bodies, "hash").join(bodies.select(F.col("hash").alias("other"), F.col("body").alias("near")), "other")

    def check(batch, texts):
        ok = [i for i, (a, b) in enumerate(zip(texts, batch.column(2).to_pylist())) if within_one(a, b)]
        yield {"hash": batch.column(0).take(pa.array(ok, pa.int64()))}

    near = saved(map_arrow(pairs.select("hash", "body", "near"), "body", check, "hash bigint"), "near")
    drop(keys, best, bodies, wanted)
    return lines.join(near, "hash", "left_anti").groupBy("at.id", "at.copy").agg(F.collect_list("at.line").alias("lines"))


def split_words(line):
    """Words `[^\\x20\\x09-\\x0D]+` of a line."""
    return line.translate(_TO_BLANK).split(" ")


_TO_BLANK = {c: " " for c in (0x09, 0x0A, 0x0B, 0x0C, 0x0D)}


def within_one(a, b):
    """Whether the word sequences are at most one insertion, deletion or replacement apart."""
    x, y = [w for w in split_words(a) if w], [w for w in split_words(b) if w]
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1:
        return False
    i = 0
    while i < len(x) and x[i] == y[i]:
        i += 1
    return x[i + (len(x) == len(y)):] == y[i + 1:]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5) -> DataFrame:
    """The rows of `docs` with the removed lines taken out of the text, and `lines_removed` (their numbers)."""
    stays, copy, out_col = fresh(docs, "kept_lines"), fresh(docs, "text_copy"), fresh(docs, "lines_removed")
    kept = kept_lines(docs, id_col, text_col, min_words).select(
        F.col("id").alias(id_col), F.col("copy").alias(copy), F.col("lines").alias(stays))
    rows = docs.withColumn(copy, F.xxhash64(F.col(f"`{text_col}`"))).join(kept, [id_col, copy], "left")
    ddl = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in docs.columns) + f", `{out_col}` array<int>"
    others = [c for c in docs.columns if c != text_col]

    def cut(batch, texts):
        column = lambda c: batch.column(batch.schema.get_field_index(c))
        new, gone = [], []
        for key, t, s in zip(column(id_col).to_pylist(), texts, column(stays).to_pylist()):
            drop_ = []
            if key is not None and t:
                parts, s = t.split("\n"), set(s or ())
                drop_ = [j for j, x in enumerate(parts) if j not in s and any(split_words(x))]
            if drop_:
                out = set(drop_)
                t = "\n".join(x for j, x in enumerate(parts) if j not in out)
            new.append(t)
            gone.append(drop_)
        yield {c: column(c) for c in others} | {text_col: new, out_col: gone}

    return map_arrow(rows.select(*[F.col(f"`{c}`") for c in docs.columns], stays), text_col, cut, ddl)


def op3(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select(
        "doc_id", F.size("lines_removed").cast("bigint").alias("n_removed"),
        F.array_join(F.col("lines_removed").cast("array<string>"), ",").alias("lines_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
