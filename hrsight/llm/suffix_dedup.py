"""Repeated passages by suffix order and longest-previous-factor arrays.

A window is a string of `length` bytes. Wanted are the windows that start in more
than one place, anywhere in the corpus.

1. Anchors. Each window picks the `gram`-byte string in it with the smallest hash
   (the leftmost of equal ones). Equal windows pick equal strings at the same
   offset, so only windows whose anchors are equal can be equal. Runs of windows
   with one anchor are one row: its fingerprint, that of the whole run of bytes
   (the segment), and the place. About one row for 150 bytes.
2. Rows whose anchor occurs once are done. Where whole segments are equal, all
   their windows are; one segment of each kind goes on, if its anchor has others.
3. Suffix order. The segments of an anchor meet in one task, which sorts their
   window starts by the following `length` bytes (prefix doubling: ranks of 8,
   16, ... bytes), ties by place in the corpus. With ties in that order the
   previous smaller position of a suffix in the order, the earlier place that
   shares its longest prefix, is its predecessor, and the longest previous factor
   reaches `length` where both have the same rank. Those suffixes are later
   copies; the first of a tie is the passage that stays.
4. An anchor with more than `GROUP` different segments (a passage in very many
   documents) is not gathered: its windows are dealt out by their fingerprints
   and counted, with map-side aggregation; the results are the same.

`repeats` returns, per document, the runs of windows that occur elsewhere, and
whether each also occurs earlier. Fingerprints are 64 bits of the anchor and 64
bits of the segment or window, which must agree together.

Defined results: matches never cross documents; texts are judged as UTF-8 bytes
on the input, not on what is left; null and empty texts have nothing to remove;
rows that repeat an id are occurrences of their own (what they share is
repeated); rows with a null id count as occurrences and are returned untouched
in `remove_repeats`; other columns are not looked at. A text of any length is
taken in stretches of `STRETCH` window starts, so memory does not follow it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hrsight.llm.tasks import _arrow_schema, drop, map_arrow, saved, ship
from hrsight.llm.textnp import _BASE, _BYTE, _INV, U64, mix64, powers

GROUP, STRETCH, BATCH = 4096, 1 << 21, 1 << 21


def _running(buf):
    """Prefix sums of the byte polynomial."""
    run = np.empty(len(buf) + 1, dtype=U64)
    run[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[buf] * powers(_BASE, len(buf)), out=run[1:])
    return run


def _hash(run, begin, end):
    with np.errstate(over="ignore"):
        return mix64((run[end] - run[begin]) * powers(_INV, len(run))[begin])


def sliding_min(x, width):
    """Minimum of every `width` consecutive values: block-wise running minima from both sides."""
    n = len(x) - width + 1
    pad = -len(x) % width
    rows = np.concatenate((x, np.full(pad, np.iinfo(U64).max, dtype=U64))).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def anchors(raw: list[bytes], length: int, gram: int):
    """(text number, key, segment, first window, last window) of every run of windows with one anchor."""
    parts = [(i, at, r[at:at + STRETCH + length - 1]) for i, r in enumerate(raw)
             for at in range(0, max(1, len(r) - length + 1), STRETCH) if len(r) >= length]
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none
    sizes = np.array([len(p[2]) for p in parts])
    begin = np.concatenate(([0], np.cumsum(sizes)))
    buf = np.frombuffer(b"".join(p[2] for p in parts), dtype=np.uint8)
    run = _running(buf)
    at = np.arange(len(buf) - gram + 1)
    key = _hash(run, at, at + gram)
    shift = U64(int(len(buf)).bit_length())
    best = sliding_min(((key >> shift) << shift) | at.astype(U64), length - gram + 1)
    owner = np.repeat(np.arange(len(parts)), np.maximum(0, sizes - length + 1))
    begun = np.concatenate(([0], np.cumsum(np.maximum(0, sizes - length + 1))))
    start = np.arange(len(owner)) - begun[owner] + begin[owner]
    anchor = (best[start] & ((U64(1) << shift) - U64(1))).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    first, last = start[new], start[np.append(new[1:], len(start)) - 1]
    a = anchor[new]
    with np.errstate(over="ignore"):
        segment = mix64(_hash(run, first, last + length) + mix64(((last - first).astype(U64) << U64(32)) | (a - first).astype(U64)))
    part = owner[new]
    base = np.array([p[1] for p in parts])[part] - begin[part]
    return np.array([p[0] for p in parts])[part], key[a].view(np.int64), segment.view(np.int64), first + base, last + base


def ranks(buf: np.ndarray, length: int):
    """Rank of every position's next `length` bytes in byte order (positions too near the end get any rank)."""
    n = len(buf)
    padded = np.concatenate((buf, np.zeros(length + 8, dtype=np.uint8)))
    words = np.ndarray(n, dtype=">u8", buffer=np.ascontiguousarray(padded).data, strides=(1,)).astype(U64)
    rank = np.unique(words, return_inverse=True)[1].astype(U64)
    done = 8
    while done < length:
        step = min(done, length - done)
        after = np.zeros(n, dtype=U64)
        after[:n - step] = rank[step:]
        rank = np.unique((rank << U64(32)) | after, return_inverse=True)[1].astype(U64)
        done += step
    return rank


def previous_factors(rank, place):
    """For suffixes with their rank and their place in the corpus: (has an equal one earlier, has an equal one)."""
    order = np.lexsort((place, rank))
    tie = np.concatenate(([False], rank[order][1:] == rank[order][:-1]))
    later, repeated = np.zeros(len(rank), dtype=bool), np.zeros(len(rank), dtype=bool)
    later[order] = tie
    repeated[order] = tie | np.append(tie[1:], False)
    return later, repeated


def _runs(flags):
    """(begin, end) of the stretches of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edge[0::2], edge[1::2]


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int = 96) -> DataFrame:
    """(id, copy, first, last, later): byte positions of consecutive windows that occur elsewhere; `later`: also earlier.

    `copy` is xxhash64 of the text. Earlier means a smaller id, or further up in the same text.
    """
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("copy"),
                      F.col(f"`{text_col}`").alias("text")).where(F.octet_length(F.col(f"`{text_col}`")) >= length)
    id_type = src.schema["id"].dataType.simpleString()

    def mark(batch, texts):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        doc, key, segment, first, last = anchors(raw, length, gram)
        yield {"key": key, "segment": segment, "id": batch.column(0).take(pa.array(doc, pa.int64())),
               "copy": batch.column(1).take(pa.array(doc, pa.int64())), "first": first, "last": last}

    rows = saved(map_arrow(src, "text", mark, f"key bigint, segment bigint, id {id_type}, copy bigint, first bigint, last bigint"), "anchors")
    often = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    shared = saved(rows.join(often, "key", "left_semi"), "shared")
    drop(rows)
    kinds = shared.groupBy("key", "segment").agg(F.count("*").alias("n"), F.min(F.struct("id", "copy", "first", "last")).alias("at"))
    kinds = saved(kinds, "segments")
    equal = kinds.where("n > 1").select("key", "segment", "at")
    # equal segments: all windows are repeated, and in all but the first place also later copies
    whole = shared.join(equal, ["key", "segment"]).select(
        "id", "copy", "first", "last",
        (F.struct("id", "copy", "first", "last") != F.col("at")).alias("later"))
    mixed = kinds.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1")
    wanted = saved(kinds.join(mixed, "key").select("key", "kinds", "n", "at.*"), "fragments")
    per_doc = wanted.groupBy("id", "copy").agg(F.collect_list(F.struct("key", "kinds", "n", "first", "last")).alias("cuts"))
    sources = src.join(per_doc, src["id"].eqNullSafe(per_doc["id"]) & (src["copy"] == per_doc["copy"])).select(
        src["id"], src["copy"], "text", "cuts")

    def cut(batch, texts):
        out = {c: [] for c in ("key", "kinds", "n", "id", "copy", "first", "last", "body")}
        for key, copy, t, cuts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, batch.column(3).to_pylist()):
            raw = t.encode("utf-8", "surrogatepass")
            for c in cuts:
                for name in ("key", "kinds", "n", "first", "last"):
                    out[name].append(c[name])
                out["id"].append(key)
                out["copy"].append(copy)
                out["body"].append(raw[c["first"]:c["last"] + length])
        yield out

    cols = f"id {id_type}, copy bigint, first bigint, last bigint"
    bodies = map_arrow(sources, "text", cut, f"key bigint, kinds bigint, n bigint, {cols}, body binary")
    bodies = saved(bodies.dropDuplicates(["key", "id", "copy", "first"]), "bodies")
    found = _in_groups(bodies.where(F.col("kinds") <= GROUP), length, cols).unionByName(
        _dealt_out(bodies.where(F.col("kinds") > GROUP), length, cols))
    return whole.unionByName(found)


def _in_groups(bodies, length, cols):
    """Windows of anchors with few segments: suffix order within a task."""
    ddl = f"{cols}, later boolean"
    schema = _arrow_schema(bodies.sparkSession, ddl)
    names = ["key", "id", "copy", "first", "last", "body"]
    ship(bodies.sparkSession)

    def order(rows):
        """Runs of repeated windows among the segments of some anchors."""
        sizes = np.array([len(r[5]) for r in rows])
        begin = np.concatenate(([0], np.cumsum(sizes)))
        rank = ranks(np.frombuffer(b"".join(r[5] for r in rows), dtype=np.uint8), length)
        owner = np.repeat(np.arange(len(rows)), sizes - length + 1)
        begun = np.concatenate(([0], np.cumsum(sizes - length + 1)))
        within = np.arange(len(owner)) - begun[owner]
        by_place = sorted(range(len(rows)), key=lambda i: (rows[i][1] is not None, rows[i][1], rows[i][2], rows[i][3]))
        at = np.empty(len(rows), dtype=np.int64)
        at[by_place] = np.arange(len(rows))
        later, repeated = previous_factors(rank[begin[owner] + within], at[owner] * (1 << 32) + within)
        out = []
        for i, r in enumerate(rows):
            own = slice(begun[i], begun[i + 1])
            for flag, value in ((repeated[own] & ~later[own], False), (later[own], True)):
                for a, b in zip(*_runs(flag)):
                    out.append((r[1], r[2], r[3] + int(a), r[3] + int(b) - 1, value))
        return out

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if size > BATCH and r[0] != last:
                    out = order(held)
                    held, size = [], 0
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                held.append(r)
                size += len(r[5])
                last = r[0]
        out = order(held) if held else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return bodies.select(names).repartition("key").sortWithinPartitions("key").mapInArrow(run, ddl)


def _dealt_out(bodies, length, cols):
    """Windows of anchors with very many segments: dealt out by window fingerprint, one row each."""
    spark = bodies.sparkSession
    id_type = bodies.schema["id"].dataType.simpleString()
    ddl = f"key bigint, window bigint, id {id_type}, copy bigint, at bigint"
    schema = _arrow_schema(spark, ddl)
    ship(spark)

    def windows(batches):
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            for lo in range(0, len(rows), 2000):
                part = rows[lo:lo + 2000]
                sizes = np.array([len(r[4]) for r in part])
                begin = np.concatenate(([0], np.cumsum(sizes)))
                run = _running(np.frombuffer(b"".join(r[4] for r in part), dtype=np.uint8))
                n = sizes - length + 1
                owner = np.repeat(np.arange(len(part)), n)
                within = np.arange(len(owner)) - np.repeat(np.concatenate(([0], np.cumsum(n)))[:-1], n)
                start = begin[owner] + within
                take = pa.array(owner)
                column = lambda j, kind: pa.array([r[j] for r in part], kind).take(take)  # noqa: E731, B023
                first = np.array([r[3] for r in part])
                yield pa.RecordBatch.from_arrays(
                    [column(0, pa.int64()), pa.array(_hash(run, start, start + length).view(np.int64)),
                     column(1, schema.field("id").type), column(2, pa.int64()), pa.array(first[owner] + within)], schema=schema)

    rows = saved(bodies.select("key", "id", "copy", "first", "body").mapInArrow(windows, ddl), "windows")
    same = rows.groupBy("key", "window").agg(F.count("*").alias("n"), F.min(F.struct("id", "copy", "at")).alias("e")).where("n > 1")
    return rows.join(same, ["key", "window"]).select(
        "id", "copy", F.col("at").alias("first"), F.col("at").alias("last"),
        (F.struct("id", "copy", "at") != F.col("e")).alias("later"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int = 96,
                   keep_first: bool = True) -> DataFrame:
    """Per input row: id, n_bytes, n_removed, n_spans, spans (array of begin, end in bytes), kept (the remaining bytes).

    `keep_first` removes only bytes of later copies; without it every byte of a repeated window goes.
    """
    found = repeats(docs, id_col, text_col, length, gram)
    if keep_first:
        found = found.where("later")
    per_doc = found.groupBy("id", "copy").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("copy"),
                      F.col(f"`{text_col}`").alias("text"))
    rows = src.join(per_doc, ["id", "copy"], "left").select("id", "text", "runs")
    id_type = src.schema["id"].dataType.simpleString()

    def cut(batch, texts):
        out = {c: [] for c in ("id", "n_bytes", "n_removed", "spans", "kept", "kept_sha256")}
        out["id"] = batch.column(0)
        for t, runs in zip(texts, batch.column(2).to_pylist()):
            raw = b"" if t is None else t.encode("utf-8", "surrogatepass")
            spans = []
            for r in sorted((r["first"], r["last"] + length) for r in runs or ()):
                if spans and r[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], r[1])
                else:
                    spans.append(list(r))
            edges = [0, *(x for s in spans for x in s), len(raw)]
            kept = b"".join(raw[edges[i]:edges[i + 1]] for i in range(0, len(edges), 2))
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(len(raw) - len(kept))
            out["spans"].append([{"begin": a, "end": b} for a, b in spans])
            out["kept"].append(kept)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        yield out

    out = map_arrow(rows, "text", cut, f"id {id_type}, n_bytes bigint, n_removed bigint, "
                    "spans array<struct<begin:bigint,end:bigint>>, kept binary, kept_sha256 string")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"),
                      "spans", "kept", "kept_sha256")


def op2(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, keep_first=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
