"""Line dedup against all pairs of lines."""

import random
import re

from hrsight.llm import line_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def near(x, y):
    if abs(len(x) - len(y)) > 1:
        return False
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) <= 1
    if len(x) > len(y):
        x, y = y, x
    return any(x == y[:i] + y[i + 1:] for i in range(len(y)))


def brute(rows, min_words=5):
    lines = sorted((d, j, tuple(WORD.findall(x))) for d, t in rows if t for j, x in enumerate(t.split("\n")) if WORD.search(x))
    first = {}
    for d, j, w in lines:
        first.setdefault(w, (d, j))
    by_len = {}
    for w in first:
        if len(w) >= min_words:
            by_len.setdefault(len(w), []).append(w)
    gone = {w for w in first if len(w) >= min_words for n in (len(w) - 1, len(w), len(w) + 1) for y in by_len.get(n, ())
            if first[y] < first[w] and near(w, y)}
    out = {}
    for d, j, w in lines:
        if w in gone or first[w] != (d, j):
            out.setdefault(d, []).append(j)
    return {d: sorted(out.get(d, [])) for d, _ in rows}


def made_rows():
    rng = random.Random(11)
    vocab = "alpha beta gamma delta eps é zeta".split()
    bases = [[rng.choice(vocab) for _ in range(rng.choice([3, 5, 6, 7, 12, 30]))] for _ in range(14)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randrange(0, 5)):
            w = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                p = rng.randrange(len(w))
                kind = rng.randrange(3)
                if kind == 0:
                    w[p] = rng.choice(vocab)
                elif kind == 1 and len(w) > 2:
                    del w[p]
                else:
                    w.insert(p, rng.choice(vocab))
            lines.append(rng.choice([" ", "  ", "\t"]).join(w))
        rows.append((d, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n \n"), (103, "a a a a a a\na a a a a\na a a a a a a"), (104, rows[3][1])]
    return rows


def test_within_one():
    rng = random.Random(2)
    for _ in range(3000):
        a = [rng.choice("xy") for _ in range(rng.randrange(0, 6))]
        b = [rng.choice("xy") for _ in range(rng.randrange(0, 6))]
        assert line_dedup.within_one(" ".join(a), "\t".join(b)) == near(a, b), (a, b)


def test_against_all_pairs(spark):
    rows = made_rows()
    frame = spark.createDataFrame([(d, t, [1], "c") for d, t in rows], "doc_id bigint, text string, lines_removed array<int>, kept_lines string")
    out = line_dedup.dedup_lines(frame)
    got = {r.doc_id: r for r in out.collect()}
    want = brute(rows)
    assert set(got) == set(want) and out.columns[:4] == frame.columns
    for d, t in rows:
        assert got[d]["lines_removed_"] == want[d], d
        assert got[d].lines_removed == [1] and got[d].kept_lines == "c"
        if want[d]:
            assert got[d].text == "\n".join(x for j, x in enumerate(t.split("\n")) if j not in want[d])
        else:
            assert got[d].text == t


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    want = brute(rows)
    got = {r.doc_id: r for r in line_dedup.op3(spark, "/root/testdata/sf0.01").collect()}
    assert {d: [int(x) for x in r.lines_removed.split(",") if x] for d, r in got.items()} == want
    assert all(r.n_removed == len(want[d]) for d, r in got.items())


def test_equal_short_lines(spark):
    """Lines of one to four words, and long ones without a blank: copies go, near ones stay."""
    url = "https://example.org/" + "a" * 300
    rows = [(1, f"Share\n{url}\nAll rights reserved"), (2, f"share\n{url}\nAll  rights\treserved\n-"), (3, f"Share\nAll rights kept\n{url}x\n-"),
            (4, "Share"), (5, "-\nown")]
    got = {r.doc_id: r.lines_removed for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == brute(rows) == {1: [], 2: [1, 2], 3: [0, 3], 4: [0], 5: [0]}


def test_nulls_repeats_and_empty(spark):
    line = "one two three four five"
    rows = [(None, line), (2, line), (2, line), (3, line + " six"), (4, "x " + line + " y")]
    got = sorted((str(r.doc_id), r.lines_removed) for r in line_dedup.dedup_lines(
        spark.createDataFrame(rows, "doc_id int, text string")).collect())
    assert got == [("2", []), ("2", []), ("3", [0]), ("4", []), ("None", [])]
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id int, text string")).count() == 0


def test_memory_of_a_batch_is_bounded(spark, monkeypatch):
    """Lines are laid out in small parts of a batch, whatever its rows."""
    import tracemalloc

    import pyarrow as pa

    from hrsight.llm import tasks

    got = {}
    monkeypatch.setattr(line_dedup, "map_arrow", lambda df, text, fn, ddl, limit=tasks.PIECE_BYTES: got.update(fn=fn, limit=limit))
    line_dedup._line_rows(spark.createDataFrame([], "id bigint, copy bigint, text string"), 5)
    rng = random.Random(4)
    names = [f"w{i}" for i in range(2000)]
    texts = ["\n".join(" ".join(rng.choices(names, k=12)) for _ in range(30)) for _ in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array(range(4000)), pa.array(texts)], names=["id", "copy", "text"])
    tracemalloc.start()
    lines = sum(len(rows["hash"]) for part, of in tasks.pieces(batch, "text", got["limit"]) for rows in got["fn"](part, of))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert lines == 120_000
    assert peak < 90e6
