from collections import Counter

import numpy as np
import pyspark.sql.functions as F
import pytest

from hrsight.functions import heavy


def brute(rows, columns, top=5):
    out = []
    for j, c in enumerate(columns):
        counts = Counter(str(r[j]) for r in rows if r[j] is not None)
        out += [(c, k, v, n) for k, (v, n) in enumerate(sorted(counts.items(), key=lambda t: (-t[1], t[0]))[:top], start=1)]
    return sorted(out)


def got(df, *args, **kw):
    return sorted(tuple(r) for r in heavy.top_values(df, *args, **kw).collect())


@pytest.fixture(scope="module")
def skewed(spark):
    """Long-tailed, hot, all alike, near-unique and empty columns, and values that only stand out over all tasks."""
    rng = np.random.default_rng(5)
    n = 6000
    rows = [(f"z{int(rng.zipf(1.4)) % 5000}", "hot" if i % 3 == 0 else f"t{i}", "one", f"id{i:05d}", None,
             f"s{i % 40}" if i % 4 == 0 else f"u{i}", int(rng.integers(0, 7)), "x'é\n" if i % 2 else "") for i in range(n)]
    df = spark.createDataFrame(rows, "zipf string, hot string, one string, id string, none string, spread string, `a.b` int, odd string")
    return rows, df.repartition(9)


@pytest.mark.parametrize("capacity", [3, 16, 5000])
def test_equals_counting(skewed, capacity):
    rows, df = skewed
    assert got(df, df.columns, capacity=capacity) == brute(rows, df.columns)


def test_widens_instead_of_grouping_in_full(skewed, monkeypatch):
    """The tail of the column is wide, its fifth count is not: the second, wider pass proves it."""
    rows, df = skewed
    used = []
    plain = heavy._summaries
    monkeypatch.setattr(heavy, "_summaries", lambda indexes, capacity: used.append((list(indexes), capacity)) or plain(indexes, capacity))
    assert got(df, ["spread", "hot"], top=5, capacity=8) == brute([(r[5], r[1]) for r in rows], ["spread", "hot"])
    assert len(used) == 2 and used[0] == ([0, 1], 8) and used[1][1] > 8


def test_error_bounds_hold():
    rng = np.random.default_rng(1)
    values = rng.zipf(1.2, 20000).astype(np.int64) % 3000
    v, n, miss = heavy._compact([values], [np.ones(len(values), np.int64)], 50)
    true = Counter(values.tolist())
    assert len(v) <= 50 and miss * 51 <= len(values)
    low = dict(zip(v.tolist(), n.tolist()))
    assert all(low.get(k, 0) <= c <= low.get(k, 0) + miss for k, c in true.items())


def test_defaults_and_empty(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", None)], "t string, k int")
    assert got(df) == [("t", 1, "b", 2), ("t", 2, "a", 1)]
    assert got(df, ["k", "t"], top=1) == [("k", 1, "1", 1), ("t", 1, "b", 2)]
    assert got(df.where("k > 5")) == [] and got(df.select("k")) == []
    assert got(df.select(F.lit(None).cast("string").alias("t"))) == []
