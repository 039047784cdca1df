import numpy as np
import pytest

from hrsight.functions.quantiles import exact_quantiles, grouped_quantiles


@pytest.mark.parametrize("final_max,parts,accuracy", [(100_000, 4096, 10_000), (7, 4, 10_000), (1, 2, 10_000),
                                                         (7, 4, 20), (3, 3, 8)])
def test_exact_quantiles_match_linear_interpolation(spark, final_max, parts, accuracy):
    rng = np.random.default_rng(3)
    a = np.round(rng.lognormal(8, 0.7, 997), 2)
    a[:50] = a[50]  # heavy duplicates
    b = rng.integers(0, 5, 997).astype(float)
    rows = [(float(x), float(y) if i % 13 else None) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = exact_quantiles(df, {"a": probs, "b": probs}, parts=parts, final_max=final_max,
                          sketch_accuracy=accuracy)
    bb = np.array([r[1] for r in rows if r[1] is not None])
    for p, g in zip(probs, got["a"]):
        assert g == pytest.approx(np.percentile(a, p * 100), rel=1e-12)
    for p, g in zip(probs, got["b"]):
        assert g == pytest.approx(np.percentile(bb, p * 100), rel=1e-12)


def test_quantile_of_empty_and_single(spark):
    df = spark.createDataFrame([(None,), (5.0,)], "x double")
    assert exact_quantiles(df, {"x": [0.25, 0.5]})["x"] == [5.0, 5.0]
    empty = spark.createDataFrame([], "x double")
    assert exact_quantiles(empty, {"x": [0.5]})["x"] == [None]


def test_median_of_four(spark):
    # An approximate imputer would answer 2.0 here; the exact median is 3.0.
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,)], "x double")
    assert exact_quantiles(df, {"x": [0.5]})["x"] == [3.0]


def test_values_of_all_magnitudes_and_nan(spark):
    rows = [(10.0 ** (i % 600 - 300),) for i in range(2000)] + [(float("nan"),), (None,)]
    df = spark.createDataFrame(rows, "x double")
    want = sorted(r[0] for r in rows[:2000])
    got = exact_quantiles(df, {"x": [0.0, 0.5, 1.0]}, final_max=1, sketch_accuracy=10)["x"]
    assert got[0] == want[0] and got[2] == want[-1]
    assert got[1] == want[999] + 0.5 * (want[1000] - want[999])


def per_group(rows, probs):
    groups = {}
    for k, x in rows:
        groups.setdefault(k, []).append(x)
    out = {}
    for k, xs in groups.items():
        xs = [x for x in xs if x is not None and x == x]
        out[k] = [float(np.quantile(xs, p)) if xs else None for p in probs]
    return out


@pytest.mark.parametrize("final_max", [100_000, 40, 3])
def test_grouped_against_numpy(spark, final_max):
    """Hot group, heavy ties, far outliers, one-row groups, NULL key, groups without values; few or many passes."""
    rng = np.random.default_rng(8)
    rows = [("hot", float(x)) for x in rng.lognormal(5, 3, 4000)] + [("hot", 7.0)] * 1500
    rows += [("ties", float(x)) for x in rng.integers(0, 3, 900)] + [("far", x) for x in [1.0, 2.0, 1e300, -1e300, 3.0] * 30]
    rows += [(None, float(x)) for x in rng.normal(0, 1, 333)] + [("one", 4.5), ("none", None), ("none", float("nan"))]
    rows += [(f"g{i % 40}", float(i * i % 101)) for i in range(1200)] + [("hot", None), ("ties", float("nan"))]
    rng.shuffle(rows)
    rows = [(k, None if x is None else float(x)) for k, x in rows]
    df = spark.createDataFrame(rows, "`a key` string, `x.y` double").repartition(5)
    probs = [0.5, 0.25, 0.75, 0.0, 1.0, 0.999]
    got = {r[0]: list(r)[1:] for r in grouped_quantiles(df, ["a key"], "x.y", probs, final_max=final_max).collect()}
    want = per_group(rows, probs)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == [None if w is None else pytest.approx(w, rel=1e-12) for w in want[k]], k


def test_grouped_edges(spark):
    empty = spark.createDataFrame([], "k string, j int, x double")
    assert grouped_quantiles(empty, ["k"], "x", [0.5]).count() == 0
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("a", None, 5), (None, None, 9)], "k string, j int, x int")
    got = {(r[0], r[1]): r[2] for r in grouped_quantiles(df, ["k", "j"], "x", [0.5]).collect()}
    assert got == {("a", 1): 1.5, ("a", None): 5.0, (None, None): 9.0}
