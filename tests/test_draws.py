from statistics import NormalDist

import duckdb
import pyspark.sql.functions as F
import pytest

from hrsight.functions import draws
from hrsight.operators import projection


def test_normal_equals_inverse_distribution(spark):
    us = [2.0 ** -53, 1e-12, 1e-5, 0.02424, 0.02425, 0.02426, 0.1, 0.5, 0.77, 0.97574, 0.97576, 0.9999, 1 - 1e-12]
    got = spark.createDataFrame([(u,) for u in us], "u double").select("u", F.expr(draws.normal("u", 3.0, 2.0)).alias("z")).collect()
    for r in got:
        assert r.z == pytest.approx(3.0 + 2.0 * NormalDist().inv_cdf(r.u), rel=1e-7, abs=1e-7)


def test_engines_agree_bit_for_bit(spark):
    """Uniforms and draws that need arithmetic only are equal; the logarithm of the tails may differ in its last bit."""
    made = {"u0": "{u0}", "u1": "{u1}", "i": draws.integer("{u0}", -3, 9), "c": draws.choice("{u1}", ["it's", "b", "c"]),
            "l": draws.ladder("{u0}", [("x", 0.2), ("y", 0.5), ("z", 0.3)]), "p": draws.poisson("{u1}", 3.0, 6),
            "n": draws.clipped(draws.normal("{u0}", 0.0, 4.0), -5, 5), "one": draws.ladder("{u0}", [(7, 1.0)])}

    def sql(dialect):
        u = {f"u{i}": draws.uniform("CAST(id AS STRING)", i, 9, dialect) for i in (0, 1)}
        return ", ".join(f"{text.format(**u)} AS {name}" for name, text in made.items())

    left = [tuple(r) for r in spark.sql(f"SELECT id, {sql(draws.SPARK)} FROM range(3000) ORDER BY id").collect()]
    right = duckdb.sql(f"SELECT id, {sql(draws.DUCKDB)} FROM range(3000) t(id) ORDER BY id").fetchall()
    assert left == right
    assert {r[4] for r in left} == {"it's", "b", "c"} and {r[3] for r in left} == set(range(-3, 9))
    assert abs(sum(r[1] for r in left) / 3000 - 0.5) < 0.03 and len({r[1] for r in left} | {r[2] for r in left}) == 6000


def test_noise_is_per_group_and_seed(spark):
    rows = [(d, r, "Yes" if i % 3 else "No") for d, r in (("a", "bc"), ("ab", "c"), ("a`b", "")) for i in range(40)]
    df = spark.createDataFrame(rows, "Department string, `Job``Role` string, Attrition string")

    def rates(**kw):
        p = projection.projection(df, by=["Department", "Job`Role"], periods=40, **kw)
        return {(r[0], r[1], r[2]): r["projected_attrition_rate"] for r in p.repartition(3).collect()}

    one, again, other = rates(noise_sd=0.5), rates(noise_sd=0.5), rates(noise_sd=0.5, seed=1)
    plain = rates()
    assert one == again and one != other and len(one) == 120
    by_group = {k[:2]: [one[(*k[:2], m)] - plain[(*k[:2], m)] for m in range(1, 41)] for k in one}
    assert len({tuple(v) for v in by_group.values()}) == 3
