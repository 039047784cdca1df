"""Plan shape: the properties the scale design relies on, read from the
physical plans (formatted explain) of registered queries."""

import io
from contextlib import redirect_stdout

from conftest import SF

import __spark_entry__ as entry


def plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_scans_read_only_needed_columns(spark):
    p = plan(entry.queries()["attrition_by_department"](spark, SF))
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string>" in p
    assert "o_orderdate" not in p and "o_orderpriority" not in p
    assert "PushedFilters: [IsNotNull(c_mktsegment)" in p


def test_partial_aggregation_before_shuffle(spark):
    p = plan(entry.queries()["department_metrics"](spark, SF))
    assert "partial_count" in p and "partial_sum" in p


def test_top_k_per_group_is_limited_before_exchange(spark):
    for name in ("profile_categorical", "activity_latest"):
        p = plan(entry.queries()[name](spark, SF))
        lines = [ln.strip() for ln in p.splitlines() if ln.strip().startswith(("+-", ":"))] or p.splitlines()
        text = "\n".join(lines)
        assert text.count("WindowGroupLimit") >= 2, name  # partial (map side) and final


def test_order_line_join_reuses_aggregate_partitioning(spark):
    p = plan(entry.queries()["attrition_rate"](spark, SF))
    assert "SortMergeJoin" in p
    assert "hashpartitioning(l_orderkey" in p


def test_no_window_over_raw_rows_in_shares(spark):
    p = plan(entry.queries()["distribution_department"](spark, SF))
    assert "Window" not in p
