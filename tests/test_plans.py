"""Plan shape checks: no row-at-a-time Python, no single-partition exchange of raw rows."""

from vitalgrid.operators import grid as G
from vitalgrid.operators.features import build_features
from vitalgrid.sources import fixtures as X

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_feature_plan_stays_in_jvm(spark):
    f = build_features(X.p_raw(spark, SF), "user_id", ["ts", "event_id"], ["value", "k"], 2.0, 5, 6)
    p = plan(f)
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    assert "SinglePartition" not in p


def test_clean_plan_has_no_single_partition(spark):
    c = G.clean_panel(X.p_day(spark, SF), "user_id", "ts", ["value", "k"], "1 day", limit=1)
    assert "SinglePartition" not in plan(c)


def test_filters_reach_the_scan(spark):
    from pyspark.sql import functions as F
    df = X.table(spark, SF, "events").filter(F.col("user_id") == 3).select("user_id", "value")
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,3)]" in p
    assert "ReadSchema: struct<user_id:bigint,value:double>" in p


def test_feature_plan_shuffles_rows_twice(spark):
    """Row numbering and the fused trend / run length / label each shuffle the
    rows once; every other exchange moves small statistics tables."""
    import re
    f = build_features(X.p_raw(spark, SF), "user_id", ["ts", "event_id"], ["value", "k"], 1.0, 5, 6,
                       sustained_rows=2)
    f.write.format("noop").mode("overwrite").save()
    lines = f._jdf.queryExecution().executedPlan().toString().splitlines()
    row_keys = []
    for i, line in enumerate(lines):
        m = re.search(r"Exchange hashpartitioning\(([^)]*)\)", line)
        # an exchange whose child is a HashAggregate moves partial aggregates, not rows
        if m and not (i + 1 < len(lines) and "HashAggregate" in lines[i + 1]):
            row_keys.append(m.group(1))
    assert len(row_keys) == 2
    assert sum("_chunk" in k for k in row_keys) == 1 and sum("_sl" in k for k in row_keys) == 1


def test_clean_panel_reads_its_input_three_times(spark):
    """Bounds, rows and the carry's chunk edges; the rows are exchanged once, before the grid is filled up."""
    import re
    df = G.clean_panel(X.p_raw(spark, SF).dropDuplicates(["user_id", "ts"]), "user_id", "ts", X.P_RAW_SIGNALS, "1 day",
                       on_duplicate="last", order=["event_id"])
    df.collect()
    final = plan(df).split("Initial Plan")[0]
    assert len(re.findall("FileScan", final)) <= 3
    full = G.clean_panel(X.p_day(spark, SF), "user_id", "ts", X.P_RAW_SIGNALS, "1 day", limit=5)
    full.collect()
    final = plan(full).split("Initial Plan")[0]
    generate = final.index("Generate")
    assert "Exchange" not in final[:generate].replace("ReusedExchange", "").replace("BroadcastExchange", "")
