"""Driver contract: entry runs, every oracle key is a query, queries return DataFrames."""

import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert {"user_id", "n_rows", "n_events", "event_share"} <= set(df.columns)


def test_oracle_keys_subset_of_queries():
    qs, sq = entry.queries(), entry.oracle_sql()
    assert set(sq) <= set(qs)
    assert len(qs) >= 80


def test_some_oracle_queries_match_duckdb(spark):
    import duckdb
    import pandas as pd
    SF = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ["events", "customer"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name in ["anomaly_share", "future_event", "auroc", "median_split"]:
        a = entry.queries()[name](spark, SF).toPandas()
        b = con.sql(entry.oracle_sql()[name]).df()
        cols = sorted(a.columns)
        a = a[cols].sort_values(cols).reset_index(drop=True)
        b = b[cols].sort_values(cols).reset_index(drop=True)
        pd.testing.assert_frame_equal(a, b, check_dtype=False, check_exact=False, atol=1e-6)
