"""Registered queries against their DuckDB oracle SQL on the smallest data."""

import duckdb
import pytest

from tools.oracle_check import TABLES, rows_of

SAMPLE = ["imp_unit_price", "imp_flags", "outlier_blank", "join_many_to_many", "join_unmatched_report",
          "agg_box_stats", "agg_histogram", "topn_with_ties", "ts_fill_chain", "ts_interp_position",
          "complete_grid", "unpivot_long", "fc_ets", "fc_bootstrap_paths", "fc_noise", "fc_leaderboard",
          "dom_waste_processing", "dom_metric_bins", "src_csv_panel"]


@pytest.fixture(scope="module")
def duck(small_dir):
    import os
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(small_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, small_dir, duck, name):
    import __spark_entry__ as E
    df = E.queries()[name](spark, small_dir)
    cols = df.columns
    got = [tuple(r) for r in df.collect()]
    cur = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    exp = cur.fetchall()
    assert sorted(cols) == sorted(dcols)
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    dorder = [dcols.index(cols[i]) for i in order]
    assert rows_of([tuple(r[i] for i in order) for r in got]) == rows_of([tuple(r[i] for i in dorder) for r in exp])


def test_every_query_has_sql():
    from panelwright import catalog
    assert set(catalog.oracle_sql()) == set(catalog.queries())


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0


def test_every_oracle_sql_binds_in_duckdb(duck):
    import __spark_entry__ as E
    for name, sql in E.oracle_sql().items():
        duck.execute("EXPLAIN " + sql)  # raises on a syntax or binder error
