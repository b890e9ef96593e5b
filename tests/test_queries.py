"""Every query of the library against its SQL, on the smallest tables."""

import os

import pytest

from strandline import plans

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    return ("nan" if v != v else round(v, 8) + 0.0) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query(spark, duck, name):
    df = plans.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    result = duck.execute(plans.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str) == want


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_without_sql(spark, name):
    assert plans.queries()[name](spark, DATA).count() > 0


def test_time_joins_keep_their_entity(spark):
    """No range join without an equality, and filters reach the scan."""
    for name in ("staged_label", "range_flags", "range_grid_both", "interval_overlap"):
        plan = plans.queries()[name](spark, DATA)._jdf.queryExecution().toString()
        assert "BroadcastNestedLoop" not in plan and "CartesianProduct" not in plan, name
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThan(l_shipdate" in plans.queries()["project_dict"](spark, DATA)._jdf.queryExecution().toString()


def test_intervals_have_fifty_replicates():
    """As many as the published evaluation draws, in the queries and in their SQL."""
    from strandline.plans import metrics as queries

    assert queries.REPLICATES == 50
    for name in ("bootstrap_ci", "subgroup_metrics", "perf_cells", "multiclass_ci"):
        assert "generate_series(0, 49)" in plans.oracle_sql()[name]
