"""Every query over the smallest tables gives the rows of its SQL."""

import math
import os

import duckdb
import pytest

from rayscape.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def sql():
    if not os.path.isdir(SF):
        pytest.skip("no benchmark tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 9) if isinstance(v, float) else v
    return sorted([tuple(plain(r[i]) for i in order) for r in values], key=lambda r: [(v is not None, v) for v in r])


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n in catalogue.SQL])
def test_query_equals_sql(spark, sql, name):
    df = catalogue.QUERIES[name](spark, SF)
    found = sql.execute(catalogue.SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, found.fetchall())


def test_height_matrix_gets_the_whole_map(spark, monkeypatch):
    if not os.path.isdir(SF):
        pytest.skip("no benchmark tables here")
    seen, make = [], catalogue.spatial.height_matrix
    monkeypatch.setattr(catalogue.spatial, "height_matrix", lambda heights, ids: seen.append(heights) or make(heights, ids))
    catalogue.height_matrix(spark, SF)
    assert seen[0].filter("building_id > 3").count() > 0


def test_the_others_run(spark):
    if os.path.isdir(SF):
        points = catalogue.simulate_points(spark, SF)
        assert points.columns == ["point_id", "time_ns", "x", "y", "z"] and points.count() > 0
        assert catalogue.fit_predict(spark, SF).count() > 0
