import os

import numpy as np
import pandas as pd
import pytest

from voltaic.plans import area_queries, file_queries, queries

FOLDER = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.sql(f"create view {name.partition('.')[0]} as select * from '{FOLDER}/{name}'")
    return con


def plain(frame):
    """Column names, and the rows as sorted texts with numbers as doubles."""
    frame = frame[sorted(frame.columns)]

    def cell(v):
        if isinstance(v, (bool, np.bool_)):
            return bool(v)
        return None if pd.isna(v) else float(v) if isinstance(v, (int, float, np.number)) else v

    return list(frame.columns), sorted(repr(tuple(map(cell, r))) for r in frame.itertuples(index=False, name=None))


QUERIES = queries.queries() | area_queries.queries() | file_queries.queries()
ORACLE = queries.oracle_sql() | area_queries.oracle_sql() | file_queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, database, name):
    assert plain(QUERIES[name](spark, FOLDER).toPandas()) == plain(database.sql(ORACLE[name]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


#: Noding, quadtree cells, hulls, line simplification, quote states and XML of any tag are no built-in functions; these queries need them.
IN_PYTHON = {"csv_row_counts", "decision_chains", "decisions_applied", "dissolved_overlaps", "locational_signal", "point_in_polygon", "points_in_areas", "regulator_xml_names", "repaired_polygons", "simplified_rings"}


def test_plans_stay_in_the_jvm(spark):
    for name, query in QUERIES.items():
        plan = query(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert ("Python" not in plan or name in IN_PYTHON) and "CartesianProduct" not in plan, name
