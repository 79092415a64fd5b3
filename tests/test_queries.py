"""Every query of the classification engine against its SQL on the small tables."""

import duckdb
import pytest

from sparkloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("embeddings", "documents", "pages", "labels", "events", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def table(df):
    c = sorted(df.columns)
    return sorted(tuple(None if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in row) for row in df[c].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, con, name):
    got, expected = catalog.queries()[name](spark, SF).toPandas(), con.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert table(got) == table(expected)


def test_both_neighbour_plans_agree(spark):
    from sparkloom.operators import knn

    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    q, t = rows.where("vec_id % 50 = 0"), rows.where("vec_id % 5 <> 0")
    a = knn.neighbours(q, t, "vec_id", "embedding", 4, block=37, tile=5).collect()
    b = knn.neighbours_sql(q, t, "vec_id", "embedding", 4).collect()
    key = lambda r: (r.qid, r.r)
    for x, y in zip(sorted(a, key=key), sorted(b, key=key), strict=True):
        assert (x.qid, x.tid, x.r) == (y.qid, y.tid, y.r) and abs(x.d - y.d) < 2e-9
