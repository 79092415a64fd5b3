"""The corpus queries that SQL can express against their SQL: on a small table with nulls, ties, copies, empty and long texts, and on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_operators import corpus

from sparkloom.llm import registry, sql

SF = "/root/testdata/sf0.001"


def table(df):
    c = sorted(df.columns)
    plain = lambda v: None if pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(map(plain, row)) for row in df[c].astype(object).itertuples(index=False)), key=repr)


def both(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'/*.parquet' * ('sf0' not in folder)}')")
    got, want = registry.queries()[name](spark, folder).toPandas(), con.sql(sql.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    return table(got), table(want)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    found = str(tmp_path_factory.mktemp("tables"))
    rows = corpus(11, 150)
    texts = [t for _, t in rows] + ["\n".join(["same line here", "x y z"] * 30), "#$%& " * 80, "A B C D " * 40, "a" * 300 + " b", "\t\n \x0b\f\r", "\x1f \x00 é ü"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{found}/documents.parquet")
    rng = np.random.default_rng(2)
    x = rng.standard_normal((150, 12))
    x[50:100] = x[:50] + 0.12 * rng.standard_normal((50, 12))
    x[100:110] = x[:10]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(200, None, 0), (201, [0.0] * 12, 1), (202, [float("nan")] * 12, 1), (203, [None] * 12, 1), (204, [], 1), (205, [1.0, 2.0], 1), (206, [2.0, 4.0], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(2).write.parquet(f"{found}/embeddings.parquet")
    pages = [(i, f"http://x/{i}", None if i % 9 == 0 else f"page {i % 7} é " * (i * 3)) for i in range(90)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{found}/pages.parquet")
    return found


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_odd_tables(spark, folder, name):
    got, want = both(spark, folder, name)
    assert got == want


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_smallest_tables(spark, name):
    got, want = both(spark, SF, name)
    assert got == want


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_empty_tables(spark, tmp_path, name):
    for t in ("documents", "embeddings", "pages"):
        spark.read.parquet(f"{SF}/{t}.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/{t}.parquet")
    assert registry.queries()[name](spark, str(tmp_path)).count() == 0
