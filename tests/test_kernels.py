"""Every kernel query against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from folioloom.plans import queries as K
from folioloom.plans import raster_queries, run_queries  # noqa: F401  (they add their queries to those of K)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(K.QUERIES))
def test_same_rows(spark, con, name):
    a, b = K.QUERIES[name](spark, SF).toPandas(), con.sql(K.SQL[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True).astype(object).where(x[cols].sort_values(cols).reset_index(drop=True).notna(), None) for x in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9)


def test_layout_of_three_boxes(spark):
    from folioloom.operators.books import plan_crops

    rows = [(1, 0, 1000, 1400, 100, 100, 700, 1100), (1, 1, 1000, 1400, 200, 150, 690, 1080), (1, 2, 1000, 1400, 300, 100, 300, 200), (2, 0, 900, 800, None, None, None, None)]
    df = spark.createDataFrame(rows, "book_id int, page_idx int, pw int, ph int, x int, y int, w int, h int")
    got = {(r.book_id, r.page_idx): (r.out_w, r.out_h, r.ox, r.oy) for r in plan_crops(df).collect()}
    assert got == {(1, 0): (770, 1170, 65, 65), (1, 1): (770, 1170, 165, 115), (1, 2): (770, 1170, 65, 65), (2, 0): (900, 800, 0, 0)}


def test_natural_order(spark):
    from folioloom.functions.scalars import natural_key

    df = spark.createDataFrame([(s,) for s in "p10.jpg p2.jpg P1.jpg p02b.jpg a.jpg".split()], "s string")
    assert [r.s for r in df.orderBy(natural_key(df.s), "s").collect()] == "a.jpg P1.jpg p2.jpg p02b.jpg p10.jpg".split()


def test_otsu_of_ties_and_plain_pages(spark, tmp_path):
    """Pages as dark as they are light, whose splits tie, and pages of one level."""
    rng = np.random.default_rng(0)
    half = rng.integers(0, 256, (300, 32))
    grey = [*np.concatenate((half, 255 - half), axis=1), *(np.full(64, g) for g in (0, 1, 100, 254, 255))]
    rows = [(i, [float(v) for v in g / 255 - 0.5]) for i, g in enumerate(grey)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    pages = duckdb.connect()
    pages.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(pages.sql(K.SQL["raster_otsu_level"]).fetchall())
    assert len(want) == len(rows)
    for name in ("raster_otsu_level", "otsu_level"):
        assert sorted(map(tuple, K.QUERIES[name](spark, str(tmp_path)).collect())) == want
