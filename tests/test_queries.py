"""Every registered query over FITS files against DuckDB on the tables themselves."""

import datetime
import decimal
import glob
import os

import pytest

from skylattice.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if v != v else round(float(v), 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return list(v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    names = sorted(got.columns)
    answer = duck.execute(ORACLE_SQL[name])
    theirs = [d[0] for d in answer.description]
    assert sorted(theirs) == names
    at = [theirs.index(n) for n in names]
    want = sorted((tuple(plain(r[i]) for i in at) for r in answer.fetchall()), key=repr)
    assert sorted((tuple(plain(r[n]) for n in names) for r in got.collect()), key=repr) == want


#: Queries over thousandths of floats as SQL cuts them.
THOUSANDTHS = ["hcompress_image", "hcompress_image_i2", "image_blank", "image_file_extend", "image_file_set", "image_null_fill", "zimage_extend", "zimage_repack", "zimage_set", "image_unsigned", "rice_image", "rice_image_i2"]


@pytest.fixture(scope="module")
def thousandths(tmp_path_factory):
    """Embeddings whose products with 1000 are whole numbers as floats, many of them just below as doubles."""
    pa, pq = pytest.importorskip("pyarrow"), pytest.importorskip("pyarrow.parquet")
    folder = tmp_path_factory.mktemp("thousandths")
    cells = [[(64 * row + k - 2048) / 1000 for k in range(64)] for row in range(64)]
    table = pa.table({"vec_id": pa.array(range(64), pa.int64()), "embedding": pa.array(cells, pa.list_(pa.float32()))})
    pq.write_table(table, f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("name", THOUSANDTHS)
def test_floats_are_cut_as_in_sql(spark, thousandths, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{thousandths}/embeddings.parquet'")
    answer = c.execute(ORACLE_SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(map(tuple, QUERIES[name](spark, thousandths).select(names).collect()), key=repr) == sorted(answer.fetchall(), key=repr)
