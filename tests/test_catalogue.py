"""Every registered query of the engine against its oracle SQL."""

import glob
import os

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from rivulet.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(x):
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else str(x) if hasattr(x, "isoformat") else x


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_equals_oracle(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((plain(tuple(r)) for r in df.select(*columns).collect()), key=repr)
    want = sorted((plain(r) for r in duck.execute(f"SELECT {', '.join(columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_unnest_embeddings_rounds_floats(spark, tmp_path, ansi):
    """The floats around each half of a thousandth, where a product as a double is rounded otherwise."""
    halves = ((np.arange(-600, 600) + 0.5) / 1000).astype(np.float32)
    below, above = np.nextafter(halves, np.float32(-1)), np.nextafter(halves, np.float32(1))
    lists = [*np.stack([below, halves, above], axis=1).tolist(), [None, 0.25, -0.0], [], None]
    pq.write_table(pa.table({"vec_id": range(len(lists)), "embedding": pa.array(lists, pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        got = sorted((tuple(r) for r in catalogue.queries()["unnest_embeddings"](spark, str(tmp_path)).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    assert got == sorted(con.execute(catalogue.oracle_sql()["unnest_embeddings"]).fetchall(), key=repr)
    assert len(got) == 3 * len(halves) + 3
