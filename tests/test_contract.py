import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_names():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_shared_folder(spark):
    from types import SimpleNamespace

    from threadloom.session import shared_dir

    set_ = SimpleNamespace(conf=spark.conf, sparkContext=spark.sparkContext, _jvm=spark._jvm, _jsc=spark._jsc)
    assert shared_dir(set_) == spark.conf.get("spark.checkpoint.dir")
    unset = SimpleNamespace(**vars(set_) | {"conf": {}})
    assert shared_dir(unset) == shared_dir(unset)
    assert shared_dir(unset).startswith("file:///")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_its_sql(spark, db, name):
    df = contract.queries()[name](spark, SF)
    got = db.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, got.fetchall())
