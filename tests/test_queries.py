"""Every registered query of the price engine against its SQL on the smallest test data."""

import os
from datetime import datetime

import pytest

from tidemark.plans import catalogue

DATA = os.environ.get("TIDEMARK_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def shown(value):
    if isinstance(value, float):
        return repr(round(value, 9) + 0.0)
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def lines(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted("|".join(shown(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, oracle, name):
    made = catalogue.QUERIES[name](spark, DATA).toArrow()
    if name not in catalogue.ORACLES:
        assert made.num_rows > 0
        return
    cursor = oracle.execute(catalogue.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(made.column_names) == sorted(names)
    assert lines(made.column_names, [tuple(r.values()) for r in made.to_pylist()]) == lines(names, cursor.fetchall())


def test_stream_and_batch_machines_agree(spark):
    batch, stream = (sorted(map(str, catalogue.QUERIES[n](spark, DATA).collect())) for n in ("deal_fsm_batch", "deal_fsm_stream"))
    assert batch == stream and batch
