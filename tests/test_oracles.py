"""Every registered query against its DuckDB counterpart on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from lexfold.plans.registry import ORACLE, QUERIES
from lexfold.session import importable

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(x):
    if isinstance(x, bool):
        return repr(x)
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return str(int(x)) if x == int(x) else f"{x:.9g}"
    if isinstance(x, list | tuple):
        return [plain(y) for y in x]
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return repr(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](importable(spark), SF)
    columns = sorted(df.columns)
    got = sorted(str(plain(list(r))) for r in df.select(*(f"`{c}`" for c in columns)).collect())
    if name in ORACLE:
        rel = duck.sql(ORACLE[name])
        assert sorted(rel.columns) == columns
        quoted = ", ".join(f'"{c}"' for c in columns)
        assert got == sorted(str(plain(list(r))) for r in duck.sql(f"SELECT {quoted} FROM ({ORACLE[name]})").fetchall())
    else:
        assert got or name == "s20_object_store"
