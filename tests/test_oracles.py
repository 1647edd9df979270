"""Every query with an oracle gives the oracle's rows at the smallest size."""

import math
from pathlib import Path

import duckdb
import pytest

from loomrank import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
FAST = sorted(set(catalog.ORACLE_SQL) - {"tfidf_char_wb_topk"})


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return round(x, 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", FAST)
def test_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*cols).collect()), key=repr)
    quoted = ", ".join(f'"{c}"' for c in cols)
    want = sorted((tuple(plain(x) for x in r) for r in duck.execute(f"SELECT {quoted} FROM ({catalog.ORACLE_SQL[name]})").fetchall()), key=repr)
    assert got == want
