"""Every query with SQL against DuckDB on the smallest tables; the others give rows."""

import duckdb
import pytest

from skyfix.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    text = lambda v: "~" if v is None or v != v else f"{v:.7g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(text, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", list(registry.SQL))
def test_query_agrees_with_sql(spark, duck, name):
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(registry.SQL[name]).df())


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.SQL])
def test_query_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
