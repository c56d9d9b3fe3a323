"""Every query of the engine against its SQL on the smallest tables."""

import duckdb
import pytest

from tenderflow.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def shown(frame, columns):
    rows = frame[columns].astype(object)
    return rows.where(frame[columns].notna(), None).map(lambda v: str(round(v, 6) + 0.0) if isinstance(v, float) else str(v)).sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.sql(catalog.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    numeric = [c for c in columns if got[c].dtype.kind in "if" and want[c].dtype.kind in "if" or str(want[c].dtype).startswith("Int")]
    for c in numeric:
        got[c], want[c] = got[c].astype(float), want[c].astype(float)
    assert len(got) == len(want)
    assert shown(got, columns).equals(shown(want, columns))
