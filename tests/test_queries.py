"""Every registered query of the library proper against its SQL at sf0.001."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from driftwell.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = [p.stem for p in Path(SF).glob("*.parquet")]


def canonical(rows: list[tuple], names: list[str]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else round(float(v), 8) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)[:19] if hasattr(v, "isoformat") else v
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in catalog.ORACLE_SQL:
        assert df.columns
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(rows, df.columns) == canonical(want.fetchall(), columns)
