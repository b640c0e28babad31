"""Every query of the core that has SQL, against DuckDB over sf0.001."""

import duckdb
import pytest

from quillspark.plans.surface import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    out = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "documents", "pages", "benchmark", "conversations"):
        out.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return out


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({ORACLE[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want))


def test_round_trip(spark):
    rows = QUERIES["geo_payload_roundtrip"](spark, SF).collect()
    assert rows and all(r["gid"] == r["population"] and r["name"].startswith("Customer#") and r["lat"] == -r["lon"] / 100 for r in rows)
