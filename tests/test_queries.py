"""Every core query with an oracle, against DuckDB on the smallest tables."""

import math
from pathlib import Path

import pytest

import loxodrome.queries as core

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(v):
    if v is None or isinstance(v, str | bool):
        return str(v)
    if isinstance(v, int | float) or hasattr(v, "as_tuple"):
        return f"{float(v) + 0.0:.6g}" if math.isfinite(v) else "nan"
    return str(v)


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_oracle(spark, con, name):
    df = core.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    rel = con.sql(core.ORACLES[name])
    at = [rel.columns.index(c) for c in columns]
    assert sorted(rel.columns) == columns
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_power_by_unit_uses_all_cells_and_parts(spark, tmp_path):
    parts, n = 500, 3000
    spark.createDataFrame([(i, None if i == 7 else f"type{i}") for i in range(parts)], "p_partkey long, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(i, 1.0 + i) for i in range(n)], "o_orderkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    want = {}
    for r in core.power_cells(spark, str(tmp_path)).filter("power_count > 0").select("cell_id", "power_count").collect():
        unit = "nan" if r.cell_id % parts == 7 else f"type{r.cell_id % parts}"
        want[unit] = want.get(unit, 0) + r.power_count
    got = {r.geology_unit: r.power_count for r in core.QUERIES["power_by_unit"](spark, str(tmp_path)).collect()}
    assert got == want and "nan" in want and any(u != "nan" and int(u[4:]) >= 400 for u in want)
