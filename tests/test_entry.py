import importlib.util

import pytest

import __spark_entry__ as entry


def test_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    for n in (1, 2, 4, 6, 7):
        assert f"p{n}_found" in q
    if importlib.util.find_spec("tracelode.llm"):
        assert {"p3_found", "p5_found", "p8_ids", "p9_found", "p10_found"} <= set(q)


def test_nothing_else_imports_llm():
    from pathlib import Path

    root = Path(entry.__file__).parent
    for p in [*root.glob("*.py"), *(root / "tracelode").rglob("*.py")]:
        if "llm" not in p.parts and p.name != "__spark_entry__.py":
            assert "tracelode.llm" not in p.read_text()


@pytest.mark.parametrize("name", ["page_physical", "annotations", "p4_found", "p6_found"])
def test_against_sql(spark, name):
    import duckdb
    from pathlib import Path

    sf = "/root/testdata/sf0.001"
    if not Path(sf).exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = entry.queries()[name](spark, sf)
    cols = ", ".join(f'"{c}"' for c in df.columns)
    want = con.execute(f"SELECT {cols} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))
