"""Holds a query's rows against those of its SQL in DuckDB."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

SF = "/root/testdata/sf0.001"


def rows_of(frame) -> Counter:
    cols = sorted(frame.columns)

    def plain(v):
        if v is None or v != v:
            return None
        return float(v) if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind == "f" else str(v)

    return Counter(tuple(plain(v) for v in r) for r in frame[cols].astype(object).itertuples(index=False))


def same(spark, query, sql: str, sf_dir: str = SF) -> None:
    import duckdb

    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got, want = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    for c in got.columns:  # integers with gaps come as floats
        if want[c].dtype.kind in "iuIU" or str(want[c].dtype).startswith(("Int", "UInt")):
            got[c], want[c] = got[c].astype("Int64"), want[c].astype("Int64")
    got, want = (x.astype(object).where(x.notna(), None) for x in (got, want))
    assert rows_of(got) == rows_of(want)
