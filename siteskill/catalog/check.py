"""Run every query against its SQL in DuckDB: `python -m siteskill.catalog.check [sf_dir] [name ...]`."""

from __future__ import annotations

import glob
import os
import sys
import tempfile
import time

import pandas as pd


def oracle_connection(sf: str):
    import duckdb

    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        if hasattr(v, "isoformat"):
            return v.isoformat()[:10]
        if isinstance(v, bool):
            return str(v)
        if hasattr(v, "item"):
            return cell(v.item())
        return repr(v) if isinstance(v, float) else str(v)

    columns = sorted(frame.columns)
    return sorted(tuple(cell(v) for v in row) for row in zip(*[frame[c].astype(object) for c in columns]))


def compare(con, case, frame, started: float | None = None) -> str:
    """Collect a query's frame and compare it with its SQL."""
    started = started or time.time()
    names = [c.split(":")[0] for c in case.columns.split()]
    got = pd.DataFrame([r.asDict() for r in frame.collect()], columns=names, dtype=object)
    took = time.time() - started
    if case.oracle() is None:
        return f"rows {len(got)} ({took:.1f}s)"
    started = time.time()
    rel = con.sql(case.oracle())
    want = pd.DataFrame(rel.fetchall(), columns=rel.columns, dtype=object)
    sql_took = time.time() - started
    a, b = canonical(got), canonical(want)
    times = f"({took:.1f}s, sql {sql_took:.1f}s)"
    if a == b:
        nulls = [c for c in got.columns if len(got) and got[c].isna().all()]
        return f"ok {len(a)} {times}" + (f" all-null: {nulls}" if nulls else "")
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return f"DIFF spark {len(a)} sql {len(b)} {times}\n   {sorted(got.columns)}\n   spark {only_a[:3]}\n   sql   {only_b[:3]}  ({len(only_a)} rows)"


def main() -> None:
    from ..session import local_session
    from . import all_cases

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8, settings={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="siteskill-check-")})
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(sf)
    cases = all_cases()
    names = [n for n in cases if not sys.argv[2:] or any(n.startswith(p) for p in sys.argv[2:])]
    bad = 0
    for name in names:
        try:
            started = time.time()
            out = compare(con, cases[name], cases[name].frame(spark, sf), started)
        except Exception as e:  # noqa: BLE001
            out = "ERROR " + str(e)[:1500]
        bad += out.startswith(("DIFF", "ERROR"))
        print(f"{name}: {out}", flush=True)
    print(f"{len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main()
