"""Run registered queries beside their SQL and compare the results.

Usage: python tests/oracle_check.py [sf] [name-part ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
DATA = Path("/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def canonical(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]
    rows = []
    for row in pdf.itertuples(index=False, name=None):
        cells = []
        for v in row:
            if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
                cells.append(None)
            elif hasattr(v, "isoformat"):
                cells.append(pd.Timestamp(v).isoformat())
            elif isinstance(v, (bool,)) or type(v).__name__ == "bool_":
                cells.append(bool(v))
            elif isinstance(v, str):
                cells.append(v)
            else:
                cells.append(float(v))
        rows.append(tuple(cells))
    return sorted(rows, key=lambda t: tuple((c is not None, str(type(c)), c if c is not None else 0) for c in t))


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} against {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    differing = [(a, b) for a, b in zip(canonical(got), canonical(want)) if a != b]
    return f"{len(differing)} rows differ, e.g. {differing[0]}" if differing else None


def type_notes(got: pd.DataFrame, want: pd.DataFrame) -> str:
    odd = [f"{c}:{got[c].dtype}/{want[c].dtype}" for c in sorted(got.columns) if str(got[c].dtype) != str(want[c].dtype)]
    return " ".join(o for o in odd if o.count("datetime64") != 2)


def main() -> None:
    import __spark_entry__ as entry
    from loadweave.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    sf_dir = str(DATA / f"sf{sf}")
    spark = build_session("oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g",
                          spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(sf_dir), entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            got = run(spark, sf_dir).toPandas()
            took = time.time() - start
            if name not in sql:
                print(f"rows  {name:32s} {took:6.2f}s {len(got)}", flush=True)
                continue
            want = con.execute(sql[name]).df()
            problem = compare(got, want)
            notes = "" if problem else type_notes(got, want)
        except Exception as exc:  # report and go on with the next query
            problem, took, notes = f"{type(exc).__name__}: {str(exc)[:400]}", time.time() - start, ""
        bad += problem is not None
        print(f"{'BAD ' if problem else 'ok  '}  {name:32s} {took:6.2f}s {problem or ''} {notes}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
