"""Run queries next to their DuckDB text on one scale and report differences.

usage: python tools/compare.py SF_DIR [name or prefix* ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlark.catalog import ORACLES, QUERIES  # noqa: E402
from ledgerlark.session import local_session  # noqa: E402


def canonical(value):
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, canonical(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return canonical(value.asDict())
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canonical(r[i]) for i in order) for r in rows), key=repr)


def main() -> int:
    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"create view {name} as select * from '{path}'")
    bad = 0
    for name, run in QUERIES.items():
        if wanted and not any(
            name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted
        ):
            continue
        started = time.time()
        try:
            df = run(spark, sf_dir)
            got = rows_of(df.columns, df.collect())
            took = time.time() - started
            if name not in ORACLES:
                print(f"rows  {name}: {len(got)} rows, {took:.1f}s", flush=True)
                continue
            result = con.execute(ORACLES[name])
            columns = [d[0] for d in result.description]
            types = {d[0]: str(d[1]) for d in result.description}
            expected = rows_of(columns, result.fetchall())
            spark_types = dict(df.dtypes)
            odd = {
                c: (spark_types.get(c), types[c])
                for c in columns
                if (spark_types.get(c), types[c])
                not in {
                    ("string", "VARCHAR"), ("bigint", "BIGINT"), ("int", "INTEGER"),
                    ("double", "DOUBLE"), ("boolean", "BOOLEAN"),
                }
            }
            if sorted(columns) != sorted(df.columns):
                bad += 1
                print(f"COLS  {name}: {sorted(df.columns)} != {sorted(columns)}", flush=True)
            elif got != expected:
                bad += 1
                diff = [(g, e) for g, e in zip(got, expected) if g != e][:2]
                print(f"DIFF  {name}: {len(got)} vs {len(expected)} rows; {diff}", flush=True)
            else:
                print(f"ok    {name}: {len(got)} rows, {took:.1f}s {odd or ''}", flush=True)
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: {type(error).__name__} {str(error)[:1500]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print(f"{bad} problems")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
