"""Run registered queries beside their SQL: ``python -m checks.compare [folder] [names...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from checks.oracles import ORACLES
from checks.queries import QUERIES
from usagelens.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in df.itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def difference(spark, con, folder: str, name: str) -> str | None:
    """None when both engines give the same rows, else what differs."""
    got = QUERIES[name](spark, folder).toPandas()
    want = con.execute(ORACLES[name]).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    a, b = canonical(got), canonical(want)
    for x, y in zip(a, b):
        if x != y:
            return f"{x} != {y}"
    kinds = {
        c: (str(got[c].dtype), str(want[c].dtype))
        for c in got.columns
        if str(got[c].dtype) != str(want[c].dtype) and not got[c].isna().any() and not want[c].isna().any()
    }
    return f"types {kinds}" if kinds else None


def main(folder: str, names: list[str]) -> int:
    spark, con, bad = local_session(8), connect(folder), 0
    for name in names or list(QUERIES):
        start = time.time()
        try:
            if name in ORACLES:
                note = difference(spark, con, folder, name)
                state = "same" if note is None else "DIFF"
            else:
                note, state = f"{len(QUERIES[name](spark, folder).toPandas())} rows", "rows"
        except Exception as e:  # noqa: BLE001
            note, state = f"{type(e).__name__}: {str(e)[:700]}", "FAIL"
        bad += state in ("DIFF", "FAIL")
        print(f"{state} {name} {time.time() - start:.1f}s {str(note or '')[:900]}", flush=True)
    print(f"{bad} bad of {len(names or QUERIES)}")
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    where = args[0] if args and "/" in args[0] else "/root/testdata/sf0.01"
    sys.exit(min(main(where, [a for a in args if "/" not in a]), 1))
