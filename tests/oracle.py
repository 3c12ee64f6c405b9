"""Runs a registered query and its oracle and compares the whole results."""

from __future__ import annotations

import datetime as dt
import sys
import time
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, Decimal):
        return f"decimal:{v}"
    if isinstance(v, float):
        return "nan" if v != v else repr(v + 0.0)
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return f"{type(v).__name__}:{v}"


def normal(columns: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(name: str, spark, con, sf_dir: str, queries, oracles) -> str | None:
    """None when equal, else a short description of the difference."""
    df = queries[name](spark, sf_dir)
    cols, got = normal(df.columns, (tuple(r) for r in df.collect()))
    cur = con.execute(oracles[name])
    want_cols, want = normal([d[0] for d in cur.description], cur.fetchall())
    if cols != want_cols:
        return f"columns {cols} != {want_cols}"
    if got != want:
        extra, missing = got - want, want - got
        return (f"{cols}: {sum(got.values())} vs {sum(want.values())} rows; "
                f"spark only {list(extra)[:3]}; oracle only {list(missing)[:3]}")
    return None if got else "both empty"


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from ledgerloom.session import local_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, q, o = duck(sf_dir), queries(), oracle_sql()
    names = [n for n in q if not wanted or any(n.startswith(w) for w in wanted)]
    bad = 0
    for n in names:
        start = time.time()
        try:
            if n in o:
                problem = compare(n, spark, con, sf_dir, q, o)
            else:
                df = q[n](spark, sf_dir)
                problem = f"(no oracle) {len(df.collect())} rows"
        except Exception as exc:  # noqa: BLE001 - report and go on
            problem = f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += problem is not None and not problem.startswith("(no")
        print(f"{'ok  ' if problem is None else '??  '}{n} {time.time() - start:.1f}s {'' if problem is None else problem[:1200]}", flush=True)
    print(f"{len(names)} queries, {bad} differ")


if __name__ == "__main__":
    main()
