"""Run a registered query in Spark and its checking SQL in DuckDB, and compare the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

from stewardry.session import scratch
from stewardry.sources.derived import DRIVER_TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _bag(rows, order):
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, query, sql, sf_dir) -> str | None:
    """None if equal, else what differs."""
    with scratch(spark):
        df = query(spark, sf_dir)
        mine = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    theirs = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    order = sorted(df.columns)
    a = _bag(mine, [df.columns.index(c) for c in order])
    b = _bag(theirs, [names.index(c) for c in order])
    if a == b:
        return None
    only_a, only_b = sorted(set(a) - set(b), key=repr), sorted(set(b) - set(a), key=repr)
    return f"rows {len(a)} vs {len(b)}; {order}; only spark {only_a[:3]}; only sql {only_b[:3]}"


def main(sf_dir: str, *names: str) -> int:
    from stewardry.plans import registry
    from stewardry.session import build_session

    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), 0
    for name, query in registry.QUERIES.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            if name in registry.CHECKS:
                problem = compare(spark, con, query, registry.CHECKS[name], sf_dir)
                done = "ok" if problem is None else f"DIFFERS {problem[:900]}"
            else:
                problem, done = None, f"rows only: {query(spark, sf_dir).count()}"
        except Exception as exc:  # noqa: BLE001
            problem, done = "error", f"ERROR {str(exc)[:900]}"
        failed += problem is not None
        if problem is not None or "-v" in sys.argv or time.time() - start > 5:
            print(f"{name}: {done} ({time.time() - start:.1f}s)", flush=True)
    print("failed:", failed, flush=True)
    return failed


if __name__ == "__main__":
    args = [a for a in sys.argv[1:] if a != "-v"]
    sys.exit(1 if main(*args) else 0)
