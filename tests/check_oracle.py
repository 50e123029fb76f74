"""Run registered queries against their SQL twins: ``python tests/check_oracle.py [sf_dir] [name prefix ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

import __spark_entry__ as registry  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _key(row):
    return tuple((value is None, str(type(value)), value if value is not None else 0) for value in row)


def difference(frame, connection, sql: str) -> str | None:
    """None when both sides return the same rows, else a description of the first difference."""
    names = sorted(frame.columns)
    mine = sorted((tuple(row) for row in frame.select(*[f"`{n}`" for n in names]).collect()), key=_key)
    result = connection.execute(sql)
    theirs_names = [column[0] for column in result.description]
    if sorted(theirs_names) != names:
        return f"columns differ: {names} / {sorted(theirs_names)}"
    order = [theirs_names.index(name) for name in names]
    theirs = sorted((tuple(row[i] for i in order) for row in result.fetchall()), key=_key)
    if len(mine) != len(theirs):
        return f"row counts differ: {len(mine)} / {len(theirs)}"
    worst = 0.0
    for a, b in zip(mine, theirs):
        for name, x, y in zip(names, a, b):
            if x == y and type(x) is type(y):
                continue
            if isinstance(x, float) and isinstance(y, float):
                gap = abs(x - y) / max(abs(x), abs(y))
                if math.isnan(gap) or gap > 1e-12:
                    return f"{name}: {x!r} / {y!r}\n   {dict(zip(names, a))}\n   {dict(zip(names, b))}"
                worst = max(worst, gap)
                continue
            return f"{name}: {x!r} / {y!r}\n   {dict(zip(names, a))}\n   {dict(zip(names, b))}"
    return f"tiny:{worst}" if worst else None


def main() -> None:
    from riskmill.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    connection = oracle_connection(sf_dir)
    twins = registry.oracle_sql()
    failed = []
    for name, query in registry.queries().items():
        if wanted and not any(name.startswith(prefix) for prefix in wanted):
            continue
        start = time.time()
        try:
            frame = query(spark, sf_dir)
            if name in twins:
                problem = difference(frame, connection, twins[name])
                rows = ""
            else:
                problem, rows = None, f"{len(frame.collect())} rows, no twin"
        except Exception as error:  # noqa: BLE001 - report and go on
            problem, rows = f"{type(error).__name__}: {str(error)[:600]}", ""
        status = "ok" if problem is None else problem
        print(f"{name:38s} {time.time() - start:6.2f}s {rows} {status}", flush=True)
        if problem is not None and not problem.startswith("tiny"):
            failed.append(name)
    print("FAILED:", failed, "unregistered twins:", sorted(set(twins) - set(registry.queries())))


if __name__ == "__main__":
    main()
