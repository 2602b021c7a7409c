"""Run registered queries beside their SQL in DuckDB and compare the rows.

As a script: ``python -m tests.oracle [sf] [name …]``.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
DATA = os.environ.get("TESTDATA_DIR", "/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value: object) -> object:
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _sorted_rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def compare(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when equal, else a short account of the difference."""
    got_columns = spark_df.columns
    got = _sorted_rows(got_columns, [tuple(row) for row in spark_df.collect()])
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    want = _sorted_rows(columns, cursor.fetchall())
    if sorted(got_columns) != sorted(columns):
        return f"columns {sorted(got_columns)} vs {sorted(columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}; first {got[:2]} vs {want[:2]}"
    if not got:
        return "no rows"
    bad = [(a, b) for a, b in zip(got, want) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ; columns {sorted(columns)}; first {bad[0][0]} vs {bad[0][1]}"
    return None


def main() -> int:
    from insolara import build_session
    from insolara.plans import PLANS

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"{DATA}/sf{sf}"
    names = sys.argv[2:] or list(PLANS)
    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                    "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in names:
        plan = PLANS[name]
        began = time.time()
        try:
            df = plan.build(spark, sf_dir)
            if plan.sql is None:
                rows = df.count()
                note = f"rows only: {rows}" if rows else "FAIL no rows"
            else:
                problem = compare(df, con, plan.sql)
                note = "ok" if problem is None else f"FAIL {problem}"
        except Exception as exc:  # noqa: BLE001 - report and go on
            note = f"FAIL {type(exc).__name__}: {str(exc)[:600]}"
        failed += note.startswith("FAIL")
        print(f"{name:28s} {time.time() - began:6.2f}s {note}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
