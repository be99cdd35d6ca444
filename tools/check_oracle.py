"""Compare every registered query with its SQL: columns, types, rows.

usage: python tools/check_oracle.py [sf_dir] [name ...]
"""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from starboard.registry import load_all  # noqa: E402
from starboard.session import build_session, clear_work  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
TYPES = {"bigint": "long", "integer": "int", "varchar": "string", "double": "double", "float": "float"}


def normal(row):
    return tuple((v is None, str(type(v).__name__), str(v)) for v in row)


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, name, entry, sf_dir):
    started = time.time()
    df = entry.run(spark, sf_dir)
    columns = sorted(df.columns)
    picked = df.select(*columns)
    got = sorted(normal(r) for r in picked.collect())
    plan = picked._jdf.queryExecution().executedPlan().toString()
    # Spark's own recommendForAllUsers pairs blocks of users with blocks of items.
    if not name.startswith("als_recommend") and ("NestedLoop" in plan or "Cartesian" in plan):
        return "NESTED LOOP in the plan", time.time() - started
    seconds = time.time() - started
    if not entry.sql:
        return f"rows only: {len(got)}", seconds
    result = con.execute(entry.sql)
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return f"COLUMNS {columns} vs {sorted(names)}", seconds
    order = [names.index(c) for c in columns]
    want = sorted(normal(tuple(r[i] for i in order)) for r in result.fetchall())
    if got != want:
        missing = [r for r in want if r not in set(got)][:2]
        extra = [r for r in got if r not in set(want)][:2]
        return f"DIFFERS {len(got)} vs {len(want)}\n   spark only {extra}\n   sql only {missing}", seconds
    described = con.execute(f"DESCRIBE {entry.sql}").fetchall()
    sql_types = {r[0]: r[1].lower() for r in described}
    spark_types = dict(df.dtypes)
    loose = {c: (spark_types[c], sql_types[c]) for c in columns if not same_type(spark_types[c], sql_types[c])}
    return f"ok {len(got)}" + (f" TYPES {loose}" if loose else "") + (" EMPTY" if not got else ""), seconds


def same_type(spark_type, sql_type):
    return {"integer": "int", "varchar": "string"}.get(sql_type, sql_type) == spark_type


if __name__ == "__main__":
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    session = build_session(
        master="local[8]",
        shuffle_partitions=8,
        settings={"spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    for name, e in load_all().items():
        if wanted and name not in wanted:
            continue
        try:
            text, seconds = compare(session, con, name, e, sf_dir)
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            text, seconds = f"ERROR {type(error).__name__} {str(error)[:700]}", 0
        print(f"{name:34} {seconds:6.1f}s {text}", flush=True)
    clear_work(session)
