"""Compare named queries with their SQL twins: ``python tests/check.py [folder] [names...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canonical(names: list[str], rows) -> list[tuple]:
    """Columns in name order, rows sorted."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def kind(name: str) -> str:
    """Column type under one name for both engines."""
    return {
        "bigint": "long", "BIGINT": "long", "int": "int", "INTEGER": "int", "double": "double",
        "DOUBLE": "double", "string": "text", "VARCHAR": "text", "boolean": "flag", "BOOLEAN": "flag",
    }.get(name, name)


def compare(spark, con, name, query, sql, folder) -> str | None:
    """None if equal, else what differs."""
    df = query(spark, folder)
    ours = canonical(df.columns, df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: kind(str(d[1])) for d in cursor.description}
    theirs = canonical(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    mine = {c: kind(t) for c, t in df.dtypes}
    if mine != types:
        return f"types {mine} against {types}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(e.queries())
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(folder), 0
    for name in chosen:
        started = time.time()
        try:
            if name in e.oracle_sql():
                result = compare(spark, con, name, e.queries()[name], e.oracle_sql()[name], folder)
                note = "equal" if result is None else f"DIFFERS: {result}"
            else:
                rows = len(e.queries()[name](spark, folder).collect())
                result, note = (None, f"{rows} rows") if rows else ("", "EMPTY")
        except Exception as error:  # report and go on with the next query
            result, note = "", f"ERROR {str(error)[:600]}"
        failed += result is not None
        print(f"{name:28s} {time.time() - started:6.2f}s  {note}", flush=True)
    print(f"{len(chosen) - failed} of {len(chosen)} fine")
    sys.exit(1 if failed else 0)
