"""Run registered queries beside their SQL twins and compare rows.

python tests/compare.py SF_DIR [name part ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import tempfile
import time
import traceback
from datetime import date, datetime
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, int):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def difference(df, con, sql):
    """None if equal, else a short description."""
    got_columns, got = df.columns, df.collect()
    result = con.execute(sql)
    want_columns = [c[0] for c in result.description]
    want = result.fetchall()
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} vs {sorted(want_columns)}"
    a, b = rows_of(got_columns, got), rows_of(want_columns, want)
    if len(a) != len(b):
        return f"{len(a)} rows vs {len(b)}; first {a[:2]} vs {b[:2]}"
    if not a:
        return "both empty"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ in {sorted(got_columns)}; {bad[:2]}" if bad else None


def session(cores="8"):
    from pyspark.sql import SparkSession

    shared = tempfile.mkdtemp(prefix="run-", dir="/tmp")  # one machine: a folder of its own is a shared one
    spark = (
        SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", shared).config("spark.sql.warehouse.dir", f"{shared}/warehouse").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main():
    import __spark_entry__ as entry

    sf_dir, parts = sys.argv[1], sys.argv[2:]
    spark, con = session(), connect(sf_dir)
    twins = entry.oracle_sql()
    failed = 0
    for name, run in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            if name in twins:
                problem = difference(run(spark, sf_dir), con, twins[name])
            else:
                problem = None if run(spark, sf_dir).count() else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = "".join(traceback.format_exception_only(error))[:1500]
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("failed", failed)


if __name__ == "__main__":
    main()
