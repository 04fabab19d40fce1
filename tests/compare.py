"""Run registered queries next to their SQL: ``python tests/compare.py SF_DIR [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def plain(value):
    if value is None or str(value) in ("<NA>", "NaT") or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return round(value, 9) + 0.0
    return str(value) if not isinstance(value, (int, bool)) else value


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    rows = [tuple(plain(v) for v in row) for row in frame.itertuples(index=False, name=None)]
    return sorted(rows, key=repr)


def check(spark, con, sf_dir, name, query, sql):
    start = time.time()
    try:
        left = query(spark, sf_dir).toPandas()
    except Exception as error:
        return f"{name}: SPARK FAILED {str(error)[:500]}"
    took = time.time() - start
    if sql is None:
        return f"{name}: rows only, {len(left)} rows, {took:.1f}s"
    try:
        right = con.execute(sql).df()
    except Exception as error:
        return f"{name}: SQL FAILED {str(error)[:500]}"
    if sorted(left.columns) != sorted(right.columns):
        return f"{name}: COLUMNS DIFFER {sorted(left.columns)} / {sorted(right.columns)}"
    kinds = [
        (c, str(left[c].dtype), str(right[c].dtype)) for c in left.columns
        if str(left[c].dtype) != str(right[c].dtype)
    ]
    a, b = rows_of(left), rows_of(right)
    note = f" dtypes {kinds}" if kinds else ""
    if a != b:
        extra_a, extra_b = [r for r in a if r not in set(b)], [r for r in b if r not in set(a)]
        return f"{name}: ROWS DIFFER {len(a)}/{len(b)} only left {len(extra_a)} {extra_a[:2]} only right {len(extra_b)} {extra_b[:2]}{note}"
    return f"{name}: ok {len(a)} rows, {took:.1f}s{note}" + (" EMPTY" if not a else "")


def main(argv):
    import __spark_entry__ as entry
    from hourgrid.session import get_session

    sf_dir, names = argv[0], argv[1:]
    spark = get_session(
        "compare", "local[8]", **{
            "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
            "spark.ui.showConsoleProgress": "false",
        }
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sql = duck(sf_dir), entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        line = check(spark, con, sf_dir, name, queries[name], sql.get(name))
        bad += any(word in line for word in ("FAILED", "DIFFER"))
        print(line, flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
