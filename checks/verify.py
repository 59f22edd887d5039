"""Run registered queries next to their check SQL and compare whole results.

    python -m checks.verify [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def check_engine(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        path = f"{sf_dir}/{table}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return ("num", round(value, 6)) if value == value else ("nan",)
    if isinstance(value, bool) or value is None:
        return ("", str(value))
    if isinstance(value, int):
        return ("num", float(value))
    return ("", str(value))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, con, name, query, sql, sf_dir) -> str:
    """'' when equal, else what differs."""
    df = query(spark, sf_dir)
    columns = df.columns
    mine = rows_of(columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "" if mine else "no rows"
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = rows_of(names, cursor.fetchall())
    if sorted(columns) != sorted(names):
        return f"columns {sorted(columns)} / {sorted(names)}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} / {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"{sorted(columns)}: {a} / {b}"
    return ""


def main() -> int:
    from checks.oracle import ORACLE
    from checks.queries import QUERIES
    from loglens.session import get_spark

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    settings = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    spark = get_spark("verify", "local[8]", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    con = check_engine(sf_dir)
    failed = 0
    for name in names:
        began = time.time()
        try:
            problem = compare(spark, con, name, QUERIES[name], ORACLE.get(name), sf_dir)
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        failed += bool(problem)
        kind = "sql" if name in ORACLE else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {time.time() - began:6.2f}s {name} {problem}", flush=True)
    print(f"{len(names) - failed} of {len(names)} pass; without SQL: {sorted(set(QUERIES) - set(ORACLE))}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
