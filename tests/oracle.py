"""Compare registered queries with their SQL, value by value.

Run as a script to check some or all queries: python tests/oracle.py [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, list):
        return tuple(_plain(v) for v in value)
    return value


def spark_rows(df):
    names = sorted(df.columns)
    return names, [tuple(_plain(row[n]) for n in names) for row in df.collect()]


def sql_rows(con, text: str):
    cursor = con.execute(text)
    found = [c[0] for c in cursor.description]
    names = sorted(found)
    order = [found.index(n) for n in names]
    return names, [tuple(_plain(row[i]) for i in order) for row in cursor.fetchall()]


def difference(df, con, text: str) -> str | None:
    """None when equal, else a short description."""
    spark_names, left = spark_rows(df)
    sql_names, right = sql_rows(con, text)
    if spark_names != sql_names:
        return f"columns {spark_names} vs {sql_names}"
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}"
    for i, name in enumerate(spark_names):
        kinds = [{type(r[i]).__name__ for r in rows if r[i] is not None} for rows in (left, right)]
        if kinds[0] != kinds[1]:
            return f"types of {name}: {kinds[0]} vs {kinds[1]}"
    a, b = Counter(map(repr, left)), Counter(map(repr, right))
    if a != b:
        only_left, only_right = list((a - b).elements()), list((b - a).elements())
        return (
            f"{len(only_left)} of {len(left)} rows differ\n   {spark_names}\n"
            f"   spark {sorted(only_left)[:3]}\n   sql   {sorted(only_right)[:3]}"
        )
    return None


def main() -> int:
    import __spark_entry__ as entry
    from tests.session import make_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark, con = make_session(), connect(folder)
    runs, texts = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args or runs:
        started = time.time()
        try:
            df = runs[name](spark, folder)
            if name in texts:
                problem = difference(df, con, texts[name])
                verdict = "ok" if problem is None else f"DIFF {problem}"
            else:
                verdict = f"rows only: {len(df.collect())}"
        except Exception as error:  # report every query, not just the first failure
            verdict = f"ERROR {type(error).__name__} {str(error)[:600]}"
        bad += verdict[:2] not in ("ok", "ro")
        print(f"{time.time() - started:6.1f}s {name}: {verdict}", flush=True)
    print(f"{bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
