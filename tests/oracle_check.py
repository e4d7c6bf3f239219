"""Compare registered queries with their SQL: names, kinds, row counts and values.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v).lower())
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        return (1, "nan" if math.isnan(f) else repr(f + 0.0))
    if isinstance(v, datetime.datetime):
        return (1, v.replace(tzinfo=None).isoformat())
    if isinstance(v, (list, tuple)):
        return (1, str([plain(x) for x in v]))
    return (1, str(v))


def kind(type_name: str) -> str:
    n = type_name.lower()
    if any(k in n for k in ("bigint", "smallint", "tinyint", "integer", "int", "long", "short")) and "[" not in n:
        return "int"
    if "decimal" in n:
        return "decimal"
    if "double" in n or "float" in n:
        return "float"
    if "varchar" in n or "string" in n:
        return "string"
    if "timestamp" in n:
        return "timestamp"
    return n


def compare(spark, con, sf_dir, build, sql):
    """None when equal, else a short account of the difference."""
    df = build(spark, sf_dir)
    cols = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    if sql is None:
        return None if rows else "no rows"
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}"
    order = [names.index(c) for c in cols]
    spark_kinds = {n: kind(t) for n, t in df.dtypes}
    duck_kinds = {d[0]: kind(str(d[1])) for d in res.description}
    odd = {c: (spark_kinds[c], duck_kinds[c]) for c in cols if spark_kinds[c] != duck_kinds[c]}
    other = [tuple(plain(r[k]) for k in order) for r in res.fetchall()]
    if len(rows) != len(other):
        return f"rows {len(rows)} != {len(other)}"
    if not rows:
        return "no rows on both sides"
    rows.sort(), other.sort()
    bad = [(a, b) for a, b in zip(rows, other) if a != b]
    if bad:
        a, b = bad[0]
        diff = {c: (x[1], y[1]) for c, x, y in zip(cols, a, b) if x != y}
        return f"{len(bad)} of {len(rows)} rows differ, first {diff} in {[x[1] for x in a][:8]}"
    if odd:
        return f"types {odd}"
    return None


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    from gridspark.session import get_session
    import __spark_entry__ as entry

    spark = get_session(
        "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g", "spark.ui.enabled": "false",
                     "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv[1:] or any(n.startswith(p) for p in argv[1:])]
    failed = 0
    for n in names:
        at = time.time()
        try:
            issue = compare(spark, con, sf_dir, queries[n], sqls.get(n))
        except Exception as err:
            text = str(err).strip().split("\n")
            issue = type(err).__name__ + ": " + " | ".join(text[:6])[:900]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        failed += issue is not None
        mark = "ok  " if issue is None else "FAIL"
        print(f"{mark} {n} {time.time() - at:.1f}s {'' if n in sqls else '(rows only) '}{issue or ''}", flush=True)
    print(f"{len(names) - failed}/{len(names)} equal")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
