"""Compares queries with their SQL: python tests/compare.py [--sf DIR] [NAME or prefix*]..."""

import decimal
import glob
import math
import os
import sys
import time

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join([HERE, *filter(None, [os.environ.get("PYTHONPATH")])])  # for the workers


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(d):
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in sorted(glob.glob(f"{d}/*.parquet")):
        at = f"{p}/*.parquet" if os.path.isdir(p) else p
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{at}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return plain(tuple(v))
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        import datetime

        return v.astimezone(datetime.timezone.utc).replace(tzinfo=None)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, c, name, query, sql, d):
    df = query(spark, d)
    mine = rows_of(df.columns, df.collect())
    if sql is None:
        return f"rows only: {len(mine)}", True
    cur = c.execute(sql)
    columns = [x[0] for x in cur.description]
    theirs = rows_of(columns, cur.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns differ: {sorted(df.columns)} {sorted(columns)}", False
    if mine != theirs:
        a, b = [x for x in mine if x not in set(theirs)][:3], [x for x in theirs if x not in set(mine)][:3]
        return f"rows differ: {len(mine)} and {len(theirs)}; only here {a}; only SQL {b}", False
    return f"equal: {len(mine)} rows", True


def main(args):
    d = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        d, args = args[1], args[2:]
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    names = [n for n in q if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    spark, c, bad = session(), connect(d), 0
    for n in names:
        t = time.time()
        try:
            said, good = compare(spark, c, n, q[n], o.get(n), d)
        except Exception as x:  # noqa: BLE001
            said, good = f"{type(x).__name__}: {str(x)[:1500]}", False
        bad += not good
        print("ok  " if good else "FAIL", n, f"{time.time() - t:.1f} s", said, flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
