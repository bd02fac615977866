"""Compare queries with their SQL: python -m tests.oracle SF_DIR [NAME...]."""

import os
import sys


def load(sf_dir):
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in sorted(os.listdir(sf_dir)):
        path = f"{sf_dir}/{f}"
        path = path if os.path.isfile(path) else f"{path}/*.parquet"
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        return round(v, 6) if isinstance(v, float) else v

    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, sf_dir, name, fn, sql):
    """None where both agree, else what differs."""
    df = fn(spark, sf_dir)
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    names = [x[0] for x in res.description]
    theirs = rows(names, res.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if ours != theirs:
        a, b = set(map(repr, ours)), set(map(repr, theirs))
        return f"{len(ours)} and {len(theirs)} rows; only ours {sorted(a - b)[:2]}; only SQL {sorted(b - a)[:2]}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, os.getcwd())
    import __spark_entry__ as e
    from paperloom.runtime import session

    s = session("oracle", spark__master=os.environ.get("ORACLE_MASTER", "local[8]"), spark__sql__shuffle__partitions="8", spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    con = load(sys.argv[1])
    q = e.queries()
    for n, sql in e.oracle_sql().items():
        if not sys.argv[2:] or n in sys.argv[2:]:
            try:
                bad = compare(s, con, sys.argv[1], n, q[n], sql)
            except Exception as x:  # noqa: BLE001
                bad = f"{type(x).__name__}: {str(x)[:400]}"
            print("ok  " if bad is None else "FAIL", n, bad or "", flush=True)
