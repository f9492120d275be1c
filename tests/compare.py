"""Runs registered queries beside their SQL: python tests/compare.py [--sf DIR] [NAME...]"""

import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def plain(v):
    """Values in a form both engines share."""
    import datetime
    import decimal
    import math

    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, int):
        return float(v) if abs(v) < 2**53 else v
    return v


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for p in sorted(Path(sf).glob("*.parquet")):
        at = f"{p}/*.parquet" if p.is_dir() else p
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{at}')")
    return con


def differences(df, con, sql: str):
    """(rows of Spark, rows only in Spark, rows only in SQL); column names must agree."""
    names = sorted(df.columns)
    mine = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    cur = con.execute(sql)
    theirs_names = [c[0] for c in cur.description]
    if sorted(theirs_names) != names:
        raise AssertionError(f"columns {names} and {sorted(theirs_names)}")
    order = [theirs_names.index(c) for c in names]
    theirs = Counter(tuple(plain(r[i]) for i in order) for r in cur.fetchall())
    return sum(mine.values()), mine - theirs, theirs - mine


if __name__ == "__main__":
    import __spark_entry__ as entry

    from tracefold.session import build_session

    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    spark = build_session(cores=8)
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sql = duck(sf), entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args or queries:
        began = time.time()
        try:
            if name in sql:
                n, a, b = differences(queries[name](spark, sf), con, sql[name])
                verdict = "same" if not a and not b else f"DIFFERENT {list(a.items())[:3]} | {list(b.items())[:3]}"
                bad += bool(a or b)
            else:
                n, verdict = queries[name](spark, sf).count(), "no SQL"
        except Exception as e:  # noqa: BLE001
            n, verdict, bad = -1, f"FAILED {str(e)[:600]}", bad + 1
        print(f"{name}: {n} rows, {time.time() - began:.1f} s, {verdict}", flush=True)
    sys.exit(bool(bad))
