"""Run the registered queries and their SQL side by side."""

from __future__ import annotations

import decimal
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    return value


def difference(df, con, sql: str):
    """None when the results are equal as bags of rows, else what differs."""
    got_cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in got_cols) for r in df.collect())
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    if sorted(names) != got_cols:
        return f"columns {got_cols} against {sorted(names)}"
    place = [names.index(c) for c in got_cols]
    want = Counter(tuple(plain(r[i]) for i in place) for r in result.fetchall())
    if got == want:
        return None
    extra, lost = list((got - want).items())[:2], list((want - got).items())[:2]
    return f"rows {sum(got.values())} against {sum(want.values())}; only here {extra}; only there {lost}"


if __name__ == "__main__":
    import sys

    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from segtrans.session import get_session

    sf_dir = sys.argv[1]
    only = sys.argv[2:]
    spark = get_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sql = entry.oracle_sql()
    print("no sql:", set(entry.queries()) - set(sql), "no query:", set(sql) - set(entry.queries()))
    bad = 0
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            found = difference(query(spark, sf_dir), con, sql[name])
        except Exception as exc:
            found = f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += found is not None
        print(f"{'ok ' if found is None else 'BAD'} {name} {time.time() - start:.1f}s {(found or '')[:1800]}", flush=True)
    print("bad:", bad)
