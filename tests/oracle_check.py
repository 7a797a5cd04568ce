"""Run registered queries against their DuckDB text: python tests/oracle_check.py [sf_dir] [name ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(value):
    if value is None or (isinstance(value, float) and value != value):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return float(f"{value:.12g}")
    return value


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    import __spark_entry__ as entry

    started = time.time()
    df = entry.queries()[name](spark, sf_dir)
    rows = [r.asDict() for r in df.collect()]
    spent = time.time() - started
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return True, f"{name}: {len(rows)} rows, no check, {spent:.2f}s"
    rel = con.sql(sql)
    cols = sorted(rel.columns)
    if cols != sorted(df.columns):
        return False, f"{name}: columns {sorted(df.columns)} vs {cols}"
    kinds = dict(zip(rel.columns, map(str, rel.types)))
    simple = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = [(c, t, kinds[c]) for c, t in df.dtypes if simple.get(t, t) != kinds[c]]
    expect = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
    key = lambda r: tuple(str(v) for v in r)
    a = sorted((tuple(_norm(r[c]) for c in cols) for r in rows), key=key)
    b = sorted((tuple(_norm(r[c]) for c in cols) for r in expect), key=key)
    if a != b:
        only_a, only_b = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
        return False, f"{name}: MISMATCH {len(a)} vs {len(b)} {cols}\n   spark {only_a}\n   duck  {only_b}"
    return not odd, f"{name}: ok {len(a)} rows {spent:.2f}s" + (f" TYPES {odd}" if odd else "")


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    from beaconlake.session import build

    spark = build(master="local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    import __spark_entry__ as entry

    con, bad = connect(sf_dir), 0
    for name in sys.argv[2:] or list(entry.queries()):
        try:
            ok, text = compare(spark, con, name, sf_dir)
        except Exception as error:  # noqa: BLE001
            ok, text = False, f"{name}: ERROR {type(error).__name__} {str(error)[:900]}"
        bad += not ok
        print(("" if ok else "** ") + text, flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
