"""Compare registered queries with their SQL in DuckDB: ``python tests/parity.py [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def oracle_rows(sf_dir: str, sql: str) -> tuple[list[str], list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = [str(d[1]) for d in result.description]
    return names, kinds, result.fetchall()


def normal(names: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def compare(spark, sf_dir: str, query, sql: str) -> tuple[bool, str]:
    started = time.time()
    df = query(spark, sf_dir)
    got = [tuple(row) for row in df.collect()]
    took = time.time() - started
    names, kinds, want = oracle_rows(sf_dir, sql)
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    left, right = normal(df.columns, got), normal(names, want)
    if left != right:
        only = [r for r in left if r not in set(right)][:2], [r for r in right if r not in set(left)][:2]
        return False, f"{len(left)} rows vs {len(right)}; only in one: {only}"
    types = dict(df.dtypes)
    return True, f"{len(left)} rows {took:.1f}s " + ",".join(
        f"{n}:{types[n]}/{k}" for n, k in zip(names, kinds) if not _alike(types[n], k))


def _alike(spark_type: str, duck_type: str) -> bool:
    pairs = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "int": "INTEGER", "boolean": "BOOLEAN"}
    return pairs.get(spark_type) == duck_type


def main() -> int:
    import __spark_entry__ as entry
    from rtshop.session import create_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = create_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                           spark__driver__memory="12g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("OFF")
    failed = 0
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name in names or queries:
        try:
            ok, note = compare(spark, sf_dir, queries[name], oracle[name])
        except Exception as error:  # noqa: BLE001
            ok, note = False, f"{type(error).__name__}: {str(error)[:1200]}"
        failed += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print(f"{len(names or queries)} queries, {failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
