"""Run registered queries beside their SQL and compare schema and values.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

TYPE_NAMES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP",
    "timestamp_ntz": "TIMESTAMP",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _ordered(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def differences(df, con, sql: str) -> list[str]:
    rel = con.sql(sql)
    want_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    got_types = {c: TYPE_NAMES.get(t, t) for c, t in df.dtypes}
    problems = []
    if want_types != got_types:
        problems.append(f"schema: spark {got_types} sql {want_types}")
        if set(want_types) != set(got_types):
            return problems
    got = _ordered(df.collect(), df.columns)
    want = _ordered(rel.fetchall(), rel.columns)
    if len(got) != len(want):
        problems.append(f"rows: spark {len(got)} sql {len(want)}")
    bad = [(g, w) for g, w in zip(got, want) if repr(g) != repr(w)]
    if bad:
        problems.append(f"{len(bad)} rows differ, first: spark {bad[0][0]} sql {bad[0][1]}")
    if not want:
        problems.append("no rows at all")
    return problems


def main() -> None:
    import __spark_entry__ as entry
    from sittings.runtime import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracle = entry.oracle_sql()
    failed = 0
    for name, query in entry.queries().items():
        if args and name not in args:
            continue
        start = time.time()
        df = query(spark, sf_dir)
        if name in oracle:
            problems = differences(df, con, oracle[name])
            what = f"{len(df.columns)} columns"
        else:
            problems, what = [], f"{df.count()} rows, no SQL"
        failed += bool(problems)
        mark = "BAD " if problems else "ok  "
        print(f"{mark} {name} {time.time() - start:.2f}s {what}", *problems)
    print("failed:", failed)


if __name__ == "__main__":
    main()
