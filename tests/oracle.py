"""Compare registered queries with their DuckDB SQL: ``python -m tests.oracle SF_DIR [name ...]``."""

from __future__ import annotations

import datetime as dt
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
         "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP",
         "float": "FLOAT", "array<string>": "VARCHAR[]", "array<double>": "DOUBLE[]",
         "array<bigint>": "BIGINT[]"}


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, folder: str, fn, sql: str | None) -> list[str]:
    """Differences as messages; empty when the results are the same."""
    df = fn(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    if not rows:
        return ["no rows"]
    if sql is None:
        return []
    cur = con.execute(sql)
    want_types = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    got_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = []
    if sorted(got_types) != sorted(want_types):
        return [f"columns {sorted(got_types)} != {sorted(want_types)}"]
    described = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    for name, t in got_types.items():
        if TYPES.get(t, t) != described[name]:
            out.append(f"type of {name}: {t} != {described[name]}")
    a, b = _rows(df.columns, rows), _rows(list(want_types), want)
    if a != b:
        sa, sb = set(a), set(b)
        out.append(f"rows {len(a)} vs {len(b)}; only spark {sorted(sa - sb)[:3]}; only sql {sorted(sb - sa)[:3]}"
                   f" ({len(sa - sb)}/{len(sb - sa)})")
    return out


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    from tastegrid.session import make_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark = make_session("oracle", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(folder), 0
    queries, sqls = e.queries(), e.oracle_sql()
    for name in names or queries:
        start = time.time()
        try:
            diff = compare(spark, con, folder, queries[name], sqls.get(name))
        except Exception as err:  # report and go on with the next query
            diff = [f"{type(err).__name__}: {str(err)[:1500]}"]
        bad += bool(diff)
        print(f"{'FAIL' if diff else 'ok  ' if name in sqls else 'rows'} {name} {time.time() - start:.1f}s",
              *diff, sep="\n    " if diff else " ", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
