"""Compare every registered query with its SQL statement on one data folder."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def _norm(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, int):
        return value
    if hasattr(value, "as_tuple"):
        return round(float(value), 6)
    return value if isinstance(value, str) else str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    normal = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(normal, key=lambda r: tuple((v is None, str(v)) for v in r))


def difference(spark_df, con, sql) -> str | None:
    """A short description of the first difference, or None."""
    left_columns = spark_df.columns
    left = _rows(left_columns, [tuple(r) for r in spark_df.collect()])
    result = con.execute(sql)
    right_columns = [d[0] for d in result.description]
    right = _rows(right_columns, result.fetchall())
    if sorted(left_columns) != sorted(right_columns):
        return f"columns {sorted(left_columns)} vs {sorted(right_columns)}"
    if len(left) != len(right):
        left_set, right_set = set(left), set(right)
        extra = [r for r in left if r not in right_set][:2]
        missing = [r for r in right if r not in left_set][:2]
        return f"{len(left)} rows vs {len(right)}; extra {extra} missing {missing}"
    for a, b in zip(left, right):
        if a != b and not all(
            x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float))
                       and abs(x - y) <= 1e-6 * max(1, abs(x))) for x, y in zip(a, b)):
            return f"row {a} vs {b}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from evigraph.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or list(queries):
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in sql:
                diff = difference(df, connect(sf_dir), sql[name])
                count = ""
            else:
                diff, count = None, f"{df.count()} rows (no SQL)"
        except Exception as error:  # noqa: BLE001
            diff, count = str(error)[:350].replace("\n", " "), ""
        bad += diff is not None
        print(f"{'FAIL' if diff else 'ok  '} {name} {time.time() - start:.1f}s {count} {diff or ''}",
              flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
