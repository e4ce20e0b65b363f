"""Run registered queries on Spark and their SQL twins on DuckDB and compare rows."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def duck(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(r[i] for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


# Result types that must agree, not only the values.
SQL_TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def compare(spark_df, con, sql):
    declared = {r[0]: str(r[1]) for r in con.execute("DESCRIBE " + sql).fetchall()}
    wrong = {c: (t, declared.get(c)) for c, t in spark_df.dtypes if SQL_TYPES.get(t) != declared.get(c)}
    if wrong:
        return f"types {wrong}", -1
    got = spark_df.collect()
    cols, left = rows_of(spark_df.columns, [tuple(r) for r in got])
    cur = con.execute(sql)
    rcols, right = rows_of([d[0] for d in cur.description], cur.fetchall())
    if cols != rcols:
        return f"columns {cols} vs {rcols}", len(left)
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}", len(left)
    bad = [(a, b) for a, b in zip(left, right) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    return (f"{len(bad)} rows differ, e.g. {bad[0]}" if bad else None), len(left)


def session(cpus: str = "8"):
    from drivepulse.session import build_session

    spark = build_session(
        master=f"local[{cpus}]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="8g", spark__driver__host="127.0.0.1",
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(names):
    import __spark_entry__ as entry

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = session(), duck(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    chosen = [n for n in queries if not names or any(n.startswith(p) for p in names)]
    failures = 0
    for n in chosen:
        t = time.time()
        try:
            df = queries[n](spark, sf)
            if n in oracles:
                t1 = time.time()
                problem, count = compare(df, con, oracles[n])
            else:
                problem, count = None, len(df.collect())
        except Exception as e:  # report and go on with the next query
            problem, count = f"{type(e).__name__}: {str(e)[:600]}", -1
        failures += bool(problem)
        tag = "FAIL" if problem else ("ok" if n in oracles else "rows")
        print(f"{tag:5}{n:28}{count:8} {time.time() - t:6.2f}s {problem or ''}", flush=True)
    print(f"{len(chosen)} queries, {failures} failures")
    return failures


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
