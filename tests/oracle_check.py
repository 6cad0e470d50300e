"""Run registered queries against their SQL at one scale: python tests/oracle_check.py [dir] [name ...]."""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    """A comparable form: equal for equal values of either engine."""
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        value = float(value)
        return (2, "nan" if math.isnan(value) else repr(value + 0.0))
    if isinstance(value, dict):
        return (3, str([(k, plain(v)) for k, v in sorted(value.items())]))
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, (list, tuple)):
        return (4, str([plain(v) for v in value]))
    return (5, str(value))


def differences(spark_df, con, sql):
    """An empty list when both sides hold the same rows under the same column names."""
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    expected = result.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} against {sorted(names)}"], 0
    order = sorted(names)
    got = sorted(tuple(plain(r[c]) for c in order) for r in spark_df.collect())
    want = sorted(tuple(plain(dict(zip(names, r))[c]) for c in order) for r in expected)
    if len(got) != len(want):
        return [f"{len(got)} rows against {len(want)}"], len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return ([f"{len(bad)} rows differ, first:\n   {bad[0][0]}\n   {bad[0][1]}"] if bad else []), len(got)


def types_of(spark_df, con, sql):
    spark_types = {f.name: f.dataType.simpleString() for f in spark_df.schema}
    duck = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    same = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "float": "FLOAT"}
    return {c: (t, duck.get(c)) for c, t in spark_types.items() if same.get(t, t) != duck.get(c)}


def main():
    import __spark_entry__ as entry
    from sparquill.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark, con = build_session("oracle-check", 8), connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = []
    for name, run in queries.items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in oracles:
                problems, n = differences(df, con, oracles[name])
                loose = types_of(df, con, oracles[name])
            else:
                problems, n, loose = [], df.count(), {}
        except Exception as error:
            problems, n, loose = [f"{type(error).__name__}: {str(error)[:600]}"], 0, {}
        mark = "FAIL" if problems else ("ok" if name in oracles else "rows only")
        print(f"{mark:9} {name:28} {n:8} rows {time.time() - start:6.2f}s {loose or ''}", flush=True)
        for p in problems:
            print("   ", p[:1500], flush=True)
        if problems:
            failed.append(name)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
