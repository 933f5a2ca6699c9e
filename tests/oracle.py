"""Run queries beside their SQL twins: ``python tests/oracle.py [sf] [names…]``."""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET threads TO 8")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, float):
        return (2, "nan" if math.isnan(v) else repr(v + 0.0))
    if isinstance(v, int):
        return (2, repr(float(v)))
    return (3, str(v))


# Spark type -> DuckDB type
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
         "boolean": "BOOLEAN"}


def type_gaps(df, rel):
    want = dict(zip(rel.columns, map(str, rel.types)))
    return [f"{n}: {t} vs {want[n]}" for n, t in df.dtypes if TYPES.get(t, t) != want.get(n)]


def compare(df, rel):
    """None if equal, else what differs."""
    cols = sorted(df.columns)
    if cols != sorted(rel.columns):
        return f"columns {cols} vs {sorted(rel.columns)}"
    got = sorted(tuple(norm(v) for v in r) for r in df.select(*cols).collect())
    names = ", ".join(f'"{c}"' for c in cols)
    want = sorted(tuple(norm(v) for v in r) for r in rel.select(names).fetchall())
    if got == want:
        return None
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    diff = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(diff)} of {len(got)} rows differ, first: " + str(
        [(c, g[1], w[1]) for c, g, w in zip(cols, *diff[0]) if g != w])


def main():
    import __spark_entry__ as entry
    from nocturne.session import get_session

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("sf") else "sf0.01"
    sf_dir = f"/root/testdata/{sf}"
    spark = get_session("oracle", "local[8]")
    spark.conf.set("spark.sql.shuffle.partitions", os.environ.get("ORACLE_PARTITIONS", "8"))
    spark.conf.set("spark.sql.session.timeZone", os.environ.get("ORACLE_TZ", "UTC"))
    spark.sparkContext.setLogLevel("OFF")
    con, bad = connect(sf_dir), 0
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name, run in queries.items():
        if args and not any(a in name for a in args):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in oracles:
                rel = con.sql(oracles[name])
                problem = compare(df, rel)
                gaps = type_gaps(df, rel)
                if gaps:
                    print("types", name, gaps, flush=True)
                n = len(rel)
            else:
                n, problem = df.count(), None
        except Exception as e:  # report and go on
            n, problem = -1, f"{type(e).__name__}: {str(e)[:600]}"
        kind = "sql" if name in oracles else "rows"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok':4} {kind} {name:32} rows={n} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
