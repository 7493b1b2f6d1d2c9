"""Compare registered queries with their SQL twins: python check.py [--chunked] [sf_dir] [--types] [name-prefix ...]

--chunked makes chunks so small that most keys are cut.
"""
import math
import sys
import time

import duckdb

from cohortloom import plans, session
from cohortloom.operators import ordered

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT"}


def norm(v):
    if v is None:
        return None
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def kind(v):
    return "f" if isinstance(v, float) else "b" if isinstance(v, bool) else "i" if isinstance(v, int) else type(v).__name__


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def main():
    if "--chunked" in sys.argv:
        sys.argv.remove("--chunked")
        ordered.ROWS_PER_CHUNK = 40
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    types_only = "--types" in sys.argv
    prefixes = [a for a in sys.argv[2:] if a != "--types"]
    spark = session.build("8")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = []
    for name, fn in plans.QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            got = [] if types_only else rows_of(df.columns, df.collect())
        except Exception as e:
            print(f"FAIL  {name}: {str(e)[:700]}")
            bad.append(name)
            continue
        t1 = time.time()
        sql = plans.ORACLES.get(name)
        if sql:
            types = {c: TYPES.get(t, t) for c, t in df.dtypes}
            theirs = {row[0]: row[1] for row in con.execute("DESCRIBE " + sql).fetchall()}
            off = {c: (types.get(c), theirs.get(c)) for c in theirs if types.get(c) != theirs[c]}
            if off:
                print(f"TYPES {name}: {off}")
                bad.append(name)
        if types_only:
            continue
        if not sql:
            print(f"rows  {name}: {len(got)} rows {t1 - t0:.1f}s")
            continue
        try:
            res = con.execute(sql)
            cols = [d[0] for d in res.description]
            want = rows_of(cols, res.fetchall())
        except Exception as e:
            print(f"ORACLE {name}: {str(e)[:700]}")
            bad.append(name)
            continue
        problem = None
        if sorted(cols) != sorted(df.columns):
            problem = f"columns {sorted(df.columns)} vs {sorted(cols)}"
        elif len(got) != len(want):
            problem = f"rows {len(got)} vs {len(want)}"
        elif got != want:
            i = next(i for i, (a, b) in enumerate(zip(got, want)) if a != b)
            n = sum(a != b for a, b in zip(got, want))
            problem = f"{n} rows differ, first\n    cols  {sorted(cols)}\n    spark {str(got[i])[:600]}\n    duck  {str(want[i])[:600]}"
        elif got:
            for i, c in enumerate(sorted(cols)):
                a = {kind(x[i]) for x in got if x[i] is not None}
                b = {kind(x[i]) for x in want if x[i] is not None}
                if a != b:
                    problem = f"type of {c}: {a} vs {b}"
        if problem or not got:
            print(f"DIFF  {name}: {problem or 'no rows'}")
            bad.append(name)
        else:
            print(f"ok    {name}: {len(got)} rows {t1 - t0:.1f}s duck {time.time() - t1:.1f}s")
        sys.stdout.flush()
    print(f"{len(bad)} bad: {bad}")


if __name__ == "__main__":
    main()
