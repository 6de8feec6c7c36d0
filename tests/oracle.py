"""Runs queries against their SQL twins: python tests/oracle.py [sf_dir] [name...]."""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, bytearray):
        return bytes(x)
    return x


def compare(spark, con, name, query, sql, sf_dir):
    """Problems of one query against its SQL."""
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != cols:
        return f"columns {cols} against {sorted(names)}"
    place = [names.index(c) for c in cols]
    theirs = sorted((tuple(plain(r[p]) for p in place) for r in rel.fetchall()), key=str)
    if len(mine) != len(theirs):
        return f"{len(mine)} rows against {len(theirs)}"
    bad = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b]
    types = {c: {type(x).__name__ for r in (mine[:50], theirs[:50]) for x in [row[k] for row in r] if x is not None} for k, c in enumerate(cols)}
    mixed = {c: t for c, t in types.items() if len(t) > 1}
    if bad:
        return f"{len(bad)} of {len(mine)} rows differ: {bad[:2]}"
    return f"types {mixed}" if mixed else ""


def main():
    import __spark_entry__ as entry
    from sonolith.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(4, **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = connect(sf_dir), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:] or not sys.argv[2:] and (name.startswith("op") or name == "pipeline"):
            continue
        began = time.time()
        try:
            said = compare(spark, con, name, query, sqls[name], sf_dir) if name in sqls else f"rows only: {query(spark, sf_dir).count()}"
        except Exception as e:
            said = f"ERROR {str(e)[:600]}"
        failed += bool(said) and not said.startswith("rows only")
        print(f"{name}: {said or 'equal'} ({time.time() - began:.1f} s)", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
