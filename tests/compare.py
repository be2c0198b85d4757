"""Run registered queries beside their SQL and compare the values."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.6g}" if abs(v) < 1e6 else f"{float(v):.2f}"
    return str(v)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def check(name, fn, oracle, spark, con, sf_dir) -> str:
    got = fn(spark, sf_dir)
    mine = table(got.columns, [tuple(r) for r in got.collect()])
    if oracle is None:
        return f"rows {len(mine)}"
    cur = con.execute(oracle)
    names = [c[0] for c in cur.description]
    if sorted(names) != sorted(got.columns):
        return f"COLUMNS {sorted(set(names) ^ set(got.columns))}"
    theirs = table(names, cur.fetchall())
    if len(mine) != len(theirs):
        return f"COUNT spark {len(mine)} sql {len(theirs)}"
    if mine != theirs:
        bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
        return f"VALUES {len(bad)} of {len(mine)}: {bad[0][0]} | {bad[0][1]}"
    return f"ok {len(mine)}"


def main() -> None:
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from packetloom.session import local_session

    sf_dir, picked = sys.argv[1], sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name in picked or queries:
        begun = time.time()
        try:
            result = check(name, queries[name], oracle.get(name), spark, con, sf_dir)
        except Exception as error:  # report and go on with the next query
            result = "ERROR " + type(error).__name__ + ": " + " ".join(str(error).split())[:700]
        print(f"{name:32s} {time.time() - begun:6.1f}s {result}", flush=True)


if __name__ == "__main__":
    main()
