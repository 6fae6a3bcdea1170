"""Run queries in Spark and their checking statements in DuckDB and compare the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
#: Queries that SQL cannot say; tests of their own compare them with brute force.
NO_STATEMENT = (
    "op2_line_dedup op3_embedding_dedup op4_benchmark_leaks op5_mixture_rates op6_toxicity op7_secret_ledger op8_personal_data "
    "op9_near_documents op10_warc_index op11_packing op13_dialogue_repair pipeline"
).split()


def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    return value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, sf_dir, name, run, statement):
    """Return (ok, message, seconds)."""
    start = time.time()
    df = run(spark, sf_dir)
    got_columns, got = normal(df.columns, [tuple(r) for r in df.collect()])
    seconds = time.time() - start
    if statement is None:
        tested = name in NO_STATEMENT
        return tested, f"{'rows only' if tested else 'neither a statement nor a test of its own'}: {len(got)}", seconds
    cursor = con.execute(statement)
    want_columns, want = normal([d[0] for d in cursor.description], cursor.fetchall())
    if got_columns != want_columns:
        return False, f"columns {got_columns} != {want_columns}", seconds
    if len(got) != len(want):
        return False, f"{len(got)} rows != {len(want)}: {got[:1]} {want[:1]}", seconds
    different = [(g, w) for g, w in zip(got, want) if g != w or [type(x) for x in g] != [type(x) for x in w]]
    if different:
        return False, f"{len(different)} differ, first {different[0]}", seconds
    return True, f"{len(got)} rows", seconds


if __name__ == "__main__":
    import __spark_entry__ as entry
    from emberscope.runtime import local_session

    sf_dir = sys.argv[1]
    names = sys.argv[2:]
    spark = local_session()
    con = duck(sf_dir)
    runs, statements = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or runs:
        try:
            ok, message, seconds = compare(spark, con, sf_dir, name, runs[name], statements.get(name))
        except Exception as error:  # noqa: BLE001
            ok, message, seconds = False, str(error)[:700], 0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {seconds:.1f}s {message}"[:900], flush=True)
    print("failed:", bad, "of", len(names or runs))
