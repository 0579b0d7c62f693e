"""Run a registered query and its DuckDB counterpart and compare the rows.

    python tests/compare.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from corpuslens.plans import catalog
from corpuslens.plans.fixtures import BASE_TABLES
from corpuslens.session import local_session


def canon(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9)) if v != int(v) else repr(int(v)) + ".0"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return str(v)


def rows_of(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(canon(r[i]) for i in order) for r in data)


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, name, sf_dir):
    """(ok, message) for one query."""
    df = catalog.QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        return None, f"{len(got[1])} rows, no SQL"
    rel = con.sql(sql)
    want = rows_of(list(rel.columns), rel.fetchall())
    if got[0] != want[0]:
        return False, f"columns {got[0]} vs {want[0]}"
    if got[1] != want[1]:
        gs, ws = set(got[1]), set(want[1])
        extra, missing = sorted(gs - ws)[:3], sorted(ws - gs)[:3]
        return False, f"rows {len(got[1])} vs {len(want[1])}\n   {got[0]}\n   spark {extra}\n   duck  {missing}"
    return True, f"{len(got[1])} rows"


def main(argv):
    sf_dir = "/root/testdata/sf0.01"
    if argv[:1] == ["--sf"]:
        sf_dir, argv = argv[1], argv[2:]
    spark, con = local_session("8"), duck(sf_dir)
    bad = 0
    for name in argv or sorted(catalog.QUERIES):
        t = time.time()
        try:
            ok, msg = compare(spark, con, name, sf_dir)
        except Exception as e:
            ok, msg = False, "".join(traceback.format_exception_only(e))[:1200]
            if "-v" in sys.argv:
                traceback.print_exc()
        bad += ok is False
        print(f"{'OK  ' if ok else 'rows' if ok is None else 'FAIL'} {name} {time.time() - t:.1f}s {msg}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main([a for a in sys.argv[1:] if a != "-v"]) else 0)
