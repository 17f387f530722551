"""Run queries next to their SQL: `python -m verification.check [sf_dir] [name ...]`."""

from __future__ import annotations

import os
import sys
import time
import traceback

import duckdb

from promptledger.session import build_session

from .registry import ORACLES, QUERIES
from .views import TABLES


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


def main(argv: list[str]) -> int:
    from . import load_all

    load_all()
    sf = argv[0] if argv and argv[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("/")] or list(QUERIES)
    spark = build_session("check", f"local[{os.environ.get('BENCH_CPUS', '8')}]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = 0
    for name in names:
        began = time.time()
        try:
            arrow = QUERIES[name](spark, sf).toArrow()
            took = time.time() - began
            mine = canonical(zip(*[c.to_pylist() for c in arrow.columns]), arrow.column_names)
            note = "rows only"
            if name in ORACLES:
                want = con.execute(ORACLES[name]).to_arrow_table()
                theirs = canonical(zip(*[c.to_pylist() for c in want.columns]), want.column_names)
                types = {f.name: str(f.type) for f in arrow.schema}, {f.name: str(f.type) for f in want.schema}
                same = sorted(arrow.column_names) == sorted(want.column_names)
                if not same or mine != theirs:
                    bad += 1
                    note = f"MISMATCH {len(mine)} vs {len(theirs)} rows, columns {types}"
                    extra = [tuple(x[:160] for x in r) for r in mine if r not in set(theirs)][:3]
                    missing = [tuple(x[:160] for x in r) for r in theirs if r not in set(mine)][:3]
                    note += f"\n   only Spark: {extra}\n   only SQL:   {missing}"[:1500]
                else:
                    diff = {c: (a, types[1][c]) for c, a in types[0].items()
                            if a.replace("large_", "") != types[1][c].replace("large_", "")}
                    note = "ok" + (f"  types differ: {diff}" if diff else "")
            print(f"{name:28s} {len(mine):7d} rows {took:6.2f}s  {note}", flush=True)
        except Exception as err:
            bad += 1
            print(f"{name:28s} FAILED {str(err)[:600]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print(f"{len(names) - bad} of {len(names)} fine")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
