"""Runs registered queries and compares each with its SQL in DuckDB.

usage: python tools/check.py [--sf 0.01] [name-prefix ...]
"""

import argparse
import os
import sys
import tempfile
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from corpuslens.plans import catalog  # noqa: E402
from corpuslens.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    out = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark = local_session(8)
    spark.range(10).count()
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    bad = []
    for name, fn in catalog.QUERIES.items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        try:
            begin = time.time()
            fn(spark, sf_dir).write.parquet(f"{out}/{name}")
            spent = time.time() - begin
            got = f"(select * from read_parquet('{out}/{name}/*.parquet'))"
            rows = db.execute(f"select count(*) from {got}").fetchall()[0][0]
            if name not in catalog.ORACLE:
                print(f"rows  {name:38s} {rows:9d} rows {spent:6.1f}s", flush=True)
                if rows == 0:
                    bad.append(name)
                continue
            begin = time.time()
            db.execute(f"create or replace table want as {catalog.ORACLE[name]}")
            sql_time = time.time() - begin
            want_types = {r[0]: r[1] for r in db.execute("describe want").fetchall()}
            got_types = {r[0]: r[1] for r in db.execute(f"describe select * from {got}").fetchall()}
            note = "" if want_types == got_types else f" types {got_types} / {want_types}"
            cols = ", ".join(f'"{c}"' for c in sorted(want_types))
            extra = db.execute(f"select {cols} from {got} except all select {cols} from want").fetchall()
            missing = db.execute(f"select {cols} from want except all select {cols} from {got}").fetchall()
            ok = not extra and not missing and rows > 0 and want_types.keys() == got_types.keys()
            print(
                f"{'ok   ' if ok else 'FAIL '} {name:38s} {rows:9d} rows {spent:6.1f}s sql {sql_time:5.1f}s{note}",
                flush=True,
            )
            if not ok:
                bad.append(name)
                print("   only spark:", len(extra), str(extra[:3])[:600])
                print("   only sql:  ", len(missing), str(missing[:3])[:600])
        except Exception as error:  # report and go on with the next query
            bad.append(name)
            print(f"ERROR {name}: {str(error)[:700]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
