"""Run registered queries and their SQL side by side: python tools/check.py [-d sf_dir] [-x] [name ...]"""

import argparse
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from loomcraft.catalog import QUERIES, SQL  # noqa: E402
from loomcraft.session import build_session  # noqa: E402
from tools.compare import database, spark_rows, sql_rows  # noqa: E402


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("-d", default="/root/testdata/sf0.01")
    ap.add_argument("-x", action="store_true", help="show the plan")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = build_session("check")
    spark.sparkContext.setLogLevel("ERROR")
    db = database(args.d)
    bad = []
    for name in args.names or list(QUERIES):
        start = time.time()
        try:
            if args.x:
                QUERIES[name](spark, args.d).explain("formatted")
            columns, mine = spark_rows(spark, args.d, name)
        except Exception as e:
            bad.append(name)
            print(f"{name}: ERROR {str(e)[:1500]}")
            continue
        took = f"{time.time() - start:.1f}s"
        if name not in SQL:
            print(f"{name}: {mine.total()} rows, no SQL ({took})")
            continue
        have, theirs = sql_rows(db, name)
        if have == columns and mine == theirs:
            print(f"{name}: ok, {mine.total()} rows ({took})" + ("" if mine else "  EMPTY"))
            continue
        bad.append(name)
        print(f"{name}: DIFFERENT {mine.total()} and {theirs.total()} rows, columns {columns} and {have}")
        for tag, rest in (("spark", mine - theirs), ("sql", theirs - mine)):
            for r in sorted(rest)[:2]:
                print(f"    {tag} only ({rest.total()}): {r[:600]}")
    print("bad:", bad)


if __name__ == "__main__":
    main()
