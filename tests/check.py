"""Command-line comparison: python tests/check.py [--sf DIR] [query ...]"""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry  # noqa: E402
import oracle  # noqa: E402

from tidegrid.session import local_session  # noqa: E402


def main() -> None:
    args = sys.argv[1:]
    folder = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        folder, args = args[1], args[2:]
    spark = local_session("check", 8)
    con = oracle.connect(folder)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args or list(queries):
        try:
            start = time.time()
            df = queries[name](spark, folder)
            got, got_cols = oracle.spark_rows(df)
            spark_s = time.time() - start
            if name not in sqls:
                print(f"rows {name:28s} {len(got):8d} rows {spark_s:6.2f}s", flush=True)
                continue
            start = time.time()
            want, want_cols = oracle.duck_rows(con, sqls[name])
            duck_s = time.time() - start
            ok = got == want and got_cols == want_cols
            bad += not ok
            print(f"{'ok  ' if ok else 'BAD '} {name:28s} {len(got):8d} rows {spark_s:6.2f}s duck {duck_s:6.2f}s", flush=True)
            if not ok:
                print("  columns", got_cols, want_cols, "rows", len(got), len(want))
                diff = [(a, b) for a, b in zip(got, want) if a != b][:3]
                for a, b in diff:
                    print("   spark", a, "\n   duck ", b)
        except Exception as exc:
            bad += 1
            print(f"FAIL {name}: {str(exc)[:600]}", flush=True)
            if "-v" in sys.argv:
                traceback.print_exc()
    print("bad:", bad)


main()
