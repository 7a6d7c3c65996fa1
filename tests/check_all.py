"""``python tests/check_all.py <sf_dir> [name ...]``: compare all registered queries."""

import os
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from seatflow.session import build_session  # noqa: E402
from tests.compare import compare, duck  # noqa: E402


def main() -> int:
    sf, names = sys.argv[1], sys.argv[2:]
    spark = build_session(master=os.environ.get("MASTER", "local[8]"))
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, failed = duck(sf), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in sql:
                problem = compare(spark, con, sf, fn, sql[name])
                note = "ok" if problem is None else problem
            else:
                problem, note = None, f"rows only: {len(fn(spark, sf).collect())}"
        except Exception as error:  # report and go on
            problem = note = "".join(traceback.format_exception_only(error))[:1500]
        failed += problem is not None
        print(f"{'FAIL' if problem else 'pass'} {name:24s} {time.time() - start:6.1f}s {note}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
