"""Compare registered queries with their SQL: python tests/check.py [folder] [name ...]"""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from pairwise.session import clear_scratch, local_session  # noqa: E402
from tests.parity import compare  # noqa: E402


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    registered, sql = queries(), oracle_sql()
    failed = 0
    for name in wanted or registered:
        start = time.time()
        try:
            df = registered[name](spark, folder)
            if name in sql:
                problems = compare(df, sql[name], folder)
                verdict = "equal" if not problems else "DIFFERENT"
            else:
                problems, verdict = [], f"rows {df.count()}"
        except Exception:
            problems, verdict = [traceback.format_exc()[-3000:]], "ERROR"
        clear_scratch(spark)
        failed += bool(problems)
        print(f"{name:24s} {verdict:12s} {time.time() - start:7.1f}s", flush=True)
        for problem in problems:
            print("   ", problem, flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
