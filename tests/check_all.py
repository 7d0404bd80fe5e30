"""Run every query on a table folder: python tests/check_all.py [sf_dir] [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as entry  # noqa: E402
from compare import connect, differences  # noqa: E402

from vitalgrid.session import build_session  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    conf = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    spark = build_session("check", "local[8]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    checks, failed = entry.oracle_sql(), []
    for name, query in entry.queries().items():
        if chosen and name not in chosen:
            continue
        started = time.time()
        try:
            frame = query(spark, sf_dir)
            if name in checks:
                problems = differences(frame, connection, checks[name])
            else:
                problems = [] if frame.count() else ["no rows"]
        except Exception as error:  # noqa: BLE001
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        print(f"{'ok  ' if not problems else 'FAIL'} {name} {time.time() - started:.2f}s {'' if name in checks else '(rows)'} {problems or ''}", flush=True)
        failed += [name] * bool(problems)
    print("failed:", failed)


if __name__ == "__main__":
    main()
