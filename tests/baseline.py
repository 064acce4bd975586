"""Wall time of each query's check SQL in DuckDB on the same tables: a yardstick for ``bench.py``.

    python -m tests.baseline /root/testdata/sf0.1 > table.md
"""

from __future__ import annotations

import sys
import time

from tests.oracle import connect


def main(sf_dir: str) -> None:
    import __spark_entry__ as entry

    con = connect(sf_dir)
    print("| query | DuckDB seconds |\n|---|---|")
    total = 0.0
    for name, sql in entry.oracle_sql().items():
        start = time.perf_counter()
        try:
            con.sql(sql).fetchall()
        except Exception as error:  # noqa: BLE001 - a query over the engine's limits has no time
            print(f"| {name} | {type(error).__name__} |")
            continue
        took = time.perf_counter() - start
        total += took
        print(f"| {name} | {took:.3f} |")
    print(f"| all | {total:.1f} |")


if __name__ == "__main__":
    main(sys.argv[1])
