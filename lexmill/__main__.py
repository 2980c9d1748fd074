"""``python -m lexmill list`` and ``python -m lexmill run NAME --data DIR --out DIR [--skip-existing]``."""

from __future__ import annotations

import argparse

from .plans import registry


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lexmill", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of the queries")
    run = sub.add_parser("run", help="run a query and write its result as Parquet")
    run.add_argument("name", choices=sorted(registry.queries()))
    run.add_argument("--data", required=True)
    run.add_argument("--out", required=True)
    run.add_argument("--skip-existing", action="store_true", help="leave a result that is there as it is")
    a = p.parse_args(argv)
    if a.command == "list":
        print(*sorted(registry.queries()), sep="\n")
        return 0
    from pyspark.sql import SparkSession

    from .session import local_session

    spark = SparkSession.getActiveSession() or local_session()
    registry.queries()[a.name](spark, a.data).write.mode("ignore" if a.skip_existing else "overwrite").parquet(a.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
