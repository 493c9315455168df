"""Run a registered query: ``python -m tidemark list`` or ``python -m tidemark run NAME TABLES OUT``.

Exit codes: 0 done, 2 for an unknown command or query.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from tidemark import catalog


def main(args: list[str]) -> int:
    queries = catalog.queries()
    if args == ["list"]:
        print("\n".join(queries))
        return 0
    if len(args) != 4 or args[0] != "run" or args[1] not in queries:
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName(f"tidemark {args[1]}").getOrCreate()
    queries[args[1]](spark, args[2]).write.mode("overwrite").parquet(args[3])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
