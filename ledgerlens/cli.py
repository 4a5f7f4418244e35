"""Command line: run a registered query or the batch pipeline.

    python -m ledgerlens.cli list
    python -m ledgerlens.cli query category_breakdown --data DIR --out OUT
    python -m ledgerlens.cli batch --data DIR --out OUT

On a cluster, submit with spark-submit; the session (and its
spark.checkpoint.dir) comes from the cluster configuration. Locally a
local[*] session is created.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession


def _session(local: bool) -> SparkSession:
    if local:
        from .session import local_session
        return local_session()
    spark = SparkSession.builder.getOrCreate()
    from .session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    return spark


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="ledgerlens")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="list registered queries")
    q = sub.add_parser("query", help="run one registered query, write parquet")
    q.add_argument("name")
    for p in (q, sub.add_parser("batch", help="answer every request, write results + audit")):
        p.add_argument("--data", required=True, help="folder with the input tables")
        p.add_argument("--out", required=True, help="output folder")
        p.add_argument("--local", action="store_true", help="create a local[*] session")
    a = ap.parse_args(argv)

    from .plans.catalog import ALL_QUERIES
    if a.cmd == "list":
        print("\n".join(sorted(ALL_QUERIES)))
        return 0
    spark = _session(a.local)
    if a.cmd == "query":
        if a.name not in ALL_QUERIES:
            print(f"unknown query {a.name!r}; see 'list'", file=sys.stderr)
            return 2
        ALL_QUERIES[a.name](spark, a.data).write.mode("overwrite").parquet(a.out)
        return 0
    from .plans.pipeline import run_batch
    from .sources import derived as D
    run_batch(D.requests(spark, a.data), D.requested_ledger(spark, a.data), D.responses(spark, a.data), a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
