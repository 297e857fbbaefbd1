"""python -m lattica diagram ROOT | make-config FILE | run QUERY TABLES"""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="lattica", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("diagram", help="a stored network as a Graphviz graph").add_argument("root")
    commands.add_parser("make-config", help="a configuration of defaults").add_argument("file")
    run = commands.add_parser("run", help="a query of the library over a folder of tables")
    run.add_argument("query")
    run.add_argument("tables")
    args = parser.parse_args(argv)
    if args.command == "make-config":
        from lattica.plans.configuration import DEFAULT

        with open(args.file, "w") as f:
            json.dump(DEFAULT, f, indent=2)
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("lattica").getOrCreate()
    if args.command == "diagram":
        from lattica.plans.network import Plan
        from lattica.sources.store import open_store

        print(Plan(open_store(spark, args.root, read_only=True)).diagram())
    else:
        from lattica.queries import QUERIES

        QUERIES[args.query](spark, args.tables).show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
