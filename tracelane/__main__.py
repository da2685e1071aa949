"""python -m tracelane load OUT FILE... writes the tables of logs as Parquet; query NAME FILE... prints a query's rows as CSV. A folder stands for its *.mlog.gz."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from tracelane.functions.csv import to_csv
from tracelane.plans.capture import SPECS, open_capture
from tracelane.sources.errors import CaptureError
from tracelane.sources.mlog import TraceSource, pick_directory, pick_files

QUERIES = sorted(n for n in SPECS if not n.startswith("distribution_"))


def sources_of(paths: list[str]) -> list[TraceSource]:
    if len(paths) == 1 and os.path.isdir(paths[0]):
        return pick_directory(paths[0])
    found, rejected = pick_files(paths)
    for file, why in rejected:
        print(f"{file}: {why}", file=sys.stderr)
    return found


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tracelane", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    load = commands.add_parser("load")
    load.add_argument("out")
    query = commands.add_parser("query")
    query.add_argument("name", choices=QUERIES)
    for command in (load, query):
        command.add_argument("paths", nargs="+")
    asked = parser.parse_args(args)
    spark = SparkSession.builder.appName("tracelane").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        with open_capture(spark, sources_of(asked.paths)) as capture:
            if asked.command == "load":
                for name, frame in capture.tables.items():
                    frame.write.mode("overwrite").parquet(os.path.join(asked.out, name))
                print(f"{capture.object.count()} objects")
            else:
                rows = getattr(capture, asked.name)()
                print(to_csv(rows.columns, rows.toLocalIterator()), end="")
    except CaptureError as e:
        print(f"{e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
