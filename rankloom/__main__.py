"""python -m rankloom list | run NAME --tables DIR [--out DIR] | compare A B --tables DIR [--report FILE]"""

from __future__ import annotations

import argparse
import json


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="rankloom", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("name")
    compare = sub.add_parser("compare")
    compare.add_argument("a")
    compare.add_argument("b")
    compare.add_argument("--labels", default="planted")
    compare.add_argument("--report")
    for p in (run, compare):
        p.add_argument("--tables", required=True)
    run.add_argument("--out")
    args = parser.parse_args(argv)

    from rankloom import api
    from rankloom.plans import registry

    if args.command == "list":
        print("\n".join(["queries:", *sorted(registry.QUERIES), "scorers:", *sorted(api.SCORERS)]))
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("rankloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "run":
        df = registry.QUERIES[args.name](spark, args.tables)
        df.write.mode("overwrite").parquet(args.out) if args.out else df.show(50, truncate=False)
        return 0
    from rankloom.sources import sinks
    from rankloom.sources.record import Record

    report = api.compare(Record(spark, args.tables), args.a, args.b, args.labels)
    if args.report:
        sinks.write_report(report, args.report)
    print(json.dumps(sinks.clean(report), indent=1))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
