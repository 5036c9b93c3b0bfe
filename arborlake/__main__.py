"""python -m arborlake convert|append|summary|query ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession


def main() -> None:
    p = argparse.ArgumentParser(prog="arborlake")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert", help="SWC folder to a Parquet node table")
    c.add_argument("folder")
    c.add_argument("out")
    c.add_argument("--hemisphere", choices=["left", "right"])
    c.add_argument("--recursive", action="store_true")
    a = sub.add_parser("append", help="append points to a point table")
    a.add_argument("table")
    a.add_argument("more")
    b = sub.add_parser("points", help="folder of point CSV files to a point table")
    b.add_argument("folder")
    b.add_argument("out")
    s = sub.add_parser("summary", help="somas by hemisphere")
    s.add_argument("table")
    s.add_argument("--midline", type=float, default=5695.0)
    q = sub.add_parser("query", help="run a registered query over a folder of tables")
    q.add_argument("name")
    q.add_argument("folder")
    q.add_argument("out")
    args = p.parse_args()
    spark = SparkSession.builder.appName("arborlake").getOrCreate()
    if args.command == "convert":
        from arborlake.sources import swc

        print(json.dumps(swc.convert(spark, swc.discover(spark, args.folder, args.recursive), args.out, args.hemisphere)))
    elif args.command == "append":
        from arborlake.sources import tables

        print(tables.append_points(spark, args.table, args.more))
    elif args.command == "points":
        from arborlake.sources import tables

        print(json.dumps(tables.convert_point_folder(spark, args.folder, args.out)))
    elif args.command == "summary":
        from arborlake.operators.nodes import hemisphere_summary

        print(json.dumps(hemisphere_summary(spark.read.parquet(args.table), args.midline).first().asDict()))
    else:
        from arborlake.plans import catalogue

        catalogue.queries()[args.name](spark, args.folder).write.parquet(args.out)


if __name__ == "__main__":
    main()
