"""2.14: the engine from a shell.

    spark-submit --py-files polyquilt.zip polyquilt/__main__.py solve --k-max 3 --out hdfs:///tilings
    python -m polyquilt report --solutions tilings --out report

Every command runs one job of the library; paths are Spark's.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyquilt.functions.text import parse_range
from polyquilt.operators import report, search
from polyquilt.operators.tables import numbered
from polyquilt.sources import lattices, solutions, tilings


def _arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="polyquilt", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *options: tuple[str, dict]) -> None:
        sub = commands.add_parser(name, help=text)
        for flag, how in options:
            sub.add_argument(flag, **({"required": True} | how))

    k_max = ("--k-max", {"type": int})
    found, out = ("--solutions", {}), ("--out", {})
    keep = ("--k", {"required": False, "help": "a list like 1-3,5: only results of these numbers of vertices"})
    command("count", "print the unique results of each number of vertices", k_max)
    command("solve", "enumerate, and write the unique results as a store", k_max, out)
    command("report", "write the six tables of the report as CSV", found, out, keep)
    command("texts", "write the results as texts, with their polygons", found, out, keep)
    command("documents", "write the results as tiling documents", found, out, keep)
    command("lattices", "develop the results, and write the exact lattices as a store", found, out, keep)
    command("import", "read lattices from JSON into a store", ("--json", {}), out)
    command("export", "write a complete store of lattices as JSON", ("--store", {}), out)
    return p


def _kept(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    rows = solutions.read(spark, args.solutions)
    return rows if args.k is None else report.at_most(rows, max(parse_range(args.k))).filter(F.col("k").isin(parse_range(args.k)))


def _made(rows: DataFrame) -> DataFrame:
    """Documents with an id and a file name each, by combo and document."""
    placed = numbered(tilings.documents(rows), [], [F.col("combo"), F.col("document")]).withColumn("id", F.col("idx") + 1)
    return placed.withColumn("filename", F.concat("combo", F.lit("_"), F.col("id").cast("string"), F.lit(".tes")))


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run one command; 1 where an import or a development left failures behind."""
    args = _arguments().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"polyquilt {args.command}").getOrCreate()
    if args.command == "count":
        for row in search.counts(spark, args.k_max).orderBy("k").collect():  # a row for each k
            print(f"k={row['k']}: {row['n']}")
    elif args.command == "solve":
        solutions.write(search.unique(search.solutions(spark, args.k_max)), args.out)
    elif args.command == "report":
        rows = _kept(spark, args)
        report.write_report(report.result_members(rows), rows, args.out)
    elif args.command == "texts":
        solutions.to_text(solutions.with_texts(_kept(spark, args).select("k", "combo", "types", "glue"))).write.text(args.out)
    elif args.command == "documents":
        tilings.write_documents(_made(_kept(spark, args)).filter("error IS NULL").select("id", "combo", "signature", "filename", "document"), args.out)
    elif args.command == "lattices":
        made = _made(_kept(spark, args)).select("id", "combo", "signature", "filename", "document")
        rows = tilings.convert(made, "0" * 64).withColumn("name", F.col("id").cast("string"))
        lattices.write(rows, args.out)
        return int(not lattices.is_complete(spark, args.out))
    elif args.command == "import":
        try:
            lattices.import_json(spark, args.json, args.out)
        except lattices.IncompleteStore as e:
            print(e, file=sys.stderr)
            return 1
    else:
        lattices.export_json(spark, args.store, args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
