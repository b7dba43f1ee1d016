"""python -m foldquery scan|filter PATTERN SEQUENCE [--pos-var VARIABLES], or scan-file PATTERN PATH."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def main() -> None:
    from foldquery.engine import Engine
    from foldquery.sources.files import literal, sequence_files

    p = argparse.ArgumentParser(prog="foldquery", description=__doc__)
    p.add_argument("call", choices=["scan", "filter", "scan-file"])
    p.add_argument("ss")
    p.add_argument("sequence", help="residues, or a path for scan-file")
    p.add_argument("--pos-var", default="")
    p.add_argument("--root", default="foldquery-store")
    a = p.parse_args()
    spark = SparkSession.builder.appName("foldquery").getOrCreate()
    engine = Engine(spark, a.root)
    rows = sequence_files(spark, a.sequence).withColumnRenamed("path", "seq_id") if a.call == "scan-file" else literal(spark, a.sequence)
    out = engine.filter(rows, a.ss, a.pos_var) if a.call == "filter" else engine.scan(rows, a.ss, a.pos_var)
    print(*out.columns, sep="\t")
    for row in out.toLocalIterator():  # every row, one task's at a time
        print(*row, sep="\t")


if __name__ == "__main__":
    main()
