"""Command line: index, retrieval, postings and scan.

    python -m siltgrain.cli indexer -index DIR [-positional | -tf] [-mb N] -input FILE...
    python -m siltgrain.cli buildContiguous -input DIR -output DIR
    python -m siltgrain.cli retrieval -index DIR -query FILE -algorithm SvS|WAND [-hits N] [-output DIR]
    python -m siltgrain.cli readPostings -index DIR [-term TERM]
    python -m siltgrain.cli noop FILE...
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siltgrain.functions.text import words
from siltgrain.operators import index, inspect, retrieve
from siltgrain.sources import collection


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="siltgrain", allow_abbrev=False)
    tools = top.add_subparsers(dest="tool", required=True)
    tool = tools.add_parser("indexer", allow_abbrev=False)
    tool.add_argument("-index", required=True)
    mode = tool.add_mutually_exclusive_group()
    mode.add_argument("-positional", action="store_true")
    mode.add_argument("-tf", action="store_true")
    tool.add_argument("-mb", type=int, help="accepted and not used: Spark bounds and spills its own buffers")
    tool.add_argument("-cutoff", type=int, default=index.DF_CUTOFF)
    tool.add_argument("-input", nargs="+", required=True)
    tool = tools.add_parser("buildContiguous", allow_abbrev=False)
    tool.add_argument("-input", required=True)
    tool.add_argument("-output", required=True)
    tool = tools.add_parser("retrieval", allow_abbrev=False)
    tool.add_argument("-index", required=True)
    tool.add_argument("-query", required=True)
    tool.add_argument("-algorithm", required=True, choices=("SvS", "WAND"))
    tool.add_argument("-hits", type=int, default=1000)
    tool.add_argument("-output")
    tool = tools.add_parser("readPostings", allow_abbrev=False)
    tool.add_argument("-index", required=True)
    tool.add_argument("-term")
    tool = tools.add_parser("noop", allow_abbrev=False)
    tool.add_argument("files", nargs="+")
    return top


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("siltgrain").getOrCreate()
    if args.tool == "indexer":
        mode = index.Mode.POSITIONAL if args.positional else index.Mode.TF if args.tf else index.Mode.NONPOSITIONAL
        index.build(collection.read_collection(spark, *args.input), mode, args.cutoff).write(args.index)
    elif args.tool == "buildContiguous":
        index.load(spark, args.input).write(args.output)
    elif args.tool == "retrieval":
        found = retrieve.retrieve(index.load(spark, args.index), collection.read_queries(spark, args.query), args.algorithm, args.hits)
        if args.output:
            collection.write_results(found, args.output)
        else:
            for row in collection.result_lines(found).orderBy("qid", "place").toLocalIterator():
                print(row.line)
    elif args.tool == "readPostings":
        known = index.load(spark, args.index)
        if args.term is None:
            for row in inspect.listing(known).orderBy("termid").toLocalIterator():
                print(f"termid: {row.termid}  df: {row.df}")
        else:
            n = 0
            for n, row in enumerate(inspect.pairs(known, args.term).toLocalIterator(), 1):  # a part at a time
                print(row.pair, end=" ")
            if not n:
                print(f"No postings for term {args.term}")
                return 1
            print()
    else:
        start = time.perf_counter()
        n = collection.read_collection(spark, *args.files).agg(F.sum(F.size(words(F.col("text"))))).first()[0] or 0
        print(f"tokens: {n}  seconds: {time.perf_counter() - start:.3f}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
