"""Command line: extract, load, report, inspect. Exit codes: 0, 2 for input to mend, 1 for anything else."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from spanloom.operators import graph, report
from spanloom.operators import text as T
from spanloom.plans import flagship
from spanloom.plans.base import values
from spanloom.schemas import BadInput
from spanloom.session import session
from spanloom.sources import storage, tables


def probability(x: str) -> float:
    if not 0 <= (v := float(x)) <= 1:
        raise argparse.ArgumentTypeError("a probability lies in [0, 1]")
    return v


def positive(x: str) -> int:
    if (v := int(x)) < 1:
        raise argparse.ArgumentTypeError("a positive whole number is needed")
    return v


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spanloom")
    sub = p.add_subparsers(dest="verb", required=True)
    x = sub.add_parser("extract", help="documents (parquet: doc_id, text) to mentions, entities and relations")
    x.add_argument("documents")
    x.add_argument("out")
    x = sub.add_parser("load", help="a run folder into the graph store")
    x.add_argument("run")
    x.add_argument("store")
    x.add_argument("--script", help="also write statements to this folder")
    x = sub.add_parser("report", help="a call log and prices to a markdown table")
    x.add_argument("calls")
    x.add_argument("prices")
    x = sub.add_parser("inspect", help="the chunks of a document")
    x.add_argument("documents")
    x.add_argument("doc_id", type=int)
    x.add_argument("--chunk-size", type=positive, default=T.CHUNK_ASKABLE)
    return p


def run(args: argparse.Namespace) -> None:
    spark = session()
    if args.verb == "extract":
        docs = spark.read.parquet(args.documents).select("doc_id", "text")
        found = flagship.extract(docs, values(spark, flagship.LEXICON, "word string, kind_of string"))
        found.write.mode("overwrite").parquet(f"{args.out}/mentions")
        entities, relations = flagship.graph_of(spark.read.parquet(f"{args.out}/mentions"), values(spark, flagship.SIGNATURES, "ordinal int, relation string, domain_kind string, range_kind string, text string"))
        entities.write.mode("overwrite").parquet(f"{args.out}/entities")
        relations.write.mode("overwrite").parquet(f"{args.out}/relations")
    elif args.verb == "load":
        if not storage.exists(spark, f"{args.run}/entities"):
            raise BadInput(f"{args.run} has no entities")
        e = spark.read.parquet(f"{args.run}/entities").select("entity_id", "type", "canonical_name", "aliases", F.lit(1.0).alias("confidence"))
        r = spark.read.parquet(f"{args.run}/relations").select("source_id", "type", "target_id", F.lit(args.run).alias("doc_id"), "count", "confidence")
        docs = spark.createDataFrame([(args.run,)], "doc_id string")
        mentioned = e.select("entity_id", F.lit(args.run).alias("doc_id"), F.lit(1).cast("long").alias("count"), F.array().cast("array<string>").alias("pages"))
        store = graph.ParquetGraph(spark, args.store)
        store.load(e, r, docs, mentioned)
        if args.script:
            graph.export_script(args.script, e, mentioned=mentioned, relations=r)
        print(store.counts())
    elif args.verb == "report":
        calls = report.with_price(tables.read_calls(spark, args.calls), tables.load_prices(spark, args.prices))
        print(report.markdown(report.call_stats(calls, ["variant", "stage"])))
    else:
        docs = spark.read.parquet(args.documents).where(F.col("doc_id") == args.doc_id).select("doc_id", "text")
        T.segment(docs, args.chunk_size).select(F.inline("chunks")).show(100, truncate=80)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        run(args)
    except BadInput as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
