"""Commands over item files: python -m ctxloom pack|trace|quality|place|budget|cost|diff|issues FILE ... ; one JSON line a row."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import issues, packing, quality, sets
from .sources.records import load_items


def _items(spark, path, budget):
    rows = load_items(spark, path).withColumn("ord", F.monotonically_increasing_id()).withColumn("pack_id", F.lit("pack"))
    rows = rows.withColumn("tokens", F.coalesce(F.col("tokens").cast("long"), T.estimate_tokens(F.col("content")))).withColumn("recency", F.coalesce("recency", F.lit(0.0)))
    salience = F.coalesce(F.col("metadata").getItem("salience").cast("double"), F.lit(0.0))
    rows = rows.withColumn("salience", salience).withColumn("score", F.coalesce("score", packing.score()))
    return rows.withColumn("budget", F.lit(budget).cast("long"))


def run(spark: SparkSession, args) -> list[dict]:
    if args.command == "budget":
        return [{"advertised": args.tokens, "effective": spark.range(1).select(T.effective_budget(F.lit(float(args.tokens)), args.model).alias("b")).first()["b"]}]
    if args.command == "cost":
        row = spark.createDataFrame([(args.input, args.cached, args.output)], "input_tokens long, cached_tokens long, output_tokens long")
        return [r.asDict() for r in quality.costs(row, args.model).collect()]
    if args.command == "diff":
        a, b = (load_items(spark, p).withColumn("ord", F.monotonically_increasing_id()) for p in (args.file, args.other))
        return [r.asDict() for r in sets.diff(a, b, "id", ["content", "tokens"], "ord").select("id", "change").orderBy("id").collect()]
    items = _items(spark, args.file, args.tokens)
    if args.command == "quality":
        return [r.asDict() for r in quality.analyze(items).collect()]
    if args.command == "place":
        return [r.asDict() for r in packing.place(items, args.model).select("id", "position").orderBy("position").collect()]
    decided = packing.greedy(items, ["pack_id"])
    if args.command == "issues":
        made = issues.create_handoff(decided, args.now, "cli")
        return [json.loads(r["j"]) for r in made.select(F.to_json(F.struct(*made.columns)).alias("j")).collect()]
    if args.command == "trace":
        return [r.asDict() for r in packing.trace(decided, ["pack_id"]).select("step", "id", "decision", "reason").orderBy("step").collect()]
    return [r.asDict() for r in decided.where("chosen").select("id", "tokens", "score").orderBy(F.desc("score"), "id").collect()]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ctxloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("pack", "trace", "quality", "place", "issues"):
        s = sub.add_parser(name)
        s.add_argument("file")
        s.add_argument("--tokens", type=int, default=4096)
        s.add_argument("--model", default="default")
        s.add_argument("--now", default="1970-01-01T00:00:00Z")
    s = sub.add_parser("diff")
    s.add_argument("file")
    s.add_argument("other")
    s = sub.add_parser("budget")
    s.add_argument("tokens", type=int)
    s.add_argument("--model", default="default")
    s = sub.add_parser("cost")
    s.add_argument("--model", default="claude-sonnet-4-6")
    for n in ("input", "cached", "output"):
        s.add_argument(f"--{n}", type=int, default=0)
    return p


def main(argv=None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    for row in run(spark, args):
        sys.stdout.write(json.dumps(row, default=str) + "\n")


if __name__ == "__main__":
    main()
