"""Commands: ``run`` the pipeline over layout tables, ``audit`` stored chunks, ``compare`` two runs, ``diagnose`` program
text, and ``ask`` the runner of tasks. Those that say something print JSON, and write it to a file with ``-o``."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vellum.config import ChunkConfig, PipelineConfig
from vellum.functions.code import analyse_column
from vellum.operators import diff, quality, runner
from vellum.plans import pipeline
from vellum.sources import readers, writers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vellum", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run")
    run.add_argument("tables", help="folder with documents, pages, blocks and tables as Parquet")
    run.add_argument("-o", "--output", required=True)
    run.add_argument("--config", help="JSON settings")
    for name in ("min", "target", "max", "overlap"):
        run.add_argument(f"--{name}-tokens", type=int)
    audit = sub.add_parser("audit")
    audit.add_argument("children")
    audit.add_argument("parents")
    audit.add_argument("--units")
    compare = sub.add_parser("compare")
    compare.add_argument("old")
    compare.add_argument("new")
    compare.add_argument("--key", default="child_id")
    diagnose = sub.add_parser("diagnose")
    diagnose.add_argument("units", help="JSON lines of units with unit_id, kind and text")
    ask = sub.add_parser("ask")
    ask.add_argument("goal")
    ask.add_argument("--workspace", help="folder that the runner may read and write")
    ask.add_argument("--max-steps", type=int, default=12)
    ask.add_argument("--yes", action="store_true", help="approve what is risky")
    for command in (audit, compare, diagnose, ask):
        command.add_argument("-o", "--output", help="file for the JSON, which must not be there yet")
    return p


def _say(text: str, path: str | None) -> None:
    if path:
        with open(path, "x", encoding="utf-8") as out:
            out.write(text + "\n")
    print(text)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("vellum").getOrCreate()
    if args.command == "run":
        config = PipelineConfig.from_json(open(args.config).read()) if args.config else PipelineConfig()
        given = {f"{n}_tokens": v for n in ("min", "target", "max", "overlap") if (v := getattr(args, f"{n}_tokens")) is not None}
        config = replace(config, chunk=replace(config.chunk, **given)) if given else config
        t = {n: spark.read.parquet(f"{args.tables}/{n}") for n in ("documents", "pages", "blocks", "tables")}
        writers.write_run(args.output, pipeline.run(t["documents"], t["pages"], t["blocks"], t["tables"], config))
    elif args.command == "audit":
        limits = ChunkConfig()
        units = readers.read_jsonl(spark, args.units, quality.AUDIT_UNIT) if args.units else None
        row = quality.audit(readers.read_jsonl(spark, args.children, quality.AUDIT_CHILD), readers.read_jsonl(spark, args.parents, quality.AUDIT_PARENT), units, limits.min_tokens, limits.target_tokens, limits.max_tokens)
        _say(writers.to_jsonl(row).first()["value"], args.output)
    elif args.command == "diagnose":
        found = readers.read_jsonl(spark, args.units, quality.AUDIT_UNIT).where("kind = 'code'").select("unit_id", analyse_column(F.col("text")).alias("a")).select("unit_id", "a.*")
        counts = found.where("is_python").agg(F.count("*").alias("units"), *[F.count_if(c).alias(n) for n, c in {
            "failing": ~F.col("ast_parseable"), "indentation": F.col("indentation_issues") > 0, "split_identifiers": F.col("split_identifiers") > 0, "boundaries": F.col("boundary_violations") > 0,
        }.items()])
        _say(writers.to_jsonl(counts).first()["value"], args.output)
    elif args.command == "ask":
        tools = runner.default_tools(runner.Workspace(spark, args.workspace) if args.workspace else None)
        state = runner.Runner(tools, runner.Policy(max_steps=args.max_steps), approve=lambda _: args.yes).run(args.goal)
        _say(json.dumps({"status": state.status, "output": state.output, "observations": state.observations}, ensure_ascii=False), args.output)
        return 0 if state.status == "completed" else 1
    else:
        old, new = spark.read.json(args.old), spark.read.json(args.new)
        _say(writers.to_jsonl(diff.summary(diff.compare(old, new, args.key), args.key)).first()["value"], args.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
