"""Command line: ``python -m corvane ingest | ask | eval | eval-compare``; prints JSON, exits with 0 or 1."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from corvane.config import RUNTIMES, Settings
from corvane.errors import CorvaneError
from corvane.plans import sweep


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corvane")
    verbs = top.add_subparsers(dest="verb", required=True)
    verbs.add_parser("ingest")
    ask = verbs.add_parser("ask")
    ask.add_argument("question")
    for verb in (ask, verbs.add_parser("eval")):
        verb.add_argument("--runtime", choices=RUNTIMES)
    compare = verbs.add_parser("eval-compare")
    for axis, _, _, choices, _ in sweep.AXES:
        compare.add_argument("--" + axis.removesuffix("s").replace("strategie", "strategy").replace("_", "-"), dest=axis, action="append", type=str if choices else int, choices=choices)
    compare.add_argument("--output")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from corvane.operators.index import atomic_write
    from corvane.plans.engine import Engine
    from corvane.sources.corpus import read_documents
    from corvane.sources.gold import read_gold

    try:
        settings = Settings.from_env()
        if getattr(args, "runtime", None):
            settings = settings.with_(runtime=args.runtime)
        spark = SparkSession.builder.appName("corvane").getOrCreate()
        engine = Engine.from_settings(spark, settings)
        if args.verb == "ingest":
            out = engine.ingest()
        elif args.verb == "ask":
            out = engine.ask(args.question)
        elif args.verb == "eval":
            results, totals = engine.evaluate(read_gold(spark, settings.eval_path))
            out = totals | {"results": [json.loads(x) for x in results.toJSON().collect()]}
        else:
            documents = read_documents(spark, settings.docs_dir, settings.exclude)
            runs, board = sweep.run(spark, settings, documents, read_gold(spark, settings.eval_path), {a[0]: getattr(args, a[0]) for a in sweep.AXES}, engine.chat, engine.embedder, engine.reranker)
            out = {"num_runs": len(runs), "runs": runs, "leaderboard": board}
            if args.output:
                atomic_write(Path(args.output), json.dumps(out, indent=2))
    except CorvaneError as error:
        print(json.dumps({"error": str(error), "status": error.status}), file=sys.stderr)
        return 1
    print(json.dumps(out, indent=2, default=str))
    return 0
