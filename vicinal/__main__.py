"""The offline jobs from a command line: ``python -m vicinal COMMAND --help``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vicinal import sources
from vicinal.operators import evaluate, forest
from vicinal.plans import jobs


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="vicinal")
    of = top.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *options: tuple[str, dict]) -> None:
        p = of.add_parser(name, help=about)
        for flag, kw in options:
            p.add_argument(flag, **kw)

    text, number, share = {"type": str}, {"type": int}, {"type": float}
    need = lambda kw: kw | {"required": True}
    command("generate", "payload rows, the same on each run", ("--rows", need(number)), ("--out", need(text)), ("--fraud-share", number | {"default": 35}), ("--seed", number | {"default": 0}), ("--mcc", number | {"nargs": "*"}))
    command("prepare", "references from their JSON array to Parquet", ("--json", need(text)), ("--out", need(text)))
    command("relabel", "votes of each reference's nearest others", ("--references", need(text)), ("--out", need(text)), ("--neighbours", number | {"default": 5}))
    command(
        "train", "fit, measure on the held-out part, save", ("--references", need(text)), ("--algorithm", {"choices": ["dt", "rf", "rf-soft"], "default": "dt"}), ("--votes", text),
        ("--trees", number | {"default": 30}), ("--max-depth", number | {"default": 20, "help": "0: as deep as can be"}), ("--min-leaf", number | {"default": 10}),
        ("--test-share", share | {"default": 0.2}), ("--out-model", need(text)), ("--out-metrics", need(text)),
    )
    command("evaluate", "a saved model against a labelled test set", ("--model", need(text)), ("--test-set", need(text)), ("--threshold", share | {"default": 0.6}))
    command("predict", "named samples: a JSON file, - for standard input, or else the built-in ones", ("--model", need(text)), ("--input", text), ("--threshold", share | {"default": 0.6}))
    return top


def run(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.command == "generate":
        sources.generate_payloads(spark, a.rows, a.fraud_share, a.seed, a.mcc or sources.MCCS).write.mode("overwrite").parquet(a.out)
    elif a.command == "prepare":
        jobs.prepare(spark, a.json, a.out)
    elif a.command == "relabel":
        jobs.relabel(spark.read.parquet(a.references), a.out, a.neighbours)
    elif a.command == "train":
        votes = spark.read.parquet(a.votes) if a.votes else None
        done = jobs.train(spark.read.parquet(a.references), a.algorithm, votes, a.trees, a.max_depth or forest.MAX_DEPTH, a.min_leaf, 1 - a.test_share)
        forest.save_model(done.model, a.out_model)
        sources.write_metrics(done.metrics, a.out_metrics)
        done.metrics.show(truncate=False, vertical=True)
    elif a.command == "evaluate":
        judged = jobs.judge(forest.load_model(a.model), sources.read_test_set(spark, a.test_set), a.threshold)
        evaluate.weighted_error(evaluate.outcome_counts(judged), F.col("errors")).show(vertical=True)
    else:
        samples = sources.read_samples(spark, lines=sys.stdin.read()) if a.input == "-" else sources.read_samples(spark, a.input)
        forest.predict_samples(forest.load_model(a.model), samples, a.threshold).show(truncate=False)
    return 0


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    return run(SparkSession.builder.appName(f"vicinal {a.command}").config("spark.sql.session.timeZone", "UTC").getOrCreate(), a)


if __name__ == "__main__":
    sys.exit(main())
