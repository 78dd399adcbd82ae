"""python -m tessera DATABASE TEXTS OUTPUT.csv: texts to a submission. Also: oracle, evaluate, validate (see --help of each)."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import functions as F

from tessera.operators import audit, runs, score
from tessera.session import clear, session, written
from tessera.sources import readers, sinks


def _spark(args: argparse.Namespace):
    spark = session(args.master, "tessera", **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _texts(spark, folder: str):
    """The texts, dealt to all cores: small files come as a few partitions."""
    return readers.texts(spark, folder).repartition(spark.sparkContext.defaultParallelism)


def predict(args: argparse.Namespace) -> int:
    if not os.path.exists(args.database):
        raise ValueError(f"no database at {args.database}")
    spark = _spark(args)
    docs = _texts(spark, args.texts)
    cites = written(runs.resolve.predict(docs, readers.canonical(spark, args.database), templates=args.templates), "cites")
    runs.write(docs, runs.checked(cites, docs), args.output, args.json_dir)
    return 0


def oracle(args: argparse.Namespace) -> int:
    spark = _spark(args)
    docs = _texts(spark, args.texts)
    runs.write(docs, runs.oracle_citations(readers.labels(spark, args.gold), docs), args.output, args.json_dir)
    return 0


def evaluate(args: argparse.Namespace) -> int:
    spark = _spark(args)
    levels = score.evaluate(readers.solution(readers.labels(spark, args.gold)), readers.submission(spark, args.submission))
    final = score.final_scores(levels, []).first()
    if final is None or final[0] is None:
        raise score.SubmissionError("nothing to evaluate")
    print(json.dumps({"score_final": final[0], "niveis": {str(r["nivel"]): r.asDict() for r in levels.orderBy("nivel").collect()}}, ensure_ascii=False, indent=2, sort_keys=True))
    if args.expect is not None:
        try:
            score.require_score(final[0], args.expect)
        except score.SubmissionError as fault:
            print(fault, file=sys.stderr)
            return 1
    return 0


def validate(args: argparse.Namespace) -> int:
    spark = _spark(args)
    docs, table = _texts(spark, args.texts), readers.canonical(spark, args.database)
    modes = [written(runs.predict_submission(docs, table, templates).withColumn("mode", F.lit(name)), name) for name, templates in (("generic", False), ("templates", True))]
    gold = readers.labels(spark, args.gold)  # after the predictions
    families = spark.read.csv(args.families, header=True).select("documento_id", "family")
    told = audit.report(gold, readers.solution(gold), modes[0].unionByName(modes[1]), families, "generic", "templates", audit.provenance(docs, gold=args.gold, database=args.database))
    sinks.write_report(told, args.output)
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="python -m tessera", description=__doc__)
    named = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, *positional: str, **flags: dict) -> None:
        sub = named.add_parser(name)
        for x in positional:
            sub.add_argument(x)
        for flag, how in flags.items():
            sub.add_argument("--" + flag.replace("_", "-"), **how)
        sub.add_argument("--master", default=os.environ.get("TESSERA_MASTER"))
        sub.set_defaults(run=run)

    command("predict", predict, "database", "texts", "output", json_dir={}, templates={"action": "store_true"})
    command("oracle", oracle, "gold", "texts", "output", json_dir={})
    command("evaluate", evaluate, "submission", gold={"required": True}, expect={"type": float})
    command("validate", validate, "database", "texts", "gold", "families", "output")
    return top


def main(argv: list[str]) -> int:
    """Three arguments that start with no command are those of predict. 0: done; 1: another score than expected; 2: a fault."""
    if argv and argv[0] not in ("predict", "oracle", "evaluate", "validate", "-h", "--help"):
        argv = ["predict", *argv]
    args = parser().parse_args(argv)
    try:
        done = args.run(args)
        clear(session())
        return done
    except ValueError as fault:
        print(f"error: {fault}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
