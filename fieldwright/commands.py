"""``python -m fieldwright.commands ROOT report|seed|verify|reject|map|mark ...``

The answer is one JSON line on standard output; what goes wrong is said on standard error.  Exit
codes: 0 green, 1 the gate is red or a decision was refused, 2 a conflict, 3 the run never happened."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from .operators import desk, idfile
from .sources import lake


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="fieldwright")
    top.add_argument("root")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("report").add_argument("--allow-empty", action="store_true")
    seed = sub.add_parser("seed")
    seed.add_argument("--players", help="Parquet of registry players")
    seed.add_argument("--playerids", help="CSV of outside ids")
    for name in ("verify", "reject", "mark", "map"):
        one = sub.add_parser(name)
        one.add_argument("source")
        one.add_argument("external_id")
        if name == "map":
            one.add_argument("player_id")
        if name == "mark":
            one.add_argument("--force", action="store_true")
    return top


def run(spark: SparkSession, args: argparse.Namespace) -> tuple[int, object]:
    state, now = lake.State(spark, args.root), datetime.now(UTC).replace(tzinfo=None)
    if args.command == "report":
        held = idfile.tables(state)
        told = desk.report(held["players"], held["mappings"], held["queue"])
        return desk.gate(told, args.allow_empty), told
    if args.command == "seed":
        raw = spark.read.parquet(args.players) if args.players else None
        rows = lake.read_text_ids(spark, args.playerids) if args.playerids else None
        return desk.GREEN, idfile.commit(state, now, raw, rows)
    row = (args.source, args.external_id, args.command, getattr(args, "player_id", None), getattr(args, "force", False))
    (outcome,) = desk.commit_decisions(state, spark.createDataFrame([row], desk.DECISION), now).values()
    return desk.GREEN if outcome in ("verified", "tombstone", "created", "replaced", "closed") else desk.RED, {"outcome": outcome}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    code, told = desk.exit_code(run, spark or SparkSession.builder.getOrCreate(), args)
    if code in (desk.CONFLICT, desk.OPERATIONAL):
        print(told, file=sys.stderr)
    else:
        print(json.dumps(told, default=str, sort_keys=True))
    return code


if __name__ == "__main__":
    sys.exit(main())
