"""python -m tessera "SELECT ..." [-o batch_table|live_table|csv|json|stream_native] [--describe] [--explain N]"""

from __future__ import annotations

import argparse
import json
import sys

from tessera import sinks
from tessera.errors import QueryError
from tessera.session import Engine, Query

LINES = {"csv": sinks.csv_lines, "json": sinks.json_lines, "stream_native": sinks.stream_lines}


def follow(engine: Engine, text: str, kind: str, checkpoint: str | None, once: bool) -> None:
    """A query over tables that grow, printed as it goes until it is interrupted (or, once, until the end of what is there)."""
    from tessera.sources.shared import new_path
    from tessera.streaming import runner

    checkpoint = checkpoint or new_path(engine.spark, "checkpoint")
    if kind in ("live_table", "batch_table"):
        query = runner.live_table(engine, text, sys.stdout, checkpoint, once)
    else:
        query = runner.printed(engine, text, kind, sys.stdout, checkpoint, once)
    query.awaitTermination()


def emit(engine: Engine, q: Query, own: argparse.Namespace) -> None:
    if own.describe:
        rows = [[sinks.shown(n, sinks.Type("String")), sinks.shown(t, sinks.Type("String")), "true" if f else "false"] for n, t, f in sinks.describe(q)]
        sys.stdout.write(sinks.table_text(["name", "type", "time_field"], rows, [False] * 3))
    elif own.explain:
        sys.stdout.write(sinks.explain(q, own.explain))
    elif q.frame.isStreaming:
        follow(engine, own.query, own.output, own.checkpoint, own.once)
    elif q.poll_us is not None and own.output == "live_table":
        from tessera.streaming import runner

        runner.poll(engine, own.query, lambda _, turn: sys.stdout.write(sinks.batch_table(q if turn == 0 else engine.query(own.query))), 1 if own.once else None)
    elif own.output in ("live_table", "batch_table"):
        sys.stdout.write(sinks.batch_table(q))
    else:
        sys.stdout.writelines(LINES[own.output](q))


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("query")
    p.add_argument("-o", "--output", default="live_table", choices=["live_table", "batch_table", "csv", "json", "stream_native"])
    p.add_argument("--describe", action="store_true")
    p.add_argument("--explain", type=int, default=0, choices=[0, 1, 2])
    p.add_argument("--compat", action="store_true", help="differ from ordinary SQL where the dialect does")
    p.add_argument("--databases", help="a JSON file: name -> options of a JDBC or other source")
    p.add_argument("--checkpoint", help="where a query over ?tail=true keeps its state; one that is given is resumed")
    p.add_argument("--once", action="store_true", help="of growing tables, process what is there and end")
    own = p.parse_args(args)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("tessera").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    databases = {}
    if own.databases:
        with open(own.databases) as f:
            databases = json.load(f)
    try:
        engine = Engine(spark, own.compat, databases)
        emit(engine, engine.query(own.query), own)
    except QueryError as e:
        sys.stderr.write(f"Error: {e}\n")
        return 1
    return 0
