"""Running a query over streams: tables with `?tail=true` are read as they grow.

The plan is the batch one: max_diff_watermark is a watermark, tumble a window, and
GROUP BY a stateful aggregation whose state Spark checkpoints. The trigger says
what is emitted: ON WATERMARK appends a window's final values when the watermark
has passed it, END OF STREAM keeps the whole result, COUNTING n emits in change.
Several triggers of a query all emit: any COUNTING, and the watermark with or without.
What a stream that is run once has not emitted at its end is emitted then.
"""

from __future__ import annotations

import functools
import math
import time
from collections.abc import Callable, Iterator
from typing import TextIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from tessera import sinks
from tessera.errors import QueryError
from tessera.session import Engine, Query
from tessera.sinks import shown, table_text
from tessera.sources.shared import new_path

COUNTED = ("count", "sum", "avg", "min", "max")


def output_mode(q: Query) -> str:
    """Append where rows are final when emitted, else update; complete where the result is sorted."""
    triggers = {t.kind for t in getattr(q.tree, "triggers", [])}
    order = getattr(q.tree, "order", None)
    if not (getattr(q.tree, "group", None) or q.relation.emission):
        return "append"
    if order:
        return "complete"
    return "append" if triggers == {"watermark"} else "update"


def start(engine: Engine, text: str, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str | None = None, once: bool = False, interval: str | None = None) -> StreamingQuery:
    """Starts the query; sink gets each micro-batch. once: process what is there and end."""
    engine.catalog.followed = False
    q = engine.query(text)
    if not q.frame.isStreaming:
        raise QueryError("no table of the query is a stream: add ?tail=true")
    e = q.relation.emission
    counting = [t.count for t in e.triggers if t.kind == "counting"] if e else []
    frame = counting_stream(q, counting) if counting else q.frame
    w = frame.writeStream.outputMode(mode or ("append" if counting else output_mode(q))).option("checkpointLocation", checkpoint).foreachBatch(sink)
    if once and not engine.catalog.followed:
        w = w.trigger(availableNow=True)
    elif interval:
        w = w.trigger(processingTime=interval)
    if not once:
        return w.start()
    # a Python source knows no end of what is there: the query is stopped when it has it all
    return Once(w.start(), engine.catalog.followed, (lambda: sink(remainder(q, checkpoint), -1)) if counting else None)


class Once:
    """A streaming query over what is there, with what is to be done at its end; all else is the query's."""

    def __init__(self, query: StreamingQuery, stop: bool, last: Callable[[], None] | None) -> None:
        self._query, self._stop, self._last = query, stop, last

    def __getattr__(self, name: str) -> object:
        return getattr(self._query, name)

    def awaitTermination(self, timeout: int | None = None) -> bool | None:  # noqa: N802
        if self._stop:
            self._query.processAllAvailable()
            self._query.stop()
        ended = self._query.awaitTermination(timeout)
        if self._last and ended is not False and self._query.exception() is None:
            last, self._last = self._last, None
            last()
        return ended


def state_fields(q: Query) -> tuple[list[str], list[tuple[str, str, str]], dict, dict]:
    """Keys, aggregates (name, function, kind), types of the input, types of the results."""
    e = q.relation.emission
    if any(fn not in COUNTED for _, fn, _ in e.aggs):
        raise QueryError(f"TRIGGER COUNTING over a stream takes {', '.join(COUNTED)}")
    source = e.source.select(*[x.col.alias(k) for k, x in e.keys], *[x.col.alias(a) for a, _, x in e.aggs])
    fields = {f.name: f.dataType for f in source.schema.fields}
    aggs = [(a, fn, x.type.kind) for a, fn, x in e.aggs]
    result = {a: LongType() if fn == "count" or (fn in ("sum", "avg") and kind == "Int") else fields[a] for a, fn, kind in aggs}
    return [k for k, _ in e.keys], aggs, fields, result


def so_far(fn: str, values: np.ndarray, count: int, held: object) -> tuple[np.ndarray, np.ndarray]:
    """After each record: how many values there were, and their sum or extreme; held: those of before."""
    there = ~pd.isna(values)
    counts = count + np.cumsum(there)
    if fn == "count":
        return counts, counts
    if fn in ("sum", "avg"):
        zero = values.dtype.type(0) if values.dtype != object else 0
        return counts, np.cumsum(np.where(there, values, zero)) + (zero if held is None else held)
    best = np.minimum if fn == "min" else np.maximum
    out = pd.Series(values)
    own = (out.cummin() if fn == "min" else out.cummax()).ffill().to_numpy()
    if held is None:
        return counts, own
    return counts, np.where(pd.isna(own), held, best(np.where(pd.isna(own), held, own), held))


def shown_value(fn: str, kind: str, count: int, v: object) -> object:
    """An aggregate's result from its state."""
    if fn == "count":
        return int(count) or None
    if not count:
        return None
    v = v.item() if hasattr(v, "item") else v
    return (int(v / count) if kind == "Int" else v / count) if fn == "avg" else v


def counting_stream(q: Query, counts: list[int]) -> DataFrame:
    """TRIGGER COUNTING over a stream: at every n-th record of a key, for each n, its last values are retracted and new
    ones emitted; with ON WATERMARK also when the watermark passes the key's time, which ends the key.

    The state of a key is its counts, sums and extremes and the last emission; it does
    not grow with the records. Adds __retraction and __turn.
    """
    e = q.relation.emission
    keys, aggs, fields, result = state_fields(q)
    timed = any(t.kind == "watermark" for t in e.triggers) and e.time_key in keys
    stamped = [f.name for f in e.source.schema.fields if "spark.watermarkDelayMs" in f.metadata] if timed else []
    source = e.source.select(*[x.col.alias(k) for k, x in e.keys], *[x.col.alias(a) for a, _, x in e.aggs], *[F.col(c).alias(f"__time{i}") for i, c in enumerate(stamped)])
    if timed and not stamped:
        raise QueryError("TRIGGER ON WATERMARK over a stream needs max_diff_watermark")
    schema = StructType([*[StructField(k, fields[k]) for k in keys], *[StructField(a, t) for a, t in result.items()], StructField("__retraction", BooleanType()), StructField("__turn", LongType())])
    # of each aggregate: values so far, their sum or extreme, what was emitted last
    state_schema = StructType([StructField("n", LongType()), StructField("turn", LongType()), StructField("fresh", LongType()), *[StructField(f"{p}{i}", t) for i, (a, _, _) in enumerate(aggs) for p, t in (("c", LongType()), ("v", fields[a] if result[a] != LongType() else LongType()), ("e", result[a]))]])
    names, time_at = schema.names, keys.index(e.time_key) if timed else -1

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            seen, turn, fresh, *rest = state.get
            parts = [list(rest[3 * i : 3 * i + 3]) for i in range(len(aggs))]
        else:
            seen, turn, fresh, parts = 0, 0, 0, [[0, None, None] for _ in aggs]
        out: list[tuple] = []

        def emit(values: list) -> None:
            nonlocal turn
            if turn:
                out.append((*key, *[p[2] for p in parts], True, turn))
            turn += 1
            for p, v in zip(parts, values, strict=True):
                p[2] = v
            out.append((*key, *values, False, turn))

        if state.hasTimedOut:
            if fresh:
                emit([shown_value(fn, kind, p[0], p[1]) for p, (_, fn, kind) in zip(parts, aggs, strict=True)])
            state.remove()
            yield pd.DataFrame(out, columns=names)
            return
        for b in batches:
            if not len(b):
                continue
            run = [so_far(fn, b[a].to_numpy(), p[0], p[1]) for p, (a, fn, _) in zip(parts, aggs, strict=True)]
            place = seen + 1 + np.arange(len(b))
            at = np.flatnonzero(np.any([place % n == 0 for n in counts], axis=0))
            for k in at.tolist():
                emit([shown_value(fn, kind, c[k], v[k]) for (c, v), (_, fn, kind) in zip(run, aggs, strict=True)])
            seen += len(b)
            fresh = len(b) - 1 - int(at[-1]) if len(at) else fresh + len(b)
            for p, (c, v), (_, fn, _) in zip(parts, run, aggs, strict=True):
                p[0] = int(c[-1])
                last = v[-1].item() if hasattr(v[-1], "item") else v[-1]
                p[1] = None if fn == "count" or not p[0] else last
        state.update((seen, turn, fresh, *[x for p in parts for x in p]))
        if timed:
            due = math.ceil(pd.Timestamp(key[time_at]).timestamp() * 1000)
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=names)

    log = source.groupBy(*keys).applyInPandasWithState(step, schema, state_schema, "append", GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout)
    return picked(q, log)


def picked(q: Query, log: DataFrame) -> DataFrame:
    names = [n for n, _ in q.columns]
    return log.select(*[F.col(p).alias(o) for (p, _), o in zip(q.relation.emission_picks, names, strict=True)], "__retraction", "__turn")


def remainder(q: Query, checkpoint: str) -> DataFrame:
    """At the end of the stream: of keys with records since their last emission its retraction and the final values, from
    the state that the stream has left."""
    keys, aggs, _, _ = state_fields(q)
    left = q.frame.sparkSession.read.format("statestore").load(checkpoint).select("key.*", "value.groupState.*").filter("fresh > 0")
    values = []
    for i, (a, fn, kind) in enumerate(aggs):
        c, v = F.col(f"c{i}"), F.col(f"v{i}")
        final = F.nullif(c, F.lit(0)) if fn == "count" else v if fn != "avg" else F.call_function("div", v, F.nullif(c, F.lit(0))) if kind == "Int" else v / F.nullif(c, F.lit(0))
        values.append((a, final, F.col(f"e{i}")))
    now = left.select(*keys, *[f.alias(a) for a, f, _ in values], F.lit(False).alias("__retraction"), (F.col("turn") + 1).alias("__turn"))
    old = left.filter("turn > 0").select(*keys, *[e.alias(a) for a, _, e in values], F.lit(True).alias("__retraction"), F.col("turn").alias("__turn"))
    return picked(q, old.unionAll(now))


def poll(engine: Engine, text: str, sink: Callable[[DataFrame, int], None], rounds: int | None = None, changes: bool = False) -> int:
    """Reads a finite query again and again; sink gets each snapshot with its number. Returns the number of rounds.

    The interval is that of the query's poll(), a second if it has none. With changes, sink gets the retractions of the
    snapshot before and then the rows of the new one (column __retraction), each snapshot being kept in the shared folder.
    """
    turn, before = 0, None
    while rounds is None or turn < rounds:
        q = engine.query(text)
        if changes:
            path = new_path(engine.spark, "snapshot")
            q.frame.write.parquet(path)
            now = engine.spark.read.schema(q.frame.schema).parquet(path).withColumn("__retraction", F.lit(False))
            sink(now if before is None else before.withColumn("__retraction", F.lit(True)).unionAll(now), turn)
            before = now
        else:
            sink(q.frame, turn)
        turn += 1
        if rounds is None or turn < rounds:
            time.sleep((1_000_000 if q.poll_us is None else q.poll_us) / 1e6)
    return turn


def printed(engine: Engine, text: str, kind: str, out: TextIO, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Prints what each micro-batch emits as CSV or JSON lines, or in the form of the change stream."""
    q = engine.query(text)
    counting = bool(q.relation.emission) and any(t.kind == "counting" for t in q.relation.emission.triggers)

    def show(df: DataFrame, batch: int) -> None:
        if kind == "stream_native":
            rows = df if counting else df.withColumn("__retraction", F.lit(False))
            lines = map(functools.partial(sinks.stream_line, q), rows.collect())
        else:
            # CSV and JSON have no form for a retraction: only what stands is printed
            rows = df.filter(~F.col("__retraction")).drop("__retraction", "__turn") if counting else df
            lines = sinks.csv_rows(q.columns, rows.collect(), header=batch == 0) if kind == "csv" else sinks.json_rows(q.columns, rows.collect())
        out.writelines(lines)
        out.flush()

    return start(engine, text, show, checkpoint, once=once)


def live_table(engine: Engine, text: str, out: TextIO, checkpoint: str, once: bool = False, interval: str = "250 milliseconds") -> StreamingQuery:
    """Prints the whole current result as a table after each micro-batch; a query without GROUP BY prints what is new."""
    q = engine.query(text)
    names, right = [n for n, _ in q.columns], [t.kind in ("Int", "Float") for _, t in q.columns]
    grouped = bool(getattr(q.tree, "group", None))

    def show(df: DataFrame, _: int) -> None:
        rows = [[shown(v, t) for v, (_, t) in zip(r, q.columns, strict=True)] for r in df.select(*[f"`{n}`" for n in names]).orderBy(*[f"`{n}`" for n in names]).collect()]
        out.write(table_text(names, rows, right))

    return start(engine, text, show, checkpoint, "complete" if grouped else None, once, None if once else interval)
