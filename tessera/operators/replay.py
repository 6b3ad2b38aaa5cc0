"""Bounded replay: what a stream would do record by record, as window expressions over a column of arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.aggregates import running, so_far
from tessera.functions.scalar import Expr, micros
from tessera.plans.scope import Emission

CHUNKS, CHUNK_ROWS = 4096, 1 << 20
ARRIVAL = "__arrival"


def with_arrival(df: DataFrame, seq: str | None) -> tuple[DataFrame, str]:
    """The column of arrival, or the order in which the source is read."""
    return (df, seq) if seq else (df.withColumn(ARRIVAL, F.monotonically_increasing_id()), ARRIVAL)


def earlier_max(df: DataFrame, value: Column, seq: str, name: str) -> DataFrame:
    """Adds the maximum of value over all earlier arrivals.

    One window over everything would be one task. The range of arrivals is cut into
    chunks: a window in each, and the maxima of the chunks summed up by a window of
    their own. There are CHUNKS of them, or one for CHUNK_ROWS rows if that is more,
    so neither window grows out of a task. The places that a scan gives are dense in
    each of its partitions, and CHUNK_ROWS of them are a chunk.
    """
    if seq == ARRIVAL:
        chunk = F.call_function("div", F.col(seq), F.lit(CHUNK_ROWS))
    else:
        low, high, n = df.agg(F.min(seq), F.max(seq), F.count(seq)).first()
        if low is None:
            return df.withColumn(name, F.lit(None).cast("bigint"))
        width = max(1, -(-(high - low + 1) // max(CHUNKS, n // CHUNK_ROWS)))
        chunk = F.call_function("div", F.col(seq) - low, F.lit(width))
    df = df.withColumn("__chunk", chunk).withColumn("__value", value)
    before = Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = df.groupBy("__chunk").agg(F.max("__value").alias("__most")).withColumn("__before", F.max("__most").over(before)).select("__chunk", "__before")
    inside = Window.partitionBy("__chunk").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    # without a hint: a join that shuffles by chunk deals the rows as the window in each needs them
    out = df.join(chunks, "__chunk")
    return out.withColumn(name, F.greatest(F.max("__value").over(inside), "__before")).drop("__chunk", "__value", "__before")


def drop_late(df: DataFrame, time: str, seq: str | None, max_diff: Column, resolution: Column) -> tuple[DataFrame, str, str]:
    """Keeps a record unless its time is at most the watermark that earlier records have set."""
    df, seq = with_arrival(df, seq)
    us, step = F.unix_micros(time), micros(resolution)
    df = earlier_max(df, us - F.pmod(us, step), seq, "__seen")
    df = df.withColumn("__watermark", F.col("__seen") - micros(max_diff)).filter(F.col("__watermark").isNull() | (F.unix_micros(time) > F.col("__watermark")))
    return df.drop("__seen"), seq, "__watermark"


def tumbling(time: Column, length_us: int, offset_us: int) -> Column:
    """The start of a record's window; windows are counted from the year 1, as offsets of weeks show."""
    origin = (offset_us - 62_135_596_800_000_000) % length_us
    us = F.unix_micros(time)
    return F.timestamp_micros(us - F.pmod(us - F.lit(origin), F.lit(length_us)))


def changelog(e: Emission) -> DataFrame:
    """The emissions of a grouped result: keys, aggregates, __retraction, in the order of __at and __step.

    COUNTING n emits a key's values at its n-th, 2n-th, ... record; at the end of the
    stream (or, for the watermark trigger, when it passes the key's time) the values
    are emitted once more if records came since. An emission is preceded by the
    retraction of the key's last one.
    """
    df, seq = with_arrival(e.source, e.seq)
    names = [k for k, _ in e.keys]
    df = df.select(*[x.col.alias(k) for k, x in e.keys], F.col(seq).alias("__at"), *[x.col.alias(f"__in{i}") for i, (_, _, x) in enumerate(e.aggs)])
    w = so_far(names, "__at")
    whole = Window.partitionBy(*names)
    values = [running(fn, Expr(F.col(f"__in{i}"), x.type), w).alias(name) for i, (name, fn, x) in enumerate(e.aggs)]
    df = df.select(*names, "__at", *values, F.row_number().over(w).alias("__n"), F.count(F.lit(1)).over(whole).alias("__all"))
    counts = [t.count for t in e.triggers if t.kind == "counting"]
    fire = F.col("__n") == F.col("__all")
    for n in counts:
        fire = fire | (F.col("__n") % n == 0)
    df = df.filter(fire)
    order = Window.partitionBy(*names).orderBy("__n")
    own = [a for a, _, _ in e.aggs]
    df = df.withColumn("__turn", F.row_number().over(order))
    back = df.select(*names, "__at", "__turn", *[F.lag(a).over(order).alias(a) for a in own]).filter("__turn > 1").withColumns({"__retraction": F.lit(True), "__step": F.lit(0)})
    out = df.select(*names, "__at", "__turn", *own).withColumns({"__retraction": F.lit(False), "__step": F.lit(1)})
    return out.unionByName(back).select(*names, *own, "__retraction", "__at", "__step")
