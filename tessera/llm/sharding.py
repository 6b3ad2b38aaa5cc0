"""Sharding by histogram sort.

Documents are ordered by a 64-bit key: the upper half hashes the text, so equal
texts lie together, the lower half the document id, so a group of copies of any
size can still be cut. The exact bytes below candidate boundaries are counted
across all partitions; only intervals that hold an unmet splitter get new
probes, until every splitter is within tolerance. Then each row is sent once to
the part that its key falls in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, stage, utf8_bytes

LOW, HIGH = -(2**63), 2**63
#: Probes of a round, so also the counts that reach the driver in a round.
PROBES = 1 << 14
#: A group of equal texts stays whole if it has at most this share of a part's bytes.
GROUP = 0.02


@dataclass
class Cut:
    """A splitter: parts up to it hold the keys below, with so many bytes and rows."""

    key: int
    bytes: int
    rows: int


def shard_key(text: Column, doc_id: Column) -> Column:
    """Equal texts share the upper 32 bits; rows equal in text and id share all 64."""
    upper = F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit(-(1 << 32)))
    return upper.bitwiseOR(F.shiftrightunsigned(F.xxhash64(doc_id), 32))


def part_of(keys: np.ndarray, cuts: list[int]) -> np.ndarray:
    return np.searchsorted(np.array(cuts, np.int64), keys, "right")


def count_below(slim: DataFrame, probes: list[int]) -> list[tuple[int, int]]:
    """Of each interval between probes: bytes and rows, exact."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, r = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for x in batches:
            at = part_of(x.column("key").to_numpy(zero_copy_only=False), probes)
            np.add.at(b, at, x.column("size").to_numpy(zero_copy_only=False))
            r += np.bincount(at, minlength=len(r))
        own = np.flatnonzero(r)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(b[own]), pa.array(r[own])], ["at", "b", "r"])

    found = slim.select("key", "size").mapInArrow(count, "at long, b long, r long").groupBy("at").agg(F.sum("b").alias("b"), F.sum("r").alias("r")).collect()
    out = [(0, 0)] * (len(probes) + 1)
    for x in found:
        out[x["at"]] = (x["b"], x["r"])
    return out


def find_cuts(slim: DataFrame, parts: int, tolerance: float) -> tuple[list[Cut], int, int]:
    """parts - 1 splitters of slim (key, size) with near equal bytes, and all bytes and rows."""
    bits = 12
    width = 64 - bits
    grid = [LOW + (i << width) for i in range(1, 1 << bits)]
    counts = count_below(slim, grid)
    total, rows = sum(x[0] for x in counts), sum(x[1] for x in counts)
    goals = [total * j // parts for j in range(1, parts)]
    allowed = tolerance * total / parts
    cuts: list[Cut | None] = [None] * (parts - 1)

    def settle(edges: list[int], cum_b: list[int], cum_r: list[int], mine: list[int], last: bool) -> dict[int, list[int]]:
        """Fix the splitters that an edge meets; the others by the interval that holds them."""
        left: dict[int, list[int]] = {}
        for j in mine:
            k = int(np.searchsorted(cum_b, goals[j], "right")) - 1
            k = min(max(k, 0), len(edges) - 2)
            near = k if goals[j] - cum_b[k] <= cum_b[k + 1] - goals[j] else k + 1
            # a pair has an edge as near as a document of its size would have
            whole_group = width == 32 and (cum_b[k + 1] - cum_b[k] <= GROUP * total / parts or cum_r[k + 1] - cum_r[k] <= 2)
            if last or whole_group or abs(cum_b[near] - goals[j]) <= allowed:
                cuts[j] = Cut(edges[near], cum_b[near], cum_r[near])
            else:
                left.setdefault(k, []).append(j)
        return left

    edges = [LOW, *grid, HIGH]
    cum_b = [0, *np.cumsum([x[0] for x in counts]).tolist()]
    cum_r = [0, *np.cumsum([x[1] for x in counts]).tolist()]
    open_ = [(edges[k], edges[k + 1], cum_b[k], cum_r[k], js) for k, js in settle(edges, cum_b, cum_r, list(range(parts - 1)), width == 0).items()]
    while open_ and width > 0:
        bits = min(width, 10, max(1, int(math.log2(max(PROBES, 8 * len(open_)) / len(open_)))))
        # stop at the border between text and id once: there the splitters of small groups settle
        bits = min(bits, width - 32) if width > 32 else bits
        width -= bits
        open_.sort()
        probes: list[int] = []
        for lo, hi, *_ in open_:
            probes += [lo + (i << width) for i in range(1 << bits)] + [hi] * (hi < HIGH)
        probes = sorted(set(probes))
        counts = count_below(slim, probes)
        nxt = []
        for lo, hi, b, r, js in open_:
            own = [lo + (i << width) for i in range(1 << bits)] + [hi]
            first = int(np.searchsorted(probes, lo, "right"))
            inside = counts[first : first + (1 << bits)]
            cb, cr = [b, *(b + np.cumsum([x[0] for x in inside])).tolist()], [r, *(r + np.cumsum([x[1] for x in inside])).tolist()]
            nxt += [(own[k], own[k + 1], cb[k], cr[k], j) for k, j in settle(own, cb, cr, js, width == 0).items()]
        open_ = nxt
    return [c for c in cuts if c], total, rows


def part_column(key: Column, cuts: list[Cut]) -> Column:
    """Where the key falls between the splitters; only the key crosses to Python."""
    keys = np.array([min(c.key, HIGH - 1) for c in cuts], np.int64)

    @F.pandas_udf("int")
    def part(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(keys, k.to_numpy(), "right").astype(np.int32))

    return part(key)


def part_table(df: DataFrame, shards: int, tolerance: float, part_bytes: int) -> tuple[list[Cut], DataFrame]:
    """The splitters of df (key, size), and per part: its shard and the slot of its first row."""
    total = df.agg(F.sum("size")).first()[0] or 0
    per = max(1, math.ceil(total / shards / part_bytes))
    cuts, _, _ = find_cuts(df, shards * per, tolerance)
    starts = [0, *[c.rows for c in cuts]]
    rows = [(p, p // per, starts[p] - starts[p // per * per]) for p in range(len(starts))]
    return cuts, df.sparkSession.createDataFrame(rows, "__part int, shard int, __first long")


def place(df: DataFrame, cuts: list[Cut], parts: DataFrame) -> DataFrame:
    """df (__key, doc_id, ...) -> adds shard int and slot long, gapless from 0 in each shard, in key order."""
    order = Window.partitionBy("__part").orderBy("__key", F.col("doc_id").asc_nulls_last())
    placed = df.withColumn("__part", part_column(F.col("__key"), cuts)).withColumn("__at", F.row_number().over(order) - 1)
    placed = placed.join(parts, "__part").withColumn("slot", F.col("__first") + F.col("__at"))
    return placed.select(*[F.col(f"`{c}`") for c in df.columns if c != "__key"], "shard", "slot")


def shards(docs: DataFrame, n: int = 24, tolerance: float = 0.005, part_bytes: int = 256 << 20) -> DataFrame:
    """Per document: doc_id, size (UTF-8 bytes + 8), text_crc32, law `bytes`, shard, slot, grown_shard (null).

    Null text counts as empty. Equal texts are neighbours and share a shard unless they are
    more than two, have more than GROUP of a part's bytes and a splitter's goal lies among them. So the shards' sizes
    differ from their mean by the tolerance, a document, or a group of that share at most. Rows equal in id and text are interchangeable
    neighbours. An empty table gives no rows; other columns are ignored.
    """
    ship(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", (utf8_bytes(F.col("text")) + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), shard_key(F.col("text"), F.col("doc_id")).alias("key"))
    slim = stage(slim, "shard-keys")
    placed = place(slim.withColumnRenamed("key", "__key"), *part_table(slim, n, tolerance, part_bytes))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def apply_shards(docs: DataFrame, n: int = 24, tolerance: float = 0.005, part_bytes: int = 256 << 20) -> DataFrame:
    """The documents with shard and slot (columns so named are replaced), exchanged once by part.

    Null texts count as empty, null ids as equal ones; repeated rows get a slot each; an empty table stays empty.
    """
    ship(docs.sparkSession)
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    key = shard_key(F.col("text"), F.col("doc_id"))
    slim = stage(docs.select((utf8_bytes(F.col("text")) + 8).alias("size"), key.alias("key")), "shard-keys")
    return place(docs.select(*[F.col(f"`{c}`") for c in own]).withColumn("__key", key), *part_table(slim, n, tolerance, part_bytes))
