"""Quality rules: base counts, then a hashed n-gram log-likelihood ratio.

Byte 4-grams are hashed into a fixed number of buckets. Two multinomials are
counted over them: the raw corpus (every document) and a trusted target (every other
labelled good document). A document's score is the mean log ratio of its n-grams, so
length does not matter. The threshold comes from all labelled documents that the
target was not fitted on, and every document is judged by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from . import kernel as K
from .common import maybe_in, ship, stage

BUCKETS = 1 << 16
GRAM = 4
#: At most so many ids of labelled documents of a class are brought to the driver to look at.
LABELLED = 20_000
#: At most so many scores come to the driver; of more, histograms of so many slots find the ranks that are wanted.
COLLECTED = 1 << 14
SLOTS = 1 << 12
#: Log ratios are whole multiples of one over this.
RATIO_UNIT = 1 << 20
#: The share of trusted held-back documents that the threshold may cost.
LOSS = 0.001
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: Every digit counts as one character: numbers differ, their places don't.
CLASS = np.arange(256, dtype=np.uint32)
CLASS[48:58] = 48
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram at each byte, and the number of them before each text; none spans two texts."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    d = CLASS[data]
    h = d[:n] | (d[1 : n + 1] << 8) | (d[2 : n + 2] << 16) | (d[3 : n + 3] << 24)
    h = (h * np.uint32(2654435769)) >> np.uint32(32 - 16)
    cross = np.zeros(n, bool)
    for k in range(1, GRAM):
        at = offsets[1:-1] - k
        cross[at[(at >= 0) & (at < n)]] = True
    if cross.any():
        keep = np.flatnonzero(~cross)
        # a text shorter than the n-gram has none, its bytes are all marked
        lengths = np.maximum(np.diff(offsets) - GRAM + 1, 0)
        return h[keep], np.concatenate([[0], np.cumsum(lengths)])
    lengths = np.maximum(np.diff(offsets) - GRAM + 1, 0)
    return h, np.concatenate([[0], np.cumsum(lengths)])


def base_features(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The contract's counts of each text in a slice."""
    starts, ends, bounds = K.words(data, offsets)
    h = K.prefix(data)
    solid = ~K.WS[data]
    out = {
        "n_words": np.diff(bounds),
        "word_chars": K.per_text(solid & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": K.per_text(SYMBOLS[data], offsets),
    }
    n = len(offsets) - 1
    brk = np.zeros(len(data) + 1, bool)
    brk[offsets] = True
    newline = data == 10
    line_start = np.flatnonzero(np.concatenate([[False], newline]) | brk)
    line_start = line_start[line_start < len(data)]
    line_end = np.append(line_start[1:], len(data))[: len(line_start)]
    line_end = line_end - newline[line_end - 1]
    solid_before = np.concatenate([[0], np.cumsum(solid)])
    worded = solid_before[line_end] > solid_before[line_start]
    line_start, line_end = line_start[worded], line_end[worded]
    of = np.searchsorted(offsets, line_start, "right") - 1
    keys = K.spans_hash(h, line_start, line_end) + of.astype(K.U) * K.U(0x9E3779B97F4A7C15)
    first = np.zeros(len(keys), bool)
    first[np.unique(keys, return_index=True)[1]] = True
    out["n_dup_lines"] = np.bincount(of[~first], minlength=n).astype(np.int64)
    w = K.spans_hash(h, starts, ends)
    keys, at = K.windows(w, bounds, 5)
    keys = keys + (np.searchsorted(bounds, at, "right") - 1).astype(K.U) * K.U(0x9E3779B97F4A7C15)
    at = at[K.repeated(keys)]
    step = np.zeros(len(starts) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, np.minimum(at + 5, len(starts)), -1)
    out["n_repeat_words"] = K.per_text(np.cumsum(step[:-1]) > 0, bounds)
    return out


def scores(data: np.ndarray, offsets: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Mean log ratio of each text's n-grams; 0 without any."""
    h, bounds = grams(data, offsets)
    total = np.concatenate([[0.0], np.cumsum(ratio[h], dtype=np.float64)])
    n = np.diff(bounds)
    return np.where(n > 0, (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(n, 1), 0.0)


def labelled(labels: DataFrame, good: bool, most: int) -> np.ndarray:
    """The first `most` ids of a class in ascending order, brought to the driver to look at; `fit` takes every label."""
    return np.array([r[0] for r in of_class(labels, good).orderBy("doc").limit(most).collect()], np.int64)


def of_class(labels: DataFrame, good: bool) -> DataFrame:
    """The ids (doc) of all labelled documents of a class, each once."""
    own = labels.filter(F.col("quality") == (1 if good else 0)).select(F.col("doc_id").cast("long").alias("doc"))
    return own.filter("doc IS NOT NULL").distinct()


def halves(ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every other id in ascending order, and those between; of a single id both have it."""
    ranged = ids.repartitionByRange("doc").sortWithinPartitions("doc")
    # the number of the part is above the lower 33 bits, those count its rows; staged, as another run may cut other parts
    own = stage(ranged.select("doc", F.monotonically_increasing_id().alias("at")), "quality-good")
    part = F.shiftright("at", 33)
    odd, total = [], 0
    # one row per part comes to the driver
    for p, n in sorted(own.groupBy(part.alias("part")).count().collect()):
        odd += [p] * (total % 2)
        total += n
    second = (F.col("at") % 2 == 1) != part.isin(odd)
    return own.filter(~second).select("doc"), own.filter(second if total > 1 else F.lit(True)).select("doc")


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How often each bucket's n-grams occur in the texts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(BUCKETS, np.int64)
        for x in batches:
            for _, _, data, offsets in K.slices(x.column("text")):
                own += np.bincount(grams(data, offsets)[0], minlength=BUCKETS)
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own[at])], ["bucket", "n"])

    # one row per bucket, a fixed number, comes to the driver
    out = np.zeros(BUCKETS)
    for b, n in docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[b] = n
    return out


def at_rank(scores: DataFrame, k: int, most: int = COLLECTED) -> float:
    """The score at rank k (from 0, ascending), exact: histograms between the least and the largest score pick the slot
    that holds it, until at most `most` scores are left or all are equal."""
    while True:
        n, low, high = scores.agg(F.count("score"), F.min("score"), F.max("score")).first()
        if low == high:
            return low
        if n <= most:
            return sorted(r[0] for r in scores.select("score").collect())[k]
        slot = F.least(F.floor((F.col("score") - low) / (high - low) * SLOTS), F.lit(SLOTS - 1))
        for s, c in sorted(scores.groupBy(slot.alias("slot")).count().collect()):
            if k < c:
                break
            k -= c
        scores = scores.filter(slot == s)


def fit(docs: DataFrame, labels: DataFrame, loss: float = LOSS) -> tuple[np.ndarray, float]:
    """The log ratio of each bucket and the threshold below which a document is rejected.

    Every label is used. Half of the good documents shape the target; the other half
    and all bad ones set the threshold, halfway between the least good scores and the
    bad ones below them (documents that the base rules reject anyway don't count). The
    least good score is taken, or the one at `loss` if bad documents reach beyond it,
    as clean documents must stay. Without good labels nothing is rejected.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    target, held = halves(of_class(labels, True))
    # the filter spares most texts the exchange, the join decides
    trusted = docs.filter("doc_id IS NOT NULL").filter(maybe_in(target, "doc_id")).join(target, F.col("doc_id") == F.col("doc"), "left_semi")
    own = bucket_counts(trusted)
    if not own.sum():
        return np.zeros(BUCKETS, np.float32), -np.inf
    raw = bucket_counts(docs)
    p = (raw + 0.5) / (raw.sum() + 0.5 * BUCKETS)
    strength = min(float(BUCKETS), own.sum() / 2)
    q = (own + strength * p) / (own.sum() + strength)
    # sums of such multiples are exact in doubles, so a text scores the same in every batch
    ratio = (np.round(np.log(q / p) * RATIO_UNIT) / RATIO_UNIT).astype(np.float32)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            f = features(x.column("text"), ratio, -np.inf)
            own = pa.array(f["kept"])
            yield pa.RecordBatch.from_arrays([x.column("doc_id").filter(own), pa.array(f["score"]).filter(own)], ["doc_id", "score"])

    sample = held.withColumn("good", F.lit(True)).unionAll(of_class(labels, False).withColumn("good", F.lit(False)))
    # scores are exchanged, no texts
    judged = docs.filter("doc_id IS NOT NULL").filter(maybe_in(sample, "doc_id")).mapInArrow(judge, "doc_id long, score double")
    found = stage(judged.join(sample, F.col("doc_id") == F.col("doc")).select("good", "score"), "quality-scores")
    ok, no = found.filter("good").select("score"), found.filter("NOT good").select("score")
    n, least = ok.agg(F.count("score"), F.min("score")).first()
    if not n:
        return ratio, -np.inf
    low = at_rank(ok, int(loss * n))
    under = no.filter(F.col("score") < low)
    m = under.count()
    if not m:
        return ratio, least
    at = 0.95 * (m - 1)
    high = np.quantile([at_rank(under, int(at)), at_rank(under, min(int(at) + 1, m - 1))], at % 1)
    return ratio, float((high + (least if least > high else low)) / 2)


def features(text: pa.Array, ratio: np.ndarray, threshold: float) -> dict[str, np.ndarray]:
    parts = [base_features(data, offsets) | {"score": scores(data, offsets, ratio)} for _, _, data, offsets in K.slices(text)]
    out = {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in [*FEATURES, "score"]}
    out["base_failed"] = (out["n_words"] < 10) | (100 * out["n_repeat_words"] > 20 * out["n_words"])
    out["kept"] = ~out["base_failed"] & (out["score"] >= threshold)
    return out


def judge_all(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, the five counts, base_failed, kept, score.

    Null text counts as empty (no words, so base_failed). Repeated rows are judged
    alike. Without good labels, or over an empty table, only the base rules reject.
    Other columns are ignored.
    """
    ratio, threshold = fit(docs, labels)
    types = [StructField("doc_id", docs.schema["doc_id"].dataType)] + [StructField(c, LongType()) for c in FEATURES]
    types += [StructField("base_failed", BooleanType()), StructField("kept", BooleanType()), StructField("score", DoubleType())]
    names = [t.name for t in types]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            f = features(x.column("text"), ratio, threshold)
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), *[pa.array(f[c]) for c in names[1:]]], names)

    return docs.select("doc_id", "text").mapInArrow(judge, StructType(types))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, same columns; only the text crosses to Python."""
    ratio, threshold = fit(docs, labels)

    @F.pandas_udf("boolean")
    def good(text: pd.Series) -> pd.Series:
        return pd.Series(features(pa.array(text, pa.large_string(), from_pandas=True), ratio, threshold)["kept"])

    return docs.filter(good("text"))
