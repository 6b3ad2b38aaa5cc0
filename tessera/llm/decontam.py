"""Benchmark decontamination with a BM25 index of the test items.

The items are the index, every passage of a training document is a query: windows
of words that overlap so far that any item fits into one. An item's score is
divided by the score it gets from itself, so one threshold fits all. Terms that
can't carry an item to the threshold by themselves (the most frequent ones) don't
open a passage; the others' sums bound what an item can reach, and for what passes
block-max WAND finds every item above the threshold. Hits are verified by the
5-word shingles of question and answer (of the whole item, if it has no answer)
that occur in the passage; parts of few words, of which one changed word takes
most shingles, by the words that occur in order in a stretch of about their length.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from . import kernel as K
from .common import ship, stage

K1, B = 1.2, 0.75
#: Of an item's own score; of the shingles of its question and of its answer.
SCORE, OVERLAP = 0.5, 0.6
SHINGLE = 5
#: Parts of fewer words are aligned word by word; so many of their words must be found.
ALIGNED, WORDS = 17, 0.7
PASSAGE = 128
BLOCK = 8
#: Text of the items that one index holds; more items go to further indexes.
INDEX_BYTES = 16 << 20
TERM = np.full(256, 0x20, np.uint8)
for _a, _b in ((48, 58), (97, 123), (128, 256)):
    TERM[_a:_b] = np.arange(_a, _b)
TERM[65:91] = np.arange(97, 123)


def term_slices(text: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each slice: its first row, the hashes of its words (letters and digits, lower case) and their bounds."""
    for i, _, data, offsets in K.slices(pc.utf8_lower(pc.fill_null(text.cast(pa.large_string()), ""))):
        data = TERM[data]
        starts, ends, bounds = K.words(data, offsets)
        yield i, K.spans_hash(K.prefix(data), starts, ends), bounds


def terms(text: str) -> np.ndarray:
    for _, h, _ in term_slices(pa.array([text])):
        return h
    return np.zeros(0, K.U)


def shingle_hashes(h: np.ndarray) -> np.ndarray:
    """Distinct shingles; fewer words are one."""
    if len(h) >= SHINGLE:
        return np.unique(K.windows(h, np.array([0, len(h)]), SHINGLE)[0])
    return K.mix((h * K.WINDOW[8 : 8 + len(h)]).sum(dtype=K.U, keepdims=True) + K.U(len(h))) if len(h) else np.zeros(0, K.U)


@dataclass
class Posting:
    items: np.ndarray
    weights: np.ndarray
    most: float
    blocks: list[tuple[int, float]]  # last item and largest weight of each block


@dataclass
class Index:
    ids: list
    vocabulary: np.ndarray
    postings: list[Posting]
    essential: np.ndarray
    slack: np.ndarray  # of each item: what its other terms can add
    parts: list[tuple[np.ndarray, np.ndarray]]  # words of question and answer
    shingles: list[tuple[np.ndarray, np.ndarray]]  # of question and answer
    longest: int
    flat: tuple[np.ndarray, np.ndarray, np.ndarray] = field(default=None)  # starts, items, weights of all postings


@dataclass
class Statistics:
    """Of all items: how many have words, their mean length, and in how many each term is."""

    n: int
    mean: float
    df: dict[int, int]


def words_of(question: str | None, answer: str | None) -> np.ndarray:
    return np.concatenate([terms(question or ""), terms(answer or "")])


def build(rows: list[tuple], of: Statistics | None = None) -> Index | None:
    """rows: (item_id, question, answer or None). Without an answer, all of the item is the question.

    of: of all items, if rows are only some of them; scores are the same in either case.
    """
    ids, words, parts, shingles = [], [], [], []
    for item, question, answer in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        q, a = terms(question or ""), terms(answer or "")
        every = np.concatenate([q, a])
        if not len(every):
            continue
        ids.append(item)
        words.append(every)
        parts.append((q, a))
        shingles.append((shingle_hashes(q), shingle_hashes(a)))
    if not ids:
        return None
    tf = [Counter(w.tolist()) for w in words]
    of = of or Statistics(len(ids), sum(map(len, words)) / len(ids), Counter(t for c in tf for t in c))
    mean, df = of.mean, of.df
    lists: dict[int, list[tuple[int, float]]] = defaultdict(list)
    own = np.zeros(len(ids))
    for i, c in enumerate(tf):
        norm = K1 * (1 - B + B * len(words[i]) / mean)
        w = {t: math.log(1 + (of.n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + norm) for t, f in c.items()}
        own[i] = sum(w.values())
        for t, x in w.items():
            lists[t].append((i, x / own[i]))
    vocabulary = np.array(sorted(lists), K.U)
    postings = []
    for t in vocabulary.tolist():
        items, weights = np.array([x[0] for x in lists[t]]), np.array([x[1] for x in lists[t]])
        blocks = [(int(items[k : k + BLOCK][-1]), float(weights[k : k + BLOCK].max())) for k in range(0, len(items), BLOCK)]
        postings.append(Posting(items, weights, float(weights.max()), blocks))
    # the most frequent terms are left out of the opening as long as no item gets half the threshold from them
    slack, essential = np.zeros(len(ids)), np.ones(len(postings), bool)
    for t in sorted(range(len(postings)), key=lambda t: (-len(postings[t].items), t)):
        p = postings[t]
        if (slack[p.items] + p.weights).max() > SCORE / 2:
            break
        slack[p.items] += p.weights
        essential[t] = False
    starts = np.concatenate([[0], np.cumsum([len(p.items) for p in postings])])
    flat = (starts, np.concatenate([p.items for p in postings]), np.concatenate([p.weights for p in postings]))
    return Index(ids, vocabulary, postings, essential, slack, parts, shingles, max(map(len, words)), flat)


def block_max_wand(index: Index, query: list[int], threshold: float) -> dict[int, float]:
    """Every item whose score for the distinct terms of the query reaches the threshold."""
    lists = [index.postings[t] for t in query]
    at, block = [0] * len(lists), [0] * len(lists)
    live = list(range(len(lists)))
    found: dict[int, float] = {}
    eps = 1e-9

    def advance(k: int, to: int) -> None:
        at[k] += int(np.searchsorted(lists[k].items[at[k] :], to))

    while live:
        live.sort(key=lambda k: lists[k].items[at[k]])
        bound, pivot = 0.0, -1
        for j, k in enumerate(live):
            bound += lists[k].most
            if bound >= threshold - eps:
                pivot = j
                break
        if pivot < 0:
            break
        item = int(lists[live[pivot]].items[at[live[pivot]]])
        while pivot + 1 < len(live) and lists[live[pivot + 1]].items[at[live[pivot + 1]]] == item:
            pivot += 1
        front, close, until = live[: pivot + 1], 0.0, math.inf
        for k in front:
            while lists[k].blocks[block[k]][0] < item:
                block[k] += 1
                if block[k] == len(lists[k].blocks):
                    block[k] -= 1
                    break
            last, most = lists[k].blocks[block[k]]
            if last >= item:
                close += most
                until = min(until, last)
        if close >= threshold - eps:
            if lists[front[0]].items[at[front[0]]] == item:
                score = sum(float(lists[k].weights[at[k]]) for k in front)
                if score >= threshold - eps:
                    found[item] = score
                to = item + 1
            else:
                to = item
                front = [k for k in front if lists[k].items[at[k]] < item]
        else:
            nxt = int(lists[live[pivot + 1]].items[at[live[pivot + 1]]]) if pivot + 1 < len(live) else math.inf
            to = int(min(until + 1, nxt)) if min(until + 1, nxt) < math.inf else item + 1
        for k in front:
            advance(k, to)
        live = [k for k in live if at[k] < len(lists[k].items)]
    return found


def search(index: Index, text: pa.Array) -> Iterator[tuple[int, int, float, float, float]]:
    """(row, item, best score, overlap of question, of answer) of the verified hits in each text."""
    width = max(PASSAGE, 2 * index.longest)
    stride = width - index.longest
    starts, items, weights = index.flat
    n_items, n_terms = len(index.ids), len(index.vocabulary)
    table = np.zeros(1 << 16, bool)
    table[(index.vocabulary >> K.U(48)).astype(np.int64)] = True
    for first, h, bounds in term_slices(text):
        if not len(h):
            continue
        at = np.flatnonzero(table[(h >> K.U(48)).astype(np.int64)])
        term = np.searchsorted(index.vocabulary, h[at])
        ok = (term < n_terms) & (index.vocabulary[np.minimum(term, n_terms - 1)] == h[at])
        at, term = at[ok], term[ok]
        of = np.searchsorted(bounds, at, "right") - 1
        place = at - bounds[of]
        lengths = np.diff(bounds)
        # windows start at multiples of the stride; the last one of a text reaches its end
        count = np.maximum(1, -(-(lengths - width) // stride) + 1)
        base = np.concatenate([[0], np.cumsum(count)])
        rare = index.essential[term]
        hi = np.minimum(place // stride, count[of] - 1)
        keys = []
        for back in range(-(-width // stride)):
            w = hi - back
            fits = rare & (w >= 0) & (place - w * stride < width)
            keys.append((base[of[fits]] + w[fits]) * n_terms + term[fits])
        keys = np.unique(np.concatenate(keys))
        if not len(keys):
            continue
        win, t = keys // n_terms, keys % n_terms
        size = starts[t + 1] - starts[t]
        spot = np.repeat(starts[t] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        pair = np.repeat(win, size) * n_items + items[spot]
        pairs, inverse = np.unique(pair, return_inverse=True)
        reach = np.bincount(inverse, weights[spot]) + index.slack[pairs % n_items]
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for w in np.unique(pairs[reach >= SCORE - 1e-9] // n_items).tolist():
            row = int(np.searchsorted(base, w, "right")) - 1
            begin = int(bounds[row]) + (w - int(base[row])) * stride
            end = min(begin + width, int(bounds[row + 1]))
            lo, hi_ = np.searchsorted(at, [begin, end])
            hits = block_max_wand(index, np.unique(term[lo:hi_]).tolist(), SCORE)
            if not hits:
                continue
            near = h[max(int(bounds[row]), begin - index.longest) : min(int(bounds[row + 1]), end + index.longest)]
            have = np.unique(K.windows(near, np.array([0, len(near)]), SHINGLE)[0])
            for item, score in hits.items():
                (q, q_ok), (a, a_ok) = (overlap(p, x, near, have) for p, x in zip(index.parts[item], index.shingles[item], strict=True))
                if q_ok and a_ok:
                    best[row, item] = max(best.get((row, item), (0.0, 0.0, 0.0)), (score, q, a))
        for (row, item), x in sorted(best.items()):
            yield first + row, item, *x


def aligned(part: np.ndarray, near: np.ndarray) -> int:
    """The most words of the part that occur in its order in a stretch of the passage a quarter longer."""
    at, width = np.flatnonzero(np.isin(near, part)), len(part) + max(1, len(part) // 4)
    need, most = math.ceil(WORDS * len(part)), 0
    words = part.tolist()
    for k in np.flatnonzero(np.searchsorted(at, at + width) - np.arange(len(at)) >= need).tolist():
        row = [0] * (len(words) + 1)
        for x in near[at[k] : at[k] + width].tolist():
            last = 0
            for j, w in enumerate(words):
                last, row[j + 1] = row[j + 1], last + 1 if w == x else max(row[j + 1], row[j])
        most = max(most, row[-1])
    return most


def overlap(part: np.ndarray, shingles: np.ndarray, near: np.ndarray, have: np.ndarray) -> tuple[float, bool]:
    """The share of a part in the passage, and whether it is enough.

    A part's shingles count, or its words in order if it has few; one shorter than a shingle must occur as it is.
    """
    n = len(part)
    if not n:
        return 1.0, True
    if n < SHINGLE:
        found = any(shingle_hashes(near[k : k + n])[0] == shingles[0] for k in range(len(near) - n + 1))
        return float(found), found
    share = float(np.isin(shingles, have).mean())
    if share < OVERLAP and n < ALIGNED:
        share = aligned(part, near) / n
        return share, share >= WORDS
    return share, share >= OVERLAP


def statistics(rows: DataFrame) -> tuple[int, float, DataFrame]:
    """Of all items (q, a), distributed: how many have words, their mean length, and the table (t, df) of terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for q, a in zip(x.column("q").to_pylist(), x.column("a").to_pylist(), strict=True):
                w = words_of(q, a)
                t = np.unique(w).view(np.int64)
                # each item's first row also carries its length
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array([len(w)] * (len(t) > 0) + [0] * (len(t) - 1), pa.int64())], ["t", "length"])

    found = rows.select("q", "a").mapInArrow(run, "t long, length long")
    n, total = found.filter("length > 0").agg(F.count(F.lit(1)), F.sum("length")).first()
    return n, (total or 0) / max(n, 1), found.groupBy("t").agg(F.count(F.lit(1)).alias("df"))


def indexes(benchmark: DataFrame, index_bytes: int = INDEX_BYTES) -> Iterator[Index]:
    """The items in indexes of about index_bytes of text each, dealt by a hash of the id, one after the other."""
    question = "question" if "question" in benchmark.columns else "text"
    answer = F.col("answer") if "answer" in benchmark.columns else F.lit(None).cast("string")
    rows = benchmark.select("item_id", F.col(question).alias("q"), answer.alias("a"))
    total = rows.agg(F.sum(F.coalesce(F.octet_length("q"), F.lit(0)) + F.coalesce(F.octet_length("a"), F.lit(0)))).first()[0] or 0
    n = max(1, math.ceil(1.5 * total / index_bytes))
    if n == 1:
        own = build([tuple(r) for r in rows.distinct().collect()])
        yield from [own] if own else []
        return
    rows = stage(rows.distinct(), "decontam-items")
    count, mean, df = statistics(rows)
    df = stage(df, "decontam-terms")
    for k in range(n):
        own = [tuple(r) for r in rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect()]
        have = np.unique(np.concatenate([words_of(q, a) for _, q, a in own] or [np.zeros(0, K.U)])).view(np.int64)
        terms_ = rows.sparkSession.createDataFrame(pd.DataFrame({"t": have}), "t long")
        index = build(own, Statistics(count, mean, {r[0] % 2**64: r[1] for r in df.join(terms_, "t").collect()}))
        if index:
            yield index


def contaminated(docs: DataFrame, benchmark: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """A row for each document and item that it holds: doc_id, item_id, score, question_overlap, answer_overlap.

    Documents without a hit have no row. Null texts and items without words hit nothing;
    repeated items count once, repeated documents have rows each. Other columns are ignored.
    Every index is broadcast, as it holds about index_bytes of items; if there are several, each
    reads the documents in a pass of its own, with the statistics of all items.
    """
    ship(docs.sparkSession)
    fields = [docs.schema["doc_id"], benchmark.schema["item_id"], *[StructField(c, DoubleType()) for c in ("score", "question_overlap", "answer_overlap")]]
    names = [f.name for f in fields]
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)

    def hits_in(index: Index) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for x in batches:
                hits = [(r, own.ids[i], *rest) for r, i, *rest in search(own, x.column("text"))]
                cols = list(zip(*hits, strict=True)) or [()] * 5
                ids = x.column("doc_id").take(pa.array(cols[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(cols[1], item_type), *[pa.array(c, pa.float64()) for c in cols[2:]]], names)

        return docs.select("doc_id", "text").mapInArrow(run, StructType(fields))

    out = [hits_in(index) for index in indexes(benchmark, index_bytes)]
    return reduce(DataFrame.unionAll, out) if out else docs.sparkSession.createDataFrame([], StructType(fields))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The documents without a hit, same columns; only the text crosses to Python.

    Null and empty texts have no hit and stay, as do documents of null id without one; repeated rows go or stay
    together. An empty table stays empty, and without items all documents stay.
    """
    ship(docs.sparkSession)

    def clean_of(index: Index):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        @F.pandas_udf("boolean")
        def clean(text: pd.Series) -> pd.Series:
            out = np.ones(len(text), bool)
            for row, *_ in search(shared.value, pa.array(text, pa.large_string(), from_pandas=True)):
                out[row] = False
            return pd.Series(out)

        return clean("text")

    for index in indexes(benchmark, index_bytes):
        docs = docs.filter(clean_of(index))
    return docs
