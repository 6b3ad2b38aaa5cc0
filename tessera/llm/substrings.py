"""Removal of repeated 100-byte strings, by hash-compared suffixes.

A string that is repeated starts suffixes with a common extension of at least its
length. Suffixes are compared only where a local minimum of the hashes of GRAM
bytes marks one: every window of LENGTH bytes has such a mark, at the same place in
all its copies. Marks are brought together by their gram hash and merge-sorted with
the hash of their whole context (all bytes that any window through the mark can
have) and their place. A context seen before at another place is covered outright: the hash
that tells so is no polynomial one, but the 128-bit BLAKE2b digest of the bytes.
Where contexts differ, at the edges of what is shared, and where marks of a short
text have it all as their context, the suffixes from the marks on and the
reversed prefixes before them are merge-sorted: two are compared by a binary search
over prefix polynomial hashes for their common extension and the byte after it. The
bytes of neighbours verify the sort; common extensions say which windows recur.

Only marks travel (about 1 in 31 bytes), packed in blocks; copies within a block of
documents are settled there, so a passage of very many documents sends a mark per
block. A gram in very many different contexts (a line that a third of the documents
have) would still meet in one task: such hot grams are found in a sample, and their
marks are sent as the windows through them, dealt by the hash of the window. Texts
move only for documents with an edge or with something removed.
"""

from __future__ import annotations

import hashlib
import math
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import kernel as K
from .common import maybe_in, ship, stage

LENGTH = 100
GRAM = 40
SPAN = LENGTH - GRAM
#: Marks that a task gathers before it sends a block.
BLOCK = 400_000
#: Text of the documents whose marks meet in one bucket.
BUCKET_BYTES = 8 << 20
#: Hot grams: so many marks in a sample of one document in SAMPLE (of at most a million), and more than HOT_SHARE of its marks.
SAMPLE, SAMPLED = 64, 1_000_000
HOT_LEAST, HOT_SHARE = 1000, 1e-6
LAST = np.uint64(2**64 - 1)
#: A mark: gram hash, digest of the context, document, hash of its text, offset, bytes of context to the left and right.
MARK = np.dtype([("g", "<u8"), ("c", "<u8"), ("c2", "<u8"), ("doc", "<i8"), ("th", "<i4"), ("off", "<i4"), ("left", "i1"), ("right", "i1")])
WINDOW = np.dtype([("w1", "<u8"), ("w2", "<u8"), ("doc", "<i8"), ("th", "<i4"), ("start", "<i4")])
PLACE = np.dtype([("doc", "<i8"), ("th", "<i4"), ("start", "<i4"), ("end", "<i4")])


def sliding(a: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """f over each run of `width` items, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        a = f(a[:-step], a[step:])
        have += step
    return a


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """BLAKE2b digests of the byte ranges, two numbers each."""
    b, f = data.tobytes(), hashlib.blake2b
    return np.frombuffer(b"".join([f(b[s:e], digest_size=16).digest() for s, e in zip(start.tolist(), end.tolist(), strict=True)]), K.U).reshape(-1, 2)


def marks(data: np.ndarray, offsets: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the marks in a slice: text, place in the slice, bytes of context to the left and right, gram hash.
    h: the prefix hashes."""
    n = len(data) - GRAM + 1
    empty = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return empty, empty, empty, empty, empty.astype(K.U)
    down = K.powers(len(h))[1]
    g = K.mix((h[GRAM:] - h[:-GRAM]) * down[:n])
    # grams over the border of two texts are none
    edge = offsets[1:-1]
    if len(edge):
        over = np.concatenate([np.arange(max(0, e - GRAM + 1), min(e, n)) for e in edge.tolist()])
        g[over] = LAST
    least = sliding(g, SPAN + 1, np.minimum)
    fill = np.zeros(SPAN, K.U)
    chosen = sliding(np.concatenate([fill, least, fill]), SPAN + 1, np.maximum) == g
    at = np.flatnonzero(chosen & (g != LAST))
    of = np.searchsorted(offsets, at, "right") - 1
    long_enough = (offsets[of + 1] - offsets[of]) >= LENGTH
    at, of = at[long_enough], of[long_enough]
    left = np.minimum(SPAN, at - offsets[of])
    right = np.minimum(SPAN, offsets[of + 1] - at - GRAM)
    return of, at, left, right, g[at]


def windows_of(data: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows through marks: index of the mark, start in the slice, digest."""
    back = np.arange(SPAN + 1)
    fits = (left[:, None] >= back) & (right[:, None] >= SPAN - back)
    mark, b = np.nonzero(fits)
    start = at[mark] - b
    return mark, start, digests(data, start, start + LENGTH)


def order_of(m: np.ndarray) -> np.ndarray:
    """Merge sort by gram, context and place."""
    return np.lexsort((m["off"], m["th"], m["doc"], m["c2"], m["c"], m["g"]))


def groups(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """m sorted, each place once; where a new gram begins; which marks are no copy of a context before.

    These are the first of each context and, in a text so short that the contexts of several
    marks are all of it, the others of the same bytes: they are the first one itself.
    """
    m = m[order_of(m)]
    new_g = np.ones(len(m), bool)
    new_g[1:] = m["g"][1:] != m["g"][:-1]
    new_c = new_g.copy()
    new_c[1:] |= (m["c"][1:] != m["c"][:-1]) | (m["c2"][1:] != m["c2"][:-1])
    again = ~new_c
    for k in ("doc", "th", "off"):
        again[1:] &= m[k][1:] == m[k][:-1]
    m, new_g, new_c = m[~again], new_g[~again], new_c[~again]
    if not len(m):
        return m, new_g, new_c
    lead = m[np.flatnonzero(new_c)[np.cumsum(new_c) - 1]]
    itself = (m["doc"] == lead["doc"]) & (m["th"] == lead["th"]) & (m["off"] - m["left"] == lead["off"] - lead["left"])
    return m, new_g, itself


def doc_key(doc_id: Column) -> Column:
    """A null id comes after all others."""
    return F.coalesce(doc_id.cast("long"), F.lit(2**63 - 1))


def text_key(text: Column) -> Column:
    """Tells apart documents of one id; identical rows are one document."""
    return F.shiftright(F.xxhash64(F.coalesce(text, F.lit(""))), 32).cast("int")


def covers_of(m: np.ndarray) -> np.ndarray:
    out = np.empty(len(m), PLACE)
    out["doc"], out["th"] = m["doc"], m["th"]
    out["start"], out["end"] = m["off"] - m["left"], m["off"] + GRAM + m["right"]
    return out


def joined(p: np.ndarray) -> np.ndarray:
    """The same cover with overlapping ranges of a document as one: the windows of a mark mostly are."""
    p = p[np.lexsort((p["start"], p["th"], p["doc"]))]
    if not len(p):
        return p
    new = np.ones(len(p), bool)
    new[1:] = (p["doc"][1:] != p["doc"][:-1]) | (p["th"][1:] != p["th"][:-1])
    owner = np.cumsum(new) << 32
    reach = np.maximum.accumulate(owner + p["end"])
    new[1:] |= owner[1:] + p["start"][1:] > reach[:-1]
    at = np.flatnonzero(new)
    out = p[at]
    out["end"] = reach[np.append(at[1:], len(p)) - 1] & 0xFFFFFFFF
    return out


def hot_grams(docs: DataFrame, n_docs: int, sample: int = SAMPLE, least: int = HOT_LEAST) -> np.ndarray:
    """Grams with very many marks, at most 1 / HOT_SHARE of them; missing or excess ones only cost time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for _, _, data, offsets in K.slices(x.column("text")):
                g, n = np.unique(marks(data, offsets, K.prefix(data))[4], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n)], ["g", "n"])

    some = docs.filter(F.pmod(F.xxhash64("doc"), F.lit(max(sample, n_docs // SAMPLED))) == 0)
    counts = stage(some.select("text").mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).filter("n > 1"), "grams")
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.filter(F.col("n") >= max(least, int(total * HOT_SHARE))).select("g").toArrow()
    return np.sort(found.column("g").to_numpy().view(K.U))


def firsts(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each window, and the ranges that its other places cover."""
    w = w[np.lexsort((w["start"], w["th"], w["doc"], w["w2"], w["w1"]))]
    new = np.ones(len(w), bool)
    new[1:] = (w["w1"][1:] != w["w1"][:-1]) | (w["w2"][1:] != w["w2"][:-1])
    lead = w[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(w) else w
    rest = (w["doc"] != lead["doc"]) | (w["th"] != lead["th"]) | (w["start"] != lead["start"])
    out = np.empty(int(rest.sum()), PLACE)
    out["doc"], out["th"], out["start"], out["end"] = w["doc"][rest], w["th"][rest], w["start"][rest], w["start"][rest] + LENGTH
    return w[new], out


def block(parts: list[np.ndarray], wide: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """bucket, marks, windows, covers: marks by gram hash, windows by theirs, less what is settled among them."""
    m, _, own = groups(np.concatenate(parts))
    covers = [covers_of(m[~own])]
    m = m[own]
    w = np.concatenate(wide) if wide else np.zeros(0, WINDOW)
    if len(w):
        w, more = firsts(w)
        covers.append(more)
    covers = joined(np.concatenate(covers))
    cuts, sent = [], []
    for x, key in ((m, "g"), (w, "w1")):
        to = (x[key] % K.U(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        sent.append(x[order])
        cuts.append(np.searchsorted(to[order], np.arange(buckets + 1)))
    sent.append(covers)
    cuts.append(np.linspace(0, len(covers), buckets + 1).astype(int))
    used = [b for b in range(buckets) if any(c[b] < c[b + 1] for c in cuts)]
    blobs = [pa.array([x[c[b] : c[b + 1]].tobytes() for b in used], pa.binary()) for x, c in zip(sent, cuts, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *blobs], ["bucket", "marks", "windows", "covers"])


def blocks(batches: Iterator[pa.RecordBatch], buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The blocks of rows doc, th, text."""
    parts, wide, n = [], [], 0
    for x in batches:
        doc, th = x.column("doc").to_numpy(), x.column("th").to_numpy()
        for i, _, data, offsets in K.slices(x.column("text")):
            of, at, left, right, g = marks(data, offsets, K.prefix(data))
            if len(hot) and (is_hot := np.isin(g, hot)).any():
                mark, start, digest = windows_of(data, at[is_hot], left[is_hot], right[is_hot])
                w = np.empty(len(mark), WINDOW)
                text = of[is_hot][mark]
                w["w1"], w["w2"], w["start"] = digest[:, 0], digest[:, 1], start - offsets[text]
                w["doc"], w["th"] = doc[i + text], th[i + text]
                wide.append(w)
                n += len(w)
                of, at, left, right, g = (v[~is_hot] for v in (of, at, left, right, g))
            m = np.empty(len(of), MARK)
            c = digests(data, at - left, at + GRAM + right)
            m["g"], m["c"], m["c2"], m["off"], m["left"], m["right"] = g, c[:, 0], c[:, 1], at - offsets[of], left, right
            m["doc"], m["th"] = doc[i + of], th[i + of]
            parts.append(m)
            n += len(m)
            if n >= BLOCK:
                yield block(parts, wide, buckets)
                parts, wide, n = [], [], 0
    if n:
        yield block(parts, wide, buckets)


def send_marks(docs: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """bucket, marks, windows, covers: blocks of marks by gram hash, windows of hot grams by theirs, and what was
    settled within the block."""
    return docs.select("doc", "th", "text").mapInArrow(lambda batches: blocks(batches, buckets, hot), "bucket int, marks binary, windows binary, covers binary")


def settled(t: pa.Table) -> pa.Table:
    """What settle_contexts gives of one bucket."""
    m = np.frombuffer(b"".join(x.as_py() for x in t.column("marks")), MARK)
    covers = np.frombuffer(b"".join(x.as_py() for x in t.column("covers")), PLACE)
    _, more = firsts(np.frombuffer(b"".join(x.as_py() for x in t.column("windows")), WINDOW))
    m, new_g, own = groups(m)
    covers = joined(np.concatenate([covers, more, covers_of(m[~own])]))
    # grams with several marks that are no copies, of other contexts or in one short text: these are at an edge
    gram = np.cumsum(new_g) - 1
    several = np.bincount(gram[own], minlength=int(new_g.sum())) > 1
    edge = m[own & several[gram]]
    g = pa.array(np.concatenate([np.zeros(len(covers), np.int64), edge["g"].view(np.int64)]), mask=np.arange(len(covers) + len(edge)) < len(covers))
    return pa.table([
        pa.array(np.concatenate([covers["doc"], edge["doc"]])), pa.array(np.concatenate([covers["th"], edge["th"]])),
        pa.array(np.concatenate([covers["start"], edge["off"]])), pa.array(np.concatenate([covers["end"], edge["off"]])), g,
    ], names=["doc", "th", "start", "end", "g"])


def settle_contexts(sent: DataFrame) -> DataFrame:
    """doc, th, start, end of covered ranges, and (g not null) doc, th, start of the marks at edges."""
    return sent.groupBy("bucket").applyInArrow(settled, "doc long, th int, start int, end int, g long")


def contexts(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """bucket, g, doc, th, off, left, context of every edge in rows doc, th, text, e (g, off)."""
    for x in batches:
        for k in range(len(x)):
            e = x.column("e")[k].values
            off = e.field("off").to_numpy()
            text = x.column("text")[k].as_py().encode()
            left = np.minimum(off, SPAN)
            context = [text[o - s : o + LENGTH] for o, s in zip(off.tolist(), left.tolist(), strict=True)]
            g = e.field("g")
            to = (g.to_numpy().view(K.U) % K.U(buckets)).astype(np.int32)
            doc = pa.array(np.full(len(off), x.column("doc")[k].as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(to), g, doc, pa.array(np.full(len(off), x.column("th")[k].as_py(), np.int32)), pa.array(off), pa.array(left.astype(np.int32)), pa.array(context, pa.binary())], ["bucket", "g", "doc", "th", "off", "left", "context"])


def edge_contexts(docs: DataFrame, edges: DataFrame, buckets: int) -> DataFrame:
    """bucket, g, doc, th, off, left, context of every edge."""
    own = edges.groupBy("doc", "th").agg(F.collect_list(F.struct("g", F.col("start").alias("off"))).alias("e"))  # as many as the text has at most
    met = docs.join(own, ["doc", "th"]).select("doc", "th", "text", "e")
    return met.mapInArrow(lambda batches: contexts(batches, buckets), "bucket int, g long, doc long, th int, off int, left int, context binary")


class Suffixes:
    """Suffixes of contexts, each from a place of its own to the end of its context, compared by hashes.

    data: the contexts one after another, at: where each begins (and the last ends); start: the
    suffix of each; group: ascending, only suffixes of one group are sorted among each other.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, start: np.ndarray, group: np.ndarray) -> None:
        self.data, self.start, self.size, self.group = data, start, at[1:] - start, group
        # powers count from the begin of each context, so short tables serve for any number of them
        place = np.arange(len(data)) - np.repeat(at[:-1], np.diff(at))
        up, self.down = K.powers(int(np.diff(at).max(initial=0)))
        self.hash = np.zeros(len(data) + 1, K.U)
        np.cumsum(K.CODES[data] * up[place], out=self.hash[1:])
        self.local = start - at[:-1]

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The longest common extension of suffixes x and y, by binary search over their prefix hashes."""
        p, q, dp, dq = self.start[x], self.start[y], self.down[self.local[x]], self.down[self.local[y]]
        most = np.minimum(self.size[x], self.size[y])
        hp, hq = self.hash[p], self.hash[q]
        found = np.zeros(len(x), np.int64)
        step = 1 << int(most.max(initial=0)).bit_length() >> 1
        while step:
            reach = np.minimum(found + step, most)
            same = (self.hash[p + reach] - hp) * dp == (self.hash[q + reach] - hq) * dq
            found = np.where(same, reach, found)
            step >>= 1
        return found

    def less(self, x: np.ndarray, y: np.ndarray, found: np.ndarray, ties: np.ndarray | bool) -> np.ndarray:
        """Whether x comes before y, given their common extension; ties: what to say of equal ones."""
        ends = found >= np.minimum(self.size[x], self.size[y])
        last = len(self.data) - 1
        before = self.data[np.minimum(self.start[x] + found, last)] < self.data[np.minimum(self.start[y] + found, last)]
        return np.where(ends, np.where(self.size[x] == self.size[y], ties, self.size[x] < self.size[y]), before)

    def merge_sorted(self) -> np.ndarray:
        """Merge sort, all runs of a width at once: an item's place is its own plus its rank in the run beside."""
        n = len(self.group)
        begins = np.flatnonzero(np.diff(self.group, prepend=self.group[:1] - 1))
        length = np.diff(np.append(begins, n))
        first, end = np.repeat(begins, length), np.repeat(begins + length, length)
        k = np.arange(n) - first
        order, width = np.arange(n), 1
        while width < length.max(initial=0):
            run = k // width
            low = np.minimum(first + (run ^ 1) * width, end)
            lo, hi = low.copy(), np.minimum(low + width, end)
            later = (run & 1) == 1
            live = np.flatnonzero(lo < hi)
            while len(live):
                mid = (lo[live] + hi[live]) >> 1
                x, y = order[mid], order[live]
                up = self.less(x, y, self.extension(x, y), later[live])
                lo[live], hi[live] = np.where(up, mid + 1, lo[live]), np.where(up, hi[live], mid)
                live = live[lo[live] < hi[live]]
            merged_ = np.empty(n, order.dtype)
            merged_[first + (run & ~1) * width + k - run * width + lo - low] = order
            order, width = merged_, 2 * width
        return order

    def common(self, order: np.ndarray) -> np.ndarray:
        """Of each suffix in sorted order what it has in common with the one before; -1 in another group."""
        out = np.full(len(order), -1, np.int64)
        near = np.flatnonzero(self.group[order[1:]] == self.group[order[:-1]]) + 1
        out[near] = self.extension(order[near - 1], order[near])
        return out

    def verified(self, order: np.ndarray, common: np.ndarray) -> bool:
        """Whether the bytes bear out all that hashes have said: neighbours agree so far and are in order."""
        near = np.flatnonzero(common >= 0)
        line = np.arange(int(common.max(initial=0)))
        for part in np.array_split(near, len(near) // 4096 + 1):
            x, y, n = order[part - 1], order[part], common[part]
            inside = line < n[:, None]
            a, b = (self.data[np.minimum(self.start[v][:, None] + line, len(self.data) - 1)] for v in (x, y))
            if not ((a == b) | ~inside).all() or not self.less(x, y, n, True).all():
                return False
        return True

    def sorted_by_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """What the bytes alone give; for a collision of hashes."""
        text = [self.data[s : s + n].tobytes() for s, n in zip(self.start.tolist(), self.size.tolist(), strict=True)]
        group = self.group.tolist()
        order = sorted(range(len(text)), key=lambda i: (group[i], text[i], i))
        common = [-1] * len(order)
        for k in range(1, len(order)):
            if group[order[k]] == group[order[k - 1]]:
                common[k] = len(os.path.commonprefix([text[order[k - 1]], text[order[k]]]))
        return np.array(order, np.int64), np.array(common, np.int64)

    def sort(self) -> tuple[np.ndarray, np.ndarray]:
        """The order, equal suffixes as given, and the common extension with the one before."""
        order = self.merge_sorted()
        common = self.common(order)
        return (order, common) if self.verified(order, common) else self.sorted_by_bytes()


def most_common(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Of each suffix the longest extension that it has in common with any other of its group."""
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(common, np.append(common[1:], -1))
    return out


def covered_windows(data: np.ndarray, at: np.ndarray, left: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts in the order of their places, those of a gram (group) together -> the nearest and farthest start
    before the mark of a window that an earlier context has too; the farthest is -1 if there is none.

    The suffixes from the marks on are sorted, and the reversed prefixes before them. A window that
    starts `back` bytes before the mark is the same in contexts whose suffixes have LENGTH - back bytes
    in common and whose prefixes have `back`: those between the places where a neighbour has less.
    """
    n = len(left)
    near, far = np.full(n, LENGTH, np.int64), np.full(n, -1, np.int64)
    group = np.cumsum(np.append(0, group[1:] != group[:-1]))
    right, right_common = Suffixes(data, at, at[:-1] + left, group).sort()
    # backwards, the contexts come in reverse: number n - 1 - i is context i
    back_at = (len(data) - at)[::-1]
    before, before_common = Suffixes(data[::-1], back_at, (len(data) - at[:-1] - left)[::-1], group[-1] - group[::-1]).sort()
    before = n - 1 - before
    reach_right = most_common(right, right_common)
    reach_left = most_common(before, before_common)
    some = np.flatnonzero(reach_left + reach_right >= LENGTH)
    for back in range(SPAN + 1):
        own = some[(reach_left[some] >= back) & (reach_right[some] >= LENGTH - back)]
        if len(own) < 2:
            continue
        key = np.empty(n, np.int64)
        key[right] = np.cumsum(right_common < LENGTH - back) * (n + 1)
        side = np.empty(n, np.int64)
        side[before] = np.cumsum(before_common < back)
        key = key[own] + side[own]
        order = np.argsort(key, kind="stable")
        key = key[order]
        hit = own[order[np.flatnonzero(key[1:] == key[:-1]) + 1]]
        near[hit] = np.minimum(near[hit], back)
        far[hit] = back
    return near, far


def settled_edges(t: pa.Table) -> pa.Table:
    """What settle_edges gives of one bucket."""
    g, doc, th, off, left = (t.column(c).to_numpy() for c in ("g", "doc", "th", "off", "left"))
    order = np.lexsort((off, th, doc, g))
    fresh = np.ones(len(order), bool)
    fresh[1:] = np.any([v[order][1:] != v[order][:-1] for v in (g, doc, th, off)], axis=0)
    order = order[fresh]
    g, doc, th, off, left = (v[order] for v in (g, doc, th, off, left.astype(np.int64)))
    new = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    column, out, i = t.column("context"), [], 0
    while i < len(g):
        # whole grams, about 8192 contexts at a time
        k = int(np.searchsorted(new, i + 8192))
        j = int(new[k]) if k < len(new) else len(g)
        own = column.take(pa.array(order[i:j])).to_pylist()
        at = np.concatenate([[0], np.cumsum([len(x) for x in own])])
        near, far = covered_windows(np.frombuffer(b"".join(own), np.uint8), at, left[i:j], g[i:j])
        hit = i + np.flatnonzero(far >= 0)
        # all windows of a context hold its mark, so their union is one range
        out.append((doc[hit], th[hit], (off[hit] - far[hit - i]).astype(np.int32), (off[hit] - near[hit - i] + LENGTH).astype(np.int32)))
        i = j
    cols = [np.concatenate(c) for c in zip(*out, strict=True)]
    return pa.table([pa.array(c) for c in cols], names=["doc", "th", "start", "end"])


def settle_edges(met: DataFrame) -> DataFrame:
    """doc, th, start, end of what the windows through edge marks cover."""
    return met.groupBy("bucket").applyInArrow(settled_edges, "doc long, th int, start int, end int")


def merged(ranges: np.ndarray) -> np.ndarray:
    """Disjoint ranges, in order, of possibly overlapping ones (n, 2); touching ones are one run."""
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(ranges[:, 1])
    new = np.ones(len(ranges), bool)
    new[1:] = ranges[1:, 0] > reach[:-1]
    return np.stack([ranges[new, 0], np.append(reach[np.flatnonzero(new)[1:] - 1], reach[-1])], axis=1)


def repeats(docs: DataFrame, sample: int = SAMPLE, least: int = HOT_LEAST) -> tuple[DataFrame, DataFrame]:
    """The documents (all columns, with doc and th) and the covered ranges (doc, th, start, end)."""
    ship(docs.sparkSession)
    keyed = docs.withColumn("doc", doc_key(F.col("doc_id"))).withColumn("th", text_key(F.col("text")))
    total, n_docs = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    buckets = max(8, math.ceil(total / BUCKET_BYTES))
    texts = keyed.select("doc", "th", "text")
    found = stage(settle_contexts(send_marks(texts, buckets, hot_grams(texts, n_docs, sample, least))), "repeats")
    edges = found.filter(F.col("g").isNotNull())
    touched = keyed.select("doc", "th", "text").filter(maybe_in(edges))
    more = settle_edges(edge_contexts(touched, edges, 4 * buckets))
    covers = stage(found.filter(F.col("g").isNull()).select("doc", "th", "start", "end").unionByName(more), "covers")
    return keyed, covers


def cut(text: bytes, ranges: np.ndarray) -> bytes:
    out, at = [], 0
    for s, e in ranges.tolist():
        out.append(text[at:s])
        at = e
    return b"".join([*out, text[at:]])


def deduplicate(docs: DataFrame, sample: int = SAMPLE, least: int = HOT_LEAST) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null text has no bytes. A null id comes after all others; documents of one id are
    ordered by a hash of their text, and identical rows are one document (each row gets
    its result). An empty table gives no rows; other columns are ignored.
    """
    keyed, covers = repeats(docs, sample, least)
    some = maybe_in(covers)
    own = covers.groupBy("doc", "th").agg(F.collect_list(F.struct("start", "end")).alias("c"))  # as many as the text has marks at most
    base = keyed.select("doc_id", "doc", "th", "text")
    schema = StructType([docs.schema["doc_id"], *[StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")], StructField("kept_sha256", StringType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ranged = "c" in x.schema.names
            rows = []
            for k, t in enumerate(x.column("text")):
                text = (t.as_py() or "").encode()
                c = x.column("c")[k] if ranged else None
                if c is not None and c.is_valid and len(c):
                    r = merged(np.stack([c.values.field("start").to_numpy(), c.values.field("end").to_numpy()], axis=1))
                    rows.append((len(text), int((r[:, 1] - r[:, 0]).sum()), len(r), hashlib.sha256(cut(text, r)).hexdigest()))
                else:
                    rows.append((len(text), 0, 0, hashlib.sha256(text).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), *[pa.array(v, pa.int64()) for v in cols[:3]], pa.array(cols[3], pa.string())], names)

    plain = base.filter(~some).select("doc_id", "text").mapInArrow(run, schema)
    ranged = base.filter(some).join(own, ["doc", "th"], "left").select("doc_id", "text", "c").mapInArrow(run, schema)
    return plain.unionByName(ranged)
