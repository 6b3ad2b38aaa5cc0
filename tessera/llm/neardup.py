"""Near duplicates by bottom-k sketches of 5-word shingles.

One hash function serves all: a document's sketch is its k smallest shingle
hashes. Equal sets are one class from the start, so copies never meet pairwise.
Inverted lists over the retained values count what classes have in common: a link
of Jaccard >= 0.8 shares at least SHARE of the sketch (but for a binomial tail of
3e-8), and a class that shares less with all others together has no link. The rest,
the candidates, get inverted lists over the rarest values of their full sets (the
prefix principle, exact) and are paired there, if sizes and the places of the common
value allow a link; the sketch of the union estimates each pair, and the full sets
decide.

A list's members are compared with one pivot. What is then in one component needs
nothing more; only members outside the list's largest component are compared with
the rest, by one pivot a round, later by more. So a large group of near copies costs about its size, not its square, and
no link between components is missed, as every member left out of a comparison is
already in the component of what it would be compared with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import maybe_in, ship, stage
from .components import components

WORDS = 5
SKETCH = 32
#: The least share of a sketch that linked documents have in common.
SHARE = 0.375
#: Rounds of one pivot a list; in each round after these there are MORE times as many.
PIVOTS, MORE = 3, 64
#: Comparisons for each row of the lists up to which what is left is compared at once.
REST = 8


def shingles(text: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a shorter text is one shingle, a wordless one none."""
    for _, _, data, offsets in K.slices(text):
        starts, ends, bounds = K.words(data, offsets)
        w = K.spans_hash(K.prefix(data, K.LOWER_CODES), starts, ends)
        h, at = K.windows(w, bounds, WORDS)
        cuts = np.searchsorted(at, bounds)
        for i in range(len(offsets) - 1):
            n = bounds[i + 1] - bounds[i]
            if n >= WORDS:
                yield np.unique(h[cuts[i] : cuts[i + 1]])
            elif n:
                own = w[bounds[i] : bounds[i + 1]] * K.WINDOW[8 : 8 + n]
                yield K.mix(own.sum(dtype=K.U, keepdims=True) + K.U(n))
            else:
                yield np.zeros(0, K.U)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n (size of the set), d1 and d2 (a 128-bit digest of it), sketch (its SKETCH smallest hashes)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            sets = list(shingles(x.column("text")))
            d1 = np.array([K.mix(s ^ K.WINDOW[20]).sum(dtype=K.U) for s in sets], K.U)
            d2 = np.array([K.mix(s ^ K.WINDOW[21]).sum(dtype=K.U) for s in sets], K.U)
            sketch = pa.array([s[:SKETCH].view(np.int64) for s in sets], pa.list_(pa.int64()))
            n = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), n, pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), sketch], ["doc_id", "n", "d1", "d2", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long, sketch array<long>")


def set_table(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, set (sorted hashes) of the documents in ids (id)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            sets = pa.array([s.view(np.int64) for s in shingles(x.column("text"))], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), sets], ["id", "set"])

    own = docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id IS NOT NULL").filter(maybe_in(ids.select(F.col("id").alias("doc")), "doc_id"))
    own = own.join(ids, F.col("doc_id") == F.col("id"), "left_semi")
    return own.mapInArrow(run, "id long, set array<long>")


def verify(pairs: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have a Jaccard of at least percent / 100."""
    sk = reps.select(F.col("id"), "sketch")
    near = pairs.join(sk.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), "a").join(sk.select(F.col("id").alias("b"), F.col("sketch").alias("sb")), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, SKETCH)
    near = near.withColumn("u", union).filter(F.size(F.array_intersect(F.array_intersect("u", "sa"), "sb")) >= F.lit(SHARE) * F.size("u")).select("a", "b")
    both = near.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")

    # in the JVM, a row at a time: sets of very long texts would make large Arrow batches
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(common * 100 >= F.lit(percent) * (F.size("x") + F.size("y") - common)).select("a", "b")


def shared_values(values: DataFrame) -> DataFrame:
    """values (id, v) -> id, v, df of the values that others have too."""
    return values.join(values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "v")


def candidates(reps: DataFrame) -> DataFrame:
    """id of the classes that share enough of their sketch with others to have a link at all."""
    shared = shared_values(reps.select("id", F.explode("sketch").alias("v"))).groupBy("id").agg(F.count(F.lit(1)).alias("shared"))
    least = F.greatest(F.lit(1), F.floor(F.lit(SHARE) * F.size("sketch")))
    return shared.join(reps.select("id", "sketch"), "id").filter(F.col("shared") >= least).select("id")


def inverted_lists(sets: DataFrame, percent: int) -> DataFrame:
    """v, id, n, p: each candidate in the inverted lists of its prefix, with the place of v among its values.

    A set's values are ordered from the rarest on, those of no one else first. A linked
    set has at least percent of them in common with the other, so one of the first
    n - ceil(percent n) + 1. Lists of equal members propose equal pairs: the first in
    that order stays.
    """
    own = shared_values(sets.select("id", F.explode("set").alias("v"))).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("own"))  # as many as a text's values at most
    own = own.join(sets.select("id", F.size("set").alias("n")), "id").withColumn("u", F.col("n") - F.size("own"))
    prefix = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - F.col("u")).cast("int")
    lists = own.filter(prefix > 0).select("id", "n", "u", F.posexplode(F.slice("own", 1, prefix)).alias("at", "x")).select("x.df", "x.v", "id", "n", (F.col("u") + F.col("at")).alias("p"))
    by = lists.groupBy("df", "v").agg(F.min("n").alias("nm"), F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("s1"), F.bit_xor(F.xxhash64("id", F.lit(2))).alias("s2")).filter("k > 1")
    first = by.groupBy("k", "s1", "s2").agg(F.min(F.struct("df", "v")).alias("x"), F.min("nm").alias("nm"))
    # no member of the list reaches a link with more values behind it
    smallest = F.greatest(F.col("nm"), F.col("n") * percent / 100)
    return lists.join(first.select("x.v", "nm"), "v").filter((F.col("n") - F.col("p")) * (100 + percent) >= percent * (F.col("n") + smallest)).select("v", "id", "n", "p")


def possible(percent: int) -> Column:
    """Whether a pair whose first common value is the list's can be linked: it has no more in common than what follows."""
    most = F.least(F.col("n") - F.col("p"), F.col("on") - F.col("op"))
    return most * (100 + percent) >= percent * (F.col("n") + F.col("on"))


def links(docs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """node, component of the classes (id) that are linked to others."""
    sets = stage(set_table(docs, candidates(reps)), "neardup-sets")
    lists = stage(inverted_lists(sets, percent), "neardup-lists")
    spark = docs.sparkSession
    edges = spark.createDataFrame([], "a long, b long")
    comp = spark.createDataFrame([], "node long, component long")
    turn = 0
    while True:
        now = lists.join(comp, F.col("id") == F.col("node"), "left").select("v", "id", "n", "p", F.coalesce("component", "id").alias("c"))
        by = now.groupBy("v", "c").agg(F.count(F.lit(1)).alias("k"))
        open_ = by.groupBy("v").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.sum("k").alias("all"), F.max("k").alias("most"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
        now = stage(now.join(open_, "v").select("v", "id", "n", "p", "c", "main", "all", "most"), "neardup-open")
        rows, work = now.agg(F.count(F.lit(1)), F.sum(F.col("all") - F.col("most"))).first()
        if not rows:
            break
        last = turn > 0 and work <= REST * rows
        outside = now.filter("c <> main")
        if not last:
            # one pivot a list, outside the largest component: the one with the fewest rarer values
            pivots = outside.groupBy("v").agg(F.min_by(F.struct("id", "n", "p", "c"), F.struct("p", "id")).alias("x")).select("v", "x.*")
            if turn >= PIVOTS:
                times = MORE ** (turn - PIVOTS + 1)
                some = outside.filter(F.pmod(F.xxhash64("id", F.lit(turn)), F.greatest(F.lit(1), F.floor((F.col("all") - F.col("most")) / times))) == 0)
                pivots = pivots.unionByName(some.select("v", "id", "n", "p", "c")).distinct()
            outside = pivots
        o = outside.select("v", F.col("id").alias("o"), F.col("n").alias("on"), F.col("p").alias("op"), F.col("c").alias("oc"))
        met = now.join(o, "v").filter((F.col("c") != F.col("oc")) & possible(percent))
        met = met.select(F.least("id", "o").alias("a"), F.greatest("id", "o").alias("b")).distinct()
        edges = stage(verify(met, reps, sets, percent).unionByName(edges), "neardup-links")
        comp = components(edges)
        if last:
            break
        turn += 1
        # a pivot has met all of its list; lists in one component stay so
        lists = now.join(o.select("v", F.col("o").alias("id")), ["v", "id"], "left_anti").select("v", "id", "n", "p")
    return comp


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest id reachable), kept (it is its own).

    Documents of equal sets are one class, whose smallest id stands for it in links. A
    document without words is linked with nothing. A null id takes the component of its
    class (null if all its ids are null) and is kept only then. Rows of one id are one
    document. An empty table gives no rows; other columns are ignored.
    """
    slim = stage(sketches(docs), "neardup-sketches")
    reps = slim.filter("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("id"), F.min_by("sketch", "doc_id").alias("sketch"))
    reps = stage(reps, "neardup-classes")
    comp = links(docs, reps, percent)
    of = reps.join(comp, F.col("id") == F.col("node"), "left").select("d1", "d2", "n", F.coalesce("component", "id").alias("c"))
    out = slim.select("doc_id", "n", "d1", "d2").join(of, ["d1", "d2", "n"], "left")
    out = out.withColumn("component_id", F.when(F.col("n") > 0, F.col("c")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The documents less all but one of each group; same columns.

    The one of the smallest id stays, with all rows of that id. Rows without an id, documents without words and null
    texts stay. An empty table stays empty.
    """
    gone = near_duplicates(docs, percent).filter(~F.col("kept")).select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs["doc_id"] == F.col("__gone"), "left_anti")
