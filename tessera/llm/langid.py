"""Language identification by hierarchical discrimination.

A linear one-versus-rest classifier picks the language family; within the family
one-versus-one linear support vector machines vote. Features are hashed byte
trigrams and whole words of the lower-cased text, with everything but letters
taken as space. Decisions are sums of weights over the features of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from . import kernel as K
from .common import hash_limit, ship

DIM = 1 << 12
#: Labelled documents of each language that training uses at most, chosen by a hash of the id.
PER_LANGUAGE = 1000
#: Documents that training uses at most in all; with very many languages each has fewer, but MIN_LANGUAGE at least.
SAMPLE, MIN_LANGUAGE = 200_000, 20
#: Other languages of the family or corpus whose documents a decision is fitted on, for each of its own.
AGAINST = 4
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo af fy lb yi",
    "romance": "fr es it pt ro ca gl oc rm la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk tt",
    "semitic": "ar he mt am",
    "indic": "hi bn ur mr ne pa gu si",
    "sinitic": "zh yue wuu",
}
FAMILY = {x: f for f, xs in FAMILIES.items() for x in xs.split()}
PLAIN = np.full(256, 0x20, np.uint8)
PLAIN[97:123] = np.arange(97, 123)
PLAIN[65:91] = np.arange(97, 123)
PLAIN[128:] = np.arange(128, 256)


def family(lang: str) -> str:
    """A language outside the table is a family of its own."""
    base = lang.split("-")[0].split("_")[0].lower()
    return FAMILY.get(base, f"={lang}")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def feature_slices(text: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each slice: feature of each n-gram or word, the text it belongs to, and how many texts there are."""
    lower = pc.utf8_lower(text.cast(pa.large_string()))
    for i, j, data, offsets in K.slices(lower):
        data = PLAIN[data]
        of = K.owners(offsets)
        d = data.astype(np.uint32)
        n = len(d) - 2
        if n > 0:
            ok = np.flatnonzero((d[1:-1] != 0x20) & (of[:n] == of[2:]))
            g = d[ok] | (d[ok + 1] << 8) | (d[ok + 2] << 16)
            g = (g * np.uint32(2654435769)) >> np.uint32(20)
            gram_of = of[ok]
        else:
            g, gram_of = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        starts, ends, bounds = K.words(data, offsets)
        w = (K.spans_hash(K.prefix(data), starts, ends) >> K.U(52)).astype(np.uint32) + np.uint32(DIM)
        yield np.concatenate([g, w]), np.concatenate([gram_of, K.owners(bounds)]), np.int64(j - i)


@dataclass
class Model:
    """weights: a row for each decision; decides: (family or None, label if positive, label if not)."""

    weights: np.ndarray
    decides: list[tuple[str | None, str, str]]
    families: dict[str, list[str]]
    scale: float


@dataclass
class Rows:
    """Sparse rows of unit length: row i has values val[cut[i]:cut[i + 1]] in columns col[...]."""

    col: np.ndarray
    val: np.ndarray
    cut: np.ndarray

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.append(w[self.col] * self.val, 0.0), self.cut[:-1]) * (np.diff(self.cut) > 0)


def svm(x: Rows, use: np.ndarray, y: np.ndarray, cost: float = 4.0, epochs: int = 12) -> np.ndarray:
    """A linear L2-loss support vector machine by dual coordinate descent over the rows in use."""
    rng = np.random.Generator(np.random.PCG64(7))
    a, w = np.zeros(len(y)), np.zeros(2 * DIM, np.float32)
    share = {s: cost * len(y) / (2 * max(1, (y == s).sum())) for s in (1.0, -1.0)}
    own = [(x.col[x.cut[i] : x.cut[i + 1]], x.val[x.cut[i] : x.cut[i + 1]]) for i in use.tolist()]
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            col, val = own[i]
            d = 0.5 / share[y[i]]
            g = y[i] * float(w[col] @ val) - 1 + d * a[i]
            new = max(a[i] - g / (1 + d), 0.0)
            if new != a[i]:
                w[col] += np.float32((new - a[i]) * y[i]) * val
                a[i] = new
    return w


def sample(docs: DataFrame, per_language: int) -> tuple[Rows, list[str]]:
    """Unit feature vectors and languages of the bounded training sample; every language is in it."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    top = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    if not top:
        return Rows(np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(1, np.int64)), []
    per_language = min(per_language, max(MIN_LANGUAGE, SAMPLE // len(top)))
    # the window sees a few times the sample of each language, by the hash that it sorts by, however frequent the language is
    limits = docs.sparkSession.createDataFrame([(x, hash_limit(4 * per_language / n)) for x, n in top.items()], "s_lang string, s_limit long")
    few = known.select("doc_id", "lang").join(limits, F.col("lang") == F.col("s_lang")).filter(F.xxhash64("doc_id") <= F.col("s_limit"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = few.withColumn("rank", rank).filter(F.col("rank") <= per_language)
    ids = ids.select(F.col("doc_id").alias("s_id"), F.col("lang").alias("s_lang"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            out = []
            for g, of, n in feature_slices(x.column("text")):
                order = np.argsort(of, kind="stable")
                cuts = np.searchsorted(of[order], np.arange(n + 1))
                for k in range(n):
                    at, c = np.unique(g[order[cuts[k] : cuts[k + 1]]], return_counts=True)
                    out.append((at.astype(np.uint16).tobytes(), c.astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([x.column("s_lang"), pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary())], ["lang", "at", "c"])

    # at most SAMPLE rows (or MIN_LANGUAGE a language) reach the driver, with 2 * DIM values each at most
    chosen = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("s_id")).select("s_lang", "text")
    rows = chosen.mapInArrow(vectors, "lang string, at binary, c binary").collect()
    rows = sorted((r["lang"], bytes(r["at"]), bytes(r["c"])) for r in rows)
    col, val, cut = [], [], [0]
    for _, at, c in rows:
        v = np.frombuffer(c, np.float32)
        col.append(np.frombuffer(at, np.uint16))
        val.append(v / max(float(np.linalg.norm(v)), 1e-9))
        cut.append(cut[-1] + len(v))
    return Rows(np.concatenate(col).astype(np.int64), np.concatenate(val).astype(np.float32), np.array(cut)), [r[0] for r in rows]


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """None if no document may be learned from."""
    ship(docs.sparkSession)
    x, langs = sample(docs, per_language)
    if not langs:
        return None
    lang = np.array(langs)
    fam = np.array([family(v) for v in langs])
    families = {f: sorted(set(lang[fam == f])) for f in sorted(set(fam))}
    decides, rows, margins = [], [], []
    names = list(families)
    tasks: list[tuple[str | None, str, str, np.ndarray, np.ndarray]] = []
    place = np.arange(len(lang)) * 2654435761 % 2**32 / 2**32
    if len(names) == 2:
        tasks.append((None, names[0], names[1], np.ones(len(lang), bool), fam == names[0]))
    elif len(names) > 2:
        # against so many of the others, evenly chosen, that the work stays in proportion to the sample
        tasks += [(None, f, "", (fam == f) | (place < AGAINST * max(per_language, (fam == f).sum()) / len(lang)), fam == f) for f in names]
    for f, own in families.items():
        tasks += [(f, a, b, (lang == a) | (lang == b), lang == a) for a, b in combinations(own, 2)]
    for f, a, b, use, positive in tasks:
        w = svm(x, np.flatnonzero(use), np.where(positive[use], 1.0, -1.0))
        decides.append((f, a, b))
        rows.append(w)
        margins.append(np.abs(x.dot(w)[use]))
    weights = np.array(rows, np.float32).reshape(len(rows), 2 * DIM)
    typical = float(np.median(np.concatenate(margins))) if margins else 1.0
    return Model(weights, decides, families, 4.0 / max(typical, 1e-6))


def predict(model: Model, text: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text that has letters."""
    labels: list[str] = []
    scores: list[float] = []
    names = list(model.families)
    for g, of, n in feature_slices(text):
        sums = np.array([np.bincount(of, w[g], n) for w in model.weights]).reshape(len(model.weights), n)
        # the length of a count vector lies between the root of its sum and the sum; the root serves for the score only
        sums = sums * model.scale / np.sqrt(np.maximum(np.bincount(of, minlength=n), 1))
        p = 1 / (1 + np.exp(-np.clip(sums, -30, 30)))
        top = [k for k, d in enumerate(model.decides) if d[0] is None]
        if len(names) == 1:
            chosen, sure = np.zeros(n, int), np.ones(n)
        elif len(names) == 2:
            chosen, sure = np.where(sums[top[0]] > 0, 0, 1), np.maximum(p[top[0]], 1 - p[top[0]])
        else:
            chosen, sure = np.argmax(sums[top], axis=0), np.max(p[top], axis=0)
        out, score = np.empty(n, object), np.zeros(n)
        for f, name in enumerate(names):
            at = np.flatnonzero(chosen == f)
            if not len(at):
                continue
            own = model.families[name]
            votes = np.zeros((len(own), len(at)))
            trust = np.zeros((len(own), len(at)))
            for k, (fam, a, b) in enumerate(model.decides):
                if fam == name:
                    i, j = own.index(a), own.index(b)
                    votes[i] += sums[k, at] > 0
                    votes[j] += sums[k, at] <= 0
                    trust[i] += p[k, at]
                    trust[j] += 1 - p[k, at]
            best = np.argmax(votes + 1e-3 * trust, axis=0)
            out[at] = np.array(own, object)[best]
            score[at] = sure[at] * (trust[best, np.arange(len(at))] / max(1, len(own) - 1) if len(own) > 1 else 1.0)
        labels += out.tolist()
        scores += score.tolist()
    return labels, np.array(scores)


def has_letter(text: pa.Array) -> np.ndarray:
    ascii_ = np.asarray(pc.fill_null(pc.match_substring_regex(text, "[A-Za-z]"), False))
    for i in np.flatnonzero(~ascii_):
        s = text[int(i)].as_py()
        ascii_[i] = s is not None and any(c.isalpha() for c in s)
    return ascii_


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score.

    lang_pred is `und` with score 0 where the text is null or has no letter, and
    everywhere if nothing could be learned. A null id is not held out and not learned
    from. Repeated rows get equal results; other columns are ignored.
    """
    model = train(docs, per_language)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            text = x.column("text")
            known = np.array(has_letter(text)) if model else np.zeros(len(text), bool)
            langs, scores = predict(model, pc.fill_null(text, "")) if model else ([""] * len(text), np.zeros(len(text)))
            langs = [v if k else "und" for v, k in zip(langs, known, strict=True)]
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), x.column("held_out"), pa.array(langs, pa.string()), pa.array(np.where(known, scores, 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("held_out", BooleanType()), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(label, schema)
