"""Token ids in Arrow files of equal-length sequences.

A part of the output is two Arrow IPC files in the shared folder: `tokens`, whose
record batches hold fixed-size lists (input_ids and mask, so sequence i of a file
lies at a known place and a memory map gives it without a copy), and `docs`, which
says where each document's ids begin. The documents follow one another in
ascending order of id through the sequences and parts; only the last sequence of
a part is padded, and its mask says where.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import shared_path, ship, stage

LENGTH = 2048
#: Sequences in a record batch.
ROWS = 256
#: Entries of a worker's cache of piece ids; it is emptied when full.
CACHE = 1_000_000
LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ff"
#: How a tokenizer with RULES cuts a lower-case text of ASCII and Latin-1 letters.
PIECE = re.compile(rf"[{LETTERS}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\x09-\x0d\x20{LETTERS}0-9]+")
#: Anything else, and what may begin a special token.
ODD = re.compile("[^\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]|<\\|")
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
END = "</w>"
#: Leads words that go to the tokenizer; no piece has such a character.
MARK = "\uffff"


class Encoder:
    """Encodes whole texts as the tokenizer does, remembering the ids of pieces.

    If the tokenizer cuts a text by RULES before it merges, the ids of a text are those
    of its pieces. Texts of ASCII and Latin-1 letters are cut here; of others, the
    blank-separated words that have other characters (or might be special tokens) go
    to the tokenizer as they are. Any other tokenizer gets whole texts.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2") if max(vocabulary.values(), default=0) < 1 << 16 else np.dtype("<u4")
        own = json.loads(self.tokenizer.to_str())
        self.cuts = all(own[k] == v for k, v in RULES.items()) and own["model"].get("end_of_word_suffix") == END
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(END)]] = True
        self.pieces: dict[str, bytes] = {}

    def direct(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: list[str]) -> None:
        """Encodes pieces as one text: each ends with its only end-of-word token."""
        for at in range(0, len(new), 50_000):
            some = new[at : at + 50_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(some) and (not len(ids) or ends[-1] == len(ids)):
                data, size = ids.tobytes(), self.dtype.itemsize
                cuts = [0, *(ends * size).tolist()]
                self.pieces.update((p, data[cuts[k] : cuts[k + 1]]) for k, p in enumerate(some))
            else:
                self.pieces.update(zip(some, self.direct(some), strict=True))

    def cut(self, text: str) -> list[str]:
        if not ODD.search(text):
            return PIECE.findall(text.lower())
        out = []
        for word in text.replace("\n", " ").split(" "):
            out += [MARK + word] if ODD.search(word) else PIECE.findall(word.lower())
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian bytes."""
        if not self.cuts:
            return self.direct(texts)
        cut = [self.cut(t) for t in texts]
        need = set().union(*cut)
        new = need.difference(self.pieces)
        if new:
            if len(self.pieces) + len(new) > CACHE:
                self.pieces.clear()
                new = need
            odd = [p for p in new if p[0] == MARK]
            self.learn([p for p in new if p[0] != MARK])
            self.pieces.update(zip(odd, self.direct([p[1:] for p in odd]), strict=True))
        of = self.pieces.__getitem__
        return [b"".join(map(of, c)) for c in cut]


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def chunks(column: pa.Array, limit: int = 1 << 20) -> Iterator[list[str]]:
    """Texts of about so many bytes at a time; a null is empty."""
    out, size = [], 0
    for x in pc.fill_null(column, ""):
        out.append(x.as_py())
        size += len(out[-1])
        if size >= limit:
            yield out
            out, size = [], 0
    if out:
        yield out


class Writer:
    """One part: a stream of ids cut into sequences of equal length."""

    def __init__(self, fs: pafs.FileSystem, path: str, dtype: np.dtype, length: int) -> None:
        self.length, self.dtype = length, dtype
        self.ids = pa.list_(pa.from_numpy_dtype(dtype), length)
        self.mask = pa.list_(pa.bool_(), length)
        self.schema = pa.schema([("input_ids", self.ids), ("mask", self.mask)])
        self.sink = fs.open_output_stream(path)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.waiting: list[bytes] = []
        self.size = 0

    def add(self, ids: bytes) -> None:
        self.waiting.append(ids)
        self.size += len(ids) // self.dtype.itemsize
        if self.size >= ROWS * self.length:
            self.flush(False)

    def flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), self.dtype)
        full = len(ids) // self.length * self.length
        self.waiting = [ids[full:].tobytes()]
        self.size = len(ids) - full
        valid = np.ones(full, bool)
        ids = ids[:full]
        if last and self.size:
            pad = self.length - self.size
            ids = np.concatenate([ids, np.frombuffer(self.waiting[0], self.dtype), np.zeros(pad, self.dtype)])
            valid = np.concatenate([valid, np.ones(self.size, bool), np.zeros(pad, bool)])
        step = ROWS * self.length
        for at in range(0, len(ids), step):
            arrays = [pa.FixedSizeListArray.from_arrays(pa.array(v[at : at + step]), type=t) for v, t in ((ids, self.ids), (valid, self.mask))]
            self.file.write_batch(pa.record_batch(arrays, schema=self.schema))

    def close(self) -> None:
        self.flush(True)
        self.file.close()
        self.sink.close()


def open_file(uri: str) -> pa.ipc.RecordBatchFileReader:
    """A memory map where the file is local, else a file of its store."""
    fs, path = pafs.FileSystem.from_uri(uri)
    return pa.ipc.open_file(pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path))


class TokenFile:
    """Random access to the sequences of a tokens file, without copies where it is memory-mapped."""

    def __init__(self, uri: str) -> None:
        self.file = open_file(uri)
        self.batches = [self.file.get_batch(i) for i in range(self.file.num_record_batches)]
        self.starts = np.cumsum([0, *[b.num_rows for b in self.batches]])

    def __len__(self) -> int:
        return int(self.starts[-1])

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """ids as a view into the file, and the mask."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        b = int(np.searchsorted(self.starts, i, "right")) - 1
        ids, mask = self.batches[b].columns
        n, at = ids.type.list_size, (i - int(self.starts[b])) * ids.type.list_size
        return ids.values.to_numpy(zero_copy_only=True)[at : at + n], mask.values.slice(at, n)

    def ids(self) -> np.ndarray:
        """All ids of the file, without the padding."""
        if not self.batches:
            return np.zeros(0, np.uint16)
        last = self.batches[-1].column("mask").values
        pad = len(last) - int(pc.sum(last).as_py() or 0)
        out = np.concatenate([b.column("input_ids").values.to_numpy(zero_copy_only=True) for b in self.batches])
        return out[: len(out) - pad]


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1, length: int = LENGTH) -> DataFrame:
    """Encodes and writes all documents; a row for each part: part, uri of tokens and docs, n_tokens, n_docs.

    One exchange, by ranges of doc_id; equal ids are told apart by a hash of their text.
    A repeated attempt of a task writes other files; only the rows returned name files.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        fs, base = pafs.FileSystem.from_uri(path)
        fs.create_dir(base, recursive=True)
        stem = f"part-{part:06d}-{attempt}"
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        out = index = where = schema = None
        n = n_docs = 0
        for batch in batches:
            at = 0
            for texts in chunks(batch.column("text")):
                if out is None:
                    out = Writer(fs, f"{base}/{stem}.tokens.arrow", enc.dtype, length)
                    where = fs.open_output_stream(f"{base}/{stem}.docs.arrow")
                    schema = pa.schema([("doc_id", batch.schema.field("doc_id").type), ("offset", pa.int64()), ("n_tokens", pa.int64())])
                    index = pa.ipc.new_file(where, schema)
                sizes = []
                for ids in enc.encode(texts):
                    out.add(ids + end)
                    sizes.append(len(ids) // enc.dtype.itemsize + 1)
                sizes = np.array(sizes, np.int64)
                offsets = n + np.concatenate([[0], np.cumsum(sizes)[:-1]])
                index.write_batch(pa.record_batch([batch.column("doc_id").slice(at, len(texts)), pa.array(offsets), pa.array(sizes)], schema=schema))
                n += int(sizes.sum())
                n_docs += len(texts)
                at += len(texts)
        if out is not None:
            out.close()
            index.close()
            where.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "tokens": [f"{path}/{stem}.tokens.arrow"], "docs": [f"{path}/{stem}.docs.arrow"], "n_tokens": [n], "n_docs": [n_docs]})

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(dealt.mapInArrow(run, "part long, tokens string, docs string, n_tokens long, n_docs long"), "token-parts")


def read_back(parts: DataFrame, id_field: StructField) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = stage(parts.select("tokens", "docs", F.coalesce(before, F.lit(0)).alias("before")), "token-files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for tokens, docs, before in zip(*(c.to_pylist() for c in x.columns), strict=True):
                ids = TokenFile(tokens).ids()
                index = open_file(docs)
                for i in range(index.num_record_batches):
                    b = index.get_batch(i)
                    offset, n = b.column("offset").to_numpy(), b.column("n_tokens").to_numpy()
                    crc = [zlib.crc32(ids[s : s + k].astype("<u4")) for s, k in zip(offset.tolist(), n.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(before + offset), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    schema = StructType([id_field, *[StructField(c, LongType()) for c in ("start", "n_tokens", "ids_crc32")]])
    return files.repartition(max(1, files.count())).mapInArrow(run, schema)


def encode_all(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = LENGTH) -> DataFrame:
    """Writes all documents as token files in the shared folder and returns the digest of what is read back.

    Null text is an empty text: it has the end id alone. Null ids come first. Documents
    of equal id follow one another by a hash of their text; an empty table gives no files
    and no rows. Other columns are ignored.
    """
    parts = write(docs, tokenizer, shared_path(docs.sparkSession, "tokens"), end_id, length)
    return read_back(parts, docs.schema["doc_id"])
