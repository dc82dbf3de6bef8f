"""Token-ID output: shards of token ids, each document compressed alone with one shared
zstandard dictionary.

Shard file, all numbers little-endian:

    frames          one zstandard frame per document: its ids as unsigned 32-bit integers
    index           int64 doc_id, uint64 frame offset, uint64 frame length, uint64 ids; one record per document
    tail            sha256 of the dictionary (32 bytes), uint64 index offset, uint64 documents, magic "CTOK0001"

A reader needs the tail, the index record and one frame to get one document. The dictionary
is stored once, beside the shards, and each tail says by hash which one its frames need.

Defined cases: a null text counts as empty and gets the end id only; rows that repeat a doc_id are
all written, next to each other, by text; a null doc_id is written first and read back as null; an
empty table makes no shard and no rows; the id -2 ** 63 stands for null in the index and is read back as null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cordage.llm.common import new_path, release, staged, trimmed, whole_parts

MAGIC = b"CTOK0001"
RECORD = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u8"), ("ids", "<u8")])
TAIL = "<32sQQ8s"
#: Stands for a null doc_id in an index record.
NO_ID = -(1 << 63)
#: Documents that the dictionary is trained on, at most, and ids of each.
DICT_DOCUMENTS, DICT_IDS, DICT_BYTES = 2000, 2048, 65536
#: Words whose ids a worker keeps, and characters that it encodes at a time.
KEPT_WORDS, STRETCH = 700_000, 1_000_000

_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of whole texts by a tokenizer whose pre-tokens never span white space, as bytes.

    The ids of such a text are those of its white-space separated pieces, one after another,
    so each distinct piece goes through the tokenizer once. A text that may hold a special
    token's string goes through the tokenizer whole.
    """

    # A sentence mark after a letter or digit is a pre-token of its own where the word ends.
    # Printable ASCII without apostrophes falls into pre-tokens of letters, single digits, and others.
    _printable = re.compile(rb"[!-&(-~]+")
    _parts = re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+")
    _single = re.compile(rb"[0-9]|[!-&(-/:-`{-~]+")
    _marked = re.compile(rb"([a-z0-9]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])[.,]+\Z")

    def __init__(self, definition: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_str(definition)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self._ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        for token, i in vocabulary.items():
            self._ends[i] = token.endswith("</w>")
        self._ids: dict[bytes, bytes] = {}
        # What was kept before ``_ids`` was begun anew: words that are met again move over, rare ones go.
        self._older: dict[bytes, bytes] = {}
        # Pre-tokens of printable ASCII are in the form that the model reads already: for those, the model with nothing before it.
        self._bare = Tokenizer(self.tokenizer.model)
        self._bare.pre_tokenizer = WhitespaceSplit()
        probe = "the quick brown fox jumps overly lazily qzx a 7 ... *** #$ @"
        self._same = self._bare.encode(probe, add_special_tokens=False).ids == self.tokenizer.encode(probe, add_special_tokens=False).ids

    @classmethod
    def of(cls, definition: str) -> WordEncoder:
        """One per worker and definition, so that its words serve later tasks too."""
        key = hashlib.sha256(definition.encode()).hexdigest()
        if key not in _encoders:
            _encoders[key] = cls(definition)
        return _encoders[key]

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes]) -> None:
        known, apart = self._ids, {}
        parts = {p for p in pieces if p.isalpha()} if self._same else set()
        for p in pieces:
            if p in parts:
                continue
            if self._same and p[-1] in b".,;:!?)" and p[:-1].isalpha():
                found = [p[:-1], p[-1:]]
            elif self._same and self._printable.fullmatch(p):
                found = self._parts.findall(p)
            elif p[-1] in b".," and self._marked.search(p):
                bare = p.rstrip(b".,")
                found = [bare, p[len(bare) :]]
            else:
                found = [p]
            parts.update(found)
            if len(found) > 1:
                apart[p] = found
        self._learn_parts(list(parts.difference(known)))
        for p, found in apart.items():
            known[p] = b"".join(map(known.__getitem__, found))

    def _learn_parts(self, pieces: list[bytes]) -> None:
        plain, letters, other = [], [], []
        for p in pieces:
            if self._same and (p.isalpha() or self._single.fullmatch(p)):
                plain.append(p)
            else:
                (letters if p.decode().isalpha() else other).append(p)
        for tokenizer, some in ((self._bare, plain), (self.tokenizer, letters)):
            if not some:
                continue
            # Each is one pre-token, whose last id alone ends a word.
            joined = np.asarray(tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self._ends[joined]) + 1) * 4
            if len(ends) == len(some):
                raw, start = joined.tobytes(), 0
                for p, end in zip(some, ends.tolist(), strict=True):
                    self._ids[p] = raw[start:end]
                    start = end
            else:
                other += some
        if other:
            self._ids.update(zip(other, self._plain([p.decode() for p in other]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        raw = [t.encode("utf-8", "replace") for t in texts]
        split = [None if b"<|" in b else b.lower().split() for b in raw]
        words = list(chain.from_iterable(s for s in split if s))
        found = list(map(self._ids.get, words))
        if missing := [i for i, ids in enumerate(found) if ids is None]:
            new = {words[i] for i in missing}
            if len(self._ids) + len(new) > KEPT_WORDS // 2:
                self._older, self._ids = self._ids, {}
            # The intersection of a set with a dictionary would read the whole dictionary.
            unknown = new.difference(self._older)
            self._ids.update((w, self._older[w]) for w in new.difference(unknown))
            self._learn(list(unknown))
            for i in missing:
                found[i] = self._ids[words[i]]
        out, at = [], 0
        for t, s in zip(texts, split, strict=True):
            out.append(self._plain([t])[0] if s is None else b"".join(found[at : at + len(s)]))
            at += len(s or ())
        return out


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _rows(batch: pa.RecordBatch, most: int) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of the batch, about ``most`` characters at a time."""
    ids, texts, size = [], [], 0
    for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
        ids.append(doc_id.as_py())
        texts.append(text.as_py() or "")
        size += len(texts[-1])
        if size >= most:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _shard_writer(definition, dictionary, folder: str, end_id: int, level: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = WordEncoder.of(definition.value), np.asarray([end_id], "<u4").tobytes()
        raw = dictionary.value
        compressor = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
        out, index, at, total, path = None, [], 0, 0, f"{folder}/shard-{uuid.uuid4().hex}.ctok"
        for batch in batches:
            for ids, texts in _rows(batch, STRETCH):
                frames = []
                for doc_id, body in zip(ids, encoder.encode(texts), strict=True):
                    frame = compressor.compress(body + end)
                    index.append((NO_ID if doc_id is None else doc_id, at, len(frame), len(body) // 4 + 1))
                    frames.append(frame)
                    at += len(frame)
                    total += index[-1][3]
                if out is None:
                    system, place = _filesystem(path)
                    out = system.open_output_stream(place)
                out.write(b"".join(frames))
        if out is not None:
            out.write(np.asarray(index, RECORD).tobytes())
            out.write(struct.pack(TAIL, hashlib.sha256(raw).digest(), at, len(index), MAGIC))
            out.close()
            first, last = index[0][0], index[-1][0]
            yield pa.RecordBatch.from_pylist([{"path": path, "first_id": first, "last_id": last, "documents": len(index), "ids": total}], pa.schema(_MANIFEST))

    return trimmed(write)


_MANIFEST = [("path", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("documents", pa.int64()), ("ids", pa.int64())]


class Shard:
    """One shard, read by document without reading the rest."""

    def __init__(self, path: str, dictionary: bytes):
        system, place = _filesystem(path)
        self._file = system.open_input_file(place)
        size = self._file.size()
        digest, at, count, magic = struct.unpack(TAIL, self._file.read_at(struct.calcsize(TAIL), size - struct.calcsize(TAIL)))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token shard")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} was written with another dictionary")
        self.index = np.frombuffer(self._file.read_at(count * RECORD.itemsize, at), RECORD)
        self._inflate = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def ids(self, row: int) -> np.ndarray:
        r = self.index[row]
        return np.frombuffer(self._inflate.decompress(self._file.read_at(int(r["length"]), int(r["offset"]))), "<u4")

    def document(self, doc_id: int) -> np.ndarray:
        row = np.flatnonzero(self.index["doc_id"] == doc_id)
        if not len(row):
            raise KeyError(doc_id)
        return self.ids(int(row[0]))

    def bodies(self, most: int = 8_000_000) -> Iterator[tuple[int, bytes]]:
        """doc_id and id bytes of every document, read in stretches."""
        start, n = 0, len(self.index)
        while start < n:
            end, a = start + 1, int(self.index["offset"][start])
            while end < n and int(self.index["offset"][end]) - a < most:
                end += 1
            last = self.index[end - 1]
            block = self._file.read_at(int(last["offset"]) + int(last["length"]) - a, a)
            for r in self.index[start:end]:
                o = int(r["offset"]) - a
                yield int(r["doc_id"]), self._inflate.decompress(block[o : o + int(r["length"])])
            start = end


def train_dictionary(spark: SparkSession, docs: DataFrame, definition: str) -> bytes:
    """A zstandard dictionary of at most DICT_BYTES from the first DICT_IDS ids of the DICT_DOCUMENTS
    documents with the least id hash; empty where there is too little to train on."""
    ids = docs.select("doc_id").filter("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(DICT_DOCUMENTS)
    rows = docs.join(F.broadcast(ids), "doc_id").select(F.substring("text", 1, DICT_IDS * 4).alias("text")).orderBy("text").limit(DICT_DOCUMENTS).collect()
    # An encoder of its own, that the driver does not keep.
    samples = [b[: DICT_IDS * 4] for b in WordEncoder(definition).encode([r[0] for r in rows])] if rows else []
    total, trained = sum(map(len, samples)), b""
    if len(samples) >= 16 and total >= 32 * 1024:
        trained = zstandard.train_dictionary(min(DICT_BYTES, total // 8), samples).as_bytes()
    del rows, samples
    release()
    return trained


def write_tokens(spark: SparkSession, docs: DataFrame, definition: str, end_id: int, level: int = 3) -> tuple[DataFrame, bytes]:
    """Shards of ``docs`` (doc_id, text) in ascending doc_id order. Returns the manifest, one row per shard
    with the number of ids before it, and the dictionary.

    Texts move once, dealt by ranges of doc_id. A task writes a file of its own name and returns that
    name; what a lost task wrote is in no manifest.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    folder = new_path(spark, "tokens")
    dictionary = train_dictionary(spark, docs, definition)
    system, place = _filesystem(folder)
    system.create_dir(place, recursive=True)
    with system.open_output_stream(f"{place}/{hashlib.sha256(dictionary).hexdigest()}.zdict") as f:
        f.write(dictionary)
    context = spark.sparkContext
    ordered = docs.repartitionByRange(whole_parts(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    write = _shard_writer(context.broadcast(definition), context.broadcast(dictionary), folder, end_id, level)
    manifest = staged(ordered.mapInArrow(write, "path string, first_id long, last_id long, documents long, ids long"), "manifest")
    # One row per shard, so one task is enough for the running sum.
    before = Window.orderBy("first_id", "last_id", "path").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0))), dictionary


def _shard_reader(dictionary):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start, out = row["start"], []
                for doc_id, body in Shard(row["path"], dictionary.value).bodies():
                    out.append({"doc_id": None if doc_id == NO_ID else doc_id, "start": start, "n_tokens": len(body) // 4, "ids_crc32": zlib.crc32(body)})
                    start += len(body) // 4
                    if len(out) == 10_000:
                        yield pa.RecordBatch.from_pylist(out, pa.schema(_READ))
                        out = []
                if out:
                    yield pa.RecordBatch.from_pylist(out, pa.schema(_READ))

    return trimmed(read)


_READ = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]


def read_tokens(spark: SparkSession, manifest: DataFrame, dictionary: bytes) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the shard files."""
    read = _shard_reader(spark.sparkContext.broadcast(dictionary))
    return manifest.select("path", "start").repartition(whole_parts(spark), "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write ``docs`` as token shards and report each document as the files hold it."""
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    return read_tokens(spark, *write_tokens(spark, docs, definition, end_id))
