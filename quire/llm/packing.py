"""Token-ID output: ids bit-packed at the width that the vocabulary needs.

A shard file holds, little-endian: ids in blocks of `block` ids, each id in
`bits` bits from the lowest bit up and each block from a whole byte on; then the
index (block offsets in bytes, document ids with a null mask, document starts in
ids); then a footer of fixed size. Any run of ids is read by the offsets of its
blocks and unpacked by numpy, without what lies before it.

Documents are dealt by ranges of doc_id, so shard i holds smaller ids than shard
i + 1, and sorted within; a task streams its range into a file whose name no other
attempt uses and reports it. Files that are not reported are never read.

Defined results. A null or empty text has the end id alone. Documents are in
ascending doc_id order, nulls first, equal ids by their text. Texts are encoded
whole. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import SLICE_BYTES, byte_slices, filesystem, ragged, whole_id, words_of

MAGIC = b"QTOK0001"
BLOCK_IDS = 4096
_FOOTER = struct.Struct("<IIQQQQ8s")


def width(vocab_size: int) -> int:
    """Bits that the largest id needs."""
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in `bits` bits each, from the lowest bit up, to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    spread = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (spread.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class Writer:
    """Writes a shard to a binary stream; memory holds a block of ids and the index."""

    def __init__(self, out, bits: int, block: int = BLOCK_IDS):
        self.out, self.bits, self.block = out, bits, block
        self.rest = np.empty(0, np.uint32)
        self.offsets, self.at, self.n = [0], 0, 0
        self.docs: list[np.ndarray] = []
        self.null: list[np.ndarray] = []
        self.starts: list[np.ndarray] = []

    def _put(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.out.write(data)
        self.at += len(data)
        self.offsets.append(self.at)

    def add(self, doc_ids: np.ndarray, null: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(doc_ids.astype("<i8"))
        self.null.append(null.astype(np.uint8))
        self.starts.append(self.n + np.cumsum(lengths) - lengths)
        self.n += len(ids)
        ids = np.concatenate([self.rest, ids.astype(np.uint32)])
        whole = len(ids) // self.block * self.block
        for i in range(0, whole, self.block):
            self._put(ids[i : i + self.block])
        self.rest = ids[whole:]

    def close(self) -> int:
        if len(self.rest):
            self._put(self.rest)
        none = np.empty(0, np.int64)
        index = [np.array(self.offsets, "<u8"), np.concatenate([none, *self.docs]).astype("<i8"), np.concatenate([none, *self.null]).astype(np.uint8), np.concatenate([none, *self.starts, [self.n]]).astype("<i8")]
        for x in index:
            self.out.write(x.tobytes())
        self.out.write(_FOOTER.pack(self.bits, self.block, self.n, len(index[1]), len(self.offsets) - 1, self.at, MAGIC))
        return self.n


class Reader:
    """Random access to a shard in a seekable binary stream."""

    def __init__(self, source):
        self.source = source
        source.seek(0, io.SEEK_END)
        end = source.tell() - _FOOTER.size
        source.seek(end)
        self.bits, self.block, self.n, docs, blocks, at, magic = _FOOTER.unpack(source.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        source.seek(at)
        self.offsets = np.frombuffer(source.read(8 * (blocks + 1)), "<u8").astype(np.int64)
        self.docs = np.frombuffer(source.read(8 * docs), "<i8")
        self.null = np.frombuffer(source.read(docs), np.uint8).astype(bool)
        self.starts = np.frombuffer(source.read(8 * (docs + 1)), "<i8")

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids start .. stop - 1 of the shard."""
        if stop <= start:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        self.source.seek(self.offsets[first])
        data = self.source.read(int(self.offsets[last + 1] - self.offsets[first]))
        if self.block * self.bits % 8 == 0:
            got = unpack(data, min(self.n, (last + 1) * self.block) - first * self.block, self.bits)
        else:
            cut = self.offsets[first : last + 2] - self.offsets[first]
            got = np.concatenate([unpack(data[cut[k] : cut[k + 1]], min(self.block, self.n - (first + k) * self.block), self.bits) for k in range(last - first + 1)])
        return got[start - first * self.block : stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


#: Words that surely are one run of letters, then at most one run of marks, after any normaliser.
_SIMPLE = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+([.,;:!?]?)")
#: Simple words that are encoded as one text.
_JOINED = 512


class WordEncoder:
    """Ids of texts by a vocabulary with word ends that drops white space.

    No normaliser or pre-tokeniser of such a vocabulary looks across ASCII white
    space, so a text's ids are those of its words one after another. Each distinct
    word of a slice is looked up once. Unknown words made of letters and a mark are
    encoded many at a time and told apart by their word ends; others one by one.
    Words seen lately are kept in two generations of up to `most` words each.
    """

    def __init__(self, path: str, most: int = 600_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.vocab_size, self.most = self.library.get_vocab_size(), most
        suffix = json.loads(self.library.to_str())["model"]["end_of_word_suffix"]
        self.ends = np.zeros(self.vocab_size + 1, bool)
        for token, i in self.library.get_vocab().items():
            self.ends[i] = token.endswith(suffix)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _learn(self, words: list[bytes]) -> None:
        texts = [w.decode("utf-8", "replace") for w in words]
        simple, parts, other = [], [], []
        for w, text in zip(words, texts, strict=True):
            m = _SIMPLE.fullmatch(text)
            if m:
                simple.append((w, text))
                parts.append(2 if m[1] else 1)
            else:
                other.append((w, text))
        for (w, _), e in zip(other, self.library.encode_batch_fast([x for _, x in other], add_special_tokens=False), strict=True):
            self.young[w] = np.array(e.ids, "<u4").tobytes()
        runs = [simple[i : i + _JOINED] for i in range(0, len(simple), _JOINED)]
        for k, (run, e) in enumerate(zip(runs, self.library.encode_batch_fast([" ".join(x for _, x in r) for r in runs], add_special_tokens=False), strict=True)):
            ids = np.array(e.ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            last = np.cumsum(parts[k * _JOINED : k * _JOINED + len(run)]) - 1
            if len(stops) != last[-1] + 1:
                # the vocabulary reads a word otherwise than taken for granted: each by itself
                for (w, _), one in zip(run, self.library.encode_batch_fast([x for _, x in run], add_special_tokens=False), strict=True):
                    self.young[w] = np.array(one.ids, "<u4").tobytes()
                continue
            raw, at = ids.tobytes(), 0
            for (w, _), stop in zip(run, (4 * stops[last]).tolist(), strict=True):
                self.young[w] = raw[at:stop]
                at = stop

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, ids per text)."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        words = words_of(texts)
        found = list(map(self.young.get, words.vocabulary))
        new = []
        for i, v in enumerate(found):
            if v is None:
                w = words.vocabulary[i]
                if w in self.old:
                    found[i] = self.young[w] = self.old[w]
                else:
                    new.append(i)
        if new:
            self._learn([words.vocabulary[i] for i in new])
            for i in new:
                found[i] = self.young[words.vocabulary[i]]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        pool = np.frombuffer(b"".join(found), "<u4")
        length = size[words.code]
        per = np.bincount(words.row, weights=length, minlength=len(texts)).astype(np.int64)
        return pool[ragged((np.cumsum(size) - size)[words.code], length)], per


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_shards(docs: DataFrame, folder: str, path: str, end_id: int, shards: int, block: int = BLOCK_IDS) -> list[tuple[str, int, int]]:
    """Encode documents (doc_id, text) into shard files under folder; (file, documents, ids) of each shard in doc_id order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = _encoder(path)
        fs, where = filesystem(folder)
        name, out, n_docs = f"{uuid.uuid4().hex}.qtok", None, 0
        for b in byte_slices(batches, limit=2 * SLICE_BYTES):
            if out is None:
                fs.create_dir(where, recursive=True)
                out = fs.open_output_stream(f"{where}/{name}")
                writer = Writer(out, width(max(enc.vocab_size, end_id + 1)), block)
            ids, per = enc.encode(b.column("text"))
            full = np.full(len(ids) + len(per), end_id, np.uint32)
            full[np.arange(len(ids)) + np.repeat(np.arange(len(per)), per)] = ids
            doc = b.column("doc_id")
            null = doc.is_null().to_numpy(zero_copy_only=False)
            writer.add(doc.fill_null(0).to_numpy(zero_copy_only=False), null, per + 1, full)
            n_docs += len(per)
        if out is not None:
            total = writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": [TaskContext.get().partitionId()], "file": [name], "n_docs": [n_docs], "n_ids": [total]})

    rows = docs.select(whole_id().alias("doc_id"), "text")
    dealt = rows.repartitionByRange(shards, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    found = dealt.mapInArrow(run, "shard bigint, file string, n_docs bigint, n_ids bigint").collect()  # a row a file
    return [(x.file, x.n_docs, x.n_ids) for x in sorted(found)]


def read_shards(spark: SparkSession, folder: str, shards: list[tuple[str, int, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from the files; start counts the ids of all documents before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = filesystem(folder)
        for b in batches:
            for name, base in zip(b.column("file").to_pylist(), b.column("base").to_pylist(), strict=True):
                with fs.open_input_file(f"{where}/{name}") as source:
                    r = Reader(source)
                    for k in range(0, len(r.docs), 512):
                        top = min(len(r.docs), k + 512)
                        ids = r.ids(int(r.starts[k]), int(r.starts[top])).astype("<u4")
                        cut = r.starts[k : top + 1] - r.starts[k]
                        crc = [zlib.crc32(ids[cut[i] : cut[i + 1]].tobytes()) for i in range(top - k)]
                        yield pa.RecordBatch.from_arrays([pa.array(r.docs[k:top], mask=r.null[k:top]), pa.array(base + r.starts[k:top]), pa.array(np.diff(r.starts[k : top + 1])), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    base = np.cumsum([0, *(x[2] for x in shards)])
    table = spark.createDataFrame([(i, x[0], int(base[i])) for i, x in enumerate(shards)], "shard int, file string, base bigint")
    return table.repartitionById(max(1, len(shards)), "shard").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
