"""LM scoring: an interpolated modified Kneser-Ney bigram model.

Tokens are a text's words with A-Z lower-cased, then one end token; a start token
is context only. Three steps over the corpus, each a shuffle of packed arrays:
1. distinct words with counts, by ranges of their 64-bit hash; a word's number is
   its rank among all hashes;
2. distinct bigrams with counts, by ranges of the hash of both numbers (a bijection,
   so no two bigrams share it);
3. by ranges of word numbers: of each word, how many words precede it and, as a
   context, its total and how many words follow it once, twice or oftener.
Tasks sum what they have seen before they send it, and no step puts all rows of a
word in one task: contexts are summed from parts.

The model is sorted hash arrays and count arrays in files of the shared folder, a
file each range. Workers map the files into memory and look up a batch's sorted
distinct hashes range by range, so pages are read in order and shared by all
workers of a machine. Where the folder is not a local or mounted one, a worker maps
a copy that is unlinked at once.

p(w|v) = max(c(vw) - D2(c), 0) / c(v.) + g(v) p(w)      g: the mass that D2 takes from v
p(w)   = max(a(w) - D1(a), 0) / A + g / (V + 1)         a(w): words seen before w, A: their sum
A context never seen gives p(w); a word never seen gives the last term alone.
Discounts follow from the counts of counts; where these are zero or out of range,
0.5, 1 and 1.5.

Defined results. A null or empty text has the end token alone. Without training
documents every token has the probability of an unseen one. Repeated rows count as
often as they come. A null doc_id is held out. Texts are read whole. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import byte_slices, filesystem, give_back, mix64, new_folder, released, words_of

#: Buckets for each shuffle partition; one is held in memory at a time.
SPREAD = 2
#: Numbers of words in a range of the last step.
RANGE = 1 << 18
_END = xxhash.xxh64_intdigest(b"\n", 0)  # no word has a line feed
_BLOB = "bucket int, ids binary, n binary, big binary"


def _range_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """The range of a 64-bit hash; grows with it."""
    return ((key >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def unmix64(x: np.ndarray) -> np.ndarray:
    """The inverse of mix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= (x >> np.uint64(31)) ^ (x >> np.uint64(62))
    x *= np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x ^= (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x *= np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    x ^= (x >> np.uint64(30)) ^ (x >> np.uint64(60))
    return x


def _sent(key: np.ndarray, count: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Sorted keys with counts as a row a range: counts in a byte each, those over 254 apart."""
    cut = np.searchsorted(_range_of(key, buckets), np.arange(buckets + 1))
    rows = [(b, key[i:j].astype("<u8").tobytes(), np.minimum(count[i:j], 255).astype(np.uint8).tobytes(), count[i:j][count[i:j] > 254].astype("<i8").tobytes()) for b, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if i < j]
    if rows:
        cols = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["bucket", "ids", "n", "big"])


def _summed(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(first) else count


def _met(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = [], []
    for ids, n, big in zip(*(table[c].to_pylist() for c in ("ids", "n", "big")), strict=True):
        keys.append(np.frombuffer(ids, "<u8"))
        c = np.frombuffer(n, np.uint8).astype(np.int64 if big else np.int32)
        if big:
            c[c == 255] = np.frombuffer(big, "<i8")
        counts.append(c)
    give_back()
    return _summed(np.concatenate(keys), np.concatenate(counts))


def _put(folder: str, arrays: list[np.ndarray]) -> str:
    """Write arrays to files that no other attempt writes; their name."""
    fs, where = filesystem(folder)
    fs.create_dir(where, recursive=True)
    name = uuid.uuid4().hex
    for i, a in enumerate(arrays):
        with fs.open_output_stream(f"{where}/{name}.{i}") as out:
            out.write(np.ascontiguousarray(a).tobytes())
    return name


def _mapped(folder: str, name: str, i: int, dtype: str, n: int) -> np.ndarray:
    """An array of a file, mapped into memory."""
    if not n:
        return np.empty(0, dtype)
    fs, where = filesystem(folder)
    path = f"{where}/{name}.{i}"
    if fs.type_name == "local":
        return np.memmap(path, dtype, "r", shape=(n,))
    with tempfile.NamedTemporaryFile() as copy, fs.open_input_stream(path) as source:
        while data := source.read(1 << 24):
            copy.write(data)
        copy.flush()
        return np.memmap(copy.name, dtype, "r", shape=(n,))


class Model(NamedTuple):
    """Where the arrays are, and the totals."""

    folder: str
    buckets: int
    words: tuple[tuple[int, str, int], ...]  # (range, file, words)
    pairs: tuple[tuple[int, str, int], ...]
    contexts: tuple[tuple[int, str, int], ...]
    tokens: int
    vocabulary: int
    d1: tuple[float, float, float]
    d2: tuple[float, float, float]
    types: int
    left: float  # mass of the unigrams that goes to all words alike


class _Open:
    """A model's arrays as a worker sees them."""

    def __init__(self, m: Model):
        self.m = m
        size = np.zeros(m.buckets + 1, np.int64)
        for b, _, n in m.words:
            size[b + 1] = n
        self.base = np.cumsum(size)  # number of the first word of each range
        self.words = {b: (_mapped(m.folder, f, 0, "<u8", n), _mapped(m.folder, f, 1, "<i8", n)) for b, f, n in m.words}
        self.pairs = {b: (_mapped(m.folder, f[1:], 0, "<u8", n), _mapped(m.folder, f[1:], 1, "<u8" if f[0] == "w" else "<u4", n)) for b, f, n in m.pairs}
        self.contexts = {b: np.reshape(_mapped(m.folder, f, 0, "<i8", 5 * n), (n, 5)) for b, f, n in m.contexts}

    def _look(self, shards: dict, key: np.ndarray, ranks: bool) -> np.ndarray:
        """For sorted keys: the value that stands beside each, or its number; 0 or -1 if absent."""
        out = np.full(len(key), -1 if ranks else 0, np.int64)
        cut = np.searchsorted(_range_of(key, self.m.buckets), np.arange(self.m.buckets + 1))
        for b, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if i < j and b in shards:
                keys, values = shards[b]
                at = np.searchsorted(keys, key[i:j])
                at[at == len(keys)] = 0
                there = keys[at] == key[i:j]
                out[i:j][there] = (self.base[b] + at[there]) if ranks else values[at[there]]
        return out

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words from 1 on by their hashes; 0 for one never seen in training."""
        order = np.argsort(hashes)
        out = np.empty(len(hashes), np.int64)
        out[order] = self._look(self.words, hashes[order], True) + 1
        return out

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        """Counts of words by number; 0 for number 0."""
        out = np.zeros(len(numbers), np.int64)
        of = np.searchsorted(self.base, numbers - 1, side="right") - 1
        for b in np.unique(of[numbers > 0]):
            here = (of == b) & (numbers > 0)
            out[here] = self.words[b][1][numbers[here] - 1 - self.base[b]]
        return out

    def context(self, numbers: np.ndarray) -> np.ndarray:
        """(words before it, total, followers seen once, twice, oftener) of each number."""
        out = np.zeros((len(numbers), 5), np.int64)
        of = numbers // RANGE
        for b in np.unique(of):
            if b in self.contexts:
                here = of == b
                out[here] = self.contexts[b][numbers[here] - b * RANGE]
        return out


_opened: dict[str, _Open] = {}


def _open(m: Model) -> _Open:
    if m.folder not in _opened:
        _opened.clear()
        _opened[m.folder] = _Open(m)
    return _opened[m.folder]


START = 0xFFFFFFFF  # the number of the start token; no word has it


def _hashes(vocabulary: list[bytes]) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w, 0) for w in vocabulary), np.uint64, len(vocabulary))


def _sequence(words, number: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number before, number) of every token, ends included, in order."""
    n = len(words.count)
    size = words.count + 1
    stop = np.cumsum(size)
    current = np.full(int(stop[-1]) if n else 0, end, np.int64)
    row = np.repeat(np.arange(n), size)
    inner = np.ones(len(current), bool)
    inner[stop - 1] = False
    current[inner] = number[words.code]
    before = np.concatenate([[START], current[:-1]])
    before[stop - size] = START
    return row, before, current


def discounts(counts: list[int]) -> tuple[float, float, float]:
    """The three discounts from how many n-grams have count 1, 2, 3 and 4."""
    n1, n2, n3, n4 = counts
    if min(n1, n2, n3, n4) > 0:
        y = n1 / (n1 + 2 * n2)
        d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        if all(0 <= x <= k + 1 for k, x in enumerate(d)):
            return d
    return 0.5, 1.0, 1.5


def train(docs: DataFrame, buckets: int) -> Model:
    """The model of all texts of docs."""
    spark = docs.sparkSession
    folder = new_folder(spark, "lm")
    texts = docs.select("text")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches):
            words = words_of(b.column("text"), lower=True)
            key = np.append(_hashes(words.vocabulary), np.uint64(_END))
            yield from _sent(*_summed(key, np.append(np.bincount(words.code, minlength=len(words.vocabulary)), b.num_rows)), buckets)

    def rank(table: pa.Table) -> pa.Table:
        key, count = _met(table)
        return pa.table({"bucket": pa.array([table["bucket"][0].as_py()], pa.int32()), "file": [_put(folder, [key.astype("<u8"), count.astype("<i8")])], "n": [len(key)], "tokens": [int(count.sum())]})

    found = texts.mapInArrow(seen, _BLOB).groupBy("bucket").applyInArrow(rank, "bucket int, file string, n bigint, tokens bigint").collect()  # a row a range
    released(spark)
    words = tuple(sorted((r.bucket, r.file, r.n) for r in found))
    tokens, vocabulary = sum(r.tokens for r in found), sum(r.n for r in found)
    if vocabulary >= START:
        raise ValueError(f"{vocabulary} words are more than have numbers of 32 bits")
    part = Model(folder, buckets, words, (), (), tokens, vocabulary, (0, 0, 0), (0, 0, 0), 0, 1.0)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _Open(part)
        end = int(model.numbers(np.array([_END], np.uint64))[0])
        for b in byte_slices(batches):
            w = words_of(b.column("text"), lower=True)
            _, before, current = _sequence(w, model.numbers(_hashes(w.vocabulary)), end)
            key, count = np.unique(mix64((before.astype(np.uint64) << np.uint64(32)) | current.astype(np.uint64)), return_counts=True)
            yield from _sent(key, count, buckets)

    def count(table: pa.Table) -> pa.Table:
        key, n = _met(table)
        both = unmix64(key)
        before, current = (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
        rows = []
        # what each word follows, and as a context its total and its followers seen once, twice, oftener; the start
        # token's row is that of number 0, which is no context else
        one = np.ones(len(n), np.int64)
        for kind, ids, values in ((0, current, [one]), (1, np.where(before == START, 0, before), [n, n == 1, n == 2, n > 2])):
            o = np.argsort(ids, kind="stable")
            kinds = ids[o]
            first = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1]]))
            sums = np.column_stack([np.add.reduceat(x[o].astype(np.int64), first) for x in values])
            kinds = kinds[first]
            width = "<u4" if sums.max() < 1 << 32 else "<u8"
            cut = np.flatnonzero(np.diff(kinds // RANGE, prepend=-1))
            for i, j in zip(cut, np.append(cut, len(kinds))[1:], strict=True):
                rows.append((int(kinds[i] // RANGE), kind, kinds[i:j].astype("<u4").tobytes(), sums[i:j].astype(width).tobytes()))
        most = [int((n == k).sum()) for k in (1, 2, 3, 4)]
        wide = n.max() >= 1 << 32
        name = ("w" if wide else "n") + _put(folder, [key.astype("<u8"), n.astype("<u8" if wide else "<u4")])
        b = table["bucket"][0].as_py()
        return pa.table({
            "part": pa.array([-1, *(r[0] for r in rows)], pa.int32()), "kind": pa.array([0, *(r[1] for r in rows)], pa.int32()), "ids": pa.array([b"", *(r[2] for r in rows)], pa.binary()), "sums": pa.array([b"", *(r[3] for r in rows)], pa.binary()),
            "bucket": pa.array([b] * (len(rows) + 1), pa.int32()), "file": [name] * (len(rows) + 1), "n": [len(key)] * (len(rows) + 1), "most": pa.array([most] * (len(rows) + 1), pa.list_(pa.int64())),
        })

    parts = texts.mapInArrow(pairs, _BLOB).groupBy("bucket").applyInArrow(count, "part int, kind int, ids binary, sums binary, bucket int, file string, n bigint, most array<bigint>")
    parts.write.parquet(f"{folder}-parts")
    parts = spark.read.schema(parts.schema).parquet(f"{folder}-parts")
    released(spark)
    heads = parts.where("part = -1").select("bucket", "file", "n", "most").collect()  # a row a range

    def gather(table: pa.Table) -> pa.Table:
        b = table["part"][0].as_py()
        dense = np.zeros((min(RANGE, vocabulary + 1 - b * RANGE), 5), np.int64)
        for kind, ids, sums in zip(*(table[c].to_pylist() for c in ("kind", "ids", "sums")), strict=True):
            at = np.frombuffer(ids, "<u4").astype(np.int64) - b * RANGE
            columns = slice(1, 5) if kind else slice(0, 1)
            wide = len(sums) // len(at) // (4 if kind else 1) == 8
            dense[at, columns] += np.frombuffer(sums, "<u8" if wide else "<u4").reshape(len(at), -1).astype(np.int64)
        give_back()
        most = [int((dense[:, 0] == k).sum()) for k in (1, 2, 3, 4)] + [int((dense[:, 0] > 2).sum())]
        return pa.table({"part": [b], "file": [_put(folder, [dense.astype("<i8")])], "n": [len(dense)], "most": pa.array([most], pa.list_(pa.int64()))})

    tails = parts.where("part >= 0").select("part", "kind", "ids", "sums").groupBy("part").applyInArrow(gather, "part bigint, file string, n bigint, most array<bigint>").collect()  # a row a range
    released(spark)
    total = lambda rows, k: sum(r.most[k] for r in rows)
    d1 = discounts([total(tails, k) for k in range(4)])
    d2 = discounts([total(heads, k) for k in range(4)])
    types = sum(r.n for r in heads)
    left = (d1[0] * total(tails, 0) + d1[1] * total(tails, 1) + d1[2] * total(tails, 4)) / types if types else 1.0
    return part._replace(pairs=tuple(sorted((r.bucket, r.file, r.n) for r in heads)), contexts=tuple(sorted((int(r.part), r.file, r.n) for r in tails)), d1=d1, d2=d2, types=types, left=left)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _open(model)
        v1 = model.vocabulary + 1
        d1, d2 = np.array([0.0, *model.d1]), np.array([0.0, *model.d2])
        end = int(m.numbers(np.array([_END], np.uint64))[0])
        for b in byte_slices(batches):
            w = words_of(b.column("text"), lower=True)
            row, before, current = _sequence(w, m.numbers(_hashes(w.vocabulary)), end)
            kinds, at = np.unique(current, return_inverse=True)
            seen = m.counts(kinds)
            a = np.where(kinds > 0, m.context(kinds)[:, 0], 0)
            base = np.log10((seen + 0.1) / (model.tokens + 0.1 * v1))
            p1 = np.where(a > 0, (a - d1[np.minimum(a, 3)]) / max(1, model.types), 0) + model.left / v1
            keys, of = np.unique(mix64((before.astype(np.uint64) << np.uint64(32)) | current.astype(np.uint64)), return_inverse=True)
            c = m._look(m.pairs, keys, False)[of]
            contexts, place = np.unique(before, return_inverse=True)
            known = contexts != 0  # number 0 is the start token in the arrays and an unseen word here
            ctx = m.context(np.where(contexts == START, 0, contexts)) * known[:, None]
            total = ctx[:, 1]
            mass = np.where(total > 0, (ctx[:, 2:] @ d2[1:]) / np.maximum(1, total), 1.0)
            p = np.where(c > 0, (c - d2[np.minimum(c, 3)]) / np.maximum(1, total)[place], 0) + mass[place] * p1[at]
            n = b.num_rows
            add = lambda x: np.bincount(row, weights=x, minlength=n)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(w.count + 1), pa.array(add(seen[at] > 0).astype(np.int64)), pa.array(np.full(n, model.tokens, np.int64)), pa.array(add(base[at])), pa.array(add(np.log10(p)))],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def held_out(doc_id: Column) -> Column:
    """A tenth of all documents, by the checksum of their id as text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 10 == 0


def score_held_out(docs: DataFrame) -> DataFrame:
    """Scores of all documents by a model of those that are not held out."""
    buckets = SPREAD * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    model = train(docs.where(~held_out(F.col("doc_id"))), buckets)
    got = score(docs, model)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
