"""Substring dedup by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of half a window.
A window of `k` words that occurs elsewhere holds a whole block of that other
document, so probing the block index with every rolling half-window finds it.
Hits are extended: all windows around a hit are hashed (80 bits of two
independent hashes, besides those of the bucket), and a window whose words also start in a document with a
smaller doc_id is removed. Overlapping removed windows make up a maximal exact
repeat.

Blocks and probes meet in buckets of a bounded number of words, as packed arrays:
40 bits of the hash (besides those of the bucket), the position in 16 bits, and
ids once for each document. A slice of documents sends one or two documents of
those that share a hash; the others already have their hit within the slice. So
a passage that a third of all documents hold costs a bucket two entries a slice,
not one a document.

Defined results. A null or empty text has no words and loses none. Windows are
judged on the input. Rows with the same doc_id don't take from each other;
repeated rows are judged alike. A row with a null doc_id loses nothing and takes
from nobody. Very long texts are read whole. An empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import byte_slices, filled, mix64, new_folder, ragged, released, removed, whole_id, words_of, written

WINDOW = 50
#: Words that a bucket holds about, and text in a slice.
BUCKET_WORDS = 4_000_000
SLICE = 8 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_KEY_BYTES, _WINDOW_KEY_BYTES = 5, 6
_EXCHANGE = "bucket int, key binary, chk binary, doc binary, id binary, per binary, pos binary, wide boolean"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k values, by the prefix sums of a polynomial modulo 2**64."""
    n = len(values)
    if n < k:
        return np.empty(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _powers(_BASE, n), dtype=np.uint64)])
    return mix64((sums[k:] - sums[:-k]) * _powers(pow(_BASE, -1, 1 << 64), n - k + 1))


def word_hashes(vocabulary: list[bytes], seed: int) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w, seed) for w in vocabulary), np.uint64, len(vocabulary))


def _packed(bucket: np.ndarray, key: np.ndarray, width: int, chk: np.ndarray | None, row: np.ndarray, pos: np.ndarray, doc: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Entries in order of row and pos, as a row of arrays for each bucket."""
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) == 0 or bucket.max() < 1 << 16 else bucket, kind="stable")
    bucket, key, row, pos = bucket[order], key[order], row[order], pos[order]
    chk = None if chk is None else chk[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    out: list[tuple] = []
    for a, b in zip([0, *cuts], [*cuts, len(bucket)], strict=True):
        if a == b:
            continue
        r = row[a:b]
        first = np.flatnonzero(np.diff(r, prepend=-1))
        step = np.diff(pos[a:b], prepend=0)
        step[first] = pos[a:b][first]
        wide = bool(step.max() > 0xFFFF)
        out.append((
            int(bucket[a]), key[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes(), b"" if chk is None else chk[a:b].astype("<u4").tobytes(),
            doc[r[first]].astype("<i8").tobytes(), ids[r[first]].astype("<i8").tobytes(), np.diff(np.append(first, b - a)).astype("<u4").tobytes(), step.astype("<u4" if wide else "<u2").tobytes(), wide,
        ))
    if out:
        cols = list(zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:7]), pa.array(cols[7])], names=["bucket", "key", "chk", "doc", "id", "per", "pos", "wide"])


def _parsed(table: pa.Table, width: int):
    """(key, check, doc number, position, doc keys, doc ids) of all entries of a bucket."""
    keys, checks, docs, ids, numbers, places, at = [], [], [], [], [], [], 0
    for x in table.to_pylist():
        if width:
            raw = np.frombuffer(x["key"], np.uint8).reshape(-1, width)
            full = np.zeros((len(raw), 8), np.uint8)
            full[:, :width] = raw
            keys.append(full.view("<u8").reshape(-1))
        checks.append(np.frombuffer(x["chk"], "<u4"))
        docs.append(np.frombuffer(x["doc"], "<i8"))
        ids.append(np.frombuffer(x["id"], "<i8"))
        per = np.frombuffer(x["per"], "<u4").astype(np.int64)
        numbers.append(np.repeat(np.arange(at, at + len(per), dtype=np.int32), per))
        at += len(per)
        step = np.frombuffer(x["pos"], "<u4" if x["wide"] else "<u2").astype(np.int64)
        total, start = np.cumsum(step), np.cumsum(per) - per
        places.append((total - np.repeat(total[start] - step[start], per)).astype(np.uint32))
    cat = np.concatenate
    return cat(keys or [np.empty(0, np.uint64)]), cat(checks), cat(numbers), cat(places), cat(docs), cat(ids)


def _by_part(doc: np.ndarray, number: np.ndarray, pos: np.ndarray, parts: int) -> pa.Table:
    """Positions of documents, in any order, as a row of arrays for each part of all documents."""
    part = (mix64(doc.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)[number] if len(doc) else number
    order = np.lexsort((number, part))
    part, number, pos = part[order], number[order], pos[order].astype("<u4")
    cuts = np.searchsorted(part, np.arange(parts + 1))
    rows = []
    for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if a < b:
            first = np.flatnonzero(np.diff(number[a:b], prepend=-1))
            rows.append((p, doc[number[a:b][first]].astype("<i8").tobytes(), np.diff(np.append(first, b - a)).astype("<u4").tobytes(), pos[a:b].tobytes()))
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.table({"part": pa.array(cols[0], pa.int32()), **{c: pa.array(x, pa.binary()) for c, x in zip(("doc", "per", "pos"), cols[1:], strict=True)}})


_PARTS = "part int, doc binary, per binary, pos binary"


def _places(table: pa.Table) -> pa.Table:
    """(doc, pos): all positions of each document of a part."""
    docs = np.concatenate([np.frombuffer(x, "<i8") for x in table["doc"].to_pylist()])
    per = np.concatenate([np.frombuffer(x, "<u4") for x in table["per"].to_pylist()])
    pos = np.concatenate([np.frombuffer(x, "<u4") for x in table["pos"].to_pylist()])
    doc = np.repeat(docs, per)
    order = np.argsort(doc, kind="stable")
    doc, pos = doc[order], pos[order]
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    ends = np.append(first, len(doc))[1:]
    return pa.table({"doc": pa.array(doc[first], pa.int64()), "pos": pa.array([pos[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary())})


def _runs(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new value begins in arrays that are sorted together."""
    new = np.zeros(len(sorted_keys[0]), bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _over(values: np.ndarray, first: np.ndarray, how) -> np.ndarray:
    """how.reduceat over runs, given back to each of their members."""
    return np.repeat(how.reduceat(values, first), np.diff(np.append(first, len(values))))


def _starts(words, k: int) -> np.ndarray:
    """Indices of words at which k words of one document start."""
    begin = np.cumsum(words.count) - words.count
    return ragged(begin, np.maximum(0, words.count - k + 1))


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def _kept_back(key: np.ndarray, chk: np.ndarray | None, ids: np.ndarray, both_ends: bool) -> tuple[np.ndarray, np.ndarray]:
    """(sent, shared): of entries of a slice with one hash, those of its smallest id (and its largest) are sent;
    shared are those whose hash another id of the slice has (both_ends), or a smaller one."""
    order = np.lexsort((ids, chk, key)) if chk is not None else np.lexsort((ids, key))
    k, i = key[order], ids[order]
    first = _runs(k) if chk is None else _runs(k, chk[order])
    low = _over(i, first, np.minimum)
    if both_ends:
        high = _over(i, first, np.maximum)
        sent, shared = (i == low) | (i == high), low != high
    else:
        sent, shared = i == low, i != low
    a, b = np.empty(len(key), bool), np.empty(len(key), bool)
    a[order], b[order] = sent, shared
    return a, b


def anchor_hits(rows: DataFrame, k: int, buckets: int) -> DataFrame:
    """Rows of _PARTS: where rolling half-windows of rows (doc, id, text) meet a reference block that another document shares."""
    half = (k + 1) // 2

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, limit=SLICE):
            words = words_of(b.column("text"))
            if not len(words.code):
                continue
            at = _starts(words, half)
            row = words.row[at]
            enough = words.count[row] >= k
            at, row = at[enough], row[enough]
            key = rolling(word_hashes(words.vocabulary, 1)[words.code], half)[at] if len(at) else np.empty(0, np.uint64)
            pos = at - (np.cumsum(words.count) - words.count)[row]
            doc, ids = b.column("doc").to_numpy(), b.column("id").to_numpy()
            sent, shared = _kept_back(key, None, ids[row], True)
            yield from _packed(_bucket(key, buckets)[sent], key[sent], _KEY_BYTES, None, row[sent], pos[sent], doc, ids)
            if shared.any():
                # known hits pass through, spread by document
                yield from _packed(buckets + (mix64(doc.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)[row[shared]], key[shared], 0, None, row[shared], pos[shared], doc, ids)

    def meet(table: pa.Table) -> pa.Table:
        through = table["bucket"][0].as_py() >= buckets
        key, _, number, pos, doc, ids = _parsed(table, 0 if through else _KEY_BYTES)
        if through:
            return _by_part(doc, number, pos, buckets)
        order = np.argsort(key, kind="stable")
        first = _runs(key[order])
        i = ids[number[order]]
        hit = (_over(i, first, np.minimum) != _over(i, first, np.maximum)) & _over(pos[order] % half == 0, first, np.logical_or)
        hit = order[hit]
        return _by_part(doc, number[hit], pos[hit], buckets)

    return rows.mapInArrow(probes, _EXCHANGE).groupBy("bucket").applyInArrow(meet, _PARTS)


def repeated_windows(hits: DataFrame, k: int, buckets: int) -> DataFrame:
    """Rows of _PARTS: windows around hits, rows (doc, id, text, hits), whose words also start in a document with a smaller id."""
    half = (k + 1) // 2

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, limit=SLICE):
            words = words_of(b.column("text"))
            begin = np.cumsum(words.count) - words.count
            near = np.zeros(len(words.code) + 1, np.int64)
            for r, x in enumerate(b.column("hits").to_pylist()):
                p = np.frombuffer(x, "<u4").astype(np.int64)
                np.add.at(near, begin[r] + np.maximum(0, p - (k - half)), 1)
                np.add.at(near, begin[r] + p + 1, -1)
            at = _starts(words, k)
            at = at[np.cumsum(near)[at] > 0]
            if not len(at):
                continue
            key = rolling(word_hashes(words.vocabulary, 2)[words.code], k)[at]
            chk = rolling(word_hashes(words.vocabulary, 3)[words.code], k)[at].astype(np.uint32)
            row = words.row[at]
            pos = at - begin[row]
            doc, ids = b.column("doc").to_numpy(), b.column("id").to_numpy()
            sent, shared = _kept_back(key, chk, ids[row], False)
            yield from _packed(_bucket(key, buckets)[sent], key[sent], _WINDOW_KEY_BYTES, chk[sent], row[sent], pos[sent], doc, ids)
            if shared.any():
                yield from _packed(buckets + (mix64(doc.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)[row[shared]], key[shared], 0, None, row[shared], pos[shared], doc, ids)

    def judge(table: pa.Table) -> pa.Table:
        through = table["bucket"][0].as_py() >= buckets
        key, chk, number, pos, doc, ids = _parsed(table, 0 if through else _WINDOW_KEY_BYTES)
        if not through:
            order = np.lexsort((chk, key))
            first = _runs(key[order], chk[order])
            i = ids[number[order]]
            later = order[i != _over(i, first, np.minimum)]
            number, pos = number[later], pos[later]
        return _by_part(doc, number, pos, buckets)

    return hits.mapInArrow(extend, _EXCHANGE).groupBy("bucket").applyInArrow(judge, _PARTS)


def cut(marked: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of rows (doc_id, text, cuts): kept are the words left, joined by a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches):
            texts, cuts = filled(b.column("text")).cast(pa.binary()).to_pylist(), b.column("cuts").to_pylist()
            total, gone, kept = [], [], []
            for text, places in zip(texts, cuts, strict=True):
                words = text.split()
                total.append(len(words))
                if places:
                    near = np.zeros(len(words) + 1, np.int64)
                    p = np.frombuffer(places, "<u4").astype(np.int64)
                    np.add.at(near, p, 1)
                    np.add.at(near, p + k, -1)
                    left = np.flatnonzero(np.cumsum(near)[:-1] == 0)
                    words = [words[i] for i in left]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

    return marked.select("doc_id", "text", "cuts").mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept binary")


def dedup_substrings(docs: DataFrame, k: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row of docs (doc_id, text); kept is the UTF-8 text that is left."""
    spark = docs.sparkSession
    folder = new_folder(spark, "substring")
    rows = docs.select(whole_id().alias("doc_id"), "text").withColumn("doc", F.xxhash64("doc_id", "text"))
    whole = rows.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc", F.col("doc_id").alias("id"), "text")
    size = whole.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), size // 6 // BUCKET_WORDS)
    gathered = lambda parts, name: written(parts.groupBy("part").applyInArrow(_places, "doc bigint, pos binary").withColumnRenamed("pos", name), folder, name)
    hits = gathered(anchor_hits(whole, k, buckets), "hits")
    released(spark)
    cuts = gathered(repeated_windows(whole.join(hits, "doc").select("doc", "id", "text", "hits"), k, buckets), "cuts")
    removed(spark, f"{folder}/hits")
    released(spark)
    return cut(rows.join(cuts, "doc", "left"), k)


def digest(kept: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256)."""
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


