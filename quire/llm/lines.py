"""Line dedup by pairwise alignment.

A document is its lines, cut at LF, each hashed without white space at its ends.
Two documents are aligned by patience diff: lines that are alike at both ends of a
range are matched, then lines that both ranges hold once, in the longest order that
both keep, and so on between them. Each aligned common block of `min_words` words or
more is deleted from the later document. The result is that of aligning a document
with every earlier one; what is aligned are the documents as they came in, so it
doesn't depend on any order of work.

Fewer are aligned. A line can only be in a block of an earlier document that holds a
smallest run of lines of `min_words` words around it. Lines that one document alone
holds match nothing, so documents that are the same but for those are one class, and
its earliest document stands for it. Each run leads to the earliest class that holds
it, and a run of which a line is left on to further ones, in rounds of eight times as
many, until nothing is left to try: rare runs are done after a round or two, and common
ones go on only where no alignment has deleted their lines.

Defined results. A null or empty text has no line with a word, and loses none. Lines
without a word are no reason for a pair and are deleted only inside a block. Rows
with the same doc_id don't take from each other; of such rows the one with the
smallest hash of its text stands for the id. A row with a null doc_id, or one that is no
whole number, loses nothing and takes from nobody. Very long texts are read whole. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import byte_slices, filled, looked_up, new_folder, quoted, removed, shuffled, whole_id, written

MIN_WORDS = 5
#: Partners that go with a document into one row; one with more of them has several rows.
PARTNERS = 16
#: Hashes of lines that no other document holds, in a document and in the one that stands for a class.
OWN, OTHER = 1, 2
_BASE, _PRIME = 0x9E3779B97F4A7C15 % ((1 << 61) - 1), (1 << 61) - 1


def line_hash(line: bytes) -> int:
    """Of a line without the white space at its ends, as a signed 64-bit integer; 0 if nothing is left, never OWN or OTHER."""
    line = line.strip(b" \t\n\r\x0b\x0c")
    if not line:
        return 0
    h = max(xxhash.xxh64_intdigest(line, 10), 3)
    return h - (1 << 64) if h >> 63 else h


def patience(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Pairs (i, j) with a[i] == b[j], both rising."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, p, j, q = todo.pop()
        while i < p and j < q and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < p and j < q and a[p - 1] == b[q - 1]:
            p, q = p - 1, q - 1
            out.append((p, q))
        if i == p or j == q:
            continue
        once = Counter(a[i:p])
        other = Counter(b[j:q])
        where = {x: k for k, x in enumerate(b[j:q], j) if other[x] == 1}
        both = [(k, where[x]) for k, x in enumerate(a[i:p], i) if once[x] == 1 and x in where]
        # the longest rising run of places in b
        tops: list[int] = []
        ends: list[int] = []
        back: list[int] = []
        for n, (_, k) in enumerate(both):
            at = bisect_left(tops, k)
            back.append(ends[at - 1] if at else -1)
            tops[at : at + 1] = [k]
            ends[at : at + 1] = [n]
        n, anchors = ends[-1] if ends else -1, []
        while n >= 0:
            anchors.append(both[n])
            n = back[n]
        if anchors:
            last = (i, j)
            for k in [*reversed(anchors), (p, q)]:
                todo.append((last[0], k[0], last[1], k[1]))
                if k != (p, q):
                    out.append(k)
                last = (k[0] + 1, k[1] + 1)
    return sorted(out)


def blocks(pairs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """(first, end) in b of each run of aligned neighbours."""
    at = 0
    for n in range(1, len(pairs) + 1):
        if n == len(pairs) or pairs[n] != (pairs[n - 1][0] + 1, pairs[n - 1][1] + 1):
            yield pairs[at][1], pairs[n - 1][1] + 1
            at = n


def folded(lines: Sequence[int]) -> list[int]:
    """What of a document others can match: runs of its own lines as one OTHER."""
    return [OTHER if x == OWN else x for n, x in enumerate(lines) if x != OWN or not n or lines[n - 1] != OWN]


def runs(lines: Sequence[int], words: Sequence[int], min_words: int) -> dict[int, set[int]]:
    """The smallest runs of lines with min_words words around each line, by hash, and the lines they are for; equal hashes
    of different runs lead to more documents only."""
    sums, hashes, powers, full = [0], [0], [1], []
    for n, (x, k) in enumerate(zip(lines, words, strict=True)):
        sums.append(sums[-1] + k)
        hashes.append((hashes[-1] * _BASE + x + (1 << 63)) % _PRIME)
        powers.append(powers[-1] * _BASE % _PRIME)
        if x:
            full.append(n)
    out: dict[int, set[int]] = {}
    ends = [n for n, x in enumerate(lines) if x == OWN] + [len(lines)]
    for low, high in zip([0, *(n + 1 for n in ends)], ends):  # noqa: B905
        for n in range(low, high):
            at, i = bisect_right(full, n) - 1, n
            while i >= low:
                j = max(n, bisect_left(sums, sums[i] + min_words) - 1)
                if j < high:
                    out.setdefault((hashes[j + 1] - hashes[i] * powers[j + 1 - i]) % _PRIME, set()).add(n)
                if sums[n + 1] - sums[i] >= min_words:
                    break
                at -= at >= 0 and full[at] == i
                if at < 0:
                    break
                i = full[at]
    return out


def deleted(lines: list[int], words: list[int], partners: list[tuple[list[int], list[int]]], min_words: int) -> set[int]:
    """Numbers of lines to delete; partners: (lines, hashes of runs that led to it). One whose lines are all gone is not aligned."""
    gone: set[int] = set()
    around = runs(lines, words, min_words)
    for other, why in sorted(partners, key=lambda p: -len(p[1])):
        if all(around[w] <= gone for w in why):
            continue
        for a, b in blocks(patience(folded(other), lines)):
            if sum(words[a:b]) >= min_words:
                gone.update(range(a, b))
    return gone


def sketches(docs: DataFrame) -> DataFrame:
    """(key, id, lines, words): hashes of the lines of docs (key, doc_id, text), and their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches):
            hashes, words = [], []
            for text in filled(b.column("text")).cast(pa.binary()).to_pylist():
                lines = text.split(b"\n")
                hashes.append(np.fromiter(map(line_hash, lines), np.int64, len(lines)))
                words.append(np.fromiter((len(x.split()) for x in lines), np.int32, len(lines)))
            lists = lambda parts, kind: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in parts])]), pa.int32()), pa.array(np.concatenate(parts), kind))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("doc_id"), lists(hashes, pa.int64()), lists(words, pa.int32())], names=["key", "id", "lines", "words"])

    return docs.select("key", "doc_id", "text").mapInArrow(run, "key bigint, id bigint, lines array<bigint>, words array<int>")


def _lists(parts: list[list[int]], kind: pa.DataType) -> pa.ListArray:
    return pa.array(parts, pa.list_(kind))


def _shared(rows: DataFrame) -> DataFrame:
    """(key, id, lines, words, class) of rows (key, id, lines, words, found): lines not found elsewhere become OWN."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                marked, classes = [], []
                for lines, found in zip(b.column("lines").to_pylist(), b.column("found").to_pylist(), strict=True):
                    keep = set(found)
                    marked.append([x if not x or n in keep else OWN for n, x in enumerate(lines)])
                    classes.append(xxhash.xxh3_128_digest(np.array(folded(marked[-1]), "<i8").tobytes()))
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("id"), _lists(marked, pa.int64()), b.column("words"), pa.array(classes, pa.binary())], names=["key", "id", "lines", "words", "class"])

    return rows.select("key", "id", "lines", "words", "found").mapInArrow(run, "key bigint, id bigint, lines array<bigint>, words array<int>, class binary")


def _left(rows: DataFrame, min_words: int) -> DataFrame:
    """(key, id, w): runs of rows (key, id, lines, words, gone) for lines that are not among the gone ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                left = []
                for lines, words, parts in zip(*(b.column(c).to_pylist() for c in ("lines", "words", "gone")), strict=True):
                    out = set(np.frombuffer(b"".join(parts or []), "<u4").tolist())
                    left.append([w for w, ns in runs(lines, words, min_words).items() if not ns <= out])
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("id"), _lists(left, pa.int64())], names=["key", "id", "left"])

    return rows.select("key", "id", "lines", "words", "gone").mapInArrow(run, "key bigint, id bigint, left array<bigint>").select("key", "id", F.explode("left").alias("w"))


def _aligned(rows: DataFrame, min_words: int) -> DataFrame:
    """(key, gone) of rows (key, lines, words, partners)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                b = batch.slice(at, 64)
                gone = []
                for lines, words, others in zip(*(b.column(c).to_pylist() for c in ("lines", "words", "partners")), strict=True):
                    out = deleted(lines, words, [(o["lines"], o["why"]) for o in others], min_words)
                    gone.append(np.array(sorted(out), "<u4").tobytes())
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(gone, pa.binary())], names=["key", "gone"])

    return rows.select("key", "lines", "words", "partners").mapInArrow(run, "key bigint, gone binary").where("length(gone) > 0")


def _union(parts: DataFrame) -> DataFrame:
    """(key, gone) with one row a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone = [np.unique(np.frombuffer(b"".join(x), "<u4")).astype("<u4").tobytes() for x in b.column("gone").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(gone, pa.binary())], names=["key", "gone"])

    return parts.groupBy("key").agg(F.collect_list("gone").alias("gone")).mapInArrow(run, "key bigint, gone binary")


def deletions(rows: DataFrame, folder: str, min_words: int) -> DataFrame:
    """(key, gone): numbers of the lines to delete from rows (key, doc_id, text), as packed 32-bit integers."""
    spark = rows.sparkSession
    made: list[str] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        made.append(name)
        return written(df, folder, name)

    sketch = kept(sketches(rows.where("doc_id IS NOT NULL AND text IS NOT NULL")).dropDuplicates(["key"]), "sketch")
    each = sketch.select("key", "id", F.posexplode("lines").alias("n", "line")).where("line <> 0")
    held = kept(each.groupBy("line").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("line"), "held")
    found = each.join(shuffled(held), "line").groupBy("key").agg(F.collect_list("n").alias("found"))
    work = kept(_shared(sketch.join(shuffled(found), "key")), "work")
    stands = sketch.groupBy("id").agg(F.min("key").alias("key")).select("key")
    first = F.min(F.struct("id", "lines", "words")).alias("least")
    classes = work.join(shuffled(stands), "key", "left_semi").groupBy("class").agg(first).select(F.col("least.id").alias("id"), F.col("least.lines").alias("lines"), F.col("least.words").alias("words"))
    classes = kept(classes, "classes")
    none = F.lit(None).cast("array<binary>").alias("gone")
    # (w, rep): classes that hold a run and were not tried for it yet
    open_ = kept(_left(classes.select(F.col("id").alias("key"), "id", "lines", "words", none), min_words).select("w", F.col("id").alias("rep")), "open0")
    left = kept(_left(work.withColumn("gone", none), min_words), "left0")
    gone = None
    for k in count():
        # the earliest class of each of 8^k shares of a run's classes: no run is ranked in one task
        share = F.pmod(F.xxhash64("rep"), F.lit(8**k))
        holders = kept(open_.groupBy("w", share.alias("share")).agg(F.min("rep").alias("rep")).select("w", "rep"), f"holders{k}")
        pairs = kept(left.join(shuffled(holders), "w").where("rep < id").groupBy("key", "rep").agg(F.collect_set("w").alias("why")), f"pairs{k}")
        if k and pairs.isEmpty():
            break
        parts = pairs.groupBy("key").agg(F.ceil(F.count("*") / PARTNERS).alias("parts"))
        dealt = pairs.join(shuffled(parts), "key").select("key", "rep", "why", F.pmod(F.xxhash64("rep"), F.col("parts")).alias("part"))
        others = dealt.join(shuffled(classes.select(F.col("id").alias("rep"), "lines")), "rep").groupBy("key", "part").agg(F.collect_list(F.struct("lines", "why")).alias("partners")).drop("part")
        more = kept(_aligned(work.join(shuffled(others), "key"), min_words), f"gone{k}")
        gone = more if gone is None else gone.unionByName(more)
        # only documents that had a run to try can have one left
        lost = gone.groupBy("key").agg(F.collect_list("gone").alias("gone"))
        tried = work.join(shuffled(pairs.select("key").distinct()), "key", "left_semi").join(shuffled(lost), "key", "left")
        left = kept(_left(tried, min_words), f"left{k + 1}")
        # the runs as a table, and their join last, so that Spark can split a run that many classes hold
        runs_left = kept(left.select("w").distinct(), f"runs{k + 1}")
        open_ = open_.join(shuffled(holders), ["w", "rep"], "left_anti").join(shuffled(runs_left), "w", "left_semi")
        open_ = kept(open_, f"open{k + 1}")
    out = written(_union(gone), folder, "gone")
    for name in made:
        removed(spark, f"{folder}/{name}")
    return out


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(whole_id().alias("doc_id"), "text").withColumn("key", F.xxhash64("doc_id", "text"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, key, n_lines, n_removed, kept) of every row of docs (doc_id, text): kept is the text of the lines left; key is xxhash64(doc_id, text)."""
    rows = keyed(docs)
    gone = deletions(rows, new_folder(docs.sparkSession, "lines"), min_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches):
            counts, lost, kept = [], [], []
            for text, where in zip(filled(b.column("text")).cast(pa.binary()).to_pylist(), b.column("gone").to_pylist(), strict=True):
                lines = text.split(b"\n")
                counts.append(len(lines))
                lost.append(len(where) // 4 if where else 0)
                if where:
                    out = set(np.frombuffer(where, "<u4").tolist())
                    text = b"\n".join(x for i, x in enumerate(lines) if i not in out)  # noqa: PLW2901
                kept.append(text)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(counts, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string(), safe=False)], names=["doc_id", "key", "n_lines", "n_removed", "kept"])

    marked = rows.join(looked_up(gone), "key", "left").select("doc_id", "key", "text", "gone")
    return marked.mapInArrow(run, "doc_id bigint, key bigint, n_lines bigint, n_removed bigint, kept string")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs, with all their columns, less the lines gone (key, gone) of deletions(): n_chars, if there is one, is counted
    again for changed texts. Rows go that had a word and have none left."""
    others = [c for c in docs.columns if c != "text"]
    row = docs.select(F.struct(*(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(others))).alias("q_row"), F.col("text").alias("q_text"), F.xxhash64(whole_id(), "text").alias("q_key"))
    marked = row.join(looked_up(gone.select(F.col("key").alias("q_key"), F.col("gone").alias("q_gone"))), "q_key", "left").select("q_text", "q_gone", "q_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, "q_text"):
            kept, keep = [], []
            for text, where in zip(b.column("q_text").cast(pa.binary()).to_pylist(), b.column("q_gone").to_pylist(), strict=True):
                if where:
                    out = set(np.frombuffer(where, "<u4").tolist())
                    text = b"\n".join(x for i, x in enumerate(text.split(b"\n")) if i not in out)  # noqa: PLW2901
                kept.append(text)
                keep.append(not where or bool(text.strip(b" \t\n\r\x0b\x0c")))
            out = pa.RecordBatch.from_arrays([pa.array(kept, pa.binary()).cast(pa.string(), safe=False), *b.columns[1:]], names=b.schema.names)
            yield out.filter(pa.array(keep, pa.bool_()))

    def value(c: str):
        if c == "text":
            return F.col("q_text").alias(c)
        own = F.col("q_row").getField(f"c{others.index(c)}")
        if c == "n_chars":
            own = F.when(F.col("q_gone").isNotNull(), F.length("q_text")).otherwise(own)
        return own.cast(docs.schema[c].dataType).alias(c)

    return marked.mapInArrow(run, marked.schema).select(*map(value, docs.columns))


def digest(kept: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256)."""
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
