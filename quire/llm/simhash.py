"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has 64 bits; bit b is 1 if it is set in over half the XXH64 values
(seed 42) of the text's word shingles. Two fingerprints link at `distance` or
fewer differing bits.

Bits that go together in a bounded sample are put into the same part, so what is
skewed stays in few parts. If the thresholds of m parts add up to distance - m + 1,
two linked fingerprints are within its threshold in at least one part (-1: the
part is not probed). A dynamic programme picks m and the thresholds with the
fewest probes and candidates, as estimated from the sample; results don't depend
on it. Every distinct fingerprint is indexed by its parts and probes with all
values within a part's threshold; candidates are verified on all 64 bits.

A part's value that more than `bucket` fingerprints hold is not joined pair by
pair. Its fingerprints are linked through midpoints instead: two fingerprints
that differ in one or two bits both lie within one bit of a common value, and any
two within one bit of a value differ in at most two, so a star over each value's
fingerprints (65 at most) loses no link and adds none. Equal texts and equal
fingerprints are put together before, so copies cost one row a group.

Defined results. A null or empty text has no words and the fingerprint zero,
linked like any other. A text with fewer words than a shingle is one shingle.
Repeated rows and repeated ids are rows of one class. A doc_id that is no whole number
is null, and a null doc_id never is a
component's name unless all its ids are null. Very long texts are read whole. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import byte_slices, filled, new_folder, removed, whole_id, written
from quire.llm.components import components

BITS = 64
SEED = 42
#: Fingerprints from which parts and thresholds are chosen, at most.
SAMPLE = 20_000
#: Fingerprints with the same value of a part that are still joined pair by pair.
BUCKET = 32
#: Words whose shingles are hashed at once, at most.
RUN = 1 << 16


def _tally(words: list[bytes], k: int, out: np.ndarray) -> int:
    """Add to out how often each bit is set in the shingles' hashes; the number of shingles."""
    if not words:
        return 0
    n = max(1, len(words) - k + 1)
    for at in range(0, n, RUN):
        run = words[at : min(n, at + RUN) + k - 1]
        joined = b" ".join(run)
        ends = np.cumsum(np.fromiter(map(len, run), np.int64, len(run)) + 1)
        starts = (ends - np.fromiter(map(len, run), np.int64, len(run)) - 1).tolist()
        stops = (ends[k - 1 :] - 1).tolist() if len(run) >= k else [len(joined)]
        h = xxhash.xxh64_intdigest
        got = np.fromiter((h(joined[s:e], SEED) for s, e in zip(starts, stops)), "<u8", len(stops))  # noqa: B905
        bits = np.unpackbits(got.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out += bits.sum(axis=0, dtype=np.int64)
    return n


def fingerprint(text: bytes, k: int) -> int:
    """The fingerprint of a UTF-8 text, as a signed 64-bit integer."""
    counts = np.zeros(BITS, np.int64)
    n = _tally(text.lower().split(), k, counts)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, fp) of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches):
            texts = filled(b.column("text")).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([fingerprint(x, k) for x in texts], pa.int64())], names=["doc_id", "fp"])

    return docs.select(whole_id().alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


def correlated_parts(sample: np.ndarray, m: int) -> list[list[int]]:
    """The 64 bits in m parts of about equal size; each part takes in the bits that go most with what it has."""
    bits = np.unpackbits(sample.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    spread = bits.std(axis=0)
    centred = (bits - bits.mean(axis=0)) / np.where(spread > 0, spread, 1)
    link = np.abs(centred.T @ centred) / max(1, len(bits))
    left, parts = set(range(BITS)), []
    for i in range(m):
        want = (BITS - sum(map(len, parts))) // (m - i)
        order = sorted(left)
        part = [max(order, key=lambda b: (link[b, order].sum(), -b))]
        while len(part) < want:
            part.append(max(sorted(left - set(part)), key=lambda b: (link[b, part].sum(), -b)))
        left -= set(part)
        parts.append(sorted(part))
    return parts


def mask_of(bits) -> int:
    """The bits as a signed 64-bit mask."""
    value = sum(1 << b for b in bits)
    return value - (1 << BITS) if value >> (BITS - 1) else value


def variants(part: list[int], radius: int) -> list[int]:
    """Masks of up to radius bits of a part."""
    return [mask_of(c) for r in range(radius + 1) for c in combinations(part, r)]


def candidate_cost(sample: np.ndarray, part: list[int], radius: int, n: int) -> float:
    """Estimated probes and candidates of a part at a threshold among n fingerprints."""
    if radius < 0:
        return 0.0
    values, count = np.unique(sample & np.int64(mask_of(part)), return_counts=True)
    hits = 0
    masks = variants(part, radius)
    for mask in masks:
        want = values ^ np.int64(mask)
        at = np.minimum(np.searchsorted(values, want), len(values) - 1)
        hits += int((count * np.where(values[at] == want, count[at], 0)).sum())
    scale = n / max(1, len(sample))
    return n * (1.0 + len(masks)) + max(0, hits - len(sample)) * scale * scale


def choose(sample: np.ndarray, n: int, distance: int) -> list[tuple[list[int], int]]:
    """(part, threshold) pairs whose thresholds add up to distance - m + 1, at the least estimated cost."""
    best: tuple[float, list] = (float("inf"), [])
    for m in range(2, distance + 3):
        parts = correlated_parts(sample, m)
        # state: the sum of thresholds so far -> (cost, thresholds)
        states: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for part in parts:
            cost = {t: candidate_cost(sample, part, t, n) for t in range(-1, distance)}
            grown: dict[int, tuple[float, list[int]]] = {}
            for total, (spent, taken) in states.items():
                for t, c in cost.items():
                    if total + t not in grown or spent + c < grown[total + t][0]:
                        grown[total + t] = (spent + c, [*taken, t])
            states = grown
        if (got := states.get(distance - m + 1)) and got[0] < best[0]:
            best = (got[0], list(zip(parts, got[1], strict=True)))
    return [(p, t) for p, t in best[1] if t >= 0]


def links(fps: DataFrame, folder: str, distance: int = 2, bucket: int = BUCKET) -> DataFrame:
    """(a, b) edges over a table of distinct fingerprints (fp); its components are those of all pairs within distance."""
    if distance != 2:
        raise ValueError("values with many fingerprints are linked by midpoints, which is exact for a distance of 2")
    n = fps.count()
    sample = np.array([r.fp for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64)
    plan = choose(sample, n, distance) if n else [(list(range(BITS)), 0)]
    key = lambda masks: F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(whole)).bitwiseXOR(F.lit(flip)).alias("key")) for i, whole, flip in masks]))
    own = [(i, mask_of(part), 0) for i, (part, _) in enumerate(plan)]
    near = [(i, mask_of(part), flip) for i, (part, radius) in enumerate(plan) for flip in variants(part, radius)]
    index = fps.select("fp", key(own).alias("k")).select("fp", "k.part", "k.key")
    probe = fps.select("fp", key(near).alias("k")).select("fp", "k.part", "k.key")
    size = index.groupBy("part", "key").count().where("count > 1 OR %s" % ("true" if len(near) > len(own) else "false"))
    full = written(size.where(F.col("count") > bucket).select("part", "key"), folder, "full")
    sparse = size.where(F.col("count") <= bucket).select("part", "key")
    listed = index.join(sparse, ["part", "key"], "left_semi").select("part", "key", F.col("fp").alias("other"))
    same = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance
    pairs = probe.join(listed, ["part", "key"]).where((F.col("fp") < F.col("other")) & same).select(F.col("fp").alias("a"), F.col("other").alias("b"))
    crowded = probe.join(full, ["part", "key"], "left_semi").select("fp").distinct()
    around = [0, *(mask_of([b]) for b in range(BITS))]
    star = (
        crowded.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(x)) for x in around])).alias("mid"))
        .groupBy("mid").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all"), F.count("*").alias("n"))
        .where("n > 1").select("a", F.explode("all").alias("b")).where("a <> b")
    )
    return pairs.unionByName(star).distinct()


def near_duplicates(docs: DataFrame, k: int = 3, distance: int = 2, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) of every row: component_id is the smallest doc_id that links reach."""
    spark = docs.sparkSession
    folder = new_folder(spark, "simhash")
    marked = written(fingerprints(docs, k), folder, "marked")
    fps = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), folder, "fps")
    edges = written(links(fps.select("fp"), folder, distance, bucket), folder, "edges")
    joined = components(edges, folder)  # fp -> smallest fp of its component
    named = fps.join(joined, fps.fp == joined.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = written(named.join(least, "root").select("fp", "component_id"), folder, "classes")
    removed(spark, f"{folder}/edges")
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")
