"""Quality rules: gradient-boosted trees over document statistics, after two base rules.

Statistics are counted on whole texts with numpy. A bounded sample of labelled
documents trains logistic gradient boosting on binned statistics; chosen features
are monotonic: the score never rises with the share of symbols, of repeated lines
or of repeated words. The trees are flattened into arrays of nodes, and scoring
walks all trees of a batch at once, one level a step.

Defined results. A null or empty text has no words and fails the base rules.
Without labels of both classes no document is rejected by the trees. Labels that
are null or whose document is missing are left out; repeated labels and repeated
rows count as they come. Very long texts are read whole. An empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import byte_slices, filled, quoted, words_of

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Feature: +1 or -1 if the score may only rise or fall with it, else 0.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "distinct_share": 0,
    "top_word_share": 0, "short_share": 0, "digit_share": 0, "upper_share": 0, "words_a_line": 0, "stop_share": 0,
}
#: Labelled documents that train the trees, at most; the rows with the smallest hashes of doc_id are taken.
TRAIN_ROWS = 20_000
#: Share of good training documents that the threshold may reject.
LOSS = 0.005


def _raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins."""
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer(b"".join(texts.cast(pa.binary()).to_pylist()), np.uint8), np.concatenate([[0], np.cumsum(size)])


def _counted(raw: np.ndarray, cuts: np.ndarray, chars: bytes) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[list(chars)] = 1
    total = np.concatenate([[0], np.cumsum(table[raw], dtype=np.int64)])
    return total[cuts[1:]] - total[cuts[:-1]]


def statistics(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The five counts of each text, and its features as a matrix."""
    texts, n = filled(texts), len(texts)
    words = words_of(texts)
    code, row, count = words.code, words.row, words.count
    kinds = max(1, len(words.vocabulary))
    chars = np.fromiter((len(w.decode("utf-8", "replace")) for w in words.vocabulary), np.int64, len(words.vocabulary))
    word_chars = np.bincount(row, weights=chars[code], minlength=n).astype(np.int64)
    short = np.bincount(row, weights=chars[code] <= 3, minlength=n)
    raw, cuts = _raw(texts)
    lists = pc.split_pattern(texts, "\n")
    lines, of = lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0).to_numpy(zero_copy_only=False)
    line = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)[full]
    of = of[full]
    n_lines = np.bincount(of, minlength=n)
    own = np.unique(of * (int(line.max(initial=0)) + 1) + line) // (int(line.max(initial=0)) + 1)
    dup_lines = n_lines - np.bincount(own, minlength=n)

    repeat = np.zeros(n, np.int64)
    if len(code) > 2:
        inside = np.flatnonzero(row[2:] == row[:-2])
        pair = code[:-1] * kinds + code[1:]
        if kinds > 1 << 20:
            pair = np.unique(pair, return_inverse=True)[1]
        key = (pair[:-1] * kinds + code[2:])[inside]
        order = np.argsort(key, kind="stable")
        k, r = key[order], row[inside][order]
        same = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
        twice = np.zeros(len(code), bool)
        twice[inside[order[1:][same]]] = True
        twice[inside[order[:-1][same]]] = True
        covered = twice.copy()  # a word is covered by a window that starts at it or at one of the two before
        covered[1:] |= twice[:-1]
        covered[2:] |= twice[:-2]
        repeat = np.bincount(row[covered], minlength=n)

    each, times = np.unique(row * kinds + code, return_counts=True)
    doc = each // kinds
    distinct = np.bincount(doc, minlength=n)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, doc, times)
    # words that many documents of any topic hold: those of three letters or fewer that a text uses twice or more
    often = (times > 1) & (chars[each % kinds] <= 3)
    stop = np.bincount(doc[often], weights=times[often], minlength=n)
    counts = dict(zip(COUNTS, (count, word_chars, _counted(raw, cuts, SYMBOLS), dup_lines, repeat), strict=True))
    w, c, li = np.maximum(1, count), np.maximum(1, word_chars), np.maximum(1, n_lines)
    features = np.column_stack([
        np.log1p(count), word_chars / w, counts["n_symbols"] / c, dup_lines / li, repeat / w, distinct / w,
        top / w, short / w, _counted(raw, cuts, b"0123456789") / c, _counted(raw, cuts, bytes(range(65, 91))) / c, count / li, stop / w,
    ])
    return counts, features


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])


class Trees(NamedTuple):
    """All nodes of all trees: a row with x[feature] <= cut goes left; a leaf leads to itself. Scores are sums of values."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return self.start + self.value[at].sum(axis=1)


def _grown(bins, grad, hess, edges, signs, depth, least, smooth, nodes) -> int:
    """Grow one tree into nodes; its root."""
    width = max(len(e) for e in edges) + 1

    def leaf(value: float) -> int:
        nodes.append([0, np.inf, len(nodes), len(nodes), value])
        return len(nodes) - 1

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        g, h = grad[rows].sum(), hess[rows].sum()
        value = float(np.clip(-g / (h + smooth), low, high))
        if level == depth or len(rows) < 2 * least:
            return leaf(value)
        best = (1e-6, None)
        for f, sign in enumerate(signs):
            b = bins[rows, f]
            gl = np.cumsum(np.bincount(b, weights=grad[rows], minlength=width))[:-1]
            hl = np.cumsum(np.bincount(b, weights=hess[rows], minlength=width))[:-1]
            nl = np.cumsum(np.bincount(b, minlength=width))[:-1]
            vl, vr = np.clip(-gl / (hl + smooth), low, high), np.clip(-(g - gl) / (h - hl + smooth), low, high)
            loss = lambda v, gg, hh: gg * v + 0.5 * (hh + smooth) * v * v
            gain = loss(value, g, h) - loss(vl, gl, hl) - loss(vr, g - gl, h - hl)
            ok = (nl >= least) & (len(rows) - nl >= least) & (sign * (vr - vl) >= 0)
            gain = np.where(ok, gain, -np.inf)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (f, k, float(vl[k]), float(vr[k])))
        if best[1] is None:
            return leaf(value)
        f, k, vl, vr = best[1]
        mid, goes = (vl + vr) / 2, bins[rows, f] <= k
        at = leaf(value)
        # either side stays on its side of the middle, so no tree breaks the order that a split has made
        ll, lh, rl, rh = (low, mid, mid, high) if signs[f] > 0 else (mid, high, low, mid) if signs[f] < 0 else (low, high, low, high)
        left = grow(rows[goes], level + 1, ll, lh)
        right = grow(rows[~goes], level + 1, rl, rh)
        nodes[at] = [f, edges[f][k], left, right, 0.0]
        return at

    return grow(np.arange(len(bins)), 0, -np.inf, np.inf)


def train(x: np.ndarray, good: np.ndarray, signs=tuple(FEATURES.values()), trees: int = 60, depth: int = 4, rate: float = 0.2, least: int = 10, smooth: float = 1.0, bins: int = 64, loss: float = LOSS) -> Trees | None:
    """Boosted trees that score good documents above others; None without both classes."""
    y = good.astype(float)
    if not len(y) or y.min() == y.max():
        return None
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    edges = [np.append(e, np.inf) for e in edges]
    start = float(np.log(y.mean() / (1 - y.mean())))
    score, nodes, roots = np.full(len(y), start), [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        first = len(nodes)
        roots.append(_grown(binned, p - y, p * (1 - p), edges, signs, depth, least, smooth, nodes))
        for node in nodes[first:]:
            node[4] *= rate
        model = _flat(nodes, roots[-1:], depth, 0.0, 0.0)
        score += model.score(x)
    threshold = min(0.0, float(np.quantile(score[good], loss, method="lower")))
    return _flat(nodes, roots, depth, start, threshold)


def _flat(nodes, roots, depth, start, threshold) -> Trees:
    f, cut, left, right, value = zip(*nodes, strict=True)
    return Trees(np.array(f, np.int32), np.array(cut), np.array(left, np.int32), np.array(right, np.int32), np.array(value), np.array(roots, np.int32), depth, start, threshold)


def train_on(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees | None:
    """Trees trained on at most `rows` labelled documents; labels has doc_id and quality (1: good)."""
    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").alias("id"), "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches):
            _, x = statistics(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("quality"), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "quality", "x"])

    # at most `rows` pairs of numbers are broadcast
    found = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(chosen), "id").select(F.xxhash64("id").alias("id"), F.col("quality").cast("long").alias("quality"), "text")
    got = sorted((r.id, r.quality, tuple(r.x)) for r in found.mapInArrow(run, "id bigint, quality bigint, x array<double>").collect())
    return train(np.array([r[2] for r in got]).reshape(-1, len(FEATURES)), np.array([r[1] == 1 for r in got], bool))


def judged(docs: DataFrame, trees: Trees | None, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, the five counts, base_failed, score, kept) of every row of docs; keep: columns of docs to carry instead of doc_id."""
    keep = ["doc_id"] if keep is None else keep
    extra = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, "__text"):
            counts, x = statistics(b.column("__text"))
            failed = base_failed(counts)
            score = trees.score(x) if trees else np.zeros(b.num_rows)
            kept = ~failed & (score >= trees.threshold if trees else True)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(counts[c].astype(np.int64)) for c in COUNTS), pa.array(failed), pa.array(score), pa.array(kept)], names=[*(f"c{i}" for i in range(len(keep))), *extra])

    source = docs.select(*(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(keep)), F.col("text").alias("__text"))
    schema = ", ".join([*(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), *(f"{c} bigint" for c in COUNTS), "base_failed boolean, score double, kept boolean"])
    out = source.mapInArrow(run, schema)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), *extra) if keep == ["doc_id"] else out


def accepted(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    names = docs.columns
    out = judged(docs, trees, names).where("kept")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))
