"""Quadrilaterals as numpy arrays of corners (n, 4, 2): areas, shared areas and centre lines of many at once."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


def usable(quads: list) -> np.ndarray:
    """Which of the quads are 8 finite numbers."""
    return np.array([q is not None and len(q) == 8 and all(v is not None and np.isfinite(v) for v in q) for q in quads], bool)


def corners(quads: list, boxes: np.ndarray) -> np.ndarray:
    """(n, 4, 2): each quad's corners, or its box's where it is not usable."""
    own = usable(quads)
    out = np.asarray(boxes, float).reshape(-1, 4)[:, [0, 1, 2, 1, 2, 3, 0, 3]].copy()
    if own.any():
        out[own] = np.array([q for q, ok in zip(quads, own, strict=True) if ok], float)
    return out.reshape(-1, 4, 2)


def signed_area(p: np.ndarray) -> np.ndarray:
    """Shoelace areas of polygons (n, k, 2), positive for clockwise corners in image space."""
    after = np.roll(p, -1, axis=1)
    return (p[..., 0] * after[..., 1] - after[..., 0] * p[..., 1]).sum(axis=1) / 2


def _half(p: np.ndarray, a: np.ndarray, b: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The polygons (m, k, 2) on their side of the lines a-b, and which of them have anything there.

    A polygon with fewer corners than others repeats its last one, which changes neither its outline nor its area.
    """
    along, rel = (b - a)[:, None], p - a[:, None]
    side = turn[:, None] * (along[..., 0] * rel[..., 1] - along[..., 1] * rel[..., 0])
    before, side_before = np.roll(p, 1, axis=1), np.roll(side, 1, axis=1)
    crosses = (side >= 0) != (side_before >= 0)
    t = np.divide(side_before, side_before - side, out=np.zeros_like(side), where=crosses)
    points = np.stack([before + t[..., None] * (p - before), p], axis=2).reshape(len(p), 2 * p.shape[1], 2)
    there = np.stack([crosses, side >= 0], axis=2).reshape(len(p), 2 * p.shape[1])
    count = there.sum(axis=1)
    at = np.argsort(~there, axis=1, kind="stable")[:, : max(1, int(count.max(initial=0)))]
    at = np.take_along_axis(at, np.minimum(np.arange(at.shape[1])[None], np.maximum(count - 1, 0)[:, None]), axis=1)
    return np.take_along_axis(points, at[..., None], axis=1), count > 0


def shared_area(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Areas that the polygons p and the convex quadrilaterals q share, pair by pair."""
    out = np.zeros(len(p))
    low, high = np.maximum(p.min(axis=1), q.min(axis=1)), np.minimum(p.max(axis=1), q.max(axis=1))
    meet = np.flatnonzero((low < high).all(axis=1))
    part, clip = p[meet], q[meet]
    turn = np.where(signed_area(clip) >= 0, 1.0, -1.0) if len(meet) else np.empty(0)
    left = np.ones(len(meet), bool)
    for k in range(4):
        part, some = _half(part, clip[:, k], clip[:, (k + 1) % 4], turn)
        left &= some
    out[meet] = np.where(left, np.abs(signed_area(part)), 0.0) if len(meet) else 0.0
    return out


class Lines(NamedTuple):
    """Centre lines: extent, height of the middle, slope and thickness."""

    left: np.ndarray
    right: np.ndarray
    center_y: np.ndarray
    slope: np.ndarray
    height: np.ndarray

    def y_at(self, i, x):
        return self.center_y[i] + self.slope[i] * (x - (self.left[i] + self.right[i]) / 2)


def lines(p: np.ndarray, boxes: np.ndarray, own: np.ndarray) -> Lines:
    """The line between the middles of the two opposite sides that are shorter together; a box's own line where the
    corners are not its own, have no width or rise by more than 45 degrees."""
    after = np.roll(p, -1, axis=1)
    side, middle = np.hypot(*np.moveaxis(after - p, -1, 0)), (p + after) / 2
    k = np.where(side[:, 0] + side[:, 2] <= side[:, 1] + side[:, 3], 0, 1)
    rows = np.arange(len(p))
    ends = np.stack([middle[rows, k], middle[rows, k + 2]], axis=1)
    swap = (ends[:, 1, 0] < ends[:, 0, 0]) | ((ends[:, 1, 0] == ends[:, 0, 0]) & (ends[:, 1, 1] < ends[:, 0, 1]))
    ends[swap] = ends[swap][:, ::-1]
    dx, dy = (ends[:, 1] - ends[:, 0]).T
    ok = own & (dx > 0) & (np.abs(dy) <= dx)
    safe = np.where(ok, dx, 1.0)
    pick = lambda a, b: np.where(ok, a, b)
    return Lines(
        pick(ends[:, 0, 0], boxes[:, 0]), pick(ends[:, 1, 0], boxes[:, 2]), pick((ends[:, 0, 1] + ends[:, 1, 1]) / 2, (boxes[:, 1] + boxes[:, 3]) / 2),
        pick(dy / safe, 0.0), np.maximum(1.0, pick(np.abs(signed_area(p)) / safe, boxes[:, 3] - boxes[:, 1])),
    )
