"""Geometry of boxes, quadrilaterals and text lines as Catalyst expressions.

A box is a struct<x1,y1,x2,y2>, a quadrilateral an array of 8 numbers (four corners,
clockwise in image space), a line a struct<left,right,center_y,slope,height>.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.base import once

INF = float("inf")


def box(x1, y1, x2, y2) -> Column:
    c = lambda v: (F.col(v) if isinstance(v, str) else v).cast("double")
    return F.struct(c(x1).alias("x1"), c(y1).alias("y1"), c(x2).alias("x2"), c(y2).alias("y2"))


def _num(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def width(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x2"] - b["x1"])


def height(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["y2"] - b["y1"])


def area(b: Column) -> Column:
    return width(b) * height(b)


def clamp(b: Column, w, h) -> Column:
    """Each coordinate within the page."""
    x = lambda v: F.greatest(F.lit(0.0), F.least(_num(w), v))
    y = lambda v: F.greatest(F.lit(0.0), F.least(_num(h), v))
    return box(x(b["x1"]), y(b["y1"]), x(b["x2"]), y(b["y2"]))


def expand(b: Column, px, w, h) -> Column:
    p = _num(px)
    return clamp(box(b["x1"] - p, b["y1"] - p, b["x2"] + p, b["y2"] + p), w, h)


def union(a: Column, b: Column) -> Column:
    return box(F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]), F.greatest(a["x2"], b["x2"]), F.greatest(a["y2"], b["y2"]))


def _overlap(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(hi_a, hi_b) - F.greatest(lo_a, lo_b))


def intersection_area(a: Column, b: Column) -> Column:
    return _overlap(a["x1"], a["x2"], b["x1"], b["x2"]) * _overlap(a["y1"], a["y2"], b["y1"], b["y2"])


def contained_fraction(a: Column, b: Column) -> Column:
    """Share of a's area that lies in b; 0 for an empty a."""
    return F.when(area(a) <= 0, 0.0).otherwise(intersection_area(a, b) / F.nullif(area(a), F.lit(0.0)))


def horizontal_overlap(a: Column, b: Column) -> Column:
    """Shared width over the smaller width; 0 if that is empty."""
    least = F.least(width(a), width(b))
    return F.when(least <= 0, 0.0).otherwise(_overlap(a["x1"], a["x2"], b["x1"], b["x2"]) / F.nullif(least, F.lit(0.0)))


def normalize(b: Column, w, h) -> Column:
    return F.array(b["x1"] / _num(w), b["y1"] / _num(h), b["x2"] / _num(w), b["y2"] / _num(h))


def quad_of(b: Column) -> Column:
    return F.array(b["x1"], b["y1"], b["x2"], b["y1"], b["x2"], b["y2"], b["x1"], b["y2"])


def _x(q: Column, i: int) -> Column:
    return F.get(q, F.lit(2 * (i % 4)))


def _y(q: Column, i: int) -> Column:
    return F.get(q, F.lit(2 * (i % 4) + 1))


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != INF)


def is_quad(q: Column) -> Column:
    """8 finite numbers; false for null."""
    return F.coalesce((F.size(q) == 8) & F.forall(q, finite), F.lit(False))


def signed_area(q: Column) -> Column:
    """Shoelace area, positive for clockwise corners in image space; 0 for an empty array."""
    total = sum((_x(q, i) * _y(q, i + 1) - _x(q, i + 1) * _y(q, i) for i in range(1, 4)), _x(q, 0) * _y(q, 1) - _x(q, 1) * _y(q, 0))
    return F.when(F.size(q) == 8, total / 2).otherwise(0.0)


def envelope(q: Column) -> Column:
    xs, ys = (lambda q: F.array(*[_x(q, i) for i in range(4)])), (lambda q: F.array(*[_y(q, i) for i in range(4)]))
    return F.when(q.isNotNull(), once(q, lambda q: box(F.array_min(xs(q)), F.array_min(ys(q)), F.array_max(xs(q)), F.array_max(ys(q)))))


def ordered_quad(q: Column) -> Column:
    """The corners from the first with the least x + y on, turned clockwise."""

    def turned(x: Column) -> Column:
        q = x["q"]
        double = sum((_x(q, i) * _y(q, i + 1) - _x(q, i + 1) * _y(q, i) for i in range(1, 4)), _x(q, 0) * _y(q, 1) - _x(q, 1) * _y(q, 0))
        first = F.array_min(F.array(*[F.struct((_x(q, i) + _y(q, i)).alias("s"), F.lit(i).alias("i")) for i in range(4)]))["i"]
        return once(F.struct(q.alias("q"), first.alias("first"), F.when(double >= 0, 1).otherwise(-1).alias("step")), picked)

    def picked(x: Column) -> Column:
        at = lambda k: F.pmod(x["first"] + x["step"] * k, F.lit(4)) * 2
        return F.array(*[F.get(x["q"], at(k) + c) for k in range(4) for c in (0, 1)])

    return F.when(q.isNotNull(), once(F.struct(q.alias("q")), turned))


def rotated_quad(cx: Column, cy: Column, w: Column, h: Column, angle: Column) -> Column:
    """The corners of a rectangle turned by angle degrees; null if a number is not finite or a side not positive."""

    def corners(r: Column) -> Column:
        out = []
        for sx, sy in ((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)):
            dx, dy = r["w"] * sx, r["h"] * sy
            out += [r["cx"] + dx * r["cos"] - dy * r["sin"], r["cy"] + dx * r["sin"] + dy * r["cos"]]
        return ordered_quad(F.array(*out))

    ok = finite(cx) & finite(cy) & finite(w) & finite(h) & finite(angle) & (w > 0) & (h > 0)
    parts = F.struct(cx.alias("cx"), cy.alias("cy"), w.alias("w"), h.alias("h"), F.cos(F.radians(angle)).alias("cos"), F.sin(F.radians(angle)).alias("sin"))
    return F.when(ok, once(parts, corners))


def _centreline(q: Column) -> dict[str, Column]:
    """Ends of the line between the middles of the two opposite sides that are shorter together."""
    side = [F.hypot(_x(q, i + 1) - _x(q, i), _y(q, i + 1) - _y(q, i)) for i in range(4)]
    mid = [((_x(q, i) + _x(q, i + 1)) / 2, (_y(q, i) + _y(q, i + 1)) / 2) for i in range(4)]
    even = side[0] + side[2] <= side[1] + side[3]
    pick = lambda a, b: F.when(even, a).otherwise(b)
    a = F.struct(pick(mid[0][0], mid[1][0]).alias("x"), pick(mid[0][1], mid[1][1]).alias("y"))
    b = F.struct(pick(mid[2][0], mid[3][0]).alias("x"), pick(mid[2][1], mid[3][1]).alias("y"))
    return {"left": F.least(a, b), "right": F.greatest(a, b)}


def line_struct(left: Column, right: Column, cy: Column, slope: Column, h: Column) -> Column:
    return F.struct(left.alias("left"), right.alias("right"), cy.alias("center_y"), slope.cast("double").alias("slope"), h.alias("height"))


def quad_line(q: Column) -> Column:
    """A quadrilateral's line, or null if it has no length, no area or is steeper than 45 degrees."""
    ends = _centreline(q)

    def line(e: Column) -> Column:
        a, b, size = e["a"], e["b"], e["size"]
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        safe = F.nullif(dx, F.lit(0.0))
        return F.when((dx > 0) & (F.abs(dy) <= dx) & (size > 0), line_struct(a["x"], b["x"], (a["y"] + b["y"]) / 2, dy / safe, F.greatest(F.lit(1.0), size / safe)))

    return F.when(is_quad(q), once(F.struct(ends["left"].alias("a"), ends["right"].alias("b"), F.abs(signed_area(q)).alias("size")), line))


def box_line(b: Column) -> Column:
    return line_struct(b["x1"], b["x2"], (b["y1"] + b["y2"]) / 2, F.lit(0.0), F.greatest(F.lit(1.0), height(b)))


def block_line(q: Column, b: Column) -> Column:
    """A block's line: from its quadrilateral where that is usable, else from its box."""
    ends = _centreline(q)

    def line(e: Column) -> Column:
        a, c = e["a"], e["c"]
        dx, dy = c["x"] - a["x"], c["y"] - a["y"]
        safe = F.nullif(dx, F.lit(0.0))
        return F.when((dx > 0) & (F.abs(dy) <= dx), line_struct(a["x"], c["x"], (a["y"] + c["y"]) / 2, dy / safe, F.greatest(F.lit(1.0), e["size"] / safe)))

    own = F.when(is_quad(q), once(F.struct(ends["left"].alias("a"), ends["right"].alias("c"), F.abs(signed_area(q)).alias("size")), line))
    return F.coalesce(own, box_line(b))


def y_at(line: Column, x: Column) -> Column:
    return line["center_y"] + line["slope"] * (x - (line["left"] + line["right"]) / 2)


def unit_lines(quads: Column, b: Column, members: Column) -> Column:
    """A unit's lines by centre, then left; without usable quadrilaterals, equal bands of its box."""
    by_place = lambda p, q: F.when(p["center_y"] < q["center_y"], -1).when(p["center_y"] > q["center_y"], 1).when(p["left"] < q["left"], -1).when(p["left"] > q["left"], 1).otherwise(0)
    own = F.array_sort(F.filter(F.transform(quads, quad_line), lambda x: x.isNotNull()), by_place)
    n = F.greatest(F.lit(1), F.size(members))
    band = F.greatest(F.lit(1.0), height(b) / n)
    bands = F.transform(F.sequence(F.lit(0), n - 1), lambda i: line_struct(b["x1"], b["x2"], b["y1"] + (i + 0.5) * band, F.lit(0.0), band))
    return once(own, lambda o: F.when(F.size(o) > 0, o).otherwise(bands))


def flow_bounds(category: Column, quads: Column, b: Column, members: Column) -> Column:
    """The box that orders a unit: its lines' extent for running text and formulas with quadrilaterals, else its box."""

    def extent(lines: Column) -> Column:
        least = lambda f: F.array_min(F.transform(lines, f))
        most = lambda f: F.array_max(F.transform(lines, f))
        return box(least(lambda x: x["left"]), least(lambda x: x["center_y"] - x["height"] / 2), most(lambda x: x["right"]), most(lambda x: x["center_y"] + x["height"] / 2))

    return F.when(category.isin("text", "unknown", "math") & (F.size(quads) > 0), once(unit_lines(quads, b, members), extent)).otherwise(b)


def should_merge(a: Column, b: Column, w, h, category: Column) -> Column:
    """Whether line b continues the group that ends with line a, both of this category."""
    la, lb = a["right"] - a["left"], b["right"] - b["left"]
    shared = _overlap(a["left"], a["right"], b["left"], b["right"])
    over = shared / F.greatest(F.lit(1.0), F.least(la, lb))
    x = F.when(shared > 0, (F.greatest(a["left"], b["left"]) + F.least(a["right"], b["right"])) / 2).otherwise((a["left"] + a["right"] + b["left"] + b["right"]) / 4)
    step = y_at(b, x) - y_at(a, x)
    gap = step - (a["height"] + b["height"]) / 2
    low, high = F.least(a["height"], b["height"]), F.greatest(a["height"], b["height"])
    w, h = _num(w), _num(h)
    math = (gap >= -0.01 * h) & (gap <= 0.035 * h) & ((over >= 0.20) | (F.abs((a["left"] + a["right"] - b["left"] - b["right"]) / 2) <= 0.18 * w))
    short, long = F.least(la, lb), F.greatest(la, lb)
    text = (
        ~((short < 0.15 * w) & (long > 2.5 * F.greatest(F.lit(1.0), short)))
        & (high <= 1.75 * low)
        & (F.abs(a["left"] - b["left"]) <= F.greatest(0.035 * w, 0.25 * short))
        & (gap >= -0.75 * low)
        & (gap <= F.least(0.018 * h, 0.65 * (a["height"] + b["height"]) / 2))
        & (over >= 0.55)
    )
    return (step >= 0.35 * low) & F.when(category == "math", math).when(category == "text", text).otherwise(False)


def neighbouring(a: Column, b: Column) -> Column:
    """Boxes one above the other, or side by side, at a small distance."""
    low, high = F.least(height(a), height(b)), F.greatest(height(a), height(b))
    vertical = _overlap(a["y1"], a["y2"], b["y1"], b["y2"]) / F.greatest(F.lit(1.0), low)
    y_gap = F.greatest(F.lit(0.0), F.greatest(a["y1"], b["y1"]) - F.least(a["y2"], b["y2"]))
    x_gap = F.greatest(F.lit(0.0), F.greatest(a["x1"], b["x1"]) - F.least(a["x2"], b["x2"]))
    return ((horizontal_overlap(a, b) >= 0.5) & (y_gap <= F.greatest(2 * low, 0.5 * high))) | ((vertical >= 0.5) & (x_gap <= 2 * low))


def starts_paragraph(last: Column, first: Column, left: Column, w, h) -> Column:
    """Whether a unit whose first line is `first` begins a paragraph after one with the last line `last` and leftmost `left`."""
    shared = _overlap(last["left"], last["right"], first["left"], first["right"])
    over = shared / F.greatest(F.lit(1.0), F.least(last["right"] - last["left"], first["right"] - first["left"]))
    x = (F.greatest(last["left"], first["left"]) + F.least(last["right"], first["right"])) / 2
    step = y_at(first, x) - y_at(last, x)
    mid = (last["height"] + first["height"]) / 2
    low, high = F.least(last["height"], first["height"]), F.greatest(last["height"], first["height"])
    return (
        (over < 0.25) | (step <= -0.5 * mid) | (high > 1.75 * low)
        | (step - mid > F.greatest(0.008 * _num(h), 0.85 * mid)) | (first["left"] - left > F.greatest(0.025 * _num(w), 0.8 * mid))
    )


def convex(q: Column, least: float = 0.01) -> Column:
    """Strictly convex and clockwise: every corner turns by a cross product over `least`."""
    out = F.lit(True)
    for i in range(4):
        cross = (_x(q, i + 1) - _x(q, i)) * (_y(q, i + 2) - _y(q, i + 1)) - (_y(q, i + 1) - _y(q, i)) * (_x(q, i + 2) - _x(q, i + 1))
        out = out & (cross > least)
    return out


def quad_valid(q: Column, w, h) -> Column:
    """A usable line quadrilateral, before and after it is cut to the page."""
    cut = F.transform(q, lambda v, i: F.greatest(F.lit(0.0), F.least(F.when(i % 2 == 0, _num(w)).otherwise(_num(h)), v)))
    return F.coalesce(is_quad(q) & convex(q) & convex(cut), F.lit(False))


def denormalise(v: Column, w, h, normalized: Column) -> Column:
    """Pixel box of 4 numbers (thousandths if all are up to 1000), 8 numbers (pixels) or a 5-number rotated rectangle
    (pixels, or thousandths if tagged: turned first, then scaled)."""
    w, h = _num(w), _num(h)
    g = lambda i: F.get(v, F.lit(i))
    four = F.when(F.forall(v, lambda x: F.abs(x) <= 1000), box(g(0) * w / 1000, g(1) * h / 1000, g(2) * w / 1000, g(3) * h / 1000)).otherwise(box(g(0), g(1), g(2), g(3)))
    # the extent of a turned rectangle, without its corners' order
    r = F.radians(g(4))
    dx, dy = (F.abs(g(2) * F.cos(r)) + F.abs(g(3) * F.sin(r))) / 2, (F.abs(g(2) * F.sin(r)) + F.abs(g(3) * F.cos(r))) / 2
    ok = F.forall(v, finite) & (g(2) > 0) & (g(3) > 0)
    e = F.when(ok, box(g(0) - dx, g(1) - dy, g(0) + dx, g(1) + dy))
    five = F.when(normalized, box(e["x1"] * w / 1000, e["y1"] * h / 1000, e["x2"] * w / 1000, e["y2"] * h / 1000)).otherwise(e)
    return F.when(F.size(v) == 4, four).when(F.size(v) == 8, envelope(v)).when(F.size(v) == 5, five)


#: Fixed values of a contact sheet: its widest crop and padding, the band for a label, the narrowest sheet.
WIDEST, PAD, LABEL, NARROWEST = 1600, 8, 26, 320
BAND = LABEL + 2 * PAD


def sheet_size(w: Column, h: Column, most: int) -> Column:
    """struct<w, h>: the size at which a crop goes on a contact sheet of at most `most` pixels."""
    least = lambda v: F.greatest(F.lit(1), v.cast("int"))
    narrow = F.least(F.lit(1.0), F.lit(float(WIDEST - 2 * PAD)) / F.greatest(F.lit(1), w))
    fit = F.struct(least(F.bround(w * narrow, 0)).alias("w"), least(F.bround(h * narrow, 0)).alias("h"))
    area = sheet_pixels(fit["w"], fit["h"] + BAND)
    shrink = F.sqrt(F.lit(float(most)) / area) * 0.95
    return F.when(area > most, F.struct(least(F.floor(fit["w"] * shrink)).alias("w"), least(F.floor(fit["h"] * shrink)).alias("h"))).otherwise(fit)


def sheet_pixels(widest: Column, stacked: Column) -> Column:
    """Pixels of a sheet of crops up to `widest` wide, of this height with their bands."""
    return F.greatest(F.lit(NARROWEST), widest + 2 * PAD) * stacked


def line_height(quads: Column, b: Column, w, h) -> Column:
    """Median thickness of a unit's usable line quadrilaterals, cut to the page; its box's height if there are none."""
    side = lambda q, i: F.hypot(_x(q, i + 1) - _x(q, i), _y(q, i + 1) - _y(q, i))
    cut = lambda q: F.transform(q, lambda v, i: F.greatest(F.lit(0.0), F.least(F.when(i % 2 == 0, _num(w)).otherwise(_num(h)), v)))
    thin = lambda q: F.least((side(q, 0) + side(q, 2)) / 2, (side(q, 1) + side(q, 3)) / 2)
    usable = F.filter(F.coalesce(quads, F.array().cast("array<array<double>>")), lambda q: quad_valid(q, w, h))
    middle = lambda f, i: F.get(f, F.floor((F.size(f) + i) / 2).cast("int"))
    found = F.array_sort(F.transform(usable, lambda q: once(cut(q), thin)))
    return once(found, lambda f: F.when(F.size(f) > 0, (middle(f, -1) + middle(f, 0)) / 2).otherwise(height(b)))


def review_window(b: Column, line: Column, w, h, padding: float = 8) -> Column:
    """struct<window, target>: the box with a line's room around it, 4 % of the page at most, and where the box lies in
    it; null for a box that is empty or not finite."""
    w, h = _num(w), _num(h)

    def around(x: Column) -> Column:
        target, room = x["target"], x["room"]
        px, py = F.least(room, 0.04 * w), F.least(room, 0.04 * h)
        return F.struct(target.alias("target"), box(F.greatest(F.lit(0.0), F.floor(target["x1"] - px)), F.greatest(F.lit(0.0), F.floor(target["y1"] - py)), F.least(w, F.ceil(target["x2"] + px)), F.least(h, F.ceil(target["y2"] + py))).alias("window"))

    def rebased(x: Column) -> Column:
        target, window = x["target"], x["window"]
        inside = box(target["x1"] - window["x1"], target["y1"] - window["y1"], target["x2"] - window["x1"], target["y2"] - window["y1"])
        return F.when((width(target) > 0) & (height(target) > 0) & (width(window) > 0) & (height(window) > 0), F.struct(window.alias("window"), inside.alias("target")))

    ok = finite(b["x1"]) & finite(b["y1"]) & finite(b["x2"]) & finite(b["y2"])
    room = F.greatest(F.lit(0.0), F.lit(float(padding)), 1.25 * line)
    return F.when(ok, once(once(F.struct(clamp(b, w, h).alias("target"), room.alias("room")), around), rebased))


def sheet_target(target: Column, source: Column, size: Column, top: Column) -> Column:
    """Where a target in its crop lies on the sheet, on which the crop is pasted in this size below `top`; the whole crop
    without a source box."""
    x = lambda v: F.lit(float(PAD)) + v / F.nullif(width(source), F.lit(0.0)) * size["w"]
    y = lambda v: top + v / F.nullif(height(source), F.lit(0.0)) * size["h"]
    whole = box(F.lit(float(PAD)), top, F.lit(float(PAD)) + size["w"], top + size["h"])
    return F.when((width(source) > 0) & (height(source) > 0), box(x(target["x1"]), y(target["y1"]), x(target["x2"]), y(target["y2"]))).otherwise(whole)
