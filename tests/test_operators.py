"""Expected values of the layout, review, compose and report operators."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import latex
from quire.functions import polygons as P
from quire.functions import text as X
from quire.operators import calls, compose, decode, images, layout, report, review
from quire.sources import provider

W, H = 1000, 1400
BLOCK = "page long, id string, category string, source_label string, score double, x1 double, y1 double, x2 double, y2 double, quad array<double>"


def block(id, category, x1, y1, x2, y2, score=0.9, label="b", quad=None):
    return (1, id, category, label, float(score), float(x1), float(y1), float(x2), float(y2), quad)


def units(spark, blocks, h=H):
    rows = layout.build_units(spark.createDataFrame(blocks, BLOCK), "page", W, h).collect()
    return [(r.category, r.member_ids) for r in sorted(rows, key=lambda r: (r.y1, r.x1))]


def line(id, cy, height=30, x1=100, x2=900):
    return block(id, "text", x1, cy - height / 2, x2, cy + height / 2)


def test_formulas_merge_and_text_in_figures_goes(spark):
    assert units(spark, [block("b1", "math", 100, 100, 700, 160), block("b2", "math", 100, 170, 700, 225)]) == [("math", ["b1", "b2"])]
    assert units(spark, [block("f", "figure", 100, 100, 800, 800), block("t", "text", 200, 200, 400, 260)]) == [("figure", ["f"])]
    diamond = [100.0, 0.0, 200.0, 100.0, 100.0, 200.0, 0.0, 100.0]
    corner = [block("f", "figure", 0, 0, 200, 200, quad=diamond), block("t", "text", 5, 5, 45, 25)]
    assert sorted(c for c, _ in units(spark, corner)) == ["figure", "text"]
    local = [block("f", "figure", 0, 0, 1000, 1400, label="local_source_fragment"), block("t", "text", 200, 200, 400, 260)]
    assert len(units(spark, local)) == 2


@pytest.mark.parametrize("flip", [False, True])
def test_duplicates_keep_the_better_then_the_first(spark, flip):
    order = lambda x: x[::-1] if flip else x
    same = [block("a", "text", 100, 100, 500, 140), block("b", "text", 100, 100, 500, 140)]
    assert units(spark, order(same)) == [("text", ["a"])]
    better = [block("a", "text", 100, 100, 500, 140, .90), block("b", "text", 100, 100, 500, 140, .99)]
    assert units(spark, order(better)) == [("text", ["b"])]


def test_line_groups(spark):
    columns = [block(f"{s}{k}", "text", x, 100 + 40 * k, x + 380, 130 + 40 * k) for k in range(3) for s, x in (("l", 60), ("r", 560))]
    assert units(spark, columns) == [("text", ["l0", "l1", "l2"]), ("text", ["r0", "r1", "r2"])]
    header = [block("h", "text", 60, 100, 940, 130), *[block(f"{s}{k}", "text", x, 140 + 40 * k, x + 380, 170 + 40 * k) for k in range(2) for s, x in (("l", 60), ("r", 560))]]
    assert units(spark, header) == [("text", ["h"]), ("text", ["l0", "l1"]), ("text", ["r0", "r1"])]
    chain = [line(f"c{k:02d}", 100 + 40 * k) for k in range(13)]
    got = units(spark, chain, 2400)
    assert len(got) == 3 and max(len(m) for _, m in got) <= 6
    gap = [line("one", 100), line("two", 140), line("after-gap", 230), line("heading", 285, 70)]
    assert units(spark, gap) == [("text", ["one", "two"]), ("text", ["after-gap"]), ("text", ["heading"])]
    tilted = [block(i, "text", 100, cy - 169, 900, cy + 169, quad=[100.0, cy - 169, 900.0, cy + 151, 900.0, cy + 169, 100.0, cy - 151]) for i, cy in (("a", 400.0), ("b", 420.0))]
    assert units(spark, tilted) == [("text", ["a", "b"])]


def order(*boxes):
    out = [layout.reading_order(list(b), W) for b in (boxes, boxes[::-1])]
    assert out[0] == out[1]
    return out[0]


def test_reading_order():
    two = [("l1", 60, 200, 460, 300), ("l2", 60, 320, 460, 420), ("r1", 540, 200, 940, 300), ("r2", 540, 320, 940, 420)]
    assert order(("h", 60, 60, 940, 120), *two, ("f", 60, 1300, 940, 1350)) == ["h", "l1", "l2", "r1", "r2", "f"]
    assert order(("lt", 60, 60, 460, 200), ("rt", 540, 60, 940, 200), ("fig", 100, 300, 900, 500), ("lb", 60, 600, 460, 700), ("rb", 540, 600, 940, 700)) == ["lt", "rt", "fig", "lb", "rb"]
    assert order(("h", 400, 60, 600, 120), *two) == ["h", "l1", "l2", "r1", "r2"]
    assert order(("p", 60, 60, 800, 300), ("note", 900, 100, 960, 140), ("c", 60, 320, 800, 500)) == ["p", "note", "c"]
    assert order(("b", 1, 1, 9, 9), ("a", 1, 1, 9, 9)) == ["a", "b"]
    rnd = random.Random(0)
    many = [(f"{k:03d}", x := rnd.randrange(900), y := rnd.randrange(1300), x + rnd.randrange(5, 300), y + rnd.randrange(5, 90)) for k in range(60)]
    assert sorted(order(*many)) == [b[0] for b in many]


def plain_order(boxes, w):
    """Reading order from its definition: a recursion over lists."""
    def gaps(spans):
        spans, out, top = sorted(spans), [], None
        for a, b in spans:
            if top is not None and a > top:
                out.append((top, a))
            top = b if top is None else max(top, b)
        return out

    if len(boxes) < 2:
        return [b[0] for b in boxes]
    for a, c in sorted(gaps([(b[1], b[3]) for b in boxes]), key=lambda g: (g[0] - g[1], g[0])):
        one, two = [b for b in boxes if b[3] <= a], [b for b in boxes if b[1] >= c]
        extent = lambda s: (min(b[1] for b in s), min(b[2] for b in s), max(b[3] for b in s), max(b[4] for b in s))
        if c - a >= 0.035 * w:
            p, q = extent(one), extent(two)
            if min(p[2] - p[0], q[2] - q[0]) >= 0.12 * w and min(p[3], q[3]) > max(p[1], q[1]):
                return plain_order(one, w) + plain_order(two, w)
    rows = gaps([(b[2], b[4]) for b in boxes])
    if rows:
        middles = [(p[3] + q[1]) / 2 for p in boxes for q in boxes if min(p[3] - p[1], q[3] - q[1]) >= 0.12 * w and min(p[4], q[4]) > max(p[2], q[2]) and q[1] - p[3] >= 0.035 * w]
        spans = [b for b in boxes if b[3] - b[1] >= 0.6 * w or any(b[1] < m < b[3] for m in middles)]
        top, low = max(rows, key=lambda g: (any(b[4] == g[0] or b[2] == g[1] for b in spans), g[1] - g[0], -g[0]))
        return plain_order([b for b in boxes if b[4] <= top], w) + plain_order([b for b in boxes if b[2] >= low], w)
    return [b[0] for b in sorted(boxes, key=lambda b: (b[2], b[1], b[0]))]


def test_reading_order_equals_plain():
    rnd = random.Random(7)
    for n in range(300):
        step = rnd.choice((1, 25, 50))
        cut = lambda v: v // step * step  # noqa: B023, E731
        boxes = [(f"{k:02d}", float(x := cut(rnd.randrange(900))), float(y := cut(rnd.randrange(1300))), float(x + max(step, cut(rnd.randrange(5, 700)))), float(y + max(step, cut(rnd.randrange(5, 150))))) for k in range(rnd.randrange(1, 14))]
        assert layout.reading_order(boxes, W) == plain_order(boxes, W), n


def test_shared_areas():
    square = [(0, 0), (10, 0), (10, 10), (0, 10)]
    others = [[(5, 5), (15, 5), (15, 15), (5, 15)], [(5, -5), (15, 5), (5, 15), (-5, 5)], [(20, 20), (30, 20), (30, 30), (20, 30)], square[::-1], [(2, 2), (4, 2), (4, 4), (2, 4)]]
    got = P.shared_area(np.array([square] * 5, float), np.array(others, float))
    assert got == pytest.approx([25, 100, 0, 100, 4])
    rnd = np.random.default_rng(3)
    angle, scale, at = rnd.uniform(0, 6.3, (2, 60, 1)), rnd.uniform(5, 40, (2, 60, 2)), rnd.uniform(0, 60, (2, 60, 1, 2))
    corner = np.array([(-1, -1), (1, -1), (1, 1), (-1, 1)], float)
    x, y = corner[:, 0] * scale[..., :1], corner[:, 1] * scale[..., 1:]
    quads = np.stack([x * np.cos(angle) - y * np.sin(angle), x * np.sin(angle) + y * np.cos(angle)], axis=-1) + at
    grid = np.stack(np.meshgrid(np.arange(-60, 130, 0.5), np.arange(-60, 130, 0.5)), axis=-1).reshape(-1, 2)

    def inside(q):
        e = np.roll(q, -1, axis=0) - q
        return np.logical_and.reduce([e[k, 0] * (grid[:, 1] - q[k, 1]) - e[k, 1] * (grid[:, 0] - q[k, 0]) >= 0 for k in range(4)])

    counted = [(inside(p) & inside(q)).sum() / 4 for p, q in zip(*quads, strict=True)]
    assert P.shared_area(*quads) == pytest.approx(counted, rel=0.05, abs=25)
    assert P.shared_area(quads[0][:, ::-1], quads[1]) == pytest.approx(P.shared_area(*quads)) == P.shared_area(quads[0], quads[1][:, ::-1])
    assert len(P.shared_area(np.zeros((0, 4, 2)), np.zeros((0, 4, 2)))) == 0


def plain_survivors(blocks):
    """Ids of axis-aligned blocks that stay, one by one."""
    shared = lambda a, b: max(0, min(a[7], b[7]) - max(a[5], b[5])) * max(0, min(a[8], b[8]) - max(a[6], b[6]))
    size = lambda a: max(1, (a[7] - a[5]) * (a[8] - a[6]))
    left = [a for a in blocks if a[2] != "text" or not any(b[2] in ("figure", "table") and b[1] != a[1] and shared(a, b) / size(a) >= 0.82 for b in blocks)]
    kept = []
    for a in sorted(left, key=lambda a: (-a[4], a[1])):
        rivals = [b for b in kept if b[2] == a[2] and abs((a[6] + a[8] - b[6] - b[8]) / 2) <= 0.15 * min(a[8] - a[6], b[8] - b[6])]
        if not any(shared(a, b) / max(size(a), size(b)) >= 0.9 for b in rivals):
            kept.append(a)
    return {a[1] for a in kept}


def test_surviving_equals_plain(spark):
    rnd, rows = random.Random(9), []
    for page in range(40):
        for k in range(rnd.randrange(1, 14)):
            x, y = rnd.randrange(0, 300, 20), rnd.randrange(0, 300, 20)
            b = block(f"b{k:02d}", rnd.choice(("text", "text", "figure", "math")), x, y, x + rnd.randrange(100, 400, 50), y + rnd.randrange(20, 120, 20), rnd.choice((0.5, 0.9)))
            rows += [(page, *b[1:])]
            if rnd.random() < 0.4:
                rows.append((page, f"c{k:02d}", *b[2:4], rnd.choice((0.5, 0.9)), b[5], b[6], b[7] + rnd.choice((0.0, 2.0)), b[8], None))
    got = {(r.page, r.id) for r in layout.greedy_nms(spark.createDataFrame(rows, BLOCK), "page").collect()}
    assert got == {(p, i) for p in range(40) for i in plain_survivors([r for r in rows if r[0] == p])}


def test_polygons_in_joins_and_units(spark):
    diamond = [100.0, 0.0, 200.0, 100.0, 100.0, 200.0, 0.0, 100.0]
    rows = [block("f", "figure", 0, 0, 200, 200, quad=diamond), block("t", "text", 5, 5, 45, 25), block("u", "text", 80, 80, 120, 120), block("v", "text", 80, 80, 120, 120)]
    df = spark.createDataFrame(rows, BLOCK)
    assert {r.id for r in layout.without_absorbed_text(df, ["page"]).collect()} == {"f", "t"}
    assert [(r.id, r.o_id) for r in layout.duplicate_pairs(df, ["page"]).collect()] == [("u", "v")]
    tilt = [100.0, 100.0, 900.0, 140.0, 900.0, 170.0, 100.0, 130.0]
    two = layout.build_units(spark.createDataFrame([block("a", "text", 100, 100, 900, 170, quad=tilt), block("b", "text", 100, 180, 900, 210)], BLOCK), "page", W, H)
    quads = {tuple(r.member_ids): r.quads for r in two.collect()}
    assert sum(map(len, quads.values())) == 1 + (("a", "b") in quads)
    flow = layout.flow_boxes(two.where("array_contains(member_ids, 'a')")).first()
    assert flow.y1 == pytest.approx(100 + 20 - 0, abs=6) and flow.y2 < 171


def test_paragraph_of_the_last_line(spark):
    rows = [(1, 0, "text", 60.0, 100.0, 900.0, 190.0, ["a", "b", "c"], []), (1, 1, "text", 60.0, 195.0, 900.0, 225.0, ["d"], []), (1, 2, "text", 60.0, 290.0, 900.0, 320.0, ["e"], [])]
    df = spark.createDataFrame(rows, "page long, ord long, category string, x1 double, y1 double, x2 double, y2 double, member_ids array<string>, quads array<array<double>>")
    assert [r.paragraph for r in compose.with_paragraphs(df, ["page"], ["ord"], W, H).orderBy("ord").collect()] == [True, False, True]


def test_paragraphs(spark):
    cases = [
        ((60, 100, 900, 130), (60, 135, 900, 165), False), ((60, 100, 400, 130), (60, 135, 900, 165), False), ((60, 100, 900, 130), (60, 180, 900, 210), True),
        ((60, 100, 900, 130), (110, 135, 900, 165), True), ((60, 900, 460, 930), (540, 100, 940, 130), True), ((60, 100, 900, 130), (60, 135, 900, 205), True),
    ]
    rows = [(k, n, "text", "x", *map(float, b)) for k, (p, q, _) in enumerate(cases) for n, b in enumerate((p, q))]
    rows += [(99, 0, "text", "x", 60.0, 100.0, 900.0, 130.0), (99, 1, "math", "x", 60.0, 135.0, 900.0, 165.0)]
    df = spark.createDataFrame(rows, "page long, ord long, category string, content string, x1 double, y1 double, x2 double, y2 double")
    got = {r.page: r.paragraph for r in compose.with_paragraphs(df, ["page"], ["ord"], W, H).where("ord = 1").collect()}
    assert got == {**{k: c[2] for k, c in enumerate(cases)}, 99: True}


def test_a_mean_at_the_threshold_needs_no_rescue(spark):
    """Added in this order the scores come to less than six times the threshold, in most others they don't."""
    tied, low = [(1, d / 100 * 12) for d in (3, 8, 3, 6, 6, 3)], [(2, d / 100 * 12) for d in (3, 8, 3, 6, 6, 2)]
    blocks = spark.createDataFrame(tied + low, "page long, score double").coalesce(1)
    pages = spark.createDataFrame([(1,), (2,), (3,)], "page long")
    assert {r.page for r in layout.needs_layout_rescue(layout.page_quality(blocks, pages, ["page"])).collect()} == {2, 3}


def test_costs(spark):
    rows = [(1, "qwen_ocr", '{"input_tokens": 100, "output_tokens": 50}'), (1, "qwen_rescue", '{"prompt_tokens": 10, "completion_tokens": 5}'), (1, "other", '{"input_tokens": 9}'), (2, "qwen_ocr", '{"input_tokens": null, "prompt_tokens": 7}')]
    df = spark.createDataFrame(rows, "doc long, provider string, usage string")
    tok = df.withColumns({"tokens_in": report.usage_tokens(F.col("usage"), "input_tokens", "prompt_tokens"), "tokens_out": report.usage_tokens(F.col("usage"), "output_tokens", "completion_tokens")})
    got = {r.doc: r for r in report.cost_estimate(tok, ["doc"], {"qwen_ocr": (1, 1), "qwen_rescue": (2, 2)}).collect()}
    assert (got[1].qwen_ocr, got[1].qwen_rescue, got[1].total) == (0.00015, 0.00003, 0.00018)
    assert got[2].total == 0


def test_batches():
    of = lambda rows, *a: review.pack([(*r, 100, 50) for r in rows], *a)
    assert of([(1, 10, p) for p in (0, 0, 0, 0, 1, 1, 1)], 3) == [0, 0, 0, 1, 2, 2, 2]
    assert of([(1, 9, 0)] * 5 + [(2, 9, 0)]) == [0, 0, 0, 0, 0, 1]
    assert of([(5, 1, 0), (2, 13_000, 0), (1, 1, 0)]) == [-1, -1, 0]
    assert review.pack([(1, 1, 0, 1000, 1500), (1, 1, 0, 100, 1500), (1, 1, 0, 1900, 2000)]) == [0, 1, -1]


def test_apply_keeps_drafts(spark):
    u = spark.createDataFrame([(1, i, "text", f"d{i}") for i in range(4)], "batch long, id long, category string, decoded string")
    r = spark.createDataFrame([(1, 0, [0, 1], "math", "corrected", "merged"), (1, 2, [2], "text", "uncertain", "maybe")], "batch long, id long, sources array<long>, category string, status string, text string")
    got = {x.id: x for x in review.apply_records(u, r, ["batch"]).collect()}
    assert (got[0].decoded, got[0].category, got[1].decoded, got[1].merged_into) == ("merged", "math", "", 0)
    assert (got[2].decoded, got[2].proposed_text, got[3].issue) == ("d2", "maybe", review.NO_REVIEW)
    assert [got[i].raw_decoded for i in range(4)] == ["d0", "d1", "d2", "d3"]


def test_cascade(spark):
    good, poor = "plain words here", "????"
    rows = [
        (0, "figure", "c", "", "x", None, None), (1, "unknown", "c", "", "x", None, None), (2, "text", "", "", good, None, None), (3, "text", "c", good, "other", None, None),
        (4, "text", "c", "", "F=ma", "\\frac{F}{m}=a", None), (5, "text", "c", "", "F=ma", "\\frac{F}{m=a?", None), (6, "text", "c", "", poor, None, good), (7, "text", "c", "", None, None, None), (8, "text", "c", "", good, None, "better?"),
    ]
    df = spark.createDataFrame(rows, "id long, category string, crop_path string, hint string, ocr string, math string, rescue string")
    got = {r.id: r for r in decode.cascade(df).collect()}
    assert [got[i].decoder for i in range(4)] == ["preserve-original", "preserve-unknown", "", "layout:text"]
    assert got[1].category == "figure" and got[2].score == 0 and got[3].calls == []
    assert (got[4].category, got[4].decoder, got[4].calls) == ("math", "ocr:math-auto", ["ocr", "math"])
    assert (got[5].category, got[5].decoded) == ("text", "F=ma") and got[6].rescued and got[6].decoded == good
    assert got[7].decoder == "error" and not got[8].rescued


def test_scores(spark):
    df = spark.createDataFrame([("text", "F=ma"), ("math", "\\frac{F}{m}=a"), ("math", "\\frac{F}{m}=a?"), ("table", "|a|\n|b|"), ("table", "x"), ("text", "  ")], "category string, s string")
    assert [round(r[0], 6) for r in df.select(X.validate(F.col("category"), F.col("s"))).collect()] == [1.0, 1.0, 0.9, 0.82, 0.45, 0.0]


def on(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{k} string" for k in range(len(values))))
    return df.select(f(*(F.col(f"c{k}") for k in range(len(values)))).alias("x")).first().x


@pytest.mark.parametrize(("text", "tex"), [
    ("Prezzi $5 e $10", "Prezzi \\$5 e \\$10"), ("Costo $5 e formula $x=1$.", "Costo \\$5 e formula \\(x=1\\)."), ("# T\n- a\n  more\n- **b**\n3. c\n4) d", "\\section*{T}\n\n\\begin{itemize}\n\\item a more\n\\item \\textbf{b}\n\\end{itemize}\n\n\\begin{enumerate}\n\\item[3.] c\n\\item[4.] d\n\\end{enumerate}"),
    ("one\ntwo\n\nthree", "one two\n\nthree"), ("a $$x$$ b", "a \\[\nx\n\\] b"), ("", ""), ("a \x005\x00 b \x000\x00 $y$", "a \x005\x00 b \x000\x00 \\(y\\)"), ("p **b\nc** q", "p \\textbf{b c} q"), ("- p **b\nc** q", "\\begin{itemize}\n\\item p **b c** q\n\\end{itemize}"),
    ("x\n#### deep\ny\n####### no", "x\n\n\\subsubsection*{deep}\n\ny \\#\\#\\#\\#\\#\\#\\# no"), ("**bold $a*b$ on**", "\\textbf{bold \\(a*b\\) on}"), ("\\begin{align*}a&b\\end{align*}", "\\[\n\\begin{aligned}a&b\\end{aligned}\n\\]"), ("\x01 \\x", "\x01 \\textbackslash{}x"),
    ("1. a\n- b\n\n- c", "\\begin{enumerate}\n\\item[1.] a\n\\end{enumerate}\n\n\\begin{itemize}\n\\item b\n\\end{itemize}\n\n\\begin{itemize}\n\\item c\n\\end{itemize}"), ("$a\nb$ c", "\\(a\nb\\) c"),
])
def test_render_text(spark, text, tex):
    assert on(spark, latex.render_text, text) == tex


def test_render_long_texts(spark):
    """No pattern needs a stack that grows with the text."""
    long = "word $x$ " * 40_000 + "$" + "y \\\\ " * 40_000 + "$ " + "a" * 100_000
    assert len(on(spark, latex.render_text, long)) > 400_000
    assert on(spark, latex.math_syntax_error, "{" * 20_000 + "}" * 20_000) is None


@pytest.mark.parametrize(("raw", "clean"), [
    ("$x$", "x"), ("$$x$$", "x"), ("\\[x\\]", "x"), ("\\(x\\)", "x"), ("```latex\nx\n```", "x"), ("$a$ $b$", "a\\quad b"), ("\\begin{equation}x\\end{equation}", "x"), ("\\begin{align*}x\\end{align*}", "\\begin{aligned}x\\end{aligned}"), ("\\\\\\begin{gather}x\\end{gather}", "\\\\\\begin{gathered}x\\end{gathered}"), ("$a$ b", "$a$ b"), ("\\[a\\] b \\[c\\]", "\\[a\\] b \\[c\\]"), ("$$", ""),
])
def test_clean_math(spark, raw, clean):
    assert on(spark, latex.clean_math, raw) == clean


def test_syntax(spark):
    ok = ["x", "\\begin{cases}a\\end{cases}", "$x$", "\\{ x", "\\begin{cases}\\begin{array}x\\end{array}\\end{cases}", "$$a$$ \\[b\\]"]
    bad = {"{x": "unbalanced LaTeX braces", "\\begin{itemize}x\\end{itemize}": "non-mathematical LaTeX environment", "\\begin{cases}x": "unclosed LaTeX environment", "\\begin{cases}\\end{array}": "mismatched LaTeX environments", "$x": "unclosed math delimiter", "\\(a\\]": "mismatched math delimiters", "\\( \\( x": "nested math delimiters", "$$a$": "nested or mismatched math delimiters", "a\\)": "mismatched math delimiters"}
    df = spark.createDataFrame([(x,) for x in [*ok, *bad]], "s string")
    got = {r.s: r.e for r in df.select("s", latex.math_syntax_error(F.col("s")).alias("e")).collect()}
    assert got == {**dict.fromkeys(ok), **bad}
    text = lambda s: on(spark, latex.syntax_error, "text", s)
    assert text("so $\\frac{a}{b}$ and C:\\alpha\\x.txt") is None and text("plain {words") is None and on(spark, latex.syntax_error, "table", "{") is None
    assert text("so \\alpha") == "mathematical command outside a math delimiter" and text("so $x") == "unclosed inline math delimiter" and text("so ${x$") == "unbalanced LaTeX braces"


def test_tables(spark):
    assert on(spark, latex.table_tex, "| a | b |\n|---|---|\n| 1 | 2 |\n|x|") == "\\begin{tabular}{|l|l|}\n\\hline\na & b \\\\ \\hline\n1 & 2 \\\\ \\hline\nx &  \\\\ \\hline\n\\end{tabular}"
    rows = lambda s: on(spark, latex.html_rows, s)
    assert rows("<table><tr><th> a  b</th><td>&lt;&#233;&#x20ac;&#xzz;</td></tr><tr></tr></table>") == [["a b", "<é€&#xzz;"]]
    assert rows("<TR><TD a='1'>x<b>y</b></TD>out<td>never closed</tr><tr><td>no end") == [["xy"]] and rows("<!-- <tr><td>a</td></tr> -->") == []
    assert on(spark, latex.table_tex, "no table") == "" and on(spark, latex.table_tex, "```latex\n\\begin{tabular}{l}a\\end{tabular}\n```") == "\\begin{tabular}{l}a\\end{tabular}"


def test_references_that_a_table_reads(spark):
    cell = "| &quot;a&#33;&lt;&amp;&gt; | b |"
    assert "\n\"a!<\\&> & b " in on(spark, latex.table_tex, cell)
    some = on(spark, lambda c: latex.table_tex(c, only=("lt", "amp")), cell)
    assert "\n\\&quot;a\\&\\#33;<\\&\\&gt; & b " in some
    assert on(spark, lambda c: latex.html_rows(c, only=("lt", "amp")), "<tr><td>&quot;&lt;&amp;</td></tr>") == [["&quot;<&"]]


def test_figure_width_is_rounded_as_printf_does(spark):
    """0.2625 is a little above a tie in binary, 0.2635 below one; 0.3125 and 0.4375 are ties."""
    values = [105 / 400, 0.2635, 0.3125, 0.4375, 0.9995, 0.99949999, 0.25, 0.1, 1.0, 7.0, *(k / 2000 for k in range(500, 2001, 7))]
    df = spark.createDataFrame([(v,) for v in values], "w double")
    got = [r.f for r in df.select(X.figure_fraction(F.col("w"), F.lit(1.0)).alias("f")).collect()]
    assert got == [f"{max(0.25, min(1.0, v)):.3f}" for v in values]


def test_documents(spark):
    box = lambda k: (60.0, 60.0 + 40 * k, 900.0, 90.0 + 40 * k)
    units = [
        ("u0", 0, "text", "# Title", "", ["b0"], "verified", False, None, 0), ("u1", 0, "text", "one $x$", "", ["b1"], "uncertain", False, None, 1), ("u2", 0, "text", "gone", "", ["b2"], "corrected", False, "u1", 2), ("u3", 0, "text", "paper", "", ["b_residual"], "verified", False, None, 3),
        ("u4", 0, "math", "$$y$$", "", ["b4"], "not_reviewed", True, None, 4), ("u5", 0, "table", "no rows", "c/t.PNG", ["b5"], "verified", False, "", 5), ("u6", 0, "figure", "", "c/f.png", ["b6"], "verified", False, None, 6), ("u7", 0, "text", "ends", "", ["b7"], "verified", False, None, 25),
        ("u8", 1, "unknown", "here", "", ["b8"], "verified", False, None, 0), ("u9", 1, "text", "", "", ["b9"], "uncertain", False, None, 9), ("ua", 1, "text", "dropped", "", ["ba"], "verified", False, None, 12),
    ]
    rows = [(1, p, i, c, t, crop, m, s, mark, into, [], *box(k)) for i, p, c, t, crop, m, s, mark, into, k in units]
    df = spark.createDataFrame(rows, "doc long, page long, id string, category string, content string, crop_path string, member_ids array<string>, status string, mark_pdf boolean, merged_into string, quads array<array<double>>, x1 double, y1 double, x2 double, y2 double")
    pages = spark.createDataFrame([(1, 0, 1000, 1400), (1, 1, 1000, 1400)], "doc long, page long, page_w long, page_h long")
    blocks = spark.createDataFrame([(1, 1, "ba", "whole_page_no_text")], "doc long, page long, id string, source_label string")
    note = "{\\small\\itshape [" + X.REVIEW_NOTE + "]}"
    picture = lambda f: "\\begin{center}\n\\includegraphics[width=0.840\\linewidth,height=0.55\\textheight,keepaspectratio]{assets/p0000_" + f + ".png}\n\\end{center}"
    want = "\n\n".join(["\\section*{Title}", "one \\(x\\) " + note, "\\[\ny\n\\]", note, picture("u5"), picture("u6"), "ends here", note])
    titles = spark.createDataFrame([(1, " "), (2, "T_1")], "doc long, title string")
    got = {r.doc: r.tex for r in compose.documents(df, pages, blocks, ["doc"], titles, W).collect()}
    head = "\n".join(compose.PREAMBLE) + "\n"
    assert got[1] == head + want + "\n\\end{document}\n" and got[2] == head + "\\title{T\\_1}\n\\date{}\n\\maketitle\n\n\\end{document}\n"
    assert {(r.id, r.source, r.asset) for r in compose.assets(df, blocks, ["doc", "page"]).collect()} == {("u5", "c/t.PNG", "assets/p0000_u5.png"), ("u6", "c/f.png", "assets/p0000_u6.png")}


@pytest.mark.parametrize("bad", ["1,2,3,4", "1,2,3,4,5,6", "1,2,a,4,5", "text\n1,2,3,4,5", "1,2,3,4,5\n1,2,3", "nan,2,3,4,5", "1,2,0,4,5", "1,2,3,4,91", "1001,2,3,4,5"])
def test_listing_is_all_or_nothing(spark, bad):
    df = spark.createDataFrame([(bad,), ("```csv\n20,30,80,100,0\n\n980, 990,100,60,0\n```",)], "s string")
    got = [r[0] for r in df.select(provider.listing(F.col("s"))).collect()]
    assert got == [[], [[20, 30, 80, 100, 0], [980, 990, 100, 60, 0]]] and provider.listing_rows(bad) == []


def test_provider_search():
    assert provider.find_words({"a": {"words_info": []}, "b": [{"words_info": [{"x": 1}, 2]}]}) == [{"x": 1}]
    assert provider.find_words({"words_info": [], "b": {"words_info": [{"x": 1}]}}) == []
    assert len(provider.find_positions({"pos_list": [{"location": [1]}, {"location": [1]}, {"q": 1}], "c": {"bbox": [2]}})) == 2
    assert provider.redact({"API-Key": "s", "t": ["a s b", "data:image/png;base64,AA"]}, "s", True) == {"API-Key": "[REDACTED]", "t": ["a [REDACTED] b", "data:image/png;base64,[OMITTED]"]}


def test_review_messages(spark):
    import json

    good = {"id": "a", "text": "t", "category": "text", "status": "verified", "issues": []}
    units = [good, {**good, "x": 1}, {**good, "issues": [" "]}, {**good, "source_ids": []}, 5, {**good, "text": 1}, {**good, "id": "b", "source_ids": ["b", "c"], "issues": ["i"] * 13}, {**good, "id": "d", "source_ids": ["d", "e"], "issues": ["i"]}]
    bodies = [(1, json.dumps({"units": units})), (2, '{"units": [], "more": 1}'), (3, "x"), (4, "```json\n" + json.dumps({"units": [good]}) + "\n```"), (5, '{"units": []}')]
    got: dict = {}
    for r in provider.review_records(spark.createDataFrame(bodies, "doc long, body string"), ["doc"]).collect():
        got.setdefault(r.doc, {})[r.ord] = r
    schema, kinds = "Review record has an invalid schema", "Review record has invalid field types"
    assert [got[1][k].error for k in range(8)] == [None, schema, kinds, "a: invalid source_ids", schema, kinds, kinds, None]
    assert got[1][0].sources == ["a"] and got[1][6].declared == ["b", "c"] and got[1][7].sources == ["d", "e"] and got[1][5].declared == ["a"]
    assert got[2][None].error == "Review response must contain only a units array" and got[3][None].error == "Review response is not a JSON object"
    assert got[4][0].error is None and 5 not in got
    gate = spark.createDataFrame([(400, '{"usage": {"input_tokens": 3}}'), (200, "[]"), (200, "x"), (200, '{"choices": [{"message": {"content": "y"}}]}')], "s int, b string")
    assert [(r[0], r[1]) for r in gate.select(provider.response_error(F.col("s"), F.col("b")), provider.response_usage(F.col("b"))).collect()] == [("HTTP 400", '{"input_tokens":3}'), ("not an object", "{}"), ("not JSON", "{}"), (None, "{}")]


def test_calls(spark):
    import json

    said = []

    def send(payload):
        said.append(calls.VENDOR_FIELD in payload)
        if calls.VENDOR_FIELD in payload:
            raise RuntimeError("HTTP 400: unknown field ocr_options")
        return "{}"

    ask = calls.Negotiated(send)
    assert ask({"m": 1}, "t") == ask({"m": 1, calls.VENDOR_FIELD: 1}, "t") == "{}" and said == [True, False, False]
    with pytest.raises(RuntimeError):
        calls.Negotiated(lambda p: (_ for _ in ()).throw(RuntimeError("HTTP 500")))({}, "t")

    def read(crop, category, task):
        if crop == "bad":
            raise OSError("gone")
        return json.dumps({"choices": [{"message": {"content": f"{crop} {task}"}}], "usage": {"input_tokens": 2}})

    units = spark.createDataFrame([(1, "text", "a"), (2, "math", "bad"), (3, "table", "c")], "id long, category string, crop string")
    got = {r.id: r for r in calls.decoded(units, ["id"], "ocr", read, 2).collect()}
    assert got[1].ocr == "a document_parsing" and got[1].ocr_usage == '{"input_tokens": 2}' and got[1].ocr_error is None
    assert got[2].ocr is None and got[2].ocr_error == "OSError: gone" and got[3].ocr == "c table_parsing"

    def locate(image, task):
        if image == "fails":
            raise TimeoutError("late")
        return json.dumps({"choices": [{"message": {"content": "500,500,100,100,0" if image == "p" else "nothing"}}], "usage": {}})

    pages = spark.createDataFrame([(1, "p", 1000, 1400), (2, "q", 1000, 1400), (3, "fails", 1000, 1400)], "page long, image string, page_w long, page_h long")
    blocks, made = calls.located(pages, "page", locate)
    assert {(r.page, r.id, r.x1, r.y1, r.x2, r.y2) for r in blocks.collect()} == {(1, "p0001_q0000", 450.0, 630.0, 550.0, 770.0), (2, "p0002_fullpage", 0.0, 0.0, 1000.0, 1400.0)}
    assert {r.page: r.error for r in made.collect()} == {1: None, 2: None, 3: "TimeoutError: late"}

    class Answer:
        json = '{"res": {"boxes": [{"coordinate": [1, 2, 3, 4], "score": 0.5, "label": "Figure"}, {"bbox": [1, 2, 3]}]}}'

    def missing():
        raise ImportError("no model")

    found = calls.detected(pages, "page", [missing, lambda: lambda image: Answer()]).collect()
    assert {(r.page, r.id, r.category, r.score) for r in found} == {(p, f"p{p:04d}_b0000", "figure", 0.5) for p in (1, 2, 3)}
    assert provider.as_result('{"a": 1}') == provider.as_result([("a", 1)]) == {"a": 1}
    with pytest.raises(TypeError):
        provider.as_result(3)
    state = units.selectExpr("id", "category", "0.123456D AS detector_score", "0.5D AS score", "'abc' AS decoded", "array('m') AS member_ids")
    asked = calls.routed(state, ["id"], lambda s: (200, json.dumps({"answers": {"rescue": {"noul": s["detector_score"]}}})))
    assert {r.rescue_asked for r in asked.collect()} == {False} and {r.rescue_asked for r in calls.routed(state, ["id"], None).collect()} == {None}
    batch = spark.createDataFrame([(1, k, f"u{k}", 0, "text", "d", 0.0, 0.0, 9.0, 9.0) for k in range(2)], "batch long, ord long, id string, page long, category string, decoded string, x1 double, y1 double, x2 double, y2 double")
    answer = lambda meta: {"choices": [{"message": {"content": json.dumps({"units": [{"id": m["id"], "text": "n", "category": "text", "status": "corrected", "issues": ["i"]} for m in json.loads(meta)]})}}], "usage": {"input_tokens": 1}}
    records, paid = calls.reviewed(batch, ["batch"], answer)
    assert [r.id for r in records.orderBy("ord").collect()] == ["u0", "u1"] and paid.first().usage == '{"input_tokens": 1}'


def test_cascade_with_a_router_and_errors(spark):
    df = spark.createDataFrame([(1, "text", "c", "", "????", None, "fine words", True, None), (2, "text", "c", "", "fine words", None, "better", True, None), (3, "text", "c", "", "????", None, "fine", False, None), (4, "text", "c", "", None, None, None, None, "OSError: x")], "id long, category string, crop_path string, hint string, ocr string, math string, rescue string, rescue_asked boolean, ocr_error string")
    got = {r.id: r for r in decode.cascade(df).collect()}
    assert got[1].rescued and got[2].decoded == "better" and not got[3].rescued and got[4].decoder == "error:OSError"


def test_images():
    page = np.full((300, 400, 3), 255, np.uint8)
    assert images.background(page) == (255, 255, 255) and not images.ink_mask(page).any()
    page[50:120, 60:160] = 20
    page[150, :] = 0  # a rule
    mask = images.ink_mask(page)
    assert not mask[150].any() and mask[60, 100]
    assert images.components(np.array([[1, 0, 1], [0, 1, 0], [0, 0, 0], [1, 0, 0]], bool)) == [(0, 0, 3, 2), (0, 3, 1, 4)]
    boxes, unsure = images.figures(page)
    assert len(boxes) == 1 and not unsure and boxes[0][0] <= 60 and boxes[0][2] >= 160
    assert (images.residual(page, [{"category": "text", "box": (60, 50, 160, 120)}])[40:130, 50:170] == 255).all()
    assert images.crop(page, (60, 50, 160, 120), 8).shape == (86, 116, 3) and images.crop(page, (5, 5, 5, 5), 0) is None
    sheet, regions = images.contact_sheet([page[50:120, 60:160], page[:40]])
    assert sheet.shape == (70 + 40 + 2 * 42, 416, 3) and (sheet[34:104, 8:108] == page[50:120, 60:160]).all() and regions[1][1] == 112 + 34
    many = np.full((1000, 1000, 3), 255, np.uint8)
    for k in range(36):
        many[20 + k // 6 * 160 : 100 + k // 6 * 160, 20 + k % 6 * 160 : 110 + k % 6 * 160] = 10
    assert images.figures(many) == ([], True)


def plain_parts(mask):
    """Extents of the 8-connected parts, pixel by pixel."""
    todo, out = {(int(y), int(x)) for y, x in zip(*np.nonzero(mask), strict=True)}, []
    while todo:
        part = stack = [todo.pop()]
        for y, x in stack:
            near = {(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)} & todo
            todo -= near
            stack += near
        ys, xs = zip(*part, strict=True)
        out.append((min(xs), min(ys), max(xs) + 1, max(ys) + 1))
    return sorted(out)


def pages_of_frames(n):
    for k in range(n):
        page = np.full((280, 200, 3), 250, np.uint8)
        for x, y in ((12, 10 + k % 5), (108, 20), (12, 60), (14, 120 + k % 7), (108, 150)):
            page[y : y + 8 + 4 * (k % 3), x : x + 60 + k % 28] = 30
            page[y + 1 : y + 7, x + 1 : x + 59] = 250
        yield page


def test_image_kernels_equal_plain():
    rng = np.random.default_rng(5)
    for k in range(60):
        mask = rng.random(rng.integers(1, 30, 2)) < (0.1, 0.4, 0.7, 1.0)[k % 4]
        assert sorted(images.components(mask)) == plain_parts(mask)
        page = rng.integers(0, 256, (40, 50, 3)).astype(np.uint8) if k % 2 else np.repeat(rng.integers(100, 256, (40, 50, 1)), 3, axis=2).astype(np.uint8)
        r, g, b = page.reshape(-1, 3).astype(np.int64).T
        assert (images.luminance(page).ravel() == (r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16).all()
        light = page.reshape(-1, 3)[(page.min(axis=2) >= 180).ravel() & (np.ptp(page, axis=2) <= 20).ravel()]
        assert not len(light) or images.background(page) == tuple(int(np.median(c)) for c in light.T)
        x, y, w, h = (int(v) for v in rng.integers(2, 30, 4))
        ys, xs = np.mgrid[:40, :50]
        far = np.maximum(np.maximum(x - xs, xs - x - w), 0) ** 2 + np.maximum(np.maximum(y - ys, ys - y - h), 0) ** 2
        quad = [x, y, x + w, y, x + w, y + h, x, y + h]
        for grow in (0, 3, 4):
            upright, turned = np.zeros((2, 40, 50), bool)
            images.fill_quad(upright, quad, grow)
            images.fill_quad(turned, quad[2:] + quad[:2], grow)  # not upright to the code
            assert (upright == (far <= grow**2)).all() and (turned == upright).all()
        left = images.residual(page, [{"category": "figure", "quad": quad}], everything=True)
        assert (left == np.where((far <= 9)[..., None], images.background(page), page)).all()
        cut = images.union_crop(page, [quad, quad], 0)
        assert (cut == page[y : min(40, y + h), x : min(50, x + w)]).all()
    assert (images.residual(page, [{"category": "text", "box": (5, -90, 20, -60)}]) == page).all()


def test_image_kernels_take_little_time():
    """A hundred pages took over two seconds."""
    quad = [12.0, 10.0, 80.0, 10.0, 80.0, 24.0, 12.0, 24.0]

    def took():
        began = time.perf_counter()
        for page in pages_of_frames(100):
            assert len(images.components(images.ink_mask(page))) >= 5
            images.figures(page)
            assert images.background(page) == (250, 250, 250)
            assert images.residual(page, [{"category": "text", "quad": quad}] * 4)[12, 12, 0] == 250
            assert images.union_crop(page, [quad] * 4, 4).shape == (22, 76, 3)
        return time.perf_counter() - began

    assert min(took() for _ in range(3)) < 1.0


def test_units_of_many_pages_in_one_batch(spark):
    """Pages beside each other don't touch, and a thousand of them took over two seconds."""
    rnd, pages = random.Random(7), []
    for _ in range(5):
        blocks = [(f"b{k}", rnd.choice(("text", "text", "math", "figure")), "b", rnd.random(), x := float(rnd.choice((60, 540))), y := 40.0 + 40 * k + rnd.randrange(7), x + 300.0 + rnd.randrange(90), y + 24.0 + rnd.randrange(12)) for k in range(6)]
        pages.append([*blocks, ("c", *blocks[0][1:])])
    names = ["id", "category", "source_label", "score", "x1", "y1", "x2", "y2"]

    def units(pages):
        ends, cols = np.cumsum([0, *map(len, pages)]), dict(zip(names, map(list, zip(*sum(pages, []), strict=True)), strict=True))
        return [(n + k, *u) for n, p in layout._in_parts(ends, cols) for k, *u in layout._units(p, [0] * int(ends[-1]), W, H)]

    alone = [units([p]) for p in pages]
    assert any(len(u[7]) > 1 for a in alone for u in a) and all("c" not in u[7] for a in alone for u in a)
    began = time.perf_counter()
    assert units(pages * 200) == [(k, *u[1:]) for k in range(1000) for u in alone[k % 5]]
    assert time.perf_counter() - began < 1.5


def test_convexity_and_rotation(spark):
    df = spark.createDataFrame([([0.0, 0.0, 9.0, 0.0, 9.0, 9.0, 0.0, 9.0],), ([0.0, 0.0, 0.0, 9.0, 9.0, 9.0, 9.0, 0.0],), ([0.0, 0.0, float("nan"), 0.0, 9.0, 9.0, 0.0, 9.0],), ([1.0],)], "q array<double>")
    assert [r[0] for r in df.select(G.quad_valid(F.col("q"), 100, 100)).collect()] == [True, False, False, False]
    one = spark.range(1).select(G.rotated_quad(F.lit(10.0), F.lit(10.0), F.lit(8.0), F.lit(4.0), F.lit(90.0)).alias("q")).first().q
    assert one == pytest.approx([8, 6, 12, 6, 12, 14, 8, 14])


def test_entry_and_catalogue(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 110
