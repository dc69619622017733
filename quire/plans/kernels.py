"""Queries over provider readers, the decode cascade and the kernels.

Greedy, recursive, stack-based and pixel operators have no SQL; their expected values
are in the tests.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import latex
from quire.functions import text as X
from quire.operators import calls, decode, images, layout
from quire.plans.fixtures import PAGE_H, PAGE_W, fx
from quire.plans.registry import query
from quire.sources import provider


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("g09_polygon_clip", "SELECT a.page, a.id, b.id AS id_b, round(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)), 6) AS shared FROM fx_blocks a JOIN fx_blocks b ON a.page = b.page AND b.ord = a.ord + 1")
def g09(spark, d):
    b = fx(spark, d, "blocks").select("page", "ord", "id", G.quad_of(layout.box_of()).alias("q"))
    n = b.select("page", (F.col("ord") - 1).alias("ord"), F.col("id").alias("id_b"), F.col("q").alias("q_b"))

    return b.join(n, ["page", "ord"]).select("page", "id", "id_b", F.round(layout.shared_quads("q", "q_b"), 6).alias("shared"))


_AREA = "((b.x2 - b.x1) * (b.y2 - b.y1))"
_MEET = "greatest(0, least(b.x2, o.x2) - greatest(b.x1, o.x1)) * greatest(0, least(b.y2, o.y2) - greatest(b.y1, o.y1))"


@query("w01_greedy_nms", f"""
WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, id) AS k FROM fx_blocks b WHERE NOT EXISTS (SELECT 1 FROM fx_blocks o WHERE o.page = b.page AND o.id <> b.id AND b.category = 'text' AND o.category IN ('figure', 'table')
    AND o.source_label NOT IN ('residual_background', 'local_source_fragment') AND {_MEET} / greatest(1, {_AREA}) >= .82)),
rivals AS (SELECT b.page, b.k, list(o.k) AS before FROM e b JOIN e o ON o.page = b.page AND o.k < b.k AND o.category = b.category AND 'residual_background' NOT IN (b.source_label, o.source_label)
  AND abs((b.y1 + b.y2) / 2 - (o.y1 + o.y2) / 2) <= .15 * least(b.y2 - b.y1, o.y2 - o.y1) AND {_MEET} / greatest(1, {_AREA}) >= .9 AND {_MEET} / greatest(1, (o.x2 - o.x1) * (o.y2 - o.y1)) >= .9 GROUP BY b.page, b.k),
n AS (SELECT e.page, e.k, coalesce(before, []) AS before FROM e LEFT JOIN rivals r ON r.page = e.page AND r.k = e.k),
fold AS (SELECT DISTINCT page, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept FROM e
  UNION ALL SELECT n.page, n.k, CASE WHEN len(list_intersect(n.before, kept)) = 0 THEN list_append(kept, n.k) ELSE kept END FROM fold f JOIN n ON n.page = f.page AND n.k = f.k + 1),
last AS (SELECT page, arg_max(kept, k) AS kept FROM fold GROUP BY page)
SELECT e.page, e.id, row_number() OVER (PARTITION BY e.page ORDER BY (y1 + y2) / 2, x1, id) - 1 AS ord FROM e JOIN last l ON l.page = e.page WHERE list_contains(l.kept, e.k)""")
def w01(spark, d):
    return layout.greedy_nms(fx(spark, d, "blocks").select("page", "id", "category", "source_label", "score", "x1", "y1", "x2", "y2"), "page")


@query("w02_line_groups")
def w02(spark, d):
    return layout.build_units(fx(spark, d, "blocks").select("page", "id", "category", "source_label", "score", "x1", "y1", "x2", "y2"), "page", PAGE_W, PAGE_H)


@query("w04_reading_order")
def w04(spark, d):
    return layout.with_reading_order(fx(spark, d, "blocks").select("page", "id", "x1", "y1", "x2", "y2"), "page", PAGE_W)


_OPEN = r"""(SELECT id, content, coalesce(list_min(run) >= 0 AND run[-1] = 0, true) AS closed FROM (SELECT id, content, list_transform(range(1, len(cs) + 1), lambda i: list_sum(list_transform(cs[1:i], lambda c: CASE WHEN c = '{' THEN 1 ELSE -1 END))) AS run
  FROM (SELECT id, content, list_filter(string_split(regexp_replace(content, '\\.', '', 'g'), ''), lambda c: c IN ('{', '}')) AS cs FROM fx_math)))"""


@query("x08_math_syntax", f"SELECT id, CASE WHEN NOT closed THEN 'unbalanced LaTeX braces' END AS error FROM {_OPEN}")
def x08(spark, d):
    return fx(spark, d, "math").select("id", latex.math_syntax_error(F.col("content")).alias("error"))


@query("x09_text_syntax", rf"SELECT id, CASE WHEN id % 2 = 0 THEN CASE WHEN NOT closed THEN 'unbalanced LaTeX braces' END WHEN regexp_matches(content, '\\(frac|sqrt)') THEN 'mathematical command outside a math delimiter' END AS error FROM {_OPEN}")
def x09(spark, d):
    both = fx(spark, d, "math").select("id", "content", F.when(F.col("id") % 2 == 0, "math").otherwise("text").alias("category"))
    return both.select("id", latex.syntax_error(F.col("category"), F.col("content")).alias("error"))


@query("x11_clean_math", r"SELECT id, regexp_replace(content, '^\s+|\s+$', '', 'g') AS formula FROM fx_math")
def x11(spark, d):
    return fx(spark, d, "math").select("id", latex.clean_math(F.col("content")).alias("formula"))


_RAW = """(SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN '{"choices": [{"message": {"content": "  ' || event_type || ' "}}]}' WHEN 1 THEN '{"choices": [{"message": {"content": [{"text": "' || event_type || '"}, "b", {"image": 1}]}}]}'
  WHEN 2 THEN '{"choices": []}' WHEN 3 THEN 'no json' ELSE '{"choices": [{"message": {"content": "x"}}]}' END AS raw FROM events)"""


@query("n01_extract_text", f"""SELECT id, CASE id % 5 WHEN 0 THEN trim(json_extract_string(j, '$.choices[0].message.content')) WHEN 1 THEN json_extract_string(j, '$.choices[0].message.content[0].text') || chr(10) || json_extract_string(j, '$.choices[0].message.content[1]')
  WHEN 4 THEN json_extract_string(j, '$.choices[0].message.content') END AS text FROM (SELECT id, try_cast(raw AS JSON) AS j FROM {_RAW})""")
def n01(spark, d):
    e = _t(spark, d, "events")
    k = F.col("event_id") % 5
    raw = (
        F.when(k == 0, F.concat(F.lit('{"choices": [{"message": {"content": "  '), "event_type", F.lit(' "}}]}')))
        .when(k == 1, F.concat(F.lit('{"choices": [{"message": {"content": [{"text": "'), "event_type", F.lit('"}, "b", {"image": 1}]}}]}')))
        .when(k == 2, '{"choices": []}').when(k == 3, "no json").otherwise('{"choices": [{"message": {"content": "x"}}]}')
    )
    return e.select(F.col("event_id").alias("id"), provider.message_text(raw).alias("text"))


_LIST = r"""(SELECT page, CASE WHEN len(list_filter(rows, lambda r: NOT coalesce(len(r) = 5 AND r[1] BETWEEN 0 AND 1000 AND r[2] BETWEEN 0 AND 1000 AND r[3] > 0 AND r[4] > 0 AND r[5] BETWEEN -90 AND 90, false))) = 0 THEN rows ELSE [] END AS rows FROM (
  SELECT page, list_transform(list_filter(string_split(regexp_replace(regexp_replace(content, '(?i)^`{3}(?:csv|text)?\s*', ''), '\s*`{3}$', ''), chr(10)), lambda x: trim(x) <> ''), lambda x: list_transform(string_split(x, ','), lambda f: try_cast(trim(f) AS DOUBLE))) AS rows FROM fx_csv))"""


@query("n05_csv_layout", f"SELECT page, CAST(k - 1 AS BIGINT) AS ord, r[1] AS cx, r[2] AS cy, r[3] AS w, r[4] AS h, r[5] AS angle FROM (SELECT page, unnest(rows) AS r, generate_subscripts(rows, 1) AS k FROM {_LIST})")
def n05(spark, d):
    rows = fx(spark, d, "csv").select("page", F.posexplode(provider.listing(F.col("content"))).alias("ord", "r"))
    return rows.select("page", F.col("ord").cast("long").alias("ord"), *(F.col("r")[i].alias(c) for i, c in enumerate(("cx", "cy", "w", "h", "angle"))))


@query("n06_words", f"""
SELECT page, ord, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM (SELECT page, ord, greatest(0, (cx - dx)) AS x1, least(1000, cx + dx) AS x2, greatest(0, (cy - dy) * 1.4) AS y1, least(1400, (cy + dy) * 1.4) AS y2 FROM (
  SELECT page, ord, r[1] AS cx, r[2] AS cy, (abs(r[3] * cos(radians(r[5]))) + abs(r[4] * sin(radians(r[5])))) / 2 AS dx, (abs(r[3] * sin(radians(r[5]))) + abs(r[4] * cos(radians(r[5])))) / 2 AS dy
  FROM (SELECT page, unnest(rows) AS r, CAST(generate_subscripts(rows, 1) - 1 AS BIGINT) AS ord FROM {_LIST}))) WHERE x2 - x1 >= 2 AND y2 - y1 >= 2""")
def n06(spark, d):
    rows = fx(spark, d, "csv").select("page", F.posexplode(provider.listing(F.col("content"))).alias("ord", "r"))
    b = G.denormalise(F.col("r"), PAGE_W, PAGE_H, F.lit(True))
    flat = rows.select("page", F.col("ord").cast("long").alias("ord"), b.alias("b")).select("page", "ord", "b.x1", "b.y1", "b.x2", "b.y2")
    return layout.valid_geometry(flat, PAGE_W, PAGE_H).select("page", "ord", *(F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")))


@query("n12_router_answer", "SELECT event_id AS id, CASE WHEN event_id % 7 = 0 OR event_id % 5 = 0 THEN NULL ELSE (event_id % 11) / 10 >= .5 END AS rescue FROM events")
def n12(spark, d):
    i = F.col("event_id")
    raw = F.when(i % 5 == 0, F.lit('{"answers": {}}')).otherwise(F.format_string('{"answers": {"rescue": {"noul": %.1f}}}', (i % 11) / 10))
    return _t(spark, d, "events").select(i.alias("id"), provider.router_answer(raw, F.when(i % 7 == 0, 503).otherwise(200)).alias("rescue"))


@query("n13_unsupported_field", "SELECT event_id AS id, event_id % 4 < 2 AND event_id % 3 = 0 AS unsupported FROM events")
def n13(spark, d):
    i = F.col("event_id")
    text = F.concat(F.when(i % 4 < 2, "HTTP 400: ").otherwise("HTTP 500: "), F.when(i % 3 == 0, "Unknown field ocr_options").otherwise("bad request"))
    return _t(spark, d, "events").select(i.alias("id"), provider.unsupported_field(text).alias("unsupported"))


@query("m09_decode_cascade")
def m09(spark, d):
    i = F.col("id")
    u = fx(spark, d, "math").select(
        "id", F.when(i % 9 == 0, "figure").when(i % 9 == 1, "unknown").when(i % 9 == 2, "math").otherwise("text").alias("category"), F.when(i % 13 == 3, "").otherwise("crop.png").alias("crop_path"),
        F.when(i % 4 == 1, F.col("content")).otherwise("").alias("hint"), F.when(i % 10 == 7, None).otherwise(F.col("content")).alias("ocr"), F.when(i % 8 == 5, None).otherwise(F.concat(F.lit("{"), "content", F.lit("}"))).alias("math"),
        F.when(i % 3 == 0, None).otherwise(F.concat("content", F.lit("="))).alias("rescue"),
    )
    out = decode.cascade(u)
    return out.withColumn("score", F.round("score", 6))


@query("m10_layout_cascade", """
WITH a AS (SELECT * FROM fx_blocks WHERE page % 3 <> 0), good AS (SELECT page FROM a GROUP BY page HAVING round(avg(score), 6) >= .05 AND count(*) >= 2)
SELECT page, id, 0 AS layer FROM a WHERE page IN (SELECT page FROM good) UNION ALL SELECT page, id, 1 AS layer FROM fx_blocks WHERE page NOT IN (SELECT page FROM good) AND ord % 2 = 0""")
def m10(spark, d):
    b = fx(spark, d, "blocks").select("page", "ord", "id", "score")
    pages = _t(spark, d, "orders").select(F.col("o_orderkey").alias("page"))
    pages = pages.unionByName(b.select("page")).distinct()
    return decode.layout_cascade(pages, [b.where("page % 3 <> 0"), b.where("ord % 2 = 0")], ["page"], (F.round("quality", 6) >= 0.05) & (F.col("n_blocks") >= 2)).select("page", "id", "layer")


def _drawn(rows: list, scale: float = 0.2) -> np.ndarray:
    """A page on which each block is a frame, a figure a filled one."""
    page = np.full((int(PAGE_H * scale), int(PAGE_W * scale), 3), 250, np.uint8)
    for r in rows:
        x1, y1, x2, y2 = (int(v * scale) for v in (r.x1, r.y1, r.x2, r.y2))
        page[y1:y2, x1:x2] = 30
        if r.category != "figure":
            page[y1 + 1 : y2 - 1, x1 + 1 : x2 - 1] = 250
    return page


def _by_page(spark, d, f, schema: str):
    cols = ["id", "category", "x1", "y1", "x2", "y2"]
    return layout.per_page(fx(spark, d, "blocks"), ["page"], cols, f, schema)


def _fifth(r) -> tuple:
    return r.x1 / 5, r.y1 / 5, r.x2 / 5, r.y2 / 5


@query("i01_crop", "SELECT page, id, CAST(floor(least(280, y2 / 5 + 2)) - floor(greatest(0, y1 / 5 - 2)) AS INT) AS height, CAST(floor(least(200, x2 / 5 + 2)) - floor(greatest(0, x1 / 5 - 2)) AS INT) AS width FROM fx_blocks")
def i01(spark, d):
    def run(rows):
        page = _drawn(rows)
        return [(r.id, *images.crop(page, _fifth(r), 2).shape[:2]) for r in rows]

    return _by_page(spark, d, run, "id string, height int, width int")


@query("i06_residual")
def i06(spark, d):
    def run(rows):
        page = _drawn(rows)
        left = images.residual(page, [{"category": r.category, "box": _fifth(r)} for r in rows])
        return [(int(np.count_nonzero(page < 100)), int(np.count_nonzero(left < 100)))]

    return _by_page(spark, d, run, "dark_before bigint, dark_after bigint")


@query("i07_ink_mask")
def i07(spark, d):
    return _by_page(spark, d, lambda rows: [(int(np.count_nonzero(images.ink_mask(_drawn(rows)))),)], "ink bigint")


@query("i08_components")
def i08(spark, d):
    return _by_page(spark, d, lambda rows: [(len(images.components(images.ink_mask(_drawn(rows)))),)], "parts bigint")


@query("i09_figures")
def i09(spark, d):
    def run(rows):
        boxes, unsure = images.figures(_drawn([r for r in rows if r.category == "figure"]))
        return [(len(boxes), unsure)]

    return _by_page(spark, d, run, "figures bigint, uncertain boolean")


@query("i10_contact_sheet", "SELECT page, CAST(greatest(320, max(w) + 16) AS INT) AS width, CAST(sum(h + 42) AS INT) AS height, CAST(count(*) AS INT) AS regions FROM (SELECT page, floor(least(280, y2 / 5 + 2)) - floor(greatest(0, y1 / 5 - 2)) AS h, floor(least(200, x2 / 5 + 2)) - floor(greatest(0, x1 / 5 - 2)) AS w FROM fx_blocks) GROUP BY page")
def i10(spark, d):
    def run(rows):
        page = _drawn(rows)
        sheet, regions = images.contact_sheet([images.crop(page, _fifth(r), 2) for r in rows])
        return [(sheet.shape[1], sheet.shape[0], len(regions))]

    return _by_page(spark, d, run, "width int, height int, regions int")


_SIDES = "SELECT page, floor(x2 / 5) - floor(x1 / 5) AS w, floor(y2 / 5) - floor(y1 / 5) AS h, ord FROM fx_blocks"


def _corners(r) -> list[float]:
    x1, y1, x2, y2 = (float(int(v)) for v in _fifth(r))
    return [x1, y1, x2, y1, x2, y2, x1, y2]


@query("i02_straightened_line", f"SELECT page, ord AS n, CAST(w AS INT) AS width, CAST(h AS INT) AS height FROM ({_SIDES})")
def i02(spark, d):
    def run(rows):
        page = _drawn(rows)
        lines = [images.straightened(page, _corners(r)) for r in sorted(rows, key=lambda r: r.id)]
        return [(k, x.shape[1], x.shape[0]) for k, x in enumerate(lines)]

    return _by_page(spark, d, run, "n bigint, width int, height int")


@query("i03_packed_crop", f"SELECT page, CAST(max(w) + 16 AS INT) AS width, CAST(sum(h) + 8 * (count(*) - 1) + 16 AS INT) AS height FROM ({_SIDES}) GROUP BY page")
def i03(spark, d):
    def run(rows):
        out = images.packed_crop(_drawn(rows), [_corners(r) for r in rows], 8)
        return [(out.shape[1], out.shape[0])]

    return _by_page(spark, d, run, "width int, height int")


@query("i04_union_crop", "SELECT page, CAST(least(200, floor(max(x2) / 5)) - floor(min(x1) / 5) + 8 AS INT) AS width, CAST(least(280, floor(max(y2) / 5)) - floor(min(y1) / 5) + 8 AS INT) AS height FROM fx_blocks GROUP BY page")
def i04(spark, d):
    def run(rows):
        out = images.union_crop(_drawn(rows), [_corners(r) for r in rows], 4)
        return [(out.shape[1], out.shape[0])]

    return _by_page(spark, d, run, "width int, height int")


@query("i05_review_crop", "SELECT page, id, CAST(least(200, ceil(x2 + p)) - greatest(0, floor(x1 - p)) AS INT) AS width, CAST(least(280, ceil(y2 + q)) - greatest(0, floor(y1 - q)) AS INT) AS height FROM (SELECT *, 8 AS p, least(greatest(8, 1.25 * (y2 - y1)), 0.04::DOUBLE * 280) AS q FROM (SELECT page, id, x1 / 5 AS x1, y1 / 5 AS y1, x2 / 5 AS x2, y2 / 5 AS y2 FROM fx_blocks))")
def i05(spark, d):
    b = fx(spark, d, "blocks").select("page", "id", "category", *(F.col(c) / 5 for c in ("x1", "y1", "x2", "y2"))).toDF("page", "id", "category", "x1", "y1", "x2", "y2")
    w = G.review_window(layout.box_of(), G.line_height(F.lit(None).cast("array<array<double>>"), layout.box_of(), PAGE_W / 5, PAGE_H / 5), PAGE_W / 5, PAGE_H / 5)["window"]
    framed = b.withColumn("w", w).select("page", "id", "category", "x1", "y1", "x2", "y2", *(F.col("w")[c].alias(f"w{c}") for c in ("x1", "y1", "x2", "y2")))

    def run(rows):
        page = _drawn(rows, 1.0)[: PAGE_H // 5, : PAGE_W // 5]
        crops = [images.crop(page, (r.wx1, r.wy1, r.wx2, r.wy2), 0) for r in rows]
        return [(r.id, c.shape[1], c.shape[0]) for r, c in zip(rows, crops, strict=True)]

    return layout.per_page(framed, ["page"], framed.columns[1:], run, "id string, width int, height int")


@query("i12_diagnostic_residual", "SELECT page, CAST(0 AS BIGINT) AS dark FROM fx_blocks GROUP BY page")
def i12(spark, d):
    def run(rows):
        left = images.residual(_drawn(rows), [{"category": r.category, "quad": _corners(r)} for r in rows], everything=True)
        return [(int(np.count_nonzero(left < 100)),)]

    return _by_page(spark, d, run, "dark bigint")


@query("a15_background", "SELECT page, 250 AS r, 250 AS g, 250 AS b FROM fx_blocks GROUP BY page")
def a15(spark, d):
    return _by_page(spark, d, lambda rows: [images.background(_drawn(rows))], "r int, g int, b int")


@query("i11_data_url", "SELECT vec_id AS id, 'data:image/png;base64,iVBORw0KGgo' AS head FROM embeddings")
def i11(spark, d):
    """Each picture is a real one: four grey pixels by the vector's label."""
    grey = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    pictures = provider.mapped(grey, ["id"], ["label"], lambda v: [(images.png_bytes(np.full((2, 2), v % 256, np.uint8)),)], "png binary")
    return pictures.select("id", F.left(calls.data_url(F.col("png")), F.lit(33)).alias("head"))
