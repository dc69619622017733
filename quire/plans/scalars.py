"""Queries over geometry and text functions, one for each of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as X
from quire.plans.fixtures import PAGE_H, PAGE_W, fx
from quire.plans.registry import query

R = 6
_AREA = "greatest(0, x2 - x1) * greatest(0, y2 - y1)"


def _b(suffix: str = ""):
    return G.box(f"x1{suffix}", f"y1{suffix}", f"x2{suffix}", f"y2{suffix}")


def _flat(b, names=("x1", "y1", "x2", "y2")):
    return [F.round(b[n], R).alias(n) for n in names]


@query("p01_label_category", f"""
SELECT id, raw, CASE WHEN k IN {X.MATH_LABELS} THEN 'math' WHEN k IN ('table') THEN 'table' WHEN k IN {X.FIGURE_LABELS} THEN 'figure' WHEN k IN {X.TEXT_LABELS} THEN 'text' ELSE 'unknown' END AS category
FROM (SELECT *, replace(replace(lower(trim(raw)), ' ', '_'), '-', '_') AS k FROM fx_labels)""")
def p01(spark, d):
    return fx(spark, d, "labels").select("id", "raw", X.label_category(F.col("raw")).alias("category"))


_LOOKS = r"""(v <> '' AND len(list_filter(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(v, '\\(?:begin|end)\{[^}]+\}', ' ', 'g'), '\\(?:text|textrm|mathrm|operatorname)\{[^}]*\}', ' ', 'g'), '\\[A-Za-z]+', ' ', 'g'), '\p{L}{3,}'),
  lambda w: lower(w) NOT IN WORDS)) = 0 AND ((contains(v, '=') AND length(v) <= 80 AND (al <= 16 OR dg > 0)) OR sy >= 3 OR (al <= 3 AND dg >= 2 AND sy >= 1)))""".replace("WORDS", str(X.MATH_WORDS_SHORT))
_COUNTS = r"length(v) - length(regexp_replace(v, '\p{L}', '', 'g')) AS al, length(v) - length(regexp_replace(v, '\p{Nd}', '', 'g')) AS dg, length(v) - length(regexp_replace(v, '[-=+×÷∫∑√∞≈≠≤≥^_()\[\]{}|<>∂∆λμπσθΩ]', '', 'g')) AS sy"


@query("p02_raw_category", f"""
SELECT id, CASE WHEN k IN ('math','formula','equation','matrix') THEN 'math' WHEN k IN ('table','tabular') THEN 'table' WHEN k IN ('text','title','heading','paragraph','label') THEN 'text' WHEN {_LOOKS} THEN 'math' ELSE 'text' END AS category
FROM (SELECT *, {_COUNTS} FROM (SELECT id, lower(trim(raw)) AS k, trim(hint) AS v FROM fx_rawcat))""")
def p02(spark, d):
    return fx(spark, d, "rawcat").select("id", X.raw_category(F.col("raw"), F.col("hint")).alias("category"))


@query("x02_looks_math", f"SELECT id, {_LOOKS} AS looks_math FROM (SELECT id, v, {_COUNTS} FROM (SELECT id, trim(content) AS v FROM fx_math))")
def x02(spark, d):
    return fx(spark, d, "math").select("id", X.looks_math(F.col("content")).alias("looks_math"))


@query("g01_bbox_metrics", f"SELECT page, id, greatest(0, x2 - x1) AS width, greatest(0, y2 - y1) AS height, {_AREA} AS area FROM (SELECT page, id, x1, y1, x2 - CASE WHEN pk % 11 = 0 THEN 500 ELSE 0 END AS x2, y2 FROM fx_blocks)")
def g01(spark, d):
    b = G.box(F.col("x1"), F.col("y1"), F.col("x2") - F.when(F.col("pk") % 11 == 0, 500).otherwise(0), F.col("y2"))
    return fx(spark, d, "blocks").select("page", "id", G.width(b).alias("width"), G.height(b).alias("height"), G.area(b).alias("area"))


@query("g03_expand_clamp", "SELECT page, id, greatest(0, least(1000, x1 - 70)) AS x1, greatest(0, least(1400, y1 - 70)) AS y1, greatest(0, least(1000, x2 + 70)) AS x2, greatest(0, least(1400, y2 + 70)) AS y2 FROM fx_blocks")
def g03(spark, d):
    return fx(spark, d, "blocks").select("page", "id", *_flat(G.expand(_b(), 70, PAGE_W, PAGE_H)))


def _pairs(spark, d):
    """Blocks of a page with the one that follows."""
    b = fx(spark, d, "blocks")
    a = b.select("page", "ord", "id", "category", "x1", "y1", "x2", "y2")
    n = b.select("page", (F.col("ord") - 1).alias("ord"), *(F.col(c).alias(f"{c}_b") for c in ("id", "category", "x1", "y1", "x2", "y2")))
    return a.join(n, ["page", "ord"])


_PAIR = "(SELECT a.page, a.id, a.category, a.x1, a.y1, a.x2, a.y2, b.id AS id_b, b.category AS category_b, b.x1 AS u1, b.y1 AS v1, b.x2 AS u2, b.y2 AS v2 FROM fx_blocks a JOIN fx_blocks b ON a.page = b.page AND b.ord = a.ord + 1)"
_IW, _IH = "greatest(0, least(x2, u2) - greatest(x1, u1))", "greatest(0, least(y2, v2) - greatest(y1, v1))"


@query("g05_intersection", f"SELECT page, id, id_b, {_IW} * {_IH} AS shared, round(CASE WHEN (x2 - x1) * (y2 - y1) <= 0 THEN 0 ELSE {_IW} * {_IH} / ((x2 - x1) * (y2 - y1)) END, 6) AS fraction FROM {_PAIR}")
def g05(spark, d):
    a, b = _b(), _b("_b")
    return _pairs(spark, d).select("page", "id", "id_b", G.intersection_area(a, b).alias("shared"), F.round(G.contained_fraction(a, b), R).alias("fraction"))


@query("g06_h_overlap", f"SELECT page, id, id_b, round({_IW} / least(x2 - x1, u2 - u1), 6) AS overlap FROM {_PAIR}")
def g06(spark, d):
    return _pairs(spark, d).select("page", "id", "id_b", F.round(G.horizontal_overlap(_b(), _b("_b")), R).alias("overlap"))


@query("g04_union", f"SELECT page, id, id_b, least(x1, u1) AS x1, least(y1, v1) AS y1, greatest(x2, u2) AS x2, greatest(y2, v2) AS y2 FROM {_PAIR}")
def g04(spark, d):
    return _pairs(spark, d).select("page", "id", "id_b", *_flat(G.union(_b(), _b("_b"))))


@query("g07_normalize", "SELECT page, id, round(x1 / 1000, 6) AS x1, round(y1 / 1400, 6) AS y1, round(x2 / 1000, 6) AS x2, round(y2 / 1400, 6) AS y2 FROM fx_blocks")
def g07(spark, d):
    n = G.normalize(_b(), PAGE_W, PAGE_H)
    return fx(spark, d, "blocks").select("page", "id", *(F.round(n[i], R).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))))


_SHOE = "(q[1]*q[4]-q[3]*q[2] + q[3]*q[6]-q[5]*q[4] + q[5]*q[8]-q[7]*q[6] + q[7]*q[2]-q[1]*q[8])"


@query("g08_signed_area", f"SELECT id, round({_SHOE} / 2, 6) AS area FROM (SELECT id, quad AS q FROM fx_quads)")
def g08(spark, d):
    return fx(spark, d, "quads").select("id", F.round(G.signed_area(F.col("quad")), R).alias("area"))


@query("g11_ordered_polygon", f"""
SELECT id, list_transform(range(0, 8), lambda i: q[((f + CASE WHEN s >= 0 THEN i // 2 ELSE 4 - i // 2 END) % 4) * 2 + 1 + i % 2]) AS quad FROM (
  SELECT id, q, {_SHOE} AS s, CASE WHEN q[1]+q[2] <= least(q[3]+q[4], q[5]+q[6], q[7]+q[8]) THEN 0 WHEN q[3]+q[4] <= least(q[5]+q[6], q[7]+q[8]) THEN 1 WHEN q[5]+q[6] <= q[7]+q[8] THEN 2 ELSE 3 END AS f
  FROM (SELECT id, quad AS q FROM fx_quads))""")
def g11(spark, d):
    return fx(spark, d, "quads").select("id", G.ordered_quad(F.col("quad")).alias("quad"))


@query("g11b_envelope", "SELECT id, least(q[1], q[3], q[5], q[7]) AS x1, least(q[2], q[4], q[6], q[8]) AS y1, greatest(q[1], q[3], q[5], q[7]) AS x2, greatest(q[2], q[4], q[6], q[8]) AS y2 FROM (SELECT id, quad AS q FROM fx_quads)")
def g11b(spark, d):
    return fx(spark, d, "quads").select("id", *_flat(G.envelope(F.col("quad"))))


_ROT = "(SELECT l_orderkey AS page, l_partkey AS pk, l_linenumber AS ln, l_suppkey AS sk, CAST(l_partkey % 1000 AS DOUBLE) AS cx, CAST(l_suppkey % 900 AS DOUBLE) AS cy, CAST(l_partkey % 200 - 5 AS DOUBLE) AS w, CAST(10 + l_linenumber AS DOUBLE) AS h, CAST(l_partkey % 13 * 15 - 90 AS DOUBLE) AS ang FROM lineitem)"


@query("g10_rotated_polygon", f"""
SELECT page, pk, ln, sk, round(min(x), 6) AS x1, round(max(x), 6) AS x2, round(min(y), 6) AS y1, round(max(y), 6) AS y2, count(*) AS n FROM (
  SELECT *, cx + w * sx * cos(radians(ang)) - h * sy * sin(radians(ang)) AS x, cy + w * sx * sin(radians(ang)) + h * sy * cos(radians(ang)) AS y
  FROM {_ROT} CROSS JOIN (VALUES (-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)) c(sx, sy) WHERE w > 0) GROUP BY page, pk, ln, sk""")
def g10(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    c = lambda e: e.cast("double")
    q = G.rotated_quad(c(F.col("l_partkey") % 1000), c(F.col("l_suppkey") % 900), c(F.col("l_partkey") % 200 - 5), c(10 + F.col("l_linenumber")), c(F.col("l_partkey") % 13 * 15 - 90))
    rows = li.select(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("pk"), F.col("l_linenumber").alias("ln"), F.col("l_suppkey").alias("sk"), q.alias("q")).where("q IS NOT NULL")
    e = G.envelope(F.col("q"))
    flat = rows.select("page", "pk", "ln", "sk", e.alias("e"))
    # repeated keys are one row of extremes, four corners each
    agg = flat.groupBy("page", "pk", "ln", "sk").agg(F.min("e.x1").alias("x1"), F.max("e.x2").alias("x2"), F.min("e.y1").alias("y1"), F.max("e.y2").alias("y2"), (F.count("*") * 4).alias("n"))
    return agg.select("page", "pk", "ln", "sk", *(F.round(v, R).alias(v) for v in ("x1", "x2", "y1", "y2")), "n")


_ENDS = """CASE WHEN s0 + s2 <= s1 + s3 THEN {'x': (q[1]+q[3])/2, 'y': (q[2]+q[4])/2} ELSE {'x': (q[3]+q[5])/2, 'y': (q[4]+q[6])/2} END AS e1,
  CASE WHEN s0 + s2 <= s1 + s3 THEN {'x': (q[5]+q[7])/2, 'y': (q[6]+q[8])/2} ELSE {'x': (q[7]+q[1])/2, 'y': (q[8]+q[2])/2} END AS e2"""


@query("g12_line", f"""
SELECT id, round(CASE WHEN ok THEN l.x ELSE x1 END, 6) AS "left", round(CASE WHEN ok THEN r.x ELSE x2 END, 6) AS "right", round(CASE WHEN ok THEN (l.y + r.y) / 2 ELSE (y1 + y2) / 2 END, 6) AS center_y,
  round(CASE WHEN ok THEN (r.y - l.y) / (r.x - l.x) ELSE 0 END, 6) AS slope, round(CASE WHEN ok THEN greatest(1, abs({_SHOE} / 2) / (r.x - l.x)) ELSE greatest(1, greatest(0, y2 - y1)) END, 6) AS height
FROM (SELECT *, l.x < r.x AND abs(r.y - l.y) <= r.x - l.x AS ok FROM (SELECT *, least(e1, e2) AS l, greatest(e1, e2) AS r FROM (SELECT *, {_ENDS} FROM (
  SELECT *, sqrt((q[3]-q[1])**2 + (q[4]-q[2])**2) AS s0, sqrt((q[5]-q[3])**2 + (q[6]-q[4])**2) AS s1, sqrt((q[7]-q[5])**2 + (q[8]-q[6])**2) AS s2, sqrt((q[1]-q[7])**2 + (q[2]-q[8])**2) AS s3
  FROM (SELECT *, quad AS q FROM fx_quads)))))""")
def g12(spark, d):
    line = G.block_line(F.col("quad"), _b())
    return fx(spark, d, "quads").select("id", *(F.round(line[c], R).alias(c) for c in ("left", "right", "center_y", "slope", "height")))


_MERGE = f"""(sh >= .35 * lo AND CASE category WHEN 'math' THEN gap >= -14 AND gap <= 49 AND (ov >= .2 OR abs((x1 + x2 - u1 - u2) / 2) <= 180)
  WHEN 'text' THEN NOT (wl < 150 AND wh > 2.5 * greatest(1, wl)) AND hi <= 1.75 * lo AND abs(x1 - u1) <= greatest(35, .25 * wl) AND gap >= -.75 * lo AND gap <= least(25.2, .65 * (ha + hb) / 2) AND ov >= .55 ELSE false END)"""


@query("g14a_should_merge_pairs", f"""
SELECT page, id, id_b, category = category_b AND {_MERGE} AS merge FROM (SELECT *, sh - (ha + hb) / 2 AS gap, least(ha, hb) AS lo, greatest(ha, hb) AS hi FROM (
  SELECT *, (v1 + v2) / 2 - (y1 + y2) / 2 AS sh, greatest(1, y2 - y1) AS ha, greatest(1, v2 - v1) AS hb, {_IW} / greatest(1, least(x2 - x1, u2 - u1)) AS ov, least(x2 - x1, u2 - u1) AS wl, greatest(x2 - x1, u2 - u1) AS wh FROM {_PAIR}))""")
def g14a(spark, d):
    same = F.col("category") == F.col("category_b")
    return _pairs(spark, d).select("page", "id", "id_b", (same & G.should_merge(G.box_line(_b()), G.box_line(_b("_b")), PAGE_W, PAGE_H, F.col("category"))).alias("merge"))


@query("g16a_neighbouring_pairs", f"""
SELECT page, id, id_b, ({_IW} / least(x2 - x1, u2 - u1) >= .5 AND yg <= greatest(2 * lo, .5 * hi)) OR ({_IH} / greatest(1, lo) >= .5 AND xg <= 2 * lo) AS near
FROM (SELECT *, least(y2 - y1, v2 - v1) AS lo, greatest(y2 - y1, v2 - v1) AS hi, greatest(0, greatest(y1, v1) - least(y2, v2)) AS yg, greatest(0, greatest(x1, u1) - least(x2, u2)) AS xg FROM {_PAIR})""")
def g16a(spark, d):
    return _pairs(spark, d).select("page", "id", "id_b", G.neighbouring(_b(), _b("_b")).alias("near"))


def _cross(q: str) -> str:
    k = lambda i: (i % 4) * 2 + 1
    return " AND ".join(f"({q}[{k(i + 1)}]-{q}[{k(i)}])*({q}[{k(i + 2) + 1}]-{q}[{k(i + 1) + 1}])-({q}[{k(i + 1) + 1}]-{q}[{k(i) + 1}])*({q}[{k(i + 2)}]-{q}[{k(i + 1)}]) > .01" for i in range(4))


@query("g18_quad_valid", f"SELECT id, {_cross('q')} AND {_cross('c')} AS valid FROM (SELECT id, quad AS q, list_transform(quad, lambda v, i: CASE WHEN i % 2 = 1 THEN greatest(0, least(600, v)) ELSE greatest(0, least(1000, v)) END) AS c FROM fx_quads)")
def g18(spark, d):
    return fx(spark, d, "quads").select("id", G.quad_valid(F.col("quad"), 600, 1000).alias("valid"))


@query("g23_denormalise", """
SELECT page, id, round(CASE WHEN pk % 2 = 0 THEN CASE WHEN greatest(x1, y1, x2, y2 * f) <= 1000 THEN x1 ELSE x1 END ELSE least(x1, x2) END, 6) AS x1,
  round(CASE WHEN pk % 2 = 0 AND greatest(x1, y1, x2, y2 * f) <= 1000 THEN y1 * 1.4 ELSE y1 END, 6) AS y1, round(x2, 6) AS x2, round(CASE WHEN pk % 2 = 0 AND greatest(x1, y1, x2, y2 * f) <= 1000 THEN y2 * f * 1.4 WHEN pk % 2 = 0 THEN y2 * f ELSE y2 END, 6) AS y2
FROM (SELECT *, CASE WHEN pk % 6 = 0 THEN 20 ELSE 1 END AS f FROM fx_blocks)""")
def g23(spark, d):
    f = F.when(F.col("pk") % 6 == 0, 20.0).otherwise(1.0)
    v = F.when(F.col("pk") % 2 == 0, F.array("x1", "y1", "x2", F.col("y2") * f)).otherwise(G.quad_of(_b()))
    return fx(spark, d, "blocks").select("page", "id", *_flat(G.denormalise(v, PAGE_W, PAGE_H, F.lit(False))))


@query("x01_balanced", r"""
SELECT id, coalesce(list_min(run) >= 0 AND run[-1] = 0, true) AS balanced FROM (
  SELECT id, list_transform(range(1, len(cs) + 1), lambda i: list_sum(list_transform(cs[1:i], lambda c: CASE WHEN c = '{' THEN 1 ELSE -1 END))) AS run
  FROM (SELECT id, list_filter(string_split(regexp_replace(content, '\\.', '', 'g'), ''), lambda c: c IN ('{', '}')) AS cs FROM fx_math))""")
def x01(spark, d):
    return fx(spark, d, "math").select("id", X.balanced(F.col("content")).alias("balanced"))


_N = lambda c: f"(length(v) - length(replace(v, '{c}', '')))"
_VT = f"CASE WHEN v = '' THEN 0 ELSE (1 - least(.8, {_N('?')} / greatest(1, length(v)) * 4 + {_N(X.BAD)} / greatest(1, length(v)) * 12)) * CASE WHEN length(v) < 2 THEN .5 ELSE 1 END END"
_VM = r"CASE WHEN v = '' THEN 0 ELSE .45 + CASE WHEN bal THEN .25 ELSE 0 END + CASE WHEN regexp_matches(v, '\\frac|\\begin|\\sqrt|\^|_|=|\\sum|\\int') THEN .2 ELSE 0 END + CASE WHEN NOT contains(v, '?') AND NOT contains(v, 'BAD') THEN .1 ELSE 0 END END".replace("BAD", X.BAD)
_VB = r"CASE WHEN v = '' THEN 0 WHEN contains(lower(v), '\begin{tabular') THEN .95 WHEN contains(lower(v), '<table') AND contains(lower(v), '</table>') THEN .9 WHEN len(list_filter(string_split(v, chr(10)), lambda x: trim(x) <> '')) >= 2 AND len(list_filter(string_split(v, chr(10)), lambda x: contains(x, '|'))) >= 2 THEN .82 ELSE .45 END"
_BAL = r"""(SELECT id AS i, coalesce(min(s) >= 0 AND sum(c) = 0, true) AS bal FROM (SELECT id, c, sum(c) OVER (PARTITION BY id ORDER BY k) AS s FROM (
  SELECT id, generate_subscripts(cs, 1) AS k, CASE unnest(cs) WHEN '{' THEN 1 ELSE -1 END AS c FROM (SELECT id, list_filter(string_split(regexp_replace(content, '\\.', '', 'g'), ''), lambda c: c IN ('{', '}')) AS cs FROM TABLE_)) u) w GROUP BY id)"""


def _scored(table: str, expr: str) -> str:
    return f"SELECT id, round(CAST({expr} AS DOUBLE), 6) AS score FROM (SELECT t.*, trim(content) AS v, coalesce(bal, true) AS bal FROM {table} t LEFT JOIN {_BAL.replace('TABLE_', table)} ON i = id)"


@query("x03_validate_text", _scored("fx_text", _VT))
def x03(spark, d):
    return fx(spark, d, "text").select("id", F.round(X.validate_text(F.col("content")), R).alias("score"))


@query("x04_validate_math", _scored("fx_math", _VM))
def x04(spark, d):
    return fx(spark, d, "math").select("id", F.round(X.validate_math(F.col("content")), R).alias("score"))


@query("x05_validate_table", _scored("fx_text", _VB))
def x05(spark, d):
    return fx(spark, d, "text").select("id", F.round(X.validate_table(F.col("content")), R).alias("score"))


@query("x06_validate_dispatch", _scored("fx_text", f"CASE category WHEN 'math' THEN {_VM} WHEN 'table' THEN {_VB} ELSE {_VT} END"))
def x06(spark, d):
    return fx(spark, d, "text").select("id", F.round(X.validate(F.col("category"), F.col("content")), R).alias("score"))


PROSE_SQL = r"""list_filter(regexp_extract_all(regexp_replace(regexp_replace(content, '(?s)\$\$.*?\$\$|\$.*?\$|\\\(.*?\\\)|\\\[.*?\\\]', ' ', 'g'), '\\(?:begin|end)\{[^}]+\}|\\[A-Za-z]+', ' ', 'g'), '\p{L}{2,}'),
  lambda w: lower(w) NOT IN WORDS AND NOT (upper(w) = w AND length(w) <= 3))""".replace("WORDS", str(X.MATH_WORDS))


@query("x07_prose_words", f"SELECT id, {PROSE_SQL} AS words FROM (SELECT id, content FROM fx_math UNION ALL SELECT id + 1000000000 AS id, content FROM fx_tex)")
def x07(spark, d):
    both = fx(spark, d, "math").select("id", "content").unionByName(fx(spark, d, "tex").select((F.col("id") + 1000000000).alias("id"), "content"))
    return both.select("id", X.prose_words(F.col("content")).alias("words"))


def tex_sql(v: str) -> str:
    out = f"replace({v}, chr(92), chr(1))"
    for c in "{}&%$#_":
        out = f"replace({out}, '{c}', '{X.TEX_ESCAPES[c]}')"
    for c, to in (("chr(1)", X.TEX_ESCAPES["\\"]), ("'~'", X.TEX_ESCAPES["~"]), ("'^'", X.TEX_ESCAPES["^"])):
        out = f"replace({out}, {c}, '{to}')"
    return out


@query("x10_escape_tex", f"SELECT id, {tex_sql('content')} AS tex FROM fx_tex")
def x10(spark, d):
    return fx(spark, d, "tex").select("id", X.escape_tex(F.col("content")).alias("tex"))


_STRIP = lambda v: rf"regexp_replace({v}, '^\s+|\s+$', '', 'g')"


@query("x12_text_source", rf"SELECT id, regexp_replace(regexp_replace(replace(replace({_STRIP('content')}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '(?i)^`{{3}}(?:markdown|text|latex|tex)?\s*\n', ''), '\n\s*`{{3}}$', '') AS source FROM fx_fence")
def x12(spark, d):
    return fx(spark, d, "fence").select("id", X.text_source(F.col("content")).alias("source"))


@query("x13a_heading", r"SELECT id, CASE WHEN m <> '' THEN least(length(m), 3) END AS level, CASE WHEN m <> '' THEN regexp_extract(line, '^\s*(#{1,6})\s+(.+)$', 2) END AS title FROM (SELECT id, line, regexp_extract(line, '^\s*(#{1,6})\s+(.+)$', 1) AS m FROM fx_lines)")
def x13a(spark, d):
    h = X.heading(F.col("line"))
    return fx(spark, d, "lines").select("id", h["level"].cast("long").alias("level"), h["title"].alias("title"))


@query("x13b_list_item", r"""SELECT id, CASE WHEN b <> '' THEN 'itemize' WHEN n <> '' THEN 'enumerate' END AS kind, CASE WHEN b <> '' OR n <> '' THEN n END AS number, CASE WHEN b <> '' OR n <> '' THEN regexp_extract(line, p, 3) END AS content
FROM (SELECT *, regexp_extract(line, p, 1) AS b, regexp_extract(line, p, 2) AS n FROM (SELECT *, '^\s*(?:([-*•])\s+|(\d+)[.)]\s+)(.+)$' AS p FROM fx_lines))""".replace(", p, ", r", '^\s*(?:([-*•])\s+|(\d+)[.)]\s+)(.+)$', "))
def x13b(spark, d):
    i = X.list_item(F.col("line"))
    return fx(spark, d, "lines").select("id", *(i[c].alias(c) for c in ("kind", "number", "content")))


@query("x13c_whitespace", rf"SELECT id, {_STRIP(chr(34) + 'l' + chr(34))} AS line FROM (SELECT id, regexp_replace(line, '[\t\f\v ]+', ' ', 'g') AS l FROM fx_lines)")
def x13c(spark, d):
    return fx(spark, d, "lines").select("id", X.collapse(F.col("line")).alias("line"))


ROWS_SQL = r"list_filter(list_transform(list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)), lambda x: contains(x, '|')), lambda x: list_transform(string_split(trim(x, '|'), '|'), lambda c: trim(c))), lambda r: len(list_filter(r, lambda c: NOT regexp_full_match(c, '[-: ]*'))) > 0)"


@query("x17_pipe_rows", f"SELECT id, {ROWS_SQL} AS cells FROM fx_pipe")
def x17(spark, d):
    return fx(spark, d, "pipe").select("id", X.pipe_rows(F.col("content")).alias("cells"))


TABULAR_SQL = rf"""CASE WHEN len(rs) = 0 THEN '' ELSE '\begin{{tabular}}{{|' || repeat('l|', n) || '}}' || chr(10) || '\hline' || chr(10) ||
  array_to_string(list_transform(rs, lambda r: array_to_string(list_transform(range(1, n + 1), lambda i: {tex_sql("replace(replace(coalesce(r[i], ''), '&lt;', '<'), '&amp;', '&')")}), ' & ')), ' \\ \hline' || chr(10)) || ' \\ \hline' || chr(10) || '\end{{tabular}}' END"""


@query("x18_tabular", f"SELECT id, {TABULAR_SQL} AS tex FROM (SELECT id, rs, list_max(list_transform(rs, lambda r: len(r))) AS n FROM (SELECT id, {ROWS_SQL} AS rs FROM fx_pipe))")
def x18(spark, d):
    return fx(spark, d, "pipe").select("id", X.tabular(X.pipe_rows(F.col("content"))).alias("tex"))


@query("x20_asset_id", "SELECT p_partkey AS id, regexp_replace(p_name || '/' || p_brand, '[^A-Za-z0-9_.-]', '_', 'g') AS asset FROM part")
def x20(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), X.asset_id(F.concat_ws("/", "p_name", "p_brand")).alias("asset"))


@query("x21_clean_json", rf"SELECT id, CASE WHEN j <> '' THEN j ELSE v END AS json FROM (SELECT id, v, regexp_extract(v, '(?s)\{{.*\}}') AS j FROM (SELECT id, regexp_replace(regexp_replace({_STRIP('content')}, '(?i)^`{{3}}(?:json)?\s*', ''), '\s*`{{3}}$', '') AS v FROM fx_fence))")
def x21(spark, d):
    return fx(spark, d, "fence").select("id", X.clean_json(F.col("content")).alias("json"))


@query("p10_figure_width", "SELECT page, id, printf('%.3f', CAST(greatest(.25, least(1, (x2 - x1) / greatest(1, 300 + pk % 2000))) AS DOUBLE)) AS fraction FROM fx_blocks")
def p10(spark, d):
    return fx(spark, d, "blocks").select("page", "id", X.figure_fraction(F.col("x2") - F.col("x1"), (300 + F.col("pk") % 2000).cast("double")).alias("fraction"))
