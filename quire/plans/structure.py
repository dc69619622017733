"""Queries over providers' responses, review records, reports and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as X
from quire.operators import calls, compose, decode, layout, report, review
from quire.plans.fixtures import PAGE_H, PAGE_W, fx
from quire.plans.registry import query
from quire.plans.scalars import PROSE_SQL, tex_sql
from quire.settings import Settings
from quire.sources import export, provider

P = ["page"]


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- responses of layout models

_NESTED = "json_extract(raw, '$.a[0].b.words_info[0]')"
_NATIVE = f"(SELECT id, CASE id % 6 WHEN 0 THEN {_NESTED} WHEN 1 THEN json_extract(said, '$.words_info[0]') END AS item FROM (SELECT *, CASE WHEN id % 6 IN (1, 2) THEN text END AS said FROM fx_responses))"


@query("n02_words_info", "SELECT id, CAST(0 AS BIGINT) AS ord, raw ->> '$.a[0].b.words_info[0].text' AS said, CAST(raw ->> '$.a[0].b.words_info[0].location[0]' AS BIGINT) AS x FROM fx_responses WHERE id % 6 = 0")
def n02(spark, d):
    got = provider.native_words(fx(spark, d, "responses").select("id", F.col("raw").alias("body")), ["id"])
    return got.select("id", "ord", F.get_json_object("item", "$.text").alias("said"), F.get_json_object("item", "$.location[0]").cast("long").alias("x"))


@query("n03_position_items", """SELECT id, CAST(0 AS BIGINT) AS ord, text ->> '$.pos_list[0].rotate_rect[0]' AS first FROM fx_responses WHERE id % 6 = 2 UNION ALL SELECT id, 1, text ->> '$.x[0].bbox[0]' FROM fx_responses WHERE id % 6 = 2
UNION ALL SELECT id, 0, text ->> '$.words_info[0].location[0]' FROM fx_responses WHERE id % 6 = 1""")
def n03(spark, d):
    got = provider.positions(fx(spark, d, "responses").where("id % 6 IN (0, 1, 2, 3)").select("id", F.when(F.col("id") % 6 != 0, F.col("text")).alias("body")), ["id"])
    first = F.coalesce(*[F.get_json_object("item", f"$.{k}[0]") for k in provider.COORDINATES])
    return got.select("id", "ord", first.alias("first"))


#: What each response has to give, read with JSON paths alone: the first numbers of the item, and its kind.
_ITEMS = """(SELECT id, 0 AS ord, 'location' AS kind, raw ->> '$.a[0].b.words_info[0].location[0]' AS first FROM fx_responses WHERE id % 6 = 0
  UNION ALL SELECT id, 0, 'location', text ->> '$.words_info[0].location[0]' FROM fx_responses WHERE id % 6 = 1
  UNION ALL SELECT id, 0, 'rotate_rect', text ->> '$.pos_list[0].rotate_rect[0]' FROM fx_responses WHERE id % 6 = 2 UNION ALL SELECT id, 1, 'bbox', text ->> '$.x[0].bbox[0]' FROM fx_responses WHERE id % 6 = 2
  UNION ALL SELECT id, unnest([0, 1]), 'listing', CAST(n AS VARCHAR) FROM fx_responses WHERE id % 6 = 3
  UNION ALL SELECT id, 0, 'location', CAST(n AS VARCHAR) FROM fx_responses WHERE id % 6 = 4)"""


@query("n04_parse_cascade", f"SELECT id, CAST(ord AS BIGINT) AS ord, kind, CAST(first AS DOUBLE) AS first FROM {_ITEMS}")
def n04(spark, d):
    got = provider.response_items(fx(spark, d, "responses"), ["id"])
    has = lambda k: F.get_json_object("item", f"$.{k}").isNotNull()
    kind = F.when(has("location"), "location").when(has("bbox"), "bbox").when(has("coordinate_space"), "listing").otherwise("rotate_rect")
    return got.select("id", "ord", kind.alias("kind"), F.coalesce(*[F.get_json_object("item", f"$.{k}[0]") for k in provider.COORDINATES]).cast("double").alias("first"))


def _words(spark, d):
    items = provider.response_items(fx(spark, d, "responses"), ["id"])
    return provider.words(items, F.lit(PAGE_W), F.lit(PAGE_H))


_WORDS = """(SELECT id, 0 AS ord, CAST(n AS DOUBLE) AS x1, 0.0::DOUBLE AS y1, least(1000.0::DOUBLE, CAST(n AS BIGINT) + 9) AS x2, 5.0::DOUBLE AS y2, CASE WHEN id % 6 = 4 THEN '' ELSE 'w' || n END AS text, CASE WHEN id % 6 = 1 THEN 'formula' ELSE '' END AS category FROM fx_responses WHERE id % 6 IN (0, 1, 4)
  UNION ALL SELECT id, 1, 1.0::DOUBLE, 2.8::DOUBLE, 3.0::DOUBLE, CAST(n AS BIGINT) * 1.4::DOUBLE, '', '' FROM fx_responses WHERE id % 6 = 2 AND abs(CAST(n AS BIGINT) * 1.4 - 2.8) >= 2
  UNION ALL SELECT id, unnest([0, 1]), greatest(0, CAST(n AS BIGINT) - 10.0::DOUBLE), unnest([7.0::DOUBLE, 63.0::DOUBLE]), least(1000, CAST(n AS BIGINT) + 10.0::DOUBLE), unnest([21.0::DOUBLE, 77.0::DOUBLE]), '', '' FROM fx_responses WHERE id % 6 = 3)"""


@query("n06_word_rows", f"SELECT id, CAST(ord AS BIGINT) AS ord, round(x1, 6) AS x1, round(least(y1, y2), 6) AS y1, round(x2, 6) AS x2, round(greatest(y1, y2), 6) AS y2, text, category FROM {_WORDS} WHERE x2 - x1 >= 2")
def n06_rows(spark, d):
    return _words(spark, d).where("NOT (id % 6 = 2 AND ord = 0)").select("id", "ord", *(F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")), "text", "category")


@query("p03_words_to_blocks", f"SELECT id AS page, printf('p%04d_q%04d', id, ord) AS id, CASE WHEN category = 'formula' THEN 'math' ELSE 'text' END AS category, 'qwen_layout_' || CASE WHEN category = 'formula' THEN 'math' ELSE 'text' END AS source_label, CAST(.95 AS DOUBLE) AS score, text AS hint FROM {_WORDS} WHERE x2 - x1 >= 2")
def p03(spark, d):
    w = _words(spark, d).where("NOT (id % 6 = 2 AND ord = 0)").withColumnRenamed("id", "page")
    return provider.word_blocks(w, "page").select("page", "id", "category", "source_label", "score", "hint")


@query("p04_detector_boxes", """SELECT page, printf('p%04d_b%04d', page, ord) AS id, CASE WHEN category = 'math' THEN 'math' WHEN category = 'figure' THEN 'figure' ELSE 'text' END AS category, CASE category WHEN 'math' THEN 'Formula' ELSE category END AS source_label, CASE WHEN pk % 4 = 1 THEN 0 ELSE round(score, 6) END AS score, x1, y1, x2, y2
FROM fx_blocks WHERE page % 11 <> 3 AND pk % 9 <> 2""")
def p04(spark, d):
    b = fx(spark, d, "blocks")
    place = F.when(F.col("pk") % 9 == 2, F.array("x1", "y1")).otherwise(F.array("x1", "y1", "x2", "y2"))
    one = F.struct(
        F.when(F.col("pk") % 2 == 0, place).alias("coordinate"), F.when(F.col("pk") % 2 == 1, place).alias("bbox"), F.when(F.col("pk") % 4 != 1, F.col("score")).alias("score"),
        F.when(F.col("category") == "math", "Formula").otherwise(F.col("category")).alias("label"),
    )
    boxes = b.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", one.alias("b")))), lambda x: x["b"]).alias("boxes"))
    raw = F.when(F.col("page") % 11 == 3, "oops").when(F.col("page") % 2 == 0, F.to_json(F.struct("boxes"))).otherwise(F.to_json(F.struct(F.struct("boxes").alias("res"))))
    return provider.detector_blocks(boxes.select("page", raw.alias("raw")), "page").withColumn("score", F.round("score", 6))


@query("p05_second_provider", """SELECT page, printf('p%04d_m%04d', page, ord) AS id, CASE WHEN category = 'figure' THEN 'figure' WHEN category = 'math' THEN 'unknown' ELSE 'text' END AS category, CASE WHEN pk % 3 = 0 THEN round(score, 6) WHEN pk % 3 = 1 THEN .5 ELSE .75 END AS score,
  least(1000, x1 * k) AS x1, least(1400, y1 * k) AS y1, least(1000, x2 * k) AS x2, least(1400, y2 * k) AS y2 FROM (SELECT *, CASE WHEN page % 2 = 0 THEN 2 ELSE 1 END AS k FROM fx_blocks)""")
def p05(spark, d):
    sure = F.struct(F.when(F.col("pk") % 3 == 0, F.col("score")).alias("block_type_confidence_score"), F.when(F.col("pk") % 3 == 1, F.lit(0.5)).alias("average_content_confidence_score"))
    one = F.struct(F.when(F.col("category") != "math", F.col("category")).alias("type"), sure.alias("confidence_scores"), F.col("x1").alias("top_left_x"), F.col("y1").alias("top_left_y"), F.col("x2").alias("bottom_right_x"), F.col("y2").alias("bottom_right_y"))
    per = fx(spark, d, "blocks").groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", one.alias("b")))), lambda x: x["b"]).alias("blocks"))
    dims = F.when(F.col("page") % 2 == 0, F.struct(F.lit(PAGE_W / 2).alias("width"), F.lit(PAGE_H / 2).alias("height")))
    raw = per.select("page", F.lit(PAGE_W).alias("w"), F.lit(PAGE_H).alias("h"), F.to_json(F.struct(F.array(F.struct(dims.alias("dimensions"), "blocks")).alias("pages"))).alias("raw"))
    return provider.page_blocks(raw, "page", "w", "h").drop("source_label").withColumn("score", F.round("score", 6))


@query("n11_response_gate", """SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN 'not JSON' WHEN event_id % 5 = 1 THEN 'not an object' WHEN event_id % 2 = 1 THEN 'HTTP 404' WHEN event_id % 5 = 2 THEN 'incomplete' WHEN event_id % 5 = 3 THEN 'unreadable message' END AS error,
  CASE WHEN event_id % 5 < 2 THEN 0 ELSE event_id % 97 END AS tokens FROM events""")
def n11(spark, d):
    i = F.col("event_id")
    usage = F.concat(F.lit('"usage": {"input_tokens": '), (i % 97).cast("string"), F.lit("}}"))
    body = (
        F.when(i % 5 == 0, "oops").when(i % 5 == 1, "[1]").when(i % 5 == 2, F.concat(F.lit('{"choices": [{"finish_reason": "length", "message": {"content": "x"}}], '), usage))
        .when(i % 5 == 3, F.concat(F.lit('{"choices": [], '), usage)).otherwise(F.concat(F.lit('{"choices": [{"message": {"content": ["x"]}}], '), usage))
    )
    e = _t(spark, d, "events").select(i.alias("id"), (200 + i % 2 * 204).alias("status"), body.alias("body"))
    return e.select("id", provider.response_error(F.col("status"), F.col("body")).alias("error"), report.usage_tokens(provider.response_usage(F.col("body")), "input_tokens", "prompt_tokens").alias("tokens"))


@query("x19_redact", """SELECT event_id AS id, '[REDACTED]' AS key, 'a [REDACTED] b' AS said, 'data:image/png;base64,[OMITTED]' AS picture, event_id AS n FROM events""")
def x19(spark, d):
    i = F.col("event_id")
    body = F.concat(F.lit('{"API-Key": {"deep": 1}, "list": [{"n": '), i.cast("string"), F.lit(', "said": "a sesame b"}, "data:image/png;base64,AAAA"]}'))
    got = provider.redacted(_t(spark, d, "events").select(i.alias("id"), body.alias("body")), ["id"], "body", "sesame", images=True)
    at = lambda p: F.get_json_object("shown", p)
    return got.select("id", at("$.API-Key").alias("key"), at("$.list[0].said").alias("said"), at("$.list[1]").alias("picture"), at("$.list[0].n").cast("long").alias("n"))


# --- review

@query("n09_parse_records", """SELECT id, CASE WHEN id % 9 = 8 THEN NULL ELSE 0 END AS ord, CASE WHEN id % 9 = 8 THEN NULL ELSE CAST(id AS VARCHAR) END AS record, CASE id % 9 WHEN 0 THEN 'Review record has an invalid schema' WHEN 1 THEN 'Review record has invalid field types' WHEN 2 THEN CAST(id AS VARCHAR) || ': invalid source_ids' WHEN 3 THEN 'Review record has invalid field types' WHEN 8 THEN 'Review response must contain only a units array' END AS error,
  CASE WHEN id % 9 = 8 THEN 0 WHEN id % 9 = 2 THEN 0 WHEN id % 9 = 4 THEN 2 ELSE 1 END AS claims FROM (SELECT doc_id AS id FROM documents)""")
def n09(spark, d):
    i = F.col("doc_id")
    extra = (
        F.when(i % 9 == 0, ', "more": 1').when(i % 9 == 2, ', "source_ids": []').when(i % 9 == 4, F.concat(F.lit(', "source_ids": ["'), i.cast("string"), F.lit('", "b"]'))).otherwise("")
    )
    issues = F.when(i % 9 == 1, '[" "]').when(i % 9 == 3, "[1]").when(i % 9 == 5, "[]").otherwise('["why"]')
    record = F.concat(F.lit('{"id": "'), i.cast("string"), F.lit('", "text": "t", "category": "text", "status": "corrected", "issues": '), issues, extra, F.lit("}"))
    body = F.concat(F.when(i % 9 == 6, "```json\n").otherwise(""), F.lit('{"units": ['), record, F.lit("]"), F.when(i % 9 == 8, ', "x": 1').otherwise(""), F.lit("}"), F.when(i % 9 == 6, "\n```").otherwise(""))
    got = provider.review_records(_t(spark, d, "documents").select(i.alias("id"), body.alias("body")).withColumnRenamed("id", "doc"), ["doc"])
    return got.select(F.col("doc").alias("id"), F.col("ord").cast("int").alias("ord"), F.col("id").alias("record"), "error", F.size("declared").alias("claims"))


_SRCS = "(SELECT *, CASE WHEN second IS NULL THEN [id] WHEN second < id AND pk % 2 = 0 THEN [second, id] ELSE [id, second] END AS sources FROM fx_claims)"
_CLAIMED = f"(SELECT batch, s, count(*) AS n FROM (SELECT batch, unnest(sources) AS s FROM {_SRCS}) GROUP BY ALL)"
_LOOK = f"""(SELECT r.*, u1.decoded AS d1, u1.category AS c1, u1.page AS g1, u2.decoded AS d2, u2.category AS c2, u2.page AS g2, (sources[1] IS NOT NULL AND u1.id IS NOT NULL AND (len(sources) = 1 OR u2.id IS NOT NULL)) AS known,
    k1.n = 1 AND coalesce(k2.n, 1) = 1 AS sole, coalesce({{near}}, true) AS close, {PROSE_SQL.replace('content', "u1.decoded")} AS w1, {PROSE_SQL.replace('content', "coalesce(u2.decoded, '')")} AS w2, {PROSE_SQL.replace('content', 'r.text')} AS wt
  FROM {_SRCS} r LEFT JOIN fx_drafts u1 ON u1.batch = r.batch AND u1.id = r.sources[1] LEFT JOIN fx_drafts u2 ON u2.batch = r.batch AND u2.id = r.sources[2]
  LEFT JOIN {_CLAIMED} k1 ON k1.batch = r.batch AND k1.s = r.sources[1] LEFT JOIN {_CLAIMED} k2 ON k2.batch = r.batch AND k2.s = r.sources[2])"""
_LOW, _TOP = "least(u1.y2 - u1.y1, u2.y2 - u2.y1)", "greatest(u1.y2 - u1.y1, u2.y2 - u2.y1)"
_CLOSE = f"""((greatest(0, least(u1.x2, u2.x2) - greatest(u1.x1, u2.x1)) / nullif(least(u1.x2 - u1.x1, u2.x2 - u2.x1), 0) >= .5 AND greatest(0, greatest(u1.y1, u2.y1) - least(u1.y2, u2.y2)) <= greatest(2 * {_LOW}, .5 * {_TOP})) OR
  (greatest(0, least(u1.y2, u2.y2) - greatest(u1.y1, u2.y1)) / greatest(1, {_LOW}) >= .5 AND greatest(0, greatest(u1.x1, u2.x1) - least(u1.x2, u2.x2)) <= 2 * {_LOW}))"""
_EXPL = r"regexp_matches({}, '\$|\\[(\[]|\\frac|\\sqrt')"
_NOTA = r"regexp_matches({}, '[=^_×÷∫∑√≈≠≤≥]|\\[A-Za-z]+')"
#: What the texts of fx_claims break: an open brace in a formula, an open dollar, and a fraction outside of dollars.
_SYN = r"""CASE WHEN category = 'math' AND contains(text, '{open') THEN 'unbalanced LaTeX braces' WHEN category = 'math' AND contains(text, '$y left') THEN 'unclosed math delimiter'
  WHEN category = 'text' AND contains(text, '$y left') THEN 'unclosed inline math delimiter' WHEN category = 'text' AND regexp_matches(text, '^\\frac') THEN 'mathematical command outside a math delimiter' END"""
_RULES = f"""(SELECT *, CASE WHEN NOT known THEN 'unknown source ID' WHEN sources[1] <> id OR len(list_distinct(sources)) <> len(sources) THEN 'duplicate source IDs or nonleading record ID'
  WHEN category NOT IN ('text', 'math', 'table') OR status NOT IN ('verified', 'corrected', 'uncertain') THEN 'invalid category or status' WHEN trim(text) = '' THEN 'empty or oversized transcription'
  WHEN status IN ('corrected', 'uncertain') AND n_issues = 0 THEN 'change or uncertainty has no explanation' WHEN status = 'verified' AND (len(sources) > 1 OR text <> d1 OR category <> c1) THEN 'verified record changes the original draft'
  WHEN len(sources) > 1 AND (sources[2] <> sources[1] + 1 OR g1 <> g2) THEN 'merged sources are not consecutive on one page or exceed the merge limit' WHEN status = 'uncertain' THEN NULL WHEN {_SYN} IS NOT NULL THEN {_SYN}
  WHEN len(sources) = 1 THEN CASE WHEN c1 = 'text' AND prose AND category <> 'text' THEN 'mixed prose cannot become a formula-only or table result' WHEN prose AND {_EXPL.format('d1')} AND NOT {_EXPL.format('text')} THEN 'mixed prose lost its explicit mathematics' END
  WHEN status <> 'corrected' OR category = 'table' THEN 'merge needs one page and a corrected expression' WHEN NOT close THEN 'merged source regions are not physically adjacent'
  WHEN (c1 = 'text' AND len(w1) > 0 AND NOT {_NOTA.format('d1')}) OR (c2 = 'text' AND len(w2) > 0 AND NOT {_NOTA.format('d2')}) THEN 'merge would consume a paragraph or separate prose note'
  WHEN category = 'text' AND NOT {_EXPL.format('text')} THEN 'merged mixed expression needs explicit inline mathematics' WHEN prose AND len(wt) < least(2, len(w1) + len(w2)) THEN 'merge lost attached source prose' END AS error
  FROM (SELECT *, len(w1) + len(w2) >= 3 OR len(list_filter(list_concat(w1, w2), lambda w: length(w) >= 7)) > 0 AS prose FROM {_LOOK.replace('{near}', _CLOSE)}))"""


def _records(spark, d):
    """Judged records of fx_claims."""
    c = fx(spark, d, "claims")
    back = (F.col("second") < F.col("id")) & (F.col("pk") % 2 == 0)
    sources = F.when(F.col("second").isNull(), F.array("id")).when(back, F.array("second", "id")).otherwise(F.array("id", "second"))
    return review.judged(c.withColumn("sources", sources).drop("second", "pk"), fx(spark, d, "drafts"), ["batch"])


@query("n10_record_rules", f"SELECT batch, id, error FROM {_RULES}")
def n10(spark, d):
    return _records(spark, d).select("batch", "id", "error")


@query("a10_accepted", f"SELECT batch, id, status FROM {_RULES} WHERE error IS NULL AND sole")
def a10(spark, d):
    return review.accepted(_records(spark, d), ["batch"]).select("batch", "id", "status")


_APPLY = f"(SELECT batch, id AS leader, unnest(sources) AS id, generate_subscripts(sources, 1) AS pos, category AS rc, status AS rs, text AS rt FROM {_RULES} WHERE error IS NULL AND sole)"


@query("j10_apply_review", f"""
SELECT u.batch, u.id, CASE WHEN rs IN ('verified','corrected') AND pos = 1 THEN rc ELSE u.category END AS category, CASE WHEN rs IN ('verified','corrected') THEN CASE WHEN pos = 1 THEN rt ELSE '' END ELSE u.decoded END AS decoded, u.decoded AS raw_decoded, u.category AS original_category,
  coalesce(rs, 'uncertain') AS status, CASE WHEN rs IS NULL THEN 'No valid image-grounded review returned' ELSE '' END AS issue, coalesce(rs IN ('verified','corrected'), false) AS applied,
  CASE WHEN rs IN ('verified','corrected') AND pos > 1 THEN leader END AS merged_into, CASE WHEN rs = 'uncertain' AND pos = 1 THEN rt END AS proposed_text FROM fx_drafts u LEFT JOIN {_APPLY} r ON r.batch = u.batch AND r.id = u.id""")
def j10(spark, d):
    return review.apply_records(fx(spark, d, "drafts"), review.accepted(_records(spark, d), ["batch"]), ["batch"]).drop("source_ids")


@query("f02_typed_units", "SELECT page, id FROM fx_notes WHERE category IN ('text', 'math', 'table')")
def f02(spark, d):
    return review.typed(fx(spark, d, "notes")).select("page", "id")


@query("f03_review_eligible", """SELECT id FROM (SELECT *, CASE WHEN greatest(320, w + 16) * (h + 42) > 3000000 THEN greatest(1, CAST(floor(w * k) AS INT)) ELSE w END AS fw, CASE WHEN greatest(320, w + 16) * (h + 42) > 3000000 THEN greatest(1, CAST(floor(h * k) AS INT)) ELSE h END AS fh
  FROM (SELECT *, sqrt(3000000.0 / (greatest(320, w + 16) * (h + 42))) * .95 AS k FROM (SELECT *, greatest(1, CAST(round_even(cw * least(1, 1584.0 / cw), 0) AS INT)) AS w, greatest(1, CAST(round_even(ch * least(1, 1584.0 / cw), 0) AS INT)) AS h FROM (SELECT *, 100 + id % 3000 AS cw, CASE WHEN id % 50 = 9 THEN 400000 ELSE 50 + id * 37 % 9000 END AS ch FROM fx_units))))
WHERE category IN ('text', 'math', 'table') AND crop_path <> '' AND NOT contains(member, '_fullpage') AND length(decoded) + length(CAST(id AS STRING)) + 100 <= 12000 AND greatest(320, fw + 16) * (fh + 42) <= 3000000""")
def f03(spark, d):
    i = F.col("id")
    u = fx(spark, d, "units").withColumns({"member_ids": F.array("member"), "crop_w": 100 + i % 3000, "crop_h": F.when(i % 50 == 9, 400_000).otherwise(50 + i * 37 % 9000)})
    return review.eligible(u).select("id")


@query("f05_decode_rescue", "SELECT id, coalesce(CASE id % 11 WHEN 0 THEN true WHEN 1 THEN false END, score < .55) AS rescue FROM (SELECT id, (length(content) % 100) / 100 AS score FROM fx_text)")
def f05(spark, d):
    router = F.when(F.col("id") % 11 == 0, True).when(F.col("id") % 11 == 1, False)
    return fx(spark, d, "text").select("id", decode.rescue_needed((F.length("content") % 100) / 100, router).alias("rescue"))


@query("f07_background", "SELECT page, id FROM fx_notes WHERE NOT ends_with(member, '_residual') AND source_label = 'text'")
def f07(spark, d):
    n = fx(spark, d, "notes")
    return compose.without_background(n.withColumn("member_ids", F.array("member")), n.select("page", F.col("member").alias("id"), "source_label"), P).select("page", "id")


@query("f10_mark_pdf", """SELECT page, id, CASE WHEN own THEN 'not_reviewed' ELSE 'not_applicable' END AS before, own AS mark_before, CASE WHEN own THEN 'Source region could not be scheduled within the review budget' ELSE '' END AS why, own OR status IN ('uncertain', 'not_reviewed') AS marked
FROM (SELECT *, category IN ('text', 'math', 'table') AS own FROM fx_notes)""")
def f10(spark, d):
    n = fx(spark, d, "notes").withColumnsRenamed({"status": "outcome", "content": "decoded"}).drop("mark_pdf")
    b = review.before_review(n, enabled=True, available=True)
    return b.select("page", "id", F.col("status").alias("before"), F.col("mark_pdf").alias("mark_before"), F.array_join("issues", "").alias("why"), review.marked(F.col("outcome"), F.col("mark_pdf")).alias("marked"))


@query("a08_review_summary", "SELECT count(*) FILTER (s = 'verified') AS verified, count(*) FILTER (s = 'corrected') AS corrected, count(*) FILTER (s = 'uncertain') AS uncertain, count(*) FILTER (s = 'not_reviewed') AS not_reviewed, count(m) AS merged, count(*) AS regions, (SELECT count(DISTINCT batch) FROM fx_units) AS batches FROM (SELECT CASE WHEN toxic = 1 THEN 'uncertain' WHEN quality = 1 THEN 'verified' WHEN quality = 0 THEN 'corrected' ELSE 'not_reviewed' END AS s, CASE WHEN id % 9 = 4 THEN id END AS m FROM fx_units)")
def a08(spark, d):
    s = F.when(F.col("toxic") == 1, "uncertain").when(F.col("quality") == 1, "verified").when(F.col("quality") == 0, "corrected").otherwise("not_reviewed")
    u = fx(spark, d, "units").withColumns({"status": s, "merged_into": F.when(F.col("id") % 9 == 4, F.col("id"))})
    return review.summary(u, u.select("batch").distinct())


# --- geometry of units

_WIN = "least(greatest(8, 1.25 * lh), {})"


@query("g19_review_window", f"""SELECT page, id, greatest(0, floor(x1 - {_WIN.format(40)})) AS x1, greatest(0, floor(y1 - {_WIN.format(56)})) AS y1, least(1000, ceil(x2 + {_WIN.format(40)})) AS x2, least(1400, ceil(y2 + {_WIN.format(56)})) AS y2, x1 - greatest(0, floor(x1 - {_WIN.format(40)})) AS target_x1
FROM (SELECT *, CASE WHEN pk % 2 = 0 THEN (y2 - y1) / 2 ELSE y2 - y1 END AS lh FROM fx_blocks)""")
def g19(spark, d):
    b, middle = layout.box_of(), (F.col("y1") + F.col("y2")) / 2
    halves = F.array(G.quad_of(G.box("x1", "y1", "x2", middle)), G.quad_of(G.box("x1", middle, "x2", "y2")))
    line = G.line_height(F.when(F.col("pk") % 2 == 0, halves), b, PAGE_W, PAGE_H)
    got = fx(spark, d, "blocks").select("page", "id", G.review_window(b, line, PAGE_W, PAGE_H).alias("g"))
    return got.select("page", "id", *(F.col("g.window")[c].alias(c) for c in ("x1", "y1", "x2", "y2")), F.col("g.target.x1").alias("target_x1"))


@query("a14_line_height", "SELECT page, id, CASE WHEN pk % 3 = 0 THEN y2 - y1 ELSE (y2 - y1) / 2 END AS height FROM fx_blocks")
def a14_line(spark, d):
    b, middle = layout.box_of(), (F.col("y1") + F.col("y2")) / 2
    halves = F.array(G.quad_of(G.box("x1", "y1", "x2", middle)), G.quad_of(G.box("x1", middle, "x2", "y2")), F.array(F.lit(1.0)))
    return fx(spark, d, "blocks").select("page", "id", G.line_height(F.when(F.col("pk") % 3 != 0, halves), b, PAGE_W, PAGE_H).alias("height"))


@query("g20_sheet_size", "SELECT page, id, least(1584, w) AS w, CAST(round_even(h * least(1, 1584.0 / w), 0) AS INT) AS h, greatest(320, least(1584, w) + 16) * (CAST(round_even(h * least(1, 1584.0 / w), 0) AS INT) + 42) AS pixels FROM (SELECT page, id, CAST(200 + pk % 3000 AS INT) AS w, CAST(100 + sk % 700 AS INT) AS h FROM fx_blocks)")
def g20(spark, d):
    s = G.sheet_size(200 + F.col("pk") % 3000, 100 + F.col("sk") % 700, review.MAX_PIXELS)
    return fx(spark, d, "blocks").select("page", "id", s.alias("s")).select("page", "id", "s.w", "s.h", G.sheet_pixels(F.col("s.w"), F.col("s.h") + G.BAND).alias("pixels"))


@query("g21_sheet_target", "SELECT page, id, 8 + 10 / (x2 - x1) * 200 AS x1, 34 + 5 / (y2 - y1) * 100 AS y1, CAST(208 AS DOUBLE) AS x2, CAST(134 AS DOUBLE) AS y2 FROM fx_blocks")
def g21(spark, d):
    b = layout.box_of()
    target = G.box(F.lit(10.0), F.lit(5.0), G.width(b), G.height(b))
    got = G.sheet_target(target, b, F.struct(F.lit(200).alias("w"), F.lit(100).alias("h")), F.lit(34.0))
    return fx(spark, d, "blocks").select("page", "id", got.alias("g")).select("page", "id", *(F.col("g")[c].alias(c) for c in ("x1", "y1", "x2", "y2")))


def _grouped(spark, d):
    """Units of three blocks each, with quadrilaterals on every second page."""
    b = fx(spark, d, "blocks").withColumn("grp", F.floor(F.col("ord") / 3).cast("long"))
    quads = F.transform(F.array_sort(F.collect_list(F.struct("ord", G.quad_of(layout.box_of()).alias("q")))), lambda x: x["q"])
    one = b.groupBy("page", "grp").agg(*(F.min(c).alias(c) for c in ("x1", "y1")), *(F.max(c).alias(c) for c in ("x2", "y2")), quads.alias("quads"), F.min_by("category", "ord").alias("category"), F.array_sort(F.collect_list("id")).alias("member_ids"))
    return one.withColumn("quads", F.when(F.col("page") % 2 == 0, F.col("quads")).otherwise(F.array().cast("array<array<double>>")))


@query("g13b_flow_bounds", "SELECT page, ord // 3 AS grp, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM fx_blocks GROUP BY ALL")
def g13b(spark, d):
    return layout.flow_boxes(_grouped(spark, d)).select("page", "grp", "x1", "y1", "x2", "y2")


_SHARED = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"


@query("j04_overlapping_quads", f"""SELECT u.page, u.grp, coalesce(o.hit, false) AS overlapping FROM (SELECT DISTINCT page, ord // 3 AS grp FROM fx_blocks) u LEFT JOIN (SELECT a.page, a.ord // 3 AS grp, bool_or({_SHARED} >= greatest(4, .02 * least((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1)))) AS hit
  FROM fx_blocks a JOIN fx_blocks b ON a.page = b.page AND a.ord // 3 = b.ord // 3 AND a.ord < b.ord WHERE a.page % 2 = 0 GROUP BY ALL) o ON o.page = u.page AND o.grp = u.grp""")
def j04(spark, d):
    return layout.overlapping_lines(_grouped(spark, d), ["page", "grp"])


@query("a12_merged_geometry", "SELECT page, id, x1, y1, x2, y2, n_quads FROM (SELECT a.page, a.ord AS id, least(a.x1, b.x1) AS x1, least(a.y1, b.y1) AS y1, greatest(a.x2, b.x2) AS x2, greatest(a.y2, b.y2) AS y2, CASE WHEN a.pk % 2 = 0 THEN 2 ELSE 1 END + CASE WHEN b.pk % 2 = 0 THEN 2 ELSE 1 END AS n_quads FROM fx_blocks a JOIN fx_blocks b ON a.page = b.page AND b.ord = a.ord + 1 WHERE a.ord % 2 = 0)")
def a12(spark, d):
    b = fx(spark, d, "blocks").withColumn("id", F.col("ord"))
    quad = G.quad_of(layout.box_of())
    units = b.withColumn("quads", F.when(F.col("pk") % 2 == 0, F.array(quad, quad)).otherwise(F.array().cast("array<array<double>>")))
    pairs = b.select("page", F.col("ord").alias("id"), F.lead("ord").over(_by_page()).alias("next")).where("id % 2 = 0 AND next IS NOT NULL")
    return review.merged_geometry(units, pairs.select("page", "id", F.array("id", "next").alias("sources")), P).select("page", "id", "x1", "y1", "x2", "y2", F.size("quads").alias("n_quads"))


def _by_page():
    from pyspark.sql import Window

    return Window.partitionBy("page").orderBy("ord")


@query("o02_closest", """SELECT a.page, a.id, (SELECT g.grp FROM (SELECT page, ord // 4 AS grp, arg_max(cy, ord) AS cy, arg_max(x1, ord) AS x1, arg_min(id, ord) AS first FROM (SELECT *, (y1 + y2) / 2 AS cy FROM fx_blocks) GROUP BY ALL) g WHERE g.page = a.page AND g.cy < a.cy ORDER BY a.cy - g.cy, abs(a.x1 - g.x1), g.first, g.grp LIMIT 1) AS closest FROM (SELECT *, (y1 + y2) / 2 AS cy FROM fx_blocks) a""")
def o02(spark, d):
    b = fx(spark, d, "blocks").select("page", "ord", "id", ((F.col("y1") + F.col("y2")) / 2).alias("center_y"), F.col("x1").alias("left"))
    g = b.groupBy("page", F.floor(F.col("ord") / 4).cast("long").alias("group")).agg(F.max_by("center_y", "ord").alias("center_y"), F.max_by("left", "ord").alias("left"), F.min_by("id", "ord").alias("first"))
    return report.closest_group(b, g, P)


@query("u03_with_figures", "SELECT page, id, category, source_label FROM fx_blocks UNION ALL SELECT page, printf('p%04d_source_figure_%04d', page, ord), 'figure', 'local_source_fragment' FROM fx_blocks WHERE category = 'figure'")
def u03(spark, d):
    b = fx(spark, d, "blocks")
    full = b.select("page", "id", "category", "source_label", "score", "x1", "y1", "x2", "y2", F.lit("").alias("hint"), F.lit(None).cast("array<double>").alias("quad"))
    return calls.with_figures(full, b.where("category = 'figure'").select("page", "ord", "x1", "y1", "x2", "y2"), "page").select("page", "id", "category", "source_label")


@query("u04_geometry_distinct", "SELECT page, min(ord) AS ord, x1, x2 FROM (SELECT page, ord, x1, CASE WHEN pk % 2 = 0 THEN NULL ELSE CAST(pk % 3 AS DOUBLE) END AS x2 FROM fx_blocks) GROUP BY page, x1, x2")
def u04(spark, d):
    b = fx(spark, d, "blocks").select("page", "ord", "x1", F.when(F.col("pk") % 2 != 0, (F.col("pk") % 3).cast("double")).alias("x2"))
    return report.geometry_distinct(b, P, "ord", ["x1", "x2"]).select("page", "ord", "x1", "x2")


@query("p07_router_state", "SELECT page, id, category, round(score, 4) AS detector_score, round(score / 3, 4) AS validation_score, length(source_label) AS decoded_length, 1 + pk % 3 AS member_count FROM fx_blocks")
def p07(spark, d):
    b = fx(spark, d, "blocks").withColumns({"detector_score": F.col("score"), "decoded": F.col("source_label"), "member_ids": F.array_repeat(F.lit("m"), (1 + F.col("pk") % 3).cast("int"))}).withColumn("score", F.col("score") / 3)
    return b.select("page", "id", calls.router_state().alias("s")).select("page", "id", "s.*")


# --- usage, costs, trace

_LEDGER = """(SELECT id, unnest(calls) AS c, generate_subscripts(calls, 1) - 1 AS n FROM (SELECT id, CASE WHEN id % 4 = 0 THEN ['ocr', 'math'] WHEN id % 4 = 1 THEN ['ocr', 'rescue'] WHEN id % 4 = 2 THEN ['ocr'] ELSE [] END AS calls FROM fx_math))"""


@query("a17_usage_ledger", f"SELECT id, CAST(n AS BIGINT) AS n, CASE WHEN c = 'rescue' THEN 'qwen_rescue' WHEN c = 'ocr' AND id % 10 = 0 THEN 'other' ELSE 'qwen_ocr' END AS provider, CASE c WHEN 'ocr' THEN id % 97 WHEN 'math' THEN 5 ELSE 7 END AS tokens FROM {_LEDGER}")
def a17(spark, d):
    i = F.col("id")
    names = lambda *x: F.array(*map(F.lit, x))
    made = F.when(i % 4 == 0, names("ocr", "math")).when(i % 4 == 1, names("ocr", "rescue")).when(i % 4 == 2, names("ocr")).otherwise(F.array().cast("array<string>"))
    own = F.concat(F.lit('{"input_tokens": '), (i % 97).cast("string"), F.when(i % 10 == 0, ', "provider": "other"}').otherwise("}"))
    u = fx(spark, d, "math").select("id", made.alias("calls"), own.alias("ocr_usage"), F.lit('{"input_tokens": 5}').alias("math_usage"), F.lit('{"prompt_tokens": 7}').alias("rescue_usage"))
    return decode.ledger(u, ["id"]).select("id", "n", "provider", report.usage_tokens(F.col("usage"), "input_tokens", "prompt_tokens").alias("tokens"))


_TOK = "coalesce(CASE WHEN list_contains(json_keys(j), '{0}') THEN CAST(j ->> '{0}' AS BIGINT) ELSE CAST(j ->> '{1}' AS BIGINT) END, 0)"


@query("a07_cost_with_pages", f"""SELECT doc_id, round(o, 8) AS qwen_ocr, round(r, 8) AS qwen_rescue, round(c, 8) AS content_review, round(p, 8) AS layout_rescue, round(o + r + c + p, 8) AS total FROM (SELECT coalesce(e.doc_id, g.doc_id) AS doc_id, coalesce(o, 0) AS o, coalesce(r, 0) AS r, coalesce(c, 0) AS c, coalesce(p, 0) AS p FROM (
  SELECT doc_id, sum(CASE provider WHEN 'qwen_ocr' THEN i * 0.0735::DOUBLE + t * 0.168::DOUBLE ELSE 0 END) / 1e6 AS o, sum(CASE provider WHEN 'qwen_rescue' THEN i * 1.74075::DOUBLE + t * 5.223305::DOUBLE ELSE 0 END) / 1e6 AS r, sum(CASE provider WHEN 'content_review' THEN i * 1.74075::DOUBLE + t * 5.223305::DOUBLE ELSE 0 END) / 1e6 AS c
  FROM (SELECT doc_id, provider, {_TOK.format('input_tokens', 'prompt_tokens')} AS i, {_TOK.format('output_tokens', 'completion_tokens')} AS t FROM (SELECT *, CAST(usage AS JSON) AS j FROM fx_usage)) GROUP BY doc_id) e
  FULL JOIN (SELECT user_id + 3 AS doc_id, count(*) * 0.004::DOUBLE AS p FROM events WHERE event_id % 7 = 0 GROUP BY ALL) g ON g.doc_id = e.doc_id)""")
def a07_pages(spark, d):
    u = fx(spark, d, "usage")
    e = u.select("doc_id", "provider", report.usage_tokens(F.col("usage"), "input_tokens", "prompt_tokens").alias("tokens_in"), report.usage_tokens(F.col("usage"), "output_tokens", "completion_tokens").alias("tokens_out"))
    pages = _t(spark, d, "events").where("event_id % 7 = 0").select((F.col("user_id") + 3).alias("doc_id"))
    return report.cost_estimate(e, ["doc_id"], pages=pages)


@query("d01_trace_rows", """SELECT user_id AS page, attempt, seq, k AS kind, CASE k WHEN 'request' THEN '[REDACTED]' END AS key, CASE k WHEN 'error' THEN 'ValueError: x' END AS error FROM (SELECT user_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt, unnest(['request', CASE WHEN event_id % 3 = 0 THEN 'error' ELSE 'response' END]) AS k FROM events)""")
def d01(spark, d):
    got = report.trace_rows(_trace_calls(spark, d), "page")
    return got.select("page", "attempt", "seq", "kind", F.get_json_object("payload", "$.api_key").alias("key"), F.get_json_object("payload", "$.error").alias("error"))


def _trace_calls(spark, d):
    i = F.col("event_id")
    return _t(spark, d, "events").select(
        F.col("user_id").alias("page"), i.alias("seq"), F.lit('{"api_key": "k", "model": "m"}').alias("request"),
        F.when(i % 3 != 0, F.lit('{"choices": []}')).alias("response"), F.when(i % 3 == 0, "ValueError: x").alias("error"),
    )


@query("s07_trace_documents", "SELECT user_id // 10 AS doc, count(*) AS attempts, count(*) FILTER (event_id % 3 = 0) AS errors FROM events GROUP BY ALL")
def s07(spark, d):
    trace = report.trace_rows(_trace_calls(spark, d), "page").withColumn("doc", F.floor(F.col("page") / 10).cast("long"))
    pages = F.from_json("json", "pages array<struct<page: bigint, attempt: bigint, payload: struct<error: string>>>")["pages"]
    return export.trace_json(trace, ["doc"], "response").select("doc", F.size(pages).cast("long").alias("attempts"), F.size(F.filter(pages, lambda x: x["payload"]["error"].isNotNull())).cast("long").alias("errors"))


@query("j13_trace_of_page", "SELECT page, count(*) AS n FROM (SELECT user_id AS page, unnest([1, 2]) AS k FROM events) WHERE page IN (SELECT o_orderkey FROM orders) GROUP BY page")
def j13(spark, d):
    pages = _t(spark, d, "orders").select(F.col("o_orderkey").alias("page"))
    return report.trace_of_page(report.trace_rows(_trace_calls(spark, d), "page"), pages, "page").groupBy("page").agg(F.count("*").alias("n"))


@query("d03_usable_boxes", "SELECT page, count(*) FILTER (starts_with(source_label, 'qwen_layout_')) AS usable FROM fx_blocks GROUP BY page")
def d03(spark, d):
    return report.usable_boxes(fx(spark, d, "blocks"), P)


# --- exports


@query("s01_scan_kinds", "SELECT id, lower(regexp_extract(name, '\\.([^./]+)$', 1)) AS kind, row_number() OVER (PARTITION BY id % 10 ORDER BY id) - 1 AS index FROM (SELECT page_id AS id, url || CASE page_id % 4 WHEN 0 THEN '/a.PNG' WHEN 1 THEN '/b.jpeg' WHEN 2 THEN '/c.Pdf' ELSE '/d.webp' END AS name FROM pages)")
def s01(spark, d):
    i = F.col("page_id")
    name = F.concat("url", F.when(i % 4 == 0, "/a.PNG").when(i % 4 == 1, "/b.jpeg").when(i % 4 == 2, "/c.Pdf").otherwise("/d.webp"))
    files = provider.checked_scans(_t(spark, d, "pages").select(i.alias("id"), name.alias("path"), (i % 10).alias("doc")))
    return layout.page_numbers(files, ["doc"], ["id"]).select("id", "kind", "index")


_FILES = "(SELECT doc_id // 30 AS doc, doc_id AS ord, CASE doc_id % 7 WHEN 0 THEN 'a b.PNG' WHEN 1 THEN 'x.exe' WHEN 2 THEN 'noext' ELSE 'page ' || doc_id || '.jpg' END AS name, CASE WHEN doc_id % 11 = 4 THEN 40000000 ELSE doc_id END AS length FROM documents WHERE doc_id // 30 % 2 = 0 OR doc_id % 30 < 18)"


@query("s05_uploads", f"SELECT doc, ord, CASE WHEN reason IS NULL THEN printf('%03d_%s', ord, regexp_replace(name, '[^A-Za-z0-9_.-]', '_', 'g')) END AS stored, reason FROM (SELECT *, CASE WHEN n > 20 THEN 'too many files' WHEN lower(regexp_extract(name, '\\.([^./]+)$', 1)) NOT IN ('pdf', 'png', 'jpg', 'jpeg', 'webp') THEN 'unsupported type' WHEN length > 31457280 THEN 'file too large' END AS reason FROM (SELECT *, count(*) OVER (PARTITION BY doc) AS n FROM {_FILES}))")
def s05(spark, d):
    i = F.col("doc_id")
    name = F.when(i % 7 == 0, "a b.PNG").when(i % 7 == 1, "x.exe").when(i % 7 == 2, "noext").otherwise(F.concat(F.lit("page "), i, F.lit(".jpg")))
    f = _t(spark, d, "documents").select(F.floor(i / 30).cast("long").alias("doc"), i.alias("ord"), name.alias("name"), F.when(i % 11 == 4, 40_000_000).otherwise(i).alias("length")).where("doc % 2 = 0 OR ord % 30 < 18")
    good, bad = export.checked_uploads(f, "doc", Settings())
    return good.select("doc", "ord", "stored", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("doc", "ord", F.lit(None).cast("string").alias("stored"), "reason"))


def _decoded(spark, d):
    n = fx(spark, d, "notes").withColumnsRenamed({"content": "decoded"})
    return n.withColumns({"doc": F.col("doc").cast("long"), "raw_decoded": F.concat("decoded", F.lit(" raw")), "decoder": F.concat(F.lit("ocr:"), "category"), "score": F.length("decoded") / 100, "rescued": F.col("ord") % 2 == 0, "member_ids": F.array("member"), "issues": F.array(F.lit("i")), "applied": F.lit(False)})


@query("s06_decoded_json", "SELECT CAST(doc AS BIGINT) AS doc, id, category, content AS decoded, content || ' raw' AS raw, x1, status, round(length(content) / 100, 6) AS validation FROM fx_notes")
def s06(spark, d):
    schema = "array<struct<id: string, category: string, bbox: struct<x1: double>, decoded: string, raw_decoded: string, quality_review: struct<status: string>, validation: double>>"
    rows = export.decoded_json(_decoded(spark, d), ["doc"]).select("doc", F.explode(F.from_json("json", schema)).alias("u"))
    return rows.select("doc", "u.id", "u.category", "u.decoded", F.col("u.raw_decoded").alias("raw"), F.col("u.bbox.x1").alias("x1"), F.col("u.quality_review.status").alias("status"), F.round("u.validation", 6).alias("validation"))


@query("s06_layout_json", "SELECT page, CAST(doc AS BIGINT) AS doc, count(*) AS units, count(*) FILTER (category = 'text') AS texts, min(x1) AS left FROM fx_notes GROUP BY ALL")
def s06_layout(spark, d):
    n = _decoded(spark, d)
    pages = n.select("doc", "page", F.lit(PAGE_W).alias("page_w"), F.lit(PAGE_H).alias("page_h"), F.lit("x").alias("detector"), F.lit(0.5).alias("quality")).distinct()
    blocks = n.select("doc", "page", "id", "category", "source_label", F.lit(1.0).alias("score"), "x1", "y1", "x2", "y2")
    schema = "pages array<struct<index: bigint, blocks: array<struct<category: string>>, units: array<struct<bbox: struct<x1: double>>>>>"
    rows = export.layout_json(pages, blocks, n, ["doc"]).select("doc", F.explode(F.from_json("json", schema)["pages"]).alias("p"))
    return rows.select(F.col("p.index").alias("page"), "doc", F.size("p.units").cast("long").alias("units"), F.size(F.filter("p.blocks", lambda b: b["category"] == "text")).cast("long").alias("texts"), F.array_min(F.transform("p.units", lambda u: u["bbox"]["x1"])).alias("left"))


@query("p08_decoded_rows", "SELECT page, id, category, content AS decoded, 'ocr:' || category AS decoder, 'structure' AS validation_kind FROM fx_notes")
def p08(spark, d):
    return _decoded(spark, d).select(*export.decoded_row()).select("page", "id", "category", "decoded", "decoder", "validation_kind")


@query("p09_manifest_arrays", "SELECT CAST(doc AS BIGINT) AS doc, count(*) AS decoders, string_agg(id, ',' ORDER BY page, id) AS ids, count(DISTINCT page) AS detectors, count(*) FILTER (ord % 2 = 0) AS rescued FROM fx_notes GROUP BY doc")
def p09(spark, d):
    n = _decoded(spark, d)
    pages = n.select("doc", "page", F.lit("x").alias("detector"), F.lit(0.5).alias("quality"), F.lit(False).alias("rescued")).distinct()
    both = export.decoder_rows(n, ["doc"]).join(export.detector_rows(pages, ["doc"]), "doc")
    return both.select("doc", F.size("decoders").cast("long").alias("decoders"), F.array_join(F.transform("decoders", lambda x: x["id"]), ",").alias("ids"), F.size("detectors").cast("long").alias("detectors"), F.size(F.filter("decoders", lambda x: x["rescued"])).cast("long").alias("rescued"))


@query("s09_source_pages", "SELECT page, printf('sources/page_%04d.png', page) AS path FROM (SELECT DISTINCT page FROM fx_notes WHERE status = 'uncertain')")
def s09(spark, d):
    n = fx(spark, d, "notes")
    return export.warned_sources(n.select("page").distinct(), n.where("status = 'uncertain'"), []).select("page", "path")


@query("o04_page_limit", "SELECT page, ord FROM fx_blocks")
def o04(spark, d):
    return export.page_limit(fx(spark, d, "blocks"), "page", 30).select("page", "ord")


@query("o06_log_tail", "SELECT doc_id AS id, right(text, 400) AS tail, left(text, 80) AS head FROM documents")
def o06(spark, d):
    return _t(spark, d, "documents").select(F.col("doc_id").alias("id"), export.tail(F.col("text"), 400).alias("tail"), F.left("text", F.lit(80)).alias("head"))


@query("u06_flat_units", "SELECT CAST(doc AS BIGINT) AS doc, page, unit FROM (SELECT doc, page, unnest(list(id)) AS unit FROM fx_notes GROUP BY doc, page)")
def u06(spark, d):
    nested = fx(spark, d, "notes").groupBy(F.col("doc").cast("long").alias("doc"), "page").agg(F.collect_list("id").alias("units"))
    return nested.select("doc", "page", F.explode("units").alias("unit"))


@query("x14_review_note", f"SELECT id, content || ' ' || '{{\\small\\itshape [' || {tex_sql(chr(39) + X.REVIEW_NOTE + chr(39))} || ']}}' AS noted FROM fx_tex")
def x14(spark, d):
    return fx(spark, d, "tex").select("id", F.concat_ws(" ", "content", X.review_note()).alias("noted"))
