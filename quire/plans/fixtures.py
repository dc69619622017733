"""Projections of the driver tables that stand in for the library's inputs.

Each is one SQL text that Spark and DuckDB read alike, in integer arithmetic, so both
get the same rows. `@table` names a table, `@bs` a backslash, `@bad` U+FFFD, `@arr`
the array constructor. Variation is put in by remainders, so every outcome occurs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
PAGE_W, PAGE_H = 1000, 1400

_LABELS = (
    "doc_title", "document_title", "paragraph_title", "text", "page_number", "abstract", "references", "footnotes", "header", "footer", "algorithm",
    "figure_caption", "table_caption", "figure_title", "chart_title", "sidebar_text", "list", "reference", "caption", "table_of_contents", "section_title",
    "section_header", "vertical_text", "reference_content", "formula", "equation", "formula_number", "inline_formula", "display_formula", "table", "image",
    "figure", "chart", "seal", "header_image", "footer_image", "picture", "diagram", "blob", "", "tables",
)

FX = {
    # a page is an order, a block a line of it
    "blocks": """
SELECT page, ord, concat('b', lpad(CAST(ord AS STRING), 4, '0')) AS id,
  CASE WHEN pk % 10 = 0 THEN 'figure' WHEN flag = 'R' THEN 'math' ELSE 'text' END AS category,
  CASE WHEN pk % 70 = 0 THEN 'residual_background' WHEN pk % 50 = 0 THEN 'local_source_fragment' WHEN pk % 9 = 1 THEN 'qwen_layout_text' ELSE 'block' END AS source_label,
  CAST(60 + 480 * (sk % 2) AS DOUBLE) AS x1, CAST(40 + 40 * ln + pk % 7 AS DOUBLE) AS y1,
  CAST(60 + 480 * (sk % 2) + 300 + pk % 140 AS DOUBLE) AS x2,
  CAST(40 + 40 * ln + pk % 7 + CASE WHEN pk % 10 = 0 THEN 200 ELSE 24 + q % 12 END AS DOUBLE) AS y2,
  CAST(d AS DOUBLE) / 100 AS score, pk, sk, ln, q
FROM (SELECT l_orderkey AS page, l_partkey AS pk, l_suppkey AS sk, CAST(l_linenumber AS BIGINT) AS ln, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_discount * 100) AS BIGINT) AS d, l_returnflag AS flag,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS ord FROM @lineitem) t""",
    "labels": "SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN label WHEN 1 THEN upper(replace(label, '_', ' ')) WHEN 2 THEN replace(label, '_', '-') ELSE concat('  ', label, ' ') END AS raw, p_name AS hint FROM @part JOIN (VALUES "
    + ", ".join(f"({i}, '{x}')" for i, x in enumerate(_LABELS))
    + f") AS v(k, label) ON v.k = p_partkey % {len(_LABELS)}",
    "rawcat": """
SELECT p_partkey AS id, CASE p_partkey % 12 WHEN 0 THEN 'Math' WHEN 1 THEN ' formula' WHEN 2 THEN 'equation' WHEN 3 THEN 'matrix' WHEN 4 THEN 'table' WHEN 5 THEN 'TABULAR' WHEN 6 THEN 'title' WHEN 7 THEN 'label' ELSE 'other' END AS raw,
  CASE p_size % 4 WHEN 0 THEN 'x = 1' WHEN 1 THEN p_name WHEN 2 THEN concat(CAST(p_size AS STRING), '+', CAST(p_partkey AS STRING), 'a') ELSE '' END AS hint FROM @part""",
    "text": """
SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'math' ELSE 'table' END AS category,
  CASE WHEN doc_id % 31 = 5 THEN '' WHEN doc_id % 31 = 6 THEN '  ' WHEN doc_id % 31 = 7 THEN 'x' WHEN doc_id % 31 = 8 THEN concat('|a|b|', chr(10), '|c|')
    WHEN doc_id % 31 = 9 THEN concat('<TABLE>', text, '</table>') WHEN doc_id % 31 = 10 THEN concat('@bsbegin{tabular}', text)
    ELSE concat(CASE WHEN doc_id % 3 = 1 THEN '@bsfrac{a}{b' ELSE '' END, CASE WHEN doc_id % 5 = 1 THEN '} ' ELSE '' END, text, repeat('?', CAST(doc_id % 40 AS INT)), CASE WHEN doc_id % 7 = 0 THEN '@bad@bad' ELSE '' END) END AS content
FROM @documents""",
    "math": """
SELECT p_partkey AS id, CASE p_partkey % 12
  WHEN 0 THEN concat('@bsfrac{', CAST(p_size AS STRING), '}{x}') WHEN 1 THEN concat('x = ', CAST(p_size AS STRING)) WHEN 2 THEN concat('{{a}', CAST(p_size AS STRING)) WHEN 3 THEN concat('a@bs{b', CAST(p_partkey AS STRING))
  WHEN 4 THEN concat('}{', p_brand) WHEN 5 THEN concat('@bssqrt{', p_brand, '} ?') WHEN 6 THEN concat('12+', CAST(p_size AS STRING), '-3') WHEN 7 THEN concat('sin x + cos ', CAST(p_size AS STRING), ' - log_2')
  WHEN 8 THEN concat('$a$ the words $b$ of ', p_name, ' IT') WHEN 9 THEN concat('@bstext{if} x^2 @bad ', CAST(p_size AS STRING)) WHEN 10 THEN concat('   ', p_name, ' = ', CAST(p_size AS STRING)) ELSE '' END AS content FROM @part""",
    "lines": """
SELECT doc_id AS id, CASE doc_id % 10 WHEN 0 THEN concat('# ', text) WHEN 1 THEN concat('####### ', text) WHEN 2 THEN concat('  ### ', text) WHEN 3 THEN concat('- ', text) WHEN 4 THEN concat('• ', text)
  WHEN 5 THEN concat(CAST(doc_id AS STRING), '. ', text) WHEN 6 THEN concat(CAST(doc_id AS STRING), ') ', text) WHEN 7 THEN concat('*', text) WHEN 8 THEN concat('a ', chr(9), '  b ', text, '  ') ELSE text END AS line
FROM (SELECT doc_id, replace(text, chr(10), ' ') AS text FROM @documents) t""",
    "fence": """
SELECT doc_id AS id, CASE doc_id % 6 WHEN 0 THEN concat('```markdown', chr(10), text, chr(10), '```') WHEN 1 THEN concat('  ```TEX ', chr(10), text) WHEN 2 THEN concat(text, chr(13), chr(10), 'x', chr(13), 'y ')
  WHEN 3 THEN concat('```json {"a": "', CAST(doc_id AS STRING), '"} ```') WHEN 4 THEN concat('note {x} ', CAST(doc_id AS STRING), ' {y} end') ELSE text END AS content FROM @documents""",
    "tex": "SELECT doc_id AS id, concat(text, CASE doc_id % 4 WHEN 0 THEN '@bs & % $ # _ { } ~ ^' WHEN 1 THEN '50% of $5 @bsalpha_{x}^2' ELSE '' END) AS content FROM @documents",
    # a pipe table for each supplier's nation
    "pipe": """
SELECT n_nationkey AS id, concat('Table:', chr(10), '| nation | key |', chr(10), '|---|:-:|', chr(10), '| ', n_name, ' & co | ', CAST(n_nationkey AS STRING), CASE WHEN n_nationkey % 3 = 0 THEN ' | extra_cell |' ELSE ' |' END, chr(10),
  CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE '| only 50% |' END) AS content FROM @nation
UNION ALL SELECT 1000 + p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN concat(p_name, '|', p_brand) WHEN 2 THEN concat('|', p_type, '||', CAST(p_size AS STRING), '&lt;|') ELSE '|--|' END AS content FROM @part""",
    "html": """
SELECT r_regionkey AS id, concat('<table><tr><th>region</th><th>key</th></tr><tr><td>', r_name, '</td><td> ', CAST(r_regionkey AS STRING), '  x</td></tr></table>') AS content FROM @region
UNION ALL SELECT 100 + page_id AS id, html AS content FROM @pages""",
    # a listing of rotated rectangles for each order
    "csv": """
SELECT l_orderkey AS page, concat(CASE WHEN l_orderkey % 4 = 0 THEN concat('```csv', chr(10)) ELSE '' END, body, CASE WHEN l_orderkey % 13 = 5 THEN concat(chr(10), 'a,b,c,d,e') WHEN l_orderkey % 13 = 6 THEN concat(chr(10), '1,2,3,4') WHEN l_orderkey % 13 = 7 THEN concat(chr(10), '500,500,0,20,0') ELSE '' END,
  CASE WHEN l_orderkey % 4 = 0 THEN concat(chr(10), '```') ELSE '' END) AS content
FROM (SELECT l_orderkey, string_agg(concat(CAST(l_partkey % 1001 AS STRING), ', ', CAST(l_suppkey % 990 AS STRING), ',', CAST(20 + l_partkey % 300 AS STRING), ',', CAST(10 + l_linenumber AS STRING), ',', CAST(l_partkey % 7 * 15 - 45 AS STRING)), chr(10) @within) AS body
  FROM @lineitem GROUP BY l_orderkey) t""",
    "usage": """
SELECT event_id AS id, user_id AS doc_id, CASE event_type WHEN 'click' THEN 'qwen_ocr' WHEN 'view' THEN 'qwen_rescue' WHEN 'purchase' THEN 'content_review' ELSE event_type END AS provider,
  CASE event_id % 5 WHEN 0 THEN concat('{"input_tokens": ', t, ', "output_tokens": ', o, '}') WHEN 1 THEN concat('{"prompt_tokens": ', t, ', "completion_tokens": ', o, '}')
    WHEN 2 THEN concat('{"input_tokens": null, "prompt_tokens": ', t, '}') WHEN 3 THEN '{}' ELSE concat('{"input_tokens": ', t, ', "prompt_tokens": 7, "output_tokens": ', o, '}') END AS usage
FROM (SELECT event_id, user_id, event_type, CAST(event_id % 977 AS STRING) AS t, CAST(event_id % 331 AS STRING) AS o FROM @events) e""",
    # review units: ten documents make a batch
    "units": """
SELECT d.doc_id AS id, (d.doc_id - d.doc_id % 10) / 10 AS batch, d.doc_id % 10 AS ord, CASE d.doc_id % 4 WHEN 0 THEN 'math' WHEN 1 THEN 'table' ELSE 'text' END AS category,
  CASE WHEN d.doc_id % 17 = 3 THEN '' WHEN d.doc_id % 4 = 0 THEN concat('x_', CAST(d.doc_id AS STRING)) ELSE d.text END AS decoded,
  CASE WHEN d.doc_id % 9 = 2 THEN '' ELSE concat('crop/', CAST(d.doc_id AS STRING), '.png') END AS crop_path,
  CASE WHEN d.doc_id % 23 = 4 THEN 'p0000_fullpage' ELSE concat('b', CAST(d.doc_id AS STRING)) END AS member, l.quality, l.toxic
FROM @documents d LEFT JOIN @labels l ON d.doc_id = l.doc_id""",
    # a record claims its document, and every third one the next document too
    "records": """
SELECT d.doc_id AS id, (d.doc_id - d.doc_id % 10) / 10 AS batch, CASE WHEN d.doc_id % 13 = 6 THEN 'figure' ELSE 'text' END AS category,
  CASE WHEN l.toxic = 1 THEN 'uncertain' WHEN l.quality = 1 THEN 'verified' WHEN d.doc_id % 19 = 4 THEN 'odd' ELSE 'corrected' END AS status,
  CASE WHEN d.doc_id % 6 = 5 THEN 0 ELSE 1 END AS n_issues, CASE WHEN d.doc_id % 29 = 7 THEN '  ' WHEN d.doc_id % 2 = 0 THEN d.text ELSE concat(d.text, ' fixed') END AS text,
  CASE WHEN d.doc_id % 3 = 0 THEN d.doc_id + 1 WHEN d.doc_id % 14 = 4 THEN d.doc_id END AS second
FROM @documents d LEFT JOIN @labels l ON d.doc_id = l.doc_id WHERE d.doc_id % 5 <> 1""",
    "prose": """
SELECT conv_id AS page, turn AS ord, concat('u', lpad(CAST(turn AS STRING), 4, '0')) AS id, CASE WHEN turn % 5 = 3 THEN 'math' WHEN turn % 5 = 4 THEN 'table' WHEN (conv_id + turn) % 7 = 0 THEN 'unknown' ELSE 'text' END AS category, text,
  CAST(60 + 30 * (length(text) % 2) AS DOUBLE) AS x1, CAST(60 + 40 * turn AS DOUBLE) AS y1, CAST(560 + length(text) % 300 AS DOUBLE) AS x2, CAST(60 + 40 * turn + 20 + length(text) % 13 AS DOUBLE) AS y2 FROM @conversations""",
    # units of documents: four conversations make one, a conversation is a page, a turn a unit
    "notes": """
SELECT (conv_id - conv_id % 4) / 4 AS doc, conv_id AS page, turn AS ord, concat('p', lpad(CAST(conv_id AS STRING), 4, '0'), '_U', lpad(CAST(turn AS STRING), 4, '0')) AS id,
  CASE (conv_id + 3 * turn) % 11 WHEN 3 THEN 'math' WHEN 7 THEN 'table' WHEN 9 THEN 'figure' WHEN 10 THEN 'unknown' ELSE 'text' END AS category,
  CASE (conv_id + 3 * turn) % 11
    WHEN 3 THEN CASE turn % 5 WHEN 0 THEN concat('$$x_', CAST(turn AS STRING), ' = ', CAST(length(text) AS STRING), '$$') WHEN 1 THEN concat('@bsbegin{align*}a_', CAST(turn AS STRING), '@bsend{align*}') WHEN 2 THEN concat('```latex', chr(10), '@bsfrac{a}{', CAST(turn AS STRING), '}', chr(10), '```') WHEN 3 THEN '' ELSE concat('@bs[y^', CAST(turn AS STRING), '@bs] $z$') END
    WHEN 7 THEN CASE turn % 4 WHEN 0 THEN concat('| a | ', CAST(turn AS STRING), ' & |', chr(10), '|---|---|', chr(10), '| c |') WHEN 1 THEN concat('<table><tr><td>n</td><td>', CAST(turn AS STRING), ' &lt; 5</td></tr></table>') WHEN 2 THEN 'no table' ELSE concat('@bsbegin{tabular}{l}', CAST(turn AS STRING), '@bsend{tabular}') END
    ELSE CASE (2 * conv_id + turn) % 10 WHEN 0 THEN concat('# ', flat) WHEN 1 THEN concat('- a', chr(10), '* ', flat, chr(10), 'goes on') WHEN 2 THEN concat('costs $', CAST(turn AS STRING), ' and $', CAST(length(text) AS STRING), ' for ', flat) WHEN 3 THEN concat(flat, ' with $x_', CAST(turn AS STRING), '$ inside, and **bold $b$ words**')
      WHEN 4 THEN concat(CAST(3 + turn AS STRING), '. ', flat, chr(10), CAST(4 + turn AS STRING), ') two', chr(10), '- three') WHEN 5 THEN concat(flat, chr(10), chr(10), '  **bold** & 50%  of ', chr(9), ' it', chr(10), '### end {x}') WHEN 6 THEN '' WHEN 7 THEN concat('```markdown', chr(10), flat, chr(10), 'more of it', chr(10), '```')
      WHEN 8 THEN concat('$a_', CAST(turn AS STRING), '$', chr(10), flat) ELSE flat END END AS content,
  CASE WHEN (conv_id + turn) % 5 = 2 THEN '' ELSE concat('crops/', CAST(conv_id AS STRING), '/u', CAST(turn AS STRING), CASE WHEN turn % 2 = 0 THEN '.PNG' ELSE '.png' END) END AS crop_path,
  CASE (conv_id + turn) % 6 WHEN 0 THEN 'uncertain' WHEN 1 THEN 'not_reviewed' WHEN 2 THEN 'corrected' WHEN 3 THEN 'not_applicable' ELSE 'verified' END AS status, (conv_id + turn) % 6 = 1 AND conv_id % 3 = 0 AS mark_pdf,
  CASE WHEN (7 * conv_id + turn) % 13 = 5 THEN 'leader' WHEN turn % 2 = 0 THEN '' END AS merged_into,
  CASE WHEN (conv_id + 2 * turn) % 17 = 3 THEN concat('b', CAST(turn AS STRING), '_residual') ELSE concat('b', CAST(turn AS STRING)) END AS member,
  CASE (conv_id + turn) % 19 WHEN 4 THEN 'whole_page_no_text' WHEN 5 THEN 'residual_background' ELSE 'text' END AS source_label,
  CAST(60 + 30 * (length(text) % 2) AS DOUBLE) AS x1, CAST(60 + 40 * turn AS DOUBLE) AS y1, CAST(560 + length(text) % 300 AS DOUBLE) AS x2, CAST(60 + 40 * turn + 20 + length(text) % 13 AS DOUBLE) AS y2
FROM (SELECT conv_id, turn, text, replace(text, chr(10), ' ') AS flat FROM @conversations) t""",
    # responses of layout models in six shapes
    "responses": """
SELECT id, n,
  CASE id % 6 WHEN 0 THEN concat('{"a": [{"b": {"words_info": [{"location": [', n, ', 0, ', m, ', 0, ', m, ', 5, ', n, ', 5], "text": " w', n, ' "}, "no object"]}}], "words_info": null, "usage": {"input_tokens": 3}}') ELSE '{"choices": []}' END AS raw,
  CASE id % 6 WHEN 1 THEN concat('{"words_info": [{"location": [', n, ', 0, ', m, ', 0, ', m, ', 5, ', n, ', 5], "word": "w', n, '", "category": " Formula "}]}')
    WHEN 2 THEN concat('{"pos_list": [{"rotate_rect": [', n, ', 2, 3, 4, 5]}, {"rotate_rect": [', n, ', 2, 3, 4, 5]}], "x": [{"bbox": [1, 2, 3, ', n, ']}]}')
    WHEN 3 THEN concat(n, ',10,20,10,0', chr(10), n, ', 50,20,10,0')
    WHEN 4 THEN concat('```json', chr(10), '{"words_info": [], "deep": [{"location": [', n, ', 0, ', m, ', 0, ', m, ', 5, ', n, ', 5]}]}', chr(10), '```') WHEN 5 THEN 'no layout at all' ELSE '' END AS text
FROM (SELECT event_id AS id, CAST(event_id % 990 AS STRING) AS n, CAST(event_id % 990 + 9 AS STRING) AS m FROM @events) t""",
    # drafts of a review batch: the blocks of a page that aren't figures, in two pages
    "drafts": """
SELECT batch, id, id AS ord, CASE WHEN id < 4 THEN 0 ELSE 1 END AS page, CASE WHEN pk % 4 = 0 THEN 'math' WHEN pk % 4 = 3 AND sk % 3 = 0 THEN 'table' ELSE 'text' END AS category,
  CASE pk % 6 WHEN 0 THEN concat('a = ', CAST(pk AS STRING)) WHEN 1 THEN concat('@bsfrac{', CAST(pk AS STRING), '}{2}') WHEN 2 THEN 'some plain words of prose' WHEN 3 THEN 'so $x$ holds for continuous maps' WHEN 4 THEN concat('x_', CAST(pk AS STRING)) ELSE 'is = it' END AS decoded,
  x1, y1, x2, y2
FROM (SELECT l_orderkey AS batch, l_partkey AS pk, l_suppkey AS sk, CAST(60 + 480 * (l_suppkey % 2) AS DOUBLE) AS x1, CAST(40 + 40 * CAST(l_linenumber AS BIGINT) + l_partkey % 7 AS DOUBLE) AS y1, CAST(60 + 480 * (l_suppkey % 2) + 300 + l_partkey % 140 AS DOUBLE) AS x2,
  CAST(40 + 40 * CAST(l_linenumber AS BIGINT) + l_partkey % 7 + 24 AS DOUBLE) AS y2, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS id FROM @lineitem) t""",
    # records of a review batch: most drafts have one, some name two sources
    "claims": """
SELECT batch, id, pk, CASE WHEN pk % 5 < 2 THEN id + 1 WHEN pk % 31 = 7 THEN id + 2 WHEN pk % 29 = 5 THEN id WHEN pk % 23 = 4 THEN id - 1 END AS second,
  CASE WHEN pk % 41 = 9 THEN 'figure' WHEN sk % 4 = 0 THEN 'math' WHEN sk % 17 = 3 THEN 'table' ELSE 'text' END AS category, CASE WHEN q % 7 = 0 THEN 'uncertain' WHEN q % 7 = 1 THEN 'verified' WHEN q % 43 = 2 THEN 'odd' ELSE 'corrected' END AS status,
  CASE WHEN (pk + sk) % 13 = 6 THEN 0 ELSE 1 END AS n_issues,
  CASE WHEN q % 7 = 1 AND pk % 3 > 0 THEN CASE pk % 6 WHEN 0 THEN concat('a = ', CAST(pk AS STRING)) WHEN 1 THEN concat('@bsfrac{', CAST(pk AS STRING), '}{2}') WHEN 2 THEN 'some plain words of prose' WHEN 3 THEN 'so $x$ holds for continuous maps' WHEN 4 THEN concat('x_', CAST(pk AS STRING)) ELSE 'is = it' END
    ELSE CASE (pk + 2 * sk) % 9 WHEN 0 THEN '{open' WHEN 1 THEN '$y left' WHEN 2 THEN '@bsfrac{a}{b}' WHEN 3 THEN ' ' WHEN 4 THEN 'only words of prose here' WHEN 5 THEN '$a$' ELSE 'so $a$ holds for many maps' END END AS text
FROM (SELECT l_orderkey AS batch, l_partkey AS pk, l_suppkey AS sk, CAST(l_quantity AS BIGINT) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS id FROM @lineitem) t WHERE (pk + id) % 3 <> 0""",
    "quads": """
SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN @arr(x1, y1, x2, y1 + b, x2 - a, y2, x1 - a, y2 - b) WHEN vec_id % 3 = 1 THEN @arr(x1, y1, x1, y2, x2, y2, x2, y1) ELSE @arr(x1, y1, x2, y2, x2, y1, x1 + a, y2) END AS quad, x1, y1, x2, y2
FROM (SELECT vec_id, CAST(vec_id % 90 * 10 AS DOUBLE) AS x1, CAST(vec_id % 61 * 20 + 5 AS DOUBLE) AS y1, CAST(vec_id % 90 * 10 + 40 + label * 7 AS DOUBLE) AS x2, CAST(vec_id % 61 * 20 + 35 + label % 5 AS DOUBLE) AS y2, CAST(label % 4 AS DOUBLE) AS a, CAST(vec_id % 5 AS DOUBLE) AS b FROM @embeddings) t""",
    # edges between neighbouring lines of an order
    "edges": """
SELECT page, ord AS a, ord + 1 AS b FROM (SELECT l_orderkey AS page, l_partkey AS pk, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS ord, count(*) OVER (PARTITION BY l_orderkey) AS n FROM @lineitem) t
WHERE ord + 1 < n AND pk % 3 <> 0""",
}


def duck(name: str) -> str:
    """The projection as DuckDB reads it."""
    sql = FX[name].replace("@bs", "\\").replace("@bad", "\ufffd").replace("@arr", "list_value").replace("@within", "ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate")
    return re.sub(r"@(\w+)", r"\1", sql)


def fx(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The projection as Spark reads it."""
    sql = FX[name].replace("@bs", "\\\\").replace("@bad", "\ufffd").replace("@arr", "array")
    sql = sql.replace("chr(10) @within)", "chr(10)) WITHIN GROUP (ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate)")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"@(\w+)", sql)) if t in TABLES}
    sql = re.sub(r"@(\w+)", r"{\1}", sql.replace("{", "{{").replace("}", "}}"))
    return spark.sql(sql, **tables)
