"""The registered queries of this subpackage and, where SQL can say it, the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, chat, decontaminate, lines, lm, packing, quality, rollup, simhash, substring
from quire.llm.common import new_folder, removed, written

#: Where the files of public tokenizers lie; public_tokenizers.path(name) says the same.
def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digest(chat.format_conversations(turns.unionByName(own)))


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') AS body,
    replace(replace(replace(replace(replace(replace(role, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), chr(10), '\' || chr(10)) AS who,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
s AS (SELECT *, CASE WHEN role = 'assistant' THEN length(body) + 7 ELSE length(who) + length(body) + 14 END AS size FROM e),
p AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM s)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY k)) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR k = n THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars,
  count(*) FILTER (role = 'assistant' OR k = n) AS n_examples
FROM p GROUP BY conv_id"""


def op2_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four commits: every document enters with its words and an estimate of its ids (a quarter of its bytes),
    the estimates are revised to exact counts, documents without a word are deleted, and the revision is sent again."""
    folder = new_folder(spark, "rollup")
    counts = written(rollup.count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), pattern()), folder, "counts")
    guess = F.ceil(F.col("n_bytes") / 4)
    empty = counts.where("n_words = 0")
    revised = rollup.events(counts, "revise", "byte_bpe_50k", F.col("n_bpe"), guess)
    totals = rollup.Rollup(spark, folder)
    totals.commit("load", rollup.events(counts, "insert", "words-1", F.col("n_words")).unionByName(rollup.events(counts, "insert", "byte_bpe_50k", guess)))
    totals.commit("recount", revised)
    totals.commit("drop-empty", rollup.events(empty, "delete", "words-1", F.col("n_words")).unionByName(rollup.events(empty, "delete", "byte_bpe_50k", F.col("n_bpe"))))
    totals.commit("recount", revised)
    removed(spark, f"{folder}/counts")
    return totals.totals()


def op3_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), pattern()))


def op4_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judged(docs, quality.train_on(docs, table(spark, sf_dir, "labels")))


def op5_simhash_gph(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, distance=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_held_out(table(spark, sf_dir, "documents"))


def op7_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_substring_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(substring.dedup_substrings(table(spark, sf_dir, "documents")))


def op9_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "packed")
    shards = packing.write_shards(table(spark, sf_dir, "documents"), folder, tokenizer("word_bpe_49k.json"), end_id=1, shards=int(spark.conf.get("spark.sql.shuffle.partitions")))
    return packing.read_shards(spark, folder, shards)


def op10_line_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(lines.dedup_lines(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_chat_prefix_targets": op1_chat_prefix_targets,
    "op2_token_rollups": op2_token_rollups,
    "op3_bpe_tree": op3_bpe_tree,
    "op4_quality_trees": op4_quality_trees,
    "op5_simhash_gph": op5_simhash_gph,
    "op6_kneser_ney": op6_kneser_ney,
    "op7_template_leaks": op7_template_leaks,
    "op8_substring_anchors": op8_substring_anchors,
    "op9_packed_ids": op9_packed_ids,
    "op10_line_alignment": op10_line_alignment,
}

ORACLES = {"op1_chat_prefix_targets": OP1_SQL}

OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, unnest(range(1, len(ws) - 48)) AS p, ws FROM w WHERE len(ws) >= 50),
h AS (SELECT doc_id, p, array_to_string(ws[p:p + 49], ' ') AS seq FROM s),
f AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY md5(seq)) AS low FROM h) WHERE doc_id > low),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM f),
e AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN e ON w.doc_id = e.doc_id"""

ORACLES["op8_substring_anchors"] = OP8_SQL

_QUOTED = decontaminate.PUNCTUATION.replace("'", "''")
_UNITS = ", ".join(f"'{u}'" for u in decontaminate.UNITS)
_ENDS = ", ".join(f"'{e}'" for e in decontaminate.SENTENCE_ENDS)
_TEMPLATE = rf"""
  SELECT *, list_transform(low, lambda l, i: CASE
    WHEN ascii(l) BETWEEN 48 AND 57 THEN CASE WHEN regexp_full_match(l, '[0-9.,:/-]+') THEN '#num' ELSE '#qty' END
    WHEN l = cores[i] THEN CASE WHEN l IN ({_UNITS}) THEN '#unit' ELSE l END
    WHEN i = 1 OR right(ws[i - 1], 1) IN ({_ENDS}) THEN l ELSE '#name' END) AS canon
  FROM (SELECT *, list_transform(cores, lambda c: lower(c)) AS low FROM (
    SELECT *, list_transform(ws, lambda w: trim(w, '{_QUOTED}')) AS cores FROM (
      SELECT *, string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') AS ws FROM SOURCE)))"""

OP7_SQL = (
    "WITH d AS (" + _TEMPLATE.replace("SOURCE", "(SELECT DISTINCT doc_id, text FROM documents)") + "),\nb AS (SELECT row_number() OVER () AS row, * FROM (" + _TEMPLATE.replace("SOURCE", "benchmark") + """)),
kinds AS (
  SELECT row, item_id, false AS literal, canon AS toks, list_transform(canon, lambda t: CASE WHEN t <> '' AND NOT starts_with(t, '#') THEN 1 ELSE 0 END) AS flags FROM b
  UNION ALL SELECT row, item_id, true, low, list_transform(low, lambda t: CASE WHEN t <> '' THEN 1 ELSE 0 END) FROM b),
fit AS (
  SELECT *, list_filter([8, 16, 32], lambda s: p + s <= len(toks) AND list_sum(flags[p + 1:p + s]) >= 5)[1] AS size
  FROM (SELECT *, unnest(range(0, len(toks))) AS p FROM kinds)),
bw AS (
  SELECT DISTINCT item_id, literal, p AS pos, size, array_to_string(toks[p + 1:p + size], ' ') AS h FROM fit WHERE size IS NOT NULL
  UNION SELECT item_id, literal, 0, len(toks), array_to_string(toks, ' ') FROM kinds
    WHERE list_sum(flags) >= 3 AND (row, literal) NOT IN (SELECT row, literal FROM fit WHERE size IS NOT NULL)),
dp AS (SELECT doc_id, text, canon, low, s.size, unnest(range(0, greatest(len(low) - s.size + 1, 0))) AS pos FROM d, (SELECT DISTINCT size FROM bw) s),
dw AS (
  SELECT doc_id, text, size, pos, false AS literal, array_to_string(canon[pos + 1:pos + size], ' ') AS h FROM dp
  UNION ALL SELECT doc_id, text, size, pos, true, array_to_string(low[pos + 1:pos + size], ' ') FROM dp),
hits AS (SELECT DISTINCT doc_id, text, item_id, literal, dw.pos - bw.pos AS diag, bw.pos, size FROM dw JOIN bw USING (literal, size, h)),
runs AS (SELECT doc_id, text, item_id, diag, literal, list_sort(list_distinct(flatten(list(range(pos, pos + size))))) AS places FROM hits GROUP BY ALL),
i AS (SELECT item_id, t.canon AS canon, t.low AS low FROM (SELECT item_id, min({'canon': canon, 'low': low}) AS t FROM b GROUP BY item_id)),
slots AS (
  SELECT r.doc_id, r.text, r.item_id, r.literal, places, len(i.canon) AS n,
    list_transform(list_filter(places, lambda x: starts_with(i.canon[x + 1], '#')),
      lambda x: {'kind': i.canon[x + 1], 'item': i.low[x + 1], 'doc': d.low[x + diag + 1]}) AS pairs
  FROM runs r JOIN d ON d.doc_id IS NOT DISTINCT FROM r.doc_id AND d.text = r.text JOIN i USING (item_id)),
good AS (
  SELECT *, len(list_distinct(pairs)) AS n_slots, len(list_filter(pairs, lambda x: x.item <> x.doc)) > 0 AS changed FROM slots
  WHERE literal OR (len(list_distinct(list_transform(pairs, lambda x: [x.kind, x.item]))) = len(list_distinct(pairs))
    AND len(list_distinct(list_transform(list_filter(pairs, lambda x: x.kind = '#name'), lambda x: x.doc))) = len(list_distinct(list_filter(pairs, lambda x: x.kind = '#name'))))),
total AS (
  SELECT doc_id, text, item_id, len(list_distinct(flatten(list(places)))) AS covered, max(n) AS item_tokens, max(n_slots) AS slots, bool_or(changed) AS changed
  FROM good GROUP BY doc_id, text, item_id)
SELECT doc_id, item_id, CAST(covered AS BIGINT) AS covered, CAST(item_tokens AS BIGINT) AS item_tokens, CAST(slots AS BIGINT) AS slots, changed
FROM total WHERE covered >= 13 OR covered >= 0.6 * item_tokens"""
)

ORACLES["op7_template_leaks"] = OP7_SQL
