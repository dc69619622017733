"""Reports: costs, status, trace folding, and the checks that stand before an export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.sources import provider

#: List prices in USD per million tokens (in, out).
PRICES = {"qwen_ocr": (0.0735, 0.168), "qwen_rescue": (1.74075, 5.223305), "content_review": (1.74075, 5.223305)}
PER_PAGE = 0.004
TYPED = ("text", "math", "table")


def usage_tokens(usage: Column, key: str, other: str) -> Column:
    """Tokens under key if it is present, even as null, else under other, else 0. usage is a JSON text."""
    v = F.try_parse_json(usage)
    there = F.array_contains(F.json_object_keys(usage), key)
    get = lambda k: F.coalesce(F.try_variant_get(v, f"$.{k}", "bigint"), F.lit(0))
    return F.when(there, get(key)).otherwise(get(other))


def cost_estimate(events: DataFrame, keys: list[str], prices: dict = PRICES, pages: DataFrame | None = None, per_page: float = PER_PAGE) -> DataFrame:
    """A row a key: cost of each provider (keys, provider, tokens_in, tokens_out), and the total of the unrounded parts.

    pages (keys, and a row for each page that the second layout provider read) add `layout_rescue` at a price a page.
    """
    part = lambda p: F.sum(F.when(F.col("provider") == p, F.col("tokens_in") * prices[p][0] + F.col("tokens_out") * prices[p][1]).otherwise(0.0)) / 1e6
    raw, names = events.groupBy(*keys).agg(*(part(p).alias(p) for p in prices)), list(prices)
    if pages is not None:
        raw = raw.join(pages.groupBy(*keys).agg((F.count("*") * per_page).alias("layout_rescue")), keys, "full").fillna(0.0, [*names, "layout_rescue"])
        names.append("layout_rescue")
    return raw.select(*keys, *(F.round(p, 8).alias(p) for p in names), F.round(sum((F.col(p) for p in names[1:]), F.col(names[0])), 8).alias("total"))


def manifest_status(compiled: Column, warned: Column) -> Column:
    return F.when(~compiled, "error").when(warned, "warning").otherwise("ok")


def missing_transcription(units: DataFrame) -> DataFrame:
    """Typed units with a blank draft that weren't merged away."""
    return units.where(F.col("category").isin(*TYPED) & (F.regexp_replace("decoded", r"(?U)\s+", "") == "") & F.col("merged_into").isNull())


def warned_pages(pages: DataFrame, warnings: DataFrame, quality: DataFrame, keys: list[str]) -> DataFrame:
    """Semi-join: pages with a warning or of quality 0."""
    bad = warnings.select(*keys).unionByName(quality.where("quality = 0").select(*keys)).distinct()
    return pages.join(bad, keys, "left_semi")


def fold_trace(events: DataFrame, keys: list[str]) -> DataFrame:
    """Current state of each page of a trace (keys, seq, kind, payload): the last parse wins."""
    parsed = F.col("kind") == "parsed"
    out = events.groupBy(*keys).agg(
        F.count_if(F.col("kind") == "request").alias("attempts"),
        F.max_by(F.when(parsed, F.col("payload")), F.when(parsed, F.col("seq"))).alias("parsed"),
        F.max(F.when(F.col("kind") == "error", F.col("seq"))).alias("error_seq"),
        F.max(F.when(parsed, F.col("seq"))).alias("parsed_seq"),
    )
    status = F.when(F.col("parsed").isNull() & F.col("error_seq").isNull(), "pending").when(F.col("parsed").isNull() | (F.col("error_seq") > F.col("parsed_seq")), "error").when(F.col("parsed") == 0, "no_usable_boxes").otherwise("ok")
    return out.select(*keys, "attempts", "parsed", status.alias("status"))


def stacked(rows: DataFrame, keys: list[str], order: list[str], height: Column, gap: float) -> DataFrame:
    """rows with top: where each begins when they are stacked with a gap between."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("top", F.coalesce(F.sum(height + F.lit(gap)).over(before), F.lit(0.0)))


def thin_runs(values: DataFrame, keys: list[str], value: str, most: int) -> DataFrame:
    """(keys, first, last): runs of consecutive integers that are at most `most` long. Values are distinct within a key."""
    island = F.col(value) - F.row_number().over(Window.partitionBy(*keys).orderBy(value))
    runs = values.withColumn("island", island).groupBy(*keys, "island").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("n"))
    return runs.where(F.col("n") <= most).select(*keys, "first", "last")


def all_or_none(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The rows of keys with at most `most` of them; a key with more has none."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return rows.withColumn("n", n).where(F.col("n") <= most).drop("n")


# --- the trace of layout calls --------------------------------------------------------------------------------------


def trace_rows(calls: DataFrame, page: str, secret: str = "") -> DataFrame:
    """(page, attempt, seq, kind, payload): a request and a response or error for each call (page, seq, request, response,
    error), payloads without secrets and pictures."""
    numbered = calls.withColumn("attempt", F.row_number().over(Window.partitionBy(page).orderBy("seq")).cast("long"))
    kind = F.when(F.col("error").isNotNull(), "error").otherwise("response")
    said = F.when(F.col("error").isNotNull(), F.to_json(F.struct("error"))).otherwise(F.col("response"))
    each = F.array(F.struct(F.lit("request").alias("kind"), F.col("request").alias("payload")), F.struct(kind.alias("kind"), said.alias("payload")))
    rows = numbered.select(page, "attempt", "seq", F.explode(each).alias("x")).select(page, "attempt", "seq", "x.kind", "x.payload")
    return provider.redacted(rows, [page, "attempt", "seq", "kind"], "payload", secret, images=True).withColumnRenamed("shown", "payload")


def usable_boxes(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, usable): blocks that the layout model found; none where the whole page is one block."""
    return blocks.groupBy(*keys).agg(F.count_if(F.startswith("source_label", F.lit("qwen_layout_"))).alias("usable"))


def trace_of_page(trace: DataFrame, pages: DataFrame, page: str) -> DataFrame:
    """Trace rows of pages that are there."""
    return trace.join(pages.select(page).distinct(), page)


def closest_group(units: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, closest): the group (keys, group, center_y, left, first) above a line (keys, id, center_y, left) that is
    closest by height, then by its left edge, then by its first member."""
    g = groups.select(*keys, F.col("group").alias("g"), F.col("center_y").alias("g_y"), F.col("left").alias("g_left"), "first")
    key = F.struct((F.col("center_y") - F.col("g_y")).alias("dy"), F.abs(F.col("left") - F.col("g_left")).alias("dx"), "first", "g")
    best = units.join(g, keys).where("g_y < center_y").groupBy(*keys, "id").agg(F.min(key)["g"].alias("closest"))
    return units.select(*keys, "id").join(best, [*keys, "id"], "left")


def geometry_distinct(items: DataFrame, keys: list[str], order: str, geometry: list[str]) -> DataFrame:
    """items without those whose geometry, as JSON, an earlier one of the key has."""
    shown = F.to_json(F.struct(*geometry))
    first = items.withColumn("q_geo", shown).groupBy(*keys, "q_geo").agg(F.min(order).alias(order)).drop("q_geo")
    return items.join(first, [*keys, order])
