"""Decode: the cascade over interchangeable recognisers, as candidates with a priority and a fold.

Providers are functions that are handed in; every call's usage is a row of the ledger,
whether or not its text is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as X

THRESHOLD = 0.55


def rescue_needed(score: Column, asked: Column, threshold: float = THRESHOLD) -> Column:
    """Whether the stronger reader is called: as a router says, else by the score."""
    return F.coalesce(asked, score < threshold)


def ledger(units: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, provider, usage): a row for each call of cascade()'s units (calls, and <call>_usage for each call, as
    JSON text), whether or not its text was taken. A usage object that names a provider is booked to that."""
    own = {"ocr": "qwen_ocr", "math": "qwen_ocr", "rescue": "qwen_rescue"}
    usage = lambda c: F.col(f"{c}_usage") if f"{c}_usage" in units.columns else F.lit("{}")
    paid = F.array(*[F.struct(F.lit(c).alias("call"), F.lit(p).alias("provider"), F.coalesce(usage(c), F.lit("{}")).alias("usage")) for c, p in own.items()])
    each = units.select(*keys, F.posexplode(F.filter(paid, lambda x: F.array_contains("calls", x["call"]))).alias("n", "x"))
    named = F.try_variant_get(F.try_parse_json("x.usage"), "$.provider", "string")
    return each.select(*keys, F.col("n").cast("long").alias("n"), F.coalesce(named, "x.provider").alias("provider"), F.col("x.usage").alias("usage"))


def cascade(units: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """units (id, category, crop_path, hint, ocr, math, rescue) with decoded, category, decoder, score, rescued, calls.

    ocr, math and rescue are what the calls return, or null where a call fails; <call>_error says why, <call>_usage what it
    cost, and rescue_asked what a router wants, if the units have such columns. Figures and unknown units are kept as
    they are; a text with a good hint needs no call; a text that looks like mathematics is read again as a formula, and
    a tie takes it; a score below the threshold calls the rescue, and a tie takes that.
    """
    hint = X.strip(F.coalesce("hint", F.lit("")))
    hinted = (F.col("category") == "text") & (hint != "")
    score = lambda cat, s: F.round(F.when(F.coalesce(s, F.lit("")) == "", 0.0).otherwise(X.validate(cat, s)), 10)
    s = units.withColumns({"hint_score": F.when(hinted, score(F.lit("text"), hint)).otherwise(-1.0), "hinted": hinted, "hint_text": hint})
    s = s.withColumn("step", F.when(F.col("category").isin("figure", "unknown"), "keep").when(F.col("crop_path") == "", "none").when(F.col("hint_score") >= threshold, "hint").otherwise("call"))
    s = s.withColumn("t1", F.coalesce("ocr", F.when(F.col("hinted"), F.col("hint_text")).otherwise(""))).withColumn("s1", score(F.col("category"), F.col("t1")))
    try_math = (F.col("step") == "call") & (F.col("category") == "text") & ~F.col("hinted") & F.col("ocr").isNotNull() & X.looks_math(F.col("ocr"))
    s = s.withColumn("try_math", try_math).withColumn("ms", score(F.lit("math"), F.col("math")))
    s = s.withColumn("as_math", F.col("try_math") & F.col("math").isNotNull() & (F.col("ms") >= F.col("s1")))
    s = s.withColumns({"c2": F.when(F.col("as_math"), "math").otherwise(F.col("category")), "t2": F.when(F.col("as_math"), F.col("math")).otherwise(F.col("t1")), "s2": F.when(F.col("as_math"), F.col("ms")).otherwise(F.col("s1"))})
    failed = F.col("ocr").isNull() | (F.col("try_math") & F.col("math").isNull())
    has = lambda c, kind: F.col(c) if c in units.columns else F.lit(None).cast(kind)
    why = F.coalesce(F.when(F.col("ocr").isNull(), has("ocr_error", "string")).otherwise(has("math_error", "string")), F.lit(""))
    error = F.when(why == "", "error").otherwise(F.concat(F.lit("error:"), F.substring_index(why, ":", 1)))
    s = s.withColumns({"ask": (F.col("step") == "call") & rescue_needed(F.col("s2"), has("rescue_asked", "boolean"), threshold), "rs": score(F.col("c2"), F.col("rescue"))})
    s = s.withColumn("rescued", F.col("ask") & F.col("rescue").isNotNull() & (F.col("rs") >= F.col("s2")))
    by = lambda keep, none, hint_, call: F.when(F.col("step") == "keep", keep).when(F.col("step") == "none", none).when(F.col("step") == "hint", hint_).otherwise(call)
    decoder = F.when(F.col("rescued"), F.concat(F.lit("rescue:"), "c2")).when(failed, error).when(F.col("as_math"), "ocr:math-auto").otherwise(F.concat(F.lit("ocr:"), "category"))
    calls = F.array_compact(F.array(F.when(F.col("ocr").isNotNull(), "ocr"), F.when(F.col("try_math") & F.col("math").isNotNull(), "math"), F.when(F.col("ask") & F.col("rescue").isNotNull(), "rescue")))
    return s.select(
        "id",
        by(F.lit("figure"), F.col("category"), F.col("category"), F.col("c2")).alias("category"),
        by(F.lit(""), F.lit(""), F.col("hint_text"), F.when(F.col("rescued"), F.col("rescue")).otherwise(F.col("t2"))).alias("decoded"),
        by(F.when(F.col("category") == "figure", "preserve-original").otherwise("preserve-unknown"), F.lit(""), F.lit("layout:text"), decoder).alias("decoder"),
        by(F.lit(1.0), F.lit(0.0), F.col("hint_score"), F.when(F.col("rescued"), F.col("rs")).otherwise(F.col("s2"))).alias("score"),
        F.col("rescued"),
        F.when(F.col("step") == "call", calls).otherwise(F.array().cast("array<string>")).alias("calls"),
        *(c for c in ("ocr_usage", "math_usage", "rescue_usage") if c in units.columns),
    )


def layout_cascade(pages: DataFrame, layers: list[DataFrame], keys: list[str], enough: Column) -> DataFrame:
    """Blocks of the first provider that is enough for a page, seen over quality and n_blocks; of the last one at all events."""
    out, left = None, pages.select(*keys)
    for k, blocks in enumerate(layers):
        mine = blocks.join(left, keys, "left_semi")
        per = mine.groupBy(*keys).agg(F.avg("score").alias("quality"), F.count("*").alias("n_blocks"))
        good = (per if k == len(layers) - 1 else per.where(enough)).select(*keys)
        taken = mine.join(good, keys, "left_semi").withColumn("layer", F.lit(k))
        out = taken if out is None else out.unionByName(taken)
        left = left.join(good, keys, "left_anti")
    return out
