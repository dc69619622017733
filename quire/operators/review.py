"""Review: scheduling of units, validation of records, and the merge of accepted readings.

A unit's draft is never overwritten: every step gives a new version of the units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import latex
from quire.functions import text as X
from quire.operators.layout import per_page

#: Fixed values.
TYPED = ("text", "math", "table")
STATUSES = ("verified", "corrected", "uncertain")
NO_REVIEW = "No valid image-grounded review returned"
DISABLED, UNAVAILABLE, UNSCHEDULED = "Image-grounded review disabled", "Image-grounded review unavailable", "Source region could not be scheduled within the review budget"
MAX_INPUT, MAX_TEXT, MAX_UNITS, MAX_ATOM, MAX_PIXELS = 12_000, 40_000, 6, 4, 3_000_000


def typed(units: DataFrame) -> DataFrame:
    """Units whose category has a transcription."""
    return units.where(F.col("category").isin(*TYPED))


def eligible(units: DataFrame, max_input: int = MAX_INPUT, max_pixels: int = MAX_PIXELS) -> DataFrame:
    """Typed units with a crop, no full page among their ids and members, a draft that fits a request, and a crop (crop_w,
    crop_h) that fits a contact sheet of its own."""
    room = F.length("decoded") + F.length(F.col("id").cast("string")) + 100 <= max_input
    named = F.concat(F.array(F.col("id").cast("string")), F.coalesce("member_ids", F.array().cast("array<string>")))
    size = G.sheet_size(F.col("crop_w"), F.col("crop_h"), max_pixels)
    fits = G.sheet_pixels(size["w"], size["h"] + G.BAND) <= max_pixels
    return typed(units).where((F.col("crop_path") != "") & ~F.exists(named, lambda i: F.contains(i, F.lit("_fullpage"))) & room & fits)


def before_review(units: DataFrame, enabled: bool, available: bool) -> DataFrame:
    """units (category, decoded) with raw_decoded, status, issues, applied, original_category and mark_pdf as they are
    before any record comes in."""
    own = F.col("category").isin(*TYPED)
    why = DISABLED if not enabled else UNSCHEDULED if available else UNAVAILABLE
    return units.withColumns({
        "raw_decoded": F.col("decoded"), "original_category": F.col("category"), "applied": F.lit(False), "status": F.when(own, "not_reviewed").otherwise("not_applicable"),
        "issues": F.when(own, F.array(F.lit(why))).otherwise(F.array().cast("array<string>")), "mark_pdf": own & F.lit(enabled),
    })


def marked(status: Column, mark_pdf: Column, enabled: bool = True) -> Column:
    """Whether the document shows that a unit needs a check: an open status, where there is a review at all."""
    return F.coalesce(mark_pdf, F.lit(False)) | (F.lit(enabled) & F.coalesce(status.isin("uncertain", "not_reviewed"), F.lit(False)))


def claim_counts(records: DataFrame, keys: list[str], sources: str = "sources") -> DataFrame:
    """(keys, source, claims): how many raw records, valid or not, name a source."""
    return records.select(*keys, F.explode(sources).alias("source")).groupBy(*keys, "source").agg(F.count("*").alias("claims"))


def checked_sources(records: DataFrame, units: DataFrame, keys: list[str], declared: DataFrame | None = None) -> DataFrame:
    """records (keys, id, sources) with `known` (every source is a unit of the batch) and `sole` (nobody else names one).

    declared: all records that claim sources, where records are only some of them.
    """
    named = records.select(*keys, "id", F.explode("sources").alias("source"))
    there = units.select(*keys, F.col("id").alias("source"), F.lit(1).alias("there"))
    flat = named.join(there, [*keys, "source"], "left").join(claim_counts(records if declared is None else declared, keys), [*keys, "source"])
    per = flat.groupBy(*keys, "id").agg((F.count("there") == F.count("*")).alias("known"), (F.max("claims") == 1).alias("sole"))
    return records.join(per, [*keys, "id"])


def _adjacent(a: Column, test) -> Column:
    """Whether test holds for every two neighbours of an array."""
    pairs = F.zip_with(F.slice(a, F.lit(1), F.size(a) - 1), F.slice(a, F.lit(2), F.size(a) - 1), test)
    return F.when(F.size(a) > 1, F.forall(pairs, lambda x: x)).otherwise(True)


def first_rule(record: Column, drafts: Column) -> Column:
    """The first rule that a record breaks, or null.

    record has id, sources, category, status, text, n_issues, known; drafts are its sources in order, as array<struct<ord,
    page, category, decoded, box>>, where ord is a unit's place in the batch.
    """
    sources, status, category, text = record["sources"], record["status"], record["category"], record["text"]
    leader, n = F.get(drafts, F.lit(0)), F.size(sources)
    words = F.flatten(F.transform(drafts, lambda u: X.prose_words(u["decoded"])))
    prose = (F.size(words) >= 3) | F.exists(words, lambda w: F.length(w) >= 7)
    shows = lambda s: s.rlike(latex.EXPLICIT)
    apart = ~_adjacent(drafts, lambda a, b: (b["ord"] == a["ord"] + 1) & (a["page"] == b["page"]))
    distant = ~_adjacent(drafts, lambda a, b: G.neighbouring(a["box"], b["box"]))
    paragraph = F.exists(drafts, lambda u: (u["category"] == "text") & ((F.length(u["decoded"]) > 500) | ((F.size(X.prose_words(u["decoded"])) > 0) & ~u["decoded"].rlike(latex.NOTATION))))
    any_of = (
        F.when(~record["known"] | (n == 0) | leader.isNull(), "unknown source ID")
        .when((F.size(F.array_distinct(sources)) != n) | (F.get(sources, F.lit(0)) != record["id"]), "duplicate source IDs or nonleading record ID")
        .when(~category.isin(*TYPED) | ~status.isin(*STATUSES), "invalid category or status")
        .when((X.strip(text) == "") | (F.length(text) > MAX_TEXT), "empty or oversized transcription")
        .when(status.isin("corrected", "uncertain") & (record["n_issues"] == 0), "change or uncertainty has no explanation")
        .when((status == "verified") & ((n != 1) | (text != leader["decoded"]) | (category != leader["category"])), "verified record changes the original draft")
        .when((n > 1) & ((n > MAX_ATOM) | apart), "merged sources are not consecutive on one page or exceed the merge limit")
    )
    alone = F.when((leader["category"] == "text") & prose & (category != "text"), "mixed prose cannot become a formula-only or table result").when(prose & shows(leader["decoded"]) & ~shows(text), "mixed prose lost its explicit mathematics")
    merged = (
        F.when((status != "corrected") | (category == "table"), "merge needs one page and a corrected expression")
        .when(distant, "merged source regions are not physically adjacent")
        .when(paragraph, "merge would consume a paragraph or separate prose note")
        .when((category == "text") & ~shows(text), "merged mixed expression needs explicit inline mathematics")
        .when(prose & (F.size(X.prose_words(text)) < F.least(F.lit(2), F.size(words))), "merge lost attached source prose")
    )
    later = F.coalesce(latex.syntax_error(category, text), F.when(n == 1, alone).otherwise(merged))
    return F.when(any_of.isNotNull(), any_of).when(status != "uncertain", later)


def judged(records: DataFrame, units: DataFrame, keys: list[str], declared: DataFrame | None = None) -> DataFrame:
    """records (keys, id, sources, category, status, text, n_issues) with known, sole and `error`, the first rule broken.

    units (keys, id, ord, page, category, decoded, x1..y2) are those of the batch.
    """
    checked = checked_sources(records, units, keys, declared)
    draft = F.struct("at", "ord", "page", "category", "decoded", G.box("x1", "y1", "x2", "y2").alias("box"))
    named = records.select(*keys, F.col("id").alias("record"), F.posexplode("sources").alias("at", "id"))
    drafts = named.join(units.select(*keys, "id", "ord", "page", "category", "decoded", "x1", "y1", "x2", "y2"), [*keys, "id"]).groupBy(*keys, F.col("record").alias("id")).agg(F.array_sort(F.collect_list(draft)).alias("drafts"))
    both = checked.join(drafts, [*keys, "id"], "left")
    return both.withColumn("error", first_rule(F.struct(*checked.columns), F.coalesce("drafts", F.slice("drafts", 1, 0)))).drop("drafts")


def accepted(records: DataFrame, keys: list[str]) -> DataFrame:
    """Judged records without an error whose sources no other record claims, and none of these other records consumes."""
    good = records.where("error IS NULL AND sole")
    consumed = claim_counts(good, keys).where("claims > 1").select(*keys, F.col("source").alias("s"))
    twice = good.select(*keys, "id", F.explode("sources").alias("s")).join(consumed, [*keys, "s"], "left_semi").select(*keys, "id").distinct()
    return good.join(twice, [*keys, "id"], "left_anti")


def apply_records(units: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """units (keys, id, category, decoded) after accepted records (keys, id, sources, category, status, text).

    A unit that no record names is uncertain. An uncertain record leaves the draft and keeps its text as a proposal on
    the leader; another gives the leader its text and category and empties the units merged into it.
    """
    parts = records.select(*keys, F.col("id").alias("leader"), F.posexplode("sources").alias("at", "id"), F.col("category").alias("r_category"), F.col("status").alias("r_status"), F.col("text").alias("r_text"), F.col("sources").alias("source_ids"))
    j = units.join(parts, [*keys, "id"], "left")
    applied = F.col("r_status").isin("verified", "corrected")
    lead = F.col("at") == 0
    raw = F.col("raw_decoded") if "raw_decoded" in units.columns else F.lit("")
    return j.select(
        *keys, "id",
        F.when(applied & lead, F.col("r_category")).otherwise(F.col("category")).alias("category"),
        F.when(applied & lead, F.col("r_text")).when(applied, "").otherwise(F.col("decoded")).alias("decoded"),
        F.coalesce(F.nullif(raw, F.lit("")), F.col("decoded")).alias("raw_decoded"),
        F.col("category").alias("original_category"),
        F.coalesce("r_status", F.lit("uncertain")).alias("status"),
        F.when(F.col("r_status").isNull(), F.lit(NO_REVIEW)).otherwise("").alias("issue"),
        F.coalesce(applied, F.lit(False)).alias("applied"),
        F.when(applied & ~lead, F.col("leader")).alias("merged_into"),
        F.when((F.col("r_status") == "uncertain") & lead, F.col("r_text")).alias("proposed_text"),
        "source_ids",
    )


def merged_geometry(units: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, x1, y1, x2, y2, quads) of merge leaders: the extent of all sources, and their quadrilaterals in order, or
    their boxes' corners where they have none."""
    parts = records.where(F.size("sources") > 1).select(*keys, F.col("id").alias("leader"), F.posexplode("sources").alias("at", "id"))
    own = F.col("quads") if "quads" in units.columns else F.lit(None).cast("array<array<double>>")
    full = units.withColumn("q", F.when(F.coalesce(F.size(own), F.lit(0)) > 0, own).otherwise(F.array(G.quad_of(G.box("x1", "y1", "x2", "y2")))))
    j = parts.join(full.select(*keys, "id", "x1", "y1", "x2", "y2", "q"), [*keys, "id"])
    quads = F.array_sort(F.collect_list(F.struct("at", "q")))
    out = j.groupBy(*keys, F.col("leader")).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), quads.alias("q"))
    return out.select(*keys, F.col("leader").alias("id"), "x1", "y1", "x2", "y2", F.flatten(F.transform("q", lambda x: x["q"])).alias("quads"))


def summary(units: DataFrame, batches: DataFrame | None = None) -> DataFrame:
    """One row of counts by status; with batches (planned ones, a row each), also their number."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    out = units.agg(*(n(s) for s in (*STATUSES, "not_reviewed")), F.count_if(F.coalesce(F.col("merged_into").cast("string"), F.lit("")) != "").alias("merged"), F.count("*").alias("regions"))
    return out if batches is None else out.crossJoin(batches.agg(F.count("*").alias("batches")))  # two tables of one row


def pack(sizes: list[tuple[int, int, int, int, int]], max_units: int = MAX_UNITS, max_chars: int = MAX_INPUT, max_pixels: int = MAX_PIXELS) -> list[int]:
    """Batch numbers of components (units, chars, page, widest, stacked height) in order, -1 for one that no batch may hold."""
    max_units, max_pixels = max(1, max_units), max(16_000, max_pixels)
    pixels = lambda wide, tall: max(G.NARROWEST, wide + 2 * G.PAD) * tall
    out, open_, at = [], None, -1
    for units, chars, page, wide, tall in sizes:
        if units > min(MAX_ATOM, max_units) or chars > max_chars or pixels(wide, tall) > max_pixels:
            out.append(-1)
            continue
        grown = open_ and (open_[0] + units, open_[1] + chars, page, max(open_[3], wide), open_[4] + tall)
        if not grown or page != open_[2] or grown[0] > max_units or grown[1] > max_chars or pixels(*grown[3:]) > max_pixels:
            at, grown = at + 1, (units, chars, page, wide, tall)
        open_ = grown
        out.append(at)
    return out


def pack_batches(components: DataFrame, key: str, max_units: int = MAX_UNITS, max_chars: int = MAX_INPUT, max_pixels: int = MAX_PIXELS) -> DataFrame:
    """(key, ord, batch) of components (key, ord, page, units, chars, wide, tall): a sequential fold over one document.

    wide is the widest crop of a component as it goes on a sheet, tall the sum of their heights with their bands.
    """

    def run(rows: list) -> list[tuple]:
        rows = sorted(rows, key=lambda r: r.ord)
        return list(zip([r.ord for r in rows], pack([(r.units, r.chars, r.page, r.wide, r.tall) for r in rows], max_units, max_chars, max_pixels), strict=True))

    return per_page(components, [key], ["ord", "units", "chars", "page", "wide", "tall"], run, "ord bigint, batch bigint")


def formula_pairs(units: DataFrame, keys: list[str], near, words: Column, notation: Column, relation: Column) -> DataFrame:
    """(keys, a, b): units of a page that may be parts of one expression. near(a, b) compares two boxes."""
    cols = ["ord", "x1", "y1", "x2", "y2", "category", "n_members", "chars", "words", "notation", "relation"]
    base = units.withColumns({"words": words, "notation": notation, "relation": relation, "chars": F.length("decoded")}).select(*keys, *cols)
    other = base.select(*keys, *(F.col(c).alias(f"o_{c}") for c in cols))
    box = lambda p: F.struct(*(F.col(f"{p}{c}").alias(c) for c in ("x1", "y1", "x2", "y2")))
    tall = lambda a, b: (F.col(f"{a}n_members") > 2) & (F.col(f"{a}y2") - F.col(f"{a}y1") > 2.5 * (F.col(f"{b}y2") - F.col(f"{b}y1")))
    long = lambda p: (F.col(f"{p}chars") > 500) | (F.col(f"{p}words") > 15)
    part = lambda p: (F.col(f"{p}chars") <= 120) & (F.col(f"{p}words") <= 4) & ~F.col(f"{p}relation")
    maths = (F.col("category") == "math") | (F.col("o_category") == "math") | F.col("notation") | F.col("o_notation")
    j = base.join(other, keys).where((F.col("ord") < F.col("o_ord")) & near(box(""), box("o_")))
    return j.where(~long("") & ~long("o_") & ~tall("", "o_") & ~tall("o_", "") & maths & (part("") | part("o_"))).select(*keys, F.col("ord").alias("a"), F.col("o_ord").alias("b"))


def attempt_numbers(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return events.withColumn("attempt", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
