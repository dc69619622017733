"""Benchmark decontamination by template canonicalisation, in DataFrame operations alone.

A token is a word without the punctuation around it, lower-cased. A token that
starts with a digit becomes a number (#num) or a quantity with its unit (#qty), a
unit word #unit, a capitalised word that starts neither the text nor a sentence
#name: a question asked again with other numbers, names and units has the same
template. At each place an item has the smallest window of 8, 16 or 32 tokens of which
5 are no placeholders; an item without any such window has its whole sequence, if 3 of
its tokens are none. The same windows are taken a second time from the lower-cased
tokens as they are, where all that aren't empty count, so verbatim passages are found
in any case (UPPER CASE and Title Case make other names). Windows are hashed by pairing
neighbours, and those of documents are joined with the benchmark's by hash.

Matches on one diagonal (place in the document less place in the item) tell which
token fills which slot. A diagonal counts if each value of the item stands for one
value of the document throughout, and different names stay different; windows equal
token for token count whatever the rest of the diagonal says. A document leaks an item
if the diagonals that count cover 13 of its tokens, or 6 in 10.

The benchmark's windows and items are broadcast if they take up to BROADCAST bytes,
as measured, else both sides are shuffled. If the benchmark has up to ANCHORS windows,
templates are made around pairs of its words only (_segments): a filter that changes
no result, whatever the number of documents.

Defined results. A null or empty text leaks nothing. An item with fewer than 3 words
(3 that are no placeholders, for other values) can't be told from common speech and is
never found. Repeated items are judged by their item_id, as one item with all their
windows. Rows of one doc_id and one text are one document; a null doc_id is an id.
Texts of any length are read whole. Without documents or items there are no rows.
Other columns are not read. Unit words are English, and names are told by their capital,
which languages without capitals don't have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import looked_up, new_folder, written

SIZES = (8, 16, 32)
LITERALS, WHOLE = 5, 3
RUN, SHARE = 13, 0.6
BROADCAST = 32 << 20
#: Windows of the benchmark up to which its anchors are part of the plan.
ANCHORS = 20_000
#: Punctuation that is cut off words, ends of sentences, unit words.
PUNCTUATION = ".,;:!?…\"'`()[]{}<>«»“”„‘’‚*_#$%&|/\\~^=+-–—"
SENTENCE_ENDS = (".", "!", "?", ":")
UNITS = (
    "mm", "cm", "km", "inch", "inches", "feet", "foot", "yard", "yards", "mile", "miles", "meter", "meters", "metre", "metres", "kilometer", "kilometers", "kilometre", "kilometres",
    "mg", "kg", "gram", "grams", "kilogram", "kilograms", "ounce", "ounces", "pound", "pounds", "ton", "tons", "tonne", "tonnes", "ml", "liter", "liters", "litre", "litres", "gallon", "gallons",
    "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "cent", "cents", "dollar", "dollars", "euro", "euros", "percent", "kmh", "mph",
)
_SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words as they stand; white space at an end of the text leaves an empty one."""
    return F.split(F.coalesce(text, F.lit("")), _SPACE)


def with_template(df: DataFrame) -> DataFrame:
    """df, which has q_words, with q_low and q_canon: the tokens, and the tokens with placeholders."""
    out = df.withColumn("q_cores", F.transform("q_words", lambda w: F.trim(w, F.lit(PUNCTUATION))))
    out = out.withColumn("q_low", F.transform("q_cores", lambda c: F.lower(c)))

    def canon(low: Column, i: Column) -> Column:
        digit = F.ascii(low).between(48, 57)
        begins = (i == 0) | F.right(F.get("q_words", i - 1), F.lit(1)).isin(*SENTENCE_ENDS)
        return (
            F.when(digit, F.when(low.rlike(r"^[0-9.,:/-]+$"), "#num").otherwise("#qty"))
            .when(low == F.get("q_cores", i), F.when(low.isin(*UNITS), "#unit").otherwise(low))
            .when(begins, low)
            .otherwise("#name")
        )

    return out.withColumn("q_canon", F.transform("q_low", canon)).drop("q_cores")


def unfolded(df: DataFrame, keep: list[str], array: Column, name: str) -> DataFrame:
    """A row for each element of array; explode() would first filter by the array's size, and so make it twice."""
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def hashed(df: DataFrame, sizes: list[int]) -> DataFrame:
    """df, which has q_low and q_canon, with q_windows: array<struct<pos, size, t, w>>, the hashes of all windows of these
    sizes by template and literally.

    Level k holds the hashes of 2^k tokens; a window of any size is the two of its level at its ends.
    """
    levels = max(sizes).bit_length()
    after = lambda c, step: F.slice(c, F.lit(step + 1), F.greatest(F.size(c) - step, F.lit(0)))
    for name, tokens, salt in (("t", "q_canon", []), ("w", "q_low", [F.lit(1)])):
        df = df.withColumn(f"q_{name}0", F.transform(tokens, lambda x: F.xxhash64(x, *salt)))  # noqa: B023
        for k in range(1, levels):
            df = df.withColumn(f"q_{name}{k}", F.zip_with(f"q_{name}{k - 1}", after(f"q_{name}{k - 1}", 1 << (k - 1)), lambda a, b: F.xxhash64(a, b)))
    both = {name: F.array(*[F.col(f"q_{name}{k}") for k in range(levels)]) for name in "tw"}
    df = df.withColumns({f"q_{name}": c for name, c in both.items()})
    plan = F.array(*[F.struct(F.lit(s).alias("size"), F.lit(s.bit_length() - 1).alias("k"), F.lit(s - (1 << (s.bit_length() - 1))).alias("step")) for s in sorted(sizes)])

    def of_size(z: Column) -> Column:
        ends = lambda name, i: F.xxhash64(F.get(F.get(f"q_{name}", z["k"]), i), F.get(F.get(f"q_{name}", z["k"]), i + z["step"]))
        each = F.transform(F.sequence(F.lit(0), F.size("q_low") - z["size"]), lambda i: F.struct(i.alias("pos"), z["size"].alias("size"), ends("t", i).alias("t"), ends("w", i).alias("w")))
        return F.when(F.size("q_low") >= z["size"], each)

    found = F.flatten(F.filter(F.transform(plan, of_size), lambda x: x.isNotNull()))
    made = [f"q_{name}{k}" for name in "tw" for k in ("", *range(levels))]
    return df.withColumn("q_windows", found).drop(*made)


def covered(windows: Column) -> Column:
    """Tokens that these sorted windows (ipos, size) cover."""
    return F.aggregate(
        windows, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda s, p: F.struct((s["n"] + F.greatest(F.lit(0), p["ipos"] + p["size"] - F.greatest(p["ipos"], s["end"]))).alias("n"), F.greatest(s["end"], p["ipos"] + p["size"]).alias("end")),
        lambda s: s["n"],
    )


def chosen(flags: Column) -> Column:
    """array<struct<ipos, size>>: an item's windows, from an array that has 1 for each token that counts."""
    n, total = F.size(flags), lambda x: F.aggregate(x, F.lit(0), lambda s, v: s + v)

    def smallest(p: Column) -> Column:
        fit = F.filter(F.array(*map(F.lit, SIZES)), lambda s: (p + s <= n) & (total(F.slice(flags, p + 1, s)) >= LITERALS))
        return F.struct(p.alias("ipos"), F.get(fit, F.lit(0)).alias("size"))

    windows = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), smallest), lambda x: x["size"].isNotNull())
    whole = F.when(total(flags) >= WHOLE, F.array(F.struct(F.lit(0).alias("ipos"), n.alias("size")))).otherwise(F.slice(windows, 1, 0))
    return F.when(F.size(windows) > 0, windows).otherwise(whole)


def _letters(text: Column) -> Column:
    """Lower-cased letters and digits, word by word: equal for tokens that are equal. A word without any becomes 0, so
    words keep their places."""
    marks = r"[^\p{L}\p{N}\x20\x09-\x0D]+"
    alone = F.regexp_replace(text, r"(^|[\x20\x09-\x0D])" + marks + r"(?![^\x20\x09-\x0D])", "$10")
    return F.lower(F.regexp_replace(alone, marks, ""))


def _segments(rows: DataFrame, anchors: dict[int, list[int]] | None, reach: int) -> DataFrame:
    """(q_key, doc_id, q_from, q_words): runs of words of the rows (q_key, doc_id, text) that start at place q_from.

    Every window of the benchmark has two tokens that count with none between them that does, and a document's window of
    the same hash has the same two at the same distance; the closest pair, then the one with the most letters, stands for
    a window. `anchors` are the hashes of these pairs by distance. Only words around a document's pairs with such a hash
    can match: as far as the largest window reaches, and one more that tells whether a sentence starts. Without anchors
    the run is the whole text.
    """
    if anchors is None:
        return rows.select("q_key", "doc_id", F.lit(0).alias("q_from"), words(F.col("text")).alias("q_words"))
    split = rows.select("q_key", "doc_id", words(F.col("text")).alias("w"), words(_letters(F.coalesce("text", F.lit("")))).alias("f"))
    bound = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))  # noqa: E731  evaluates value once

    def places(f: Column) -> Column:
        found = []
        for d, hashes in sorted(anchors.items()):
            pair = F.zip_with(f, F.slice(f, F.lit(d + 1), F.size(f)), lambda a, b: F.xxhash64(a, b))
            at = F.transform(pair, lambda h, i: F.when(h.isin(hashes), F.struct(i.alias("i"), F.lit(d).alias("d"))))  # noqa: B023
            found.append(F.filter(at, lambda x, i: x.isNotNull() & (i < F.size(f) - d)))  # noqa: B023
        return F.concat(*found)

    near = split.select("q_key", "doc_id", "w", bound(F.col("f"), places).alias("at"))
    begin = lambda x: F.greatest(F.lit(0), x["i"] + x["d"] - reach)
    runs = F.transform("at", lambda x: F.struct(begin(x).alias("q_from"), F.slice("w", begin(x) + 1, x["i"] + reach - begin(x)).alias("q_words")))
    return unfolded(near, ["q_key", "doc_id"], runs, "r").select("q_key", "doc_id", "r.q_from", "r.q_words")


def _index(benchmark: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(windows, items): (item_id, ipos, size, literal, d, anchor) of each window of the benchmark, where d and anchor are
    its closest pair's distance and hash; (item_id, q_canon, q_low)."""
    items = written(with_template(benchmark.select("item_id", words(F.col("text")).alias("q_words"))).drop("q_words"), folder, "items")
    counts = lambda literal: F.transform("q_low", lambda t, i: ((t != "") & (F.lit(literal) | ~F.startswith(F.get("q_canon", i), F.lit("#")))).cast("int"))
    kinds = F.array(*[F.struct(F.lit(k).alias("literal"), counts(k).alias("flags"), chosen(counts(k)).alias("windows")) for k in (False, True)])
    each = unfolded(items, ["item_id", "q_low"], kinds, "k")
    each = unfolded(each, ["item_id", "q_low", "k.literal", "k.flags"], F.col("k.windows"), "x").select("item_id", "q_low", "literal", "flags", "x.ipos", "x.size")
    inside = F.filter(F.transform("flags", lambda f, i: F.when(f == 1, i)), lambda i: i.isNotNull() & (i >= F.col("ipos")) & (i < F.col("ipos") + F.col("size")))
    token = lambda i: _letters(F.get("q_low", i))
    pairs = F.zip_with("at", F.slice("at", F.lit(2), F.greatest(F.size("at") - 1, F.lit(0))), lambda a, b: F.struct((b - a).alias("d"), (-F.length(token(a)) - F.length(token(b))).alias("n"), a.alias("i")))
    best = F.array_min(F.filter(pairs, lambda p: p["d"].isNotNull()))
    each = each.withColumn("at", inside).withColumn("best", best).withColumn("d", F.col("best.d"))
    anchor = F.xxhash64(token(F.col("best.i")), token(F.col("best.i") + F.col("d")))
    return written(each.select("item_id", "ipos", "size", "literal", "d", anchor.alias("anchor")), folder, "windows"), items


def leaks(docs: DataFrame, benchmark: DataFrame, anchors: int = ANCHORS) -> DataFrame:
    """(q_key, doc_id, item_id, covered, item_tokens, slots, changed): documents (doc_id, text) that hold items (item_id, text)."""
    folder = new_folder(docs.sparkSession, "leaks")
    windows, items = _index(benchmark, folder)
    n = windows.count()
    sizes = sorted(r.size for r in windows.select("size").distinct().collect())  # 3, and lengths of items without a window
    size = items.agg(F.sum(F.octet_length(F.concat_ws("", "q_canon", "q_low")) + 24 * F.size("q_low"))).first()[0] or 0
    small = (lambda df: F.broadcast(df)) if n * 64 + size <= BROADCAST else (lambda df: df)
    near = None
    if n <= anchors:
        near = {}
        for r in windows.select("d", "anchor").distinct().collect():  # up to ANCHORS rows
            near.setdefault(r.d, []).append(r.anchor)
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("q_key"))
    if not sizes:
        rows, sizes, near = rows.where("false"), [SIZES[0]], None
    kinds = lambda t, w: F.array(F.struct(t.alias("hash"), F.lit(False).alias("literal")), F.struct(w.alias("hash"), F.lit(True).alias("literal")))

    def each_window(df: DataFrame, keep: list[str]) -> DataFrame:
        out = unfolded(hashed(df, sizes), keep, F.col("q_windows"), "x")
        return unfolded(out, [*keep, "x.pos", "x.size"], kinds(F.col("x.t"), F.col("x.w")), "k").select(*keep, "pos", "size", "k.hash", "k.literal")

    own = each_window(items, ["item_id"]).withColumnRenamed("pos", "ipos")
    side = own.join(windows.select("item_id", "ipos", "size", "literal").distinct(), ["item_id", "ipos", "size", "literal"], "left_semi").distinct()
    side = written(side, folder, "side")
    found = each_window(with_template(_segments(rows, near, max(sizes))), ["q_key", "doc_id", "q_from", "q_low"])
    # the word before a run is no part of a window, unless it starts the text
    found = found.where((F.col("pos") > 0) | (F.col("q_from") == 0)).select("q_key", "doc_id", (F.col("q_from") + F.col("pos")).alias("pos"), "size", "hash", "literal", F.slice("q_low", F.col("pos") + 1, F.col("size")).alias("said"))
    hits = found.join(small(side), ["hash", "size", "literal"]).select("q_key", "doc_id", "item_id", "ipos", "size", "literal", (F.col("pos") - F.col("ipos")).alias("diag"), "said")
    runs = hits.groupBy("q_key", "doc_id", "item_id", "diag", "literal").agg(F.array_sort(F.collect_set(F.struct("ipos", "size", "said"))).alias("places"))

    # what fills the slots; a repeated item_id is read by its smallest template
    template = items.groupBy("item_id").agg(F.min(F.struct("q_canon", "q_low")).alias("t")).select("item_id", F.col("t.q_canon").alias("i_canon"), F.col("t.q_low").alias("i_low"))
    filled = runs.join(small(template), "item_id")
    slot = lambda p, k: F.struct(F.get("i_canon", p["ipos"] + k).alias("kind"), F.get("i_low", p["ipos"] + k).alias("item"), F.get(p["said"], k).alias("doc"))
    pairs = F.flatten(F.transform("places", lambda p: F.transform(F.sequence(F.lit(0), p["size"] - 1), lambda k: slot(p, k))))
    spans = F.transform("places", lambda p: F.struct(p["ipos"].alias("ipos"), p["size"].alias("size")))
    filled = filled.select("q_key", "doc_id", "item_id", "literal", spans.alias("places"), F.size("i_canon").alias("item_tokens"), F.array_distinct(F.filter(pairs, lambda x: F.startswith(x["kind"], F.lit("#")))).alias("pairs"))
    named = F.filter("pairs", lambda x: x["kind"] == "#name")
    function = F.size(F.array_distinct(F.transform("pairs", lambda x: F.struct(x["kind"], x["item"])))) == F.size("pairs")
    distinct = F.size(F.array_distinct(F.transform(named, lambda x: x["doc"]))) == F.size(named)
    changed = F.exists("pairs", lambda x: x["item"] != x["doc"])
    good = filled.where(F.col("literal") | (function & distinct)).select("q_key", "doc_id", "item_id", "places", "item_tokens", F.size("pairs").alias("slots"), changed.alias("changed"))
    total = good.groupBy("q_key", "doc_id", "item_id").agg(
        covered(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places"))))).cast("long").alias("covered"),
        F.max("item_tokens").cast("long").alias("item_tokens"),
        F.max("slots").cast("long").alias("slots"),
        F.bool_or("changed").alias("changed"),
    )
    return total.where((F.col("covered") >= RUN) | (F.col("covered") >= SHARE * F.col("item_tokens")))


def report(found: DataFrame) -> DataFrame:
    """(doc_id, item_id, covered, item_tokens, slots, changed) of leaks(): rows of one id and different texts apart."""
    return found.drop("q_key")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that leak no item, with all their columns."""
    named = docs.select(F.struct("*").alias("q_row"), F.xxhash64("doc_id", "text").alias("q_key"))
    bad = leaks(docs, benchmark).select("q_key").distinct()
    return named.join(looked_up(bad), "q_key", "left_anti").select("q_row.*")
