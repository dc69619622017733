"""Compose: reading order, runs of prose, blocks and the LaTeX document.

Units are rows (doc, page, id, category, content, crop_path, member_ids, quads, x1..y2,
status, mark_pdf, merged_into); pages are rows (doc, page, page_w, page_h), detected
blocks rows (doc, page, id, source_label). All of it is built-in functions and windows
but for the reading order, which is a kernel over one page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import latex
from quire.functions import text as X
from quire.functions.base import once
from quire.operators import layout

PROSE = ("text", "unknown")
#: Labels of blocks that are paper and not content, the ending of their ids, and the head of a document.
BACKGROUND, RESIDUAL = ("residual_background", "whole_page_no_text"), "_residual"
PREAMBLE = (
    "\\documentclass[11pt,a4paper]{article}", "\\usepackage[margin=25mm]{geometry}", "\\usepackage{amsmath,amssymb,graphicx,array}", "\\usepackage[T1]{fontenc}",
    "\\usepackage[utf8]{inputenc}", "\\setlength{\\parindent}{0pt}", "\\setlength{\\parskip}{0.45em}", "\\setlength{\\emergencystretch}{2em}", "\\linespread{1.08}", "\\begin{document}",
)


def without_merged(units: DataFrame) -> DataFrame:
    """Units that were not merged into another one."""
    return units.where(F.coalesce("merged_into", F.lit("")) == "")


def needs_note(status: Column, mark_pdf: Column) -> Column:
    """Whether a unit's reading has to be checked against the source."""
    return F.coalesce((status == "uncertain") | mark_pdf, F.lit(False))


def without_background(units: DataFrame, blocks: DataFrame, page: list[str]) -> DataFrame:
    """Anti-join: units with a member that is paper, by its id or by its block's label, go."""
    paper = blocks.where(F.col("source_label").isin(*BACKGROUND)).select(*page, F.col("id").alias("member")).distinct()
    named = units.select(*page, "id", F.explode("member_ids").alias("member"))
    gone = named.where(F.endswith("member", F.lit(RESIDUAL))).unionByName(named.join(paper, [*page, "member"], "left_semi"))
    return units.join(gone.select(*page, "id").distinct(), [*page, "id"], "left_anti")


def in_reading_order(units: DataFrame, page: list[str], w: float) -> DataFrame:
    """units with read_ord, their place in the reading order of their page. Pages are w wide."""
    placed = layout.with_reading_order(layout.flow_boxes(units).select(*page, "id", "x1", "y1", "x2", "y2"), page, w)
    return units.join(placed, [*page, "id"])


def with_paragraphs(units: DataFrame, doc: list[str], order: list[str], w, h) -> DataFrame:
    """units (doc, order, category, x1..y2, and quads and member_ids if they have any) with `paragraph`: does the unit
    begin one, seen from the unit before it? Its first line is compared with the last line and the left edge of that.

    The first unit begins a paragraph.
    """
    quads = F.col("quads") if "quads" in units.columns else F.array().cast("array<array<double>>")
    members = F.col("member_ids") if "member_ids" in units.columns else F.array(F.lit(""))
    win = Window.partitionBy(*doc).orderBy(*order)
    lined = units.withColumn("lines", G.unit_lines(quads, G.box("x1", "y1", "x2", "y2"), members))
    lined = lined.withColumn("ends", F.struct(F.element_at("lines", -1).alias("last"), F.array_min(F.transform("lines", lambda x: x["left"])).alias("left")))
    prev = lined.withColumns({"p_ends": F.lag("ends").over(win), "p_category": F.lag("category").over(win)})
    both = F.col("category").isin(*PROSE) & F.col("p_category").isin(*PROSE)
    begins = G.starts_paragraph(F.col("p_ends")["last"], F.get("lines", F.lit(0)), F.col("p_ends")["left"], w, h)
    return prev.withColumn("paragraph", F.when(F.col("p_ends").isNull() | ~both, True).otherwise(begins)).drop("lines", "ends", "p_ends", "p_category")


def _structural(line: Column) -> Column:
    return line.rlike(X.LIST_ITEM) | line.rlike(X.HEADING)


def prose_runs(units: DataFrame, doc: list[str], order: list[str], w, h, keep: list[str] | None = None) -> DataFrame:
    """(doc, run, category, content, first): consecutive prose units as one text, other units alone, with the columns
    `keep` of the first unit.

    Units (doc, order, page, category, content, x1..y2). Blank prose units are passed over. Between two units stands a
    blank line if the second begins a paragraph on the same page, a line feed if a list item or heading adjoins, else a
    space. Runs go on over the ends of pages.
    """
    keep = keep or []
    full = units.where(~(F.col("category").isin(*PROSE) & (F.col("content") == "")))
    marked = with_paragraphs(full, doc, order, w, h)
    win = Window.partitionBy(*doc).orderBy(*order)
    prose = F.col("category").isin(*PROSE)
    marked = marked.withColumns({
        "prose": prose, "p_prose": F.coalesce(F.lag(prose).over(win), F.lit(False)), "p_page": F.lag("page").over(win),
        "p_last": F.element_at(F.split(F.lag("content").over(win), r"\R"), -1), "first_line": F.element_at(F.split("content", r"\R"), 1),
    })
    starts = ~(F.col("prose") & F.col("p_prose"))
    sep = F.when(starts, "").when(F.col("paragraph") & (F.col("p_page") == F.col("page")), "\n\n").when(_structural(F.col("p_last")) | _structural(F.col("first_line")), "\n").otherwise(" ")
    marked = marked.withColumns({"sep": sep, "run": F.sum(starts.cast("long")).over(win), "n": F.row_number().over(win)})
    pieces = F.array_sort(F.collect_list(F.struct("n", F.concat("sep", "content").alias("t"))))
    out = marked.groupBy(*doc, "run").agg(F.min_by("category", "n").alias("category"), pieces.alias("p"), F.min("n").cast("long").alias("first"), *(F.min_by(c, "n").alias(c) for c in keep))
    return out.select(*doc, "run", F.when(F.col("category").isin(*PROSE), "text").otherwise(F.col("category")).alias("category"), F.array_join(F.transform("p", lambda x: x["t"]), "").alias("content"), "first", *keep)


def figure_tex(path: Column, fraction: Column) -> Column:
    """A centred picture of a share of the line's width; empty without a path."""
    head = F.concat(F.lit("\\begin{center}\n\\includegraphics[width="), fraction, F.lit("\\linewidth,height=0.55\\textheight,keepaspectratio]{"), path, F.lit("}\n\\end{center}"))
    return F.when(F.coalesce(path, F.lit("")) == "", "").otherwise(head)


def block_tex(category: Column, content: Column, figure: Column, noted: Column) -> Column:
    """The LaTeX of a run or unit: prose rendered, formulas displayed, tables ruled or else shown as their picture; a note
    behind a formula or table that has to be checked. Empty if nothing is left."""
    formula = lambda f: F.when(f != "", F.concat(F.lit("\\[\n"), f, F.lit("\n\\]"))).otherwise("")
    table = lambda t: F.when(t != "", F.concat(F.lit("\\begin{center}\n"), t, F.lit("\n\\end{center}"))).otherwise(figure)
    body = (
        F.when(category == "math", once(latex.clean_math(content), formula))
        .when(category == "table", once(latex.table_tex(content), table))
        .when(category == "figure", figure)
        .otherwise(latex.render_text(content, coded=True))
    )
    note = F.when(category.isin("math", "table") & noted, X.review_note()).otherwise("")
    return F.array_join(F.filter(F.array(body, note), lambda t: t != ""), "\n\n")


def body(blocks: DataFrame, doc: list[str], order: str, tex: str) -> DataFrame:
    """(doc, body): the blocks that aren't empty, in order, with a blank line between."""
    kept = blocks.where(F.col(tex) != "")
    return kept.groupBy(*doc).agg(F.array_sort(F.collect_list(F.struct(order, tex))).alias("b")).select(*doc, F.array_join(F.transform("b", lambda x: x[tex]), "\n\n").alias("body"))


def asset_path(page: Column, unit: Column, source: Column) -> Column:
    """Where a unit's picture lies beside the document."""
    suffix = F.lower(F.regexp_extract(source, r"(\.[^./]+)$", 1))
    return F.concat(F.format_string("assets/p%04d_", page.cast("long")), X.asset_id(unit), suffix)


def assets(units: DataFrame, blocks: DataFrame, page: list[str]) -> DataFrame:
    """(page, id, source, asset): pictures of figures and tables that the document can show, and where they go."""
    shown = without_background(without_merged(units).where(F.col("category").isin("figure", "table") & (F.coalesce("crop_path", F.lit("")) != "")), blocks, page)
    return shown.select(*page, "id", F.col("crop_path").alias("source"), asset_path(F.col(page[-1]), F.col("id"), F.col("crop_path")).alias("asset"))


def document_blocks(units: DataFrame, pages: DataFrame, blocks: DataFrame, doc: list[str], w: float) -> DataFrame:
    """(doc, run, category, tex): the blocks of each document in order. Pages are up to w wide."""
    page = [*doc, "page"]
    full = in_reading_order(without_merged(units), page, w)
    full = without_background(full, blocks, page).join(pages.select(*page, "page_w", "page_h"), page)
    noted = needs_note(F.col("status"), F.col("mark_pdf"))
    source = F.replace(X.text_source(F.col("content")), F.lit("\0"), F.lit("\0z"))
    said = F.when(noted, F.concat(source, F.when(source != "", " ").otherwise(""), F.lit(latex.NOTE))).otherwise(source)
    picture = F.when(F.coalesce("crop_path", F.lit("")) != "", asset_path(F.col("page"), F.col("id"), F.col("crop_path"))).otherwise("")
    figure = figure_tex(picture, X.figure_fraction(F.col("x2") - F.col("x1"), F.col("page_w").cast("double")))
    full = full.withColumns({"noted": noted, "figure": figure, "content": F.when(F.col("category").isin(*PROSE), said).otherwise(F.col("content"))})
    runs = prose_runs(full, doc, ["page", "read_ord"], F.col("page_w"), F.col("page_h"), keep=["noted", "figure"])
    return runs.select(*doc, "run", "category", block_tex(F.col("category"), F.col("content"), F.col("figure"), F.col("noted")).alias("tex"))


def document(title: Column, content: Column) -> Column:
    """A whole LaTeX document; no title block for a blank title."""
    t = X.strip(title)
    head = F.when(t == "", "").otherwise(F.concat(F.lit("\\title{"), X.escape_tex(t), F.lit("}\n\\date{}\n\\maketitle\n")))
    return F.concat(F.lit("\n".join(PREAMBLE) + "\n"), head, content, F.lit("\n\\end{document}\n"))


def documents(units: DataFrame, pages: DataFrame, blocks: DataFrame, doc: list[str], titles: DataFrame, w: float) -> DataFrame:
    """(doc, tex): a document for each row of titles (doc, title), empty between its ends if it has no block."""
    bodies = body(document_blocks(units, pages, blocks, doc, w), doc, "run", "tex")
    return titles.join(bodies, doc, "left").select(*doc, document(F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))).alias("tex"))
