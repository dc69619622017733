"""Text, LaTeX and table functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.base import once

#: Fixed values.
MATH_WORDS_SHORT = ("sin", "cos", "tan", "cot", "sec", "csc", "log", "lim", "exp", "max", "min", "det", "mod")
MATH_WORDS = (
    "sin", "cos", "tan", "cot", "log", "lim", "exp", "max", "min", "det", "mod", "sqrt", "frac", "alpha", "beta", "gamma", "delta", "epsilon",
    "theta", "lambda", "sigma", "omega", "matrix", "pmatrix", "bmatrix", "aligned",
)
MATH_CHARS = "=+-×÷∫∑√∞≈≠≤≥^_()[]{}|<>∂∆λμπσθΩ"
MATH_TOKENS = ("\\frac", "\\begin", "\\sqrt", "^", "_", "=", "\\sum", "\\int")
TEXT_LABELS = (
    "doc_title", "document_title", "paragraph_title", "text", "page_number", "abstract", "references", "footnotes", "header", "footer", "algorithm",
    "figure_caption", "table_caption", "figure_title", "chart_title", "sidebar_text", "list", "reference", "caption", "table_of_contents",
    "section_title", "section_header", "vertical_text", "reference_content",
)
MATH_LABELS = ("formula", "equation", "formula_number", "inline_formula", "display_formula")
TABLE_LABELS = ("table",)
FIGURE_LABELS = ("image", "figure", "chart", "seal", "header_image", "footer_image", "picture", "diagram")
TEX_ESCAPES = {
    "\\": "\\textbackslash{}", "&": "\\&", "%": "\\%", "$": "\\$", "#": "\\#", "_": "\\_", "{": "\\{", "}": "\\}", "~": "\\textasciitilde{}", "^": "\\textasciicircum{}",
}
REVIEW_NOTE = "Trascrizione da verificare sull’originale."
BAD = "\ufffd"
_TICKS = "`" * 3


def strip(s: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def count_of(s: Column, part: str) -> Column:
    return ((F.length(s) - F.length(F.replace(s, F.lit(part), F.lit("")))) / len(part)).cast("int")


def label_category(label: Column) -> Column:
    key = F.translate(F.lower(strip(label)), " -", "__")
    return F.when(key.isin(*MATH_LABELS), "math").when(key.isin(*TABLE_LABELS), "table").when(key.isin(*FIGURE_LABELS), "figure").when(key.isin(*TEXT_LABELS), "text").otherwise("unknown")


def raw_category(raw: Column, hint: Column) -> Column:
    key = F.lower(strip(raw))
    return (
        F.when(key.isin("math", "formula", "equation", "matrix"), "math")
        .when(key.isin("table", "tabular"), "table")
        .when(key.isin("text", "title", "heading", "paragraph", "label"), "text")
        .when(looks_math(hint), "math")
        .otherwise("text")
    )


def balanced(s: Column, left: str = "{", right: str = "}") -> Column:
    """Brackets of one kind nest; a backslash hides the next character."""
    only = F.regexp_replace(F.regexp_replace(s, r"(?s)\\.", ""), f"[^\\{left}\\{right}]", "")
    step = lambda a, c: F.struct((a["depth"] + F.when(c == left, 1).otherwise(-1)).alias("depth"), (a["ok"] & ((c == left) | (a["depth"] > 0))).alias("ok"))
    end = F.aggregate(F.filter(F.split(only, ""), lambda c: c != ""), F.struct(F.lit(0).alias("depth"), F.lit(True).alias("ok")), step)
    return end["ok"] & (end["depth"] == 0)


def looks_math(s: Column) -> Column:
    v = strip(F.coalesce(s, F.lit("")))
    plain = F.regexp_replace(v, r"\\(?:begin|end)\{[^}]+\}", " ")
    plain = F.regexp_replace(plain, r"\\(?:text|textrm|mathrm|operatorname)\{[^}]*\}", " ")
    plain = F.regexp_replace(plain, r"\\[A-Za-z]+", " ")
    prose = F.exists(F.regexp_extract_all(plain, F.lit(r"(?U)[^\W\d_]{3,}"), F.lit(0)), lambda w: ~F.lower(w).isin(*MATH_WORDS_SHORT))
    left = F.translate(v, MATH_CHARS, "")
    symbols = F.length(v) - F.length(left)
    letters = F.length(v) - F.length(F.regexp_replace(v, r"\p{L}", ""))
    digits = F.length(v) - F.length(F.regexp_replace(v, r"\p{Nd}", ""))
    formula = (F.contains(v, F.lit("=")) & (F.length(v) <= 80) & ((letters <= 16) | (digits > 0))) | (symbols >= 3) | ((letters <= 3) & (digits >= 2) & (symbols >= 1))
    return (v != "") & ~prose & formula


def validate_text(s: Column) -> Column:
    v = strip(s)
    n = F.greatest(F.lit(1), F.length(v))
    score = 1.0 - F.least(F.lit(0.8), count_of(v, "?") / n * 4 + count_of(v, BAD) / n * 6 + count_of(v, BAD) / n * 6)
    score = F.when(F.length(v) < 2, score * 0.5).otherwise(score)
    return F.when(v == "", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def validate_math(s: Column) -> Column:
    v = strip(s)
    for mark in (_TICKS + "latex", _TICKS + "tex", _TICKS):
        v = F.replace(v, F.lit(mark), F.lit(""))
    v = strip(v)
    token = F.lit(False)
    for t in MATH_TOKENS:
        token = token | F.contains(v, F.lit(t))
    score = F.lit(0.45) + F.when(balanced(v), 0.25).otherwise(0.0) + F.when(token, 0.20).otherwise(0.0) + F.when(~F.contains(v, F.lit("?")) & ~F.contains(v, F.lit(BAD)), 0.10).otherwise(0.0)
    return F.when(v == "", 0.0).otherwise(F.round(score, 10))


def validate_table(s: Column) -> Column:
    v = F.lower(strip(s))
    lines = F.filter(F.split(v, r"\R"), lambda x: strip(x) != "")
    piped = F.size(F.filter(lines, lambda x: F.contains(x, F.lit("|"))))
    return (
        F.when(v == "", 0.0)
        .when(F.contains(v, F.lit("\\begin{tabular")), 0.95)
        .when(F.contains(v, F.lit("<table")) & F.contains(v, F.lit("</table>")), 0.90)
        .when((F.size(lines) >= 2) & (piped >= 2), 0.82)
        .otherwise(0.45)
    )


def validate(category: Column, s: Column) -> Column:
    return F.when(category == "math", validate_math(s)).when(category == "table", validate_table(s)).otherwise(validate_text(s))


def prose_words(s: Column) -> Column:
    """Words that are neither inside delimited mathematics nor commands, function names or short capitals."""
    v = F.regexp_replace(s, r"(?s)\$\$.*?\$\$|(?<!\\)\$.*?(?<!\\)\$|\\\(.*?\\\)|\\\[.*?\\\]", " ")
    v = F.regexp_replace(v, r"\\(?:begin|end)\{[^}]+\}|\\[A-Za-z]+", " ")
    words = F.regexp_extract_all(v, F.lit(r"(?U)[^\W\d_]{2,}"), F.lit(0))
    return F.filter(words, lambda w: ~F.lower(w).isin(*MATH_WORDS) & ~((F.upper(w) == w) & (F.length(w) <= 3)))


def escape_tex(s: Column) -> Column:
    """The ten special characters, all at once."""
    # what stands for a backslash meanwhile, and that character itself
    out = F.replace(F.replace(s, F.lit("\x01"), F.lit("\x01a")), F.lit("\\"), F.lit("\x01b"))
    for c in "{}&%$#_":
        out = F.replace(out, F.lit(c), F.lit(TEX_ESCAPES[c]))
    for c, to in (("\x01b", TEX_ESCAPES["\\"]), ("~", TEX_ESCAPES["~"]), ("^", TEX_ESCAPES["^"]), ("\x01a", "\x01")):
        out = F.replace(out, F.lit(c), F.lit(to))
    return out


def text_source(s: Column) -> Column:
    """Stripped, with LF line ends and without a code fence around."""
    v = F.replace(F.replace(strip(s), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    v = F.regexp_replace(v, r"(?i)^`{3}(?:markdown|text|latex|tex)?\s*\n", "")
    return F.regexp_replace(v, r"\n\s*`{3}$", "")


#: What a heading and a list item look like.
HEADING = r"^\s*(#{1,6})\s+(.+)$"
LIST_ITEM = r"^\s*(?:([-*•])\s+|(\d+)[.)]\s+)(.+)$"


def heading(line: Column) -> Column:
    """struct<level, title>: a level up to 3, or null."""
    marks = F.regexp_extract(line, HEADING, 1)
    return F.when(marks != "", F.struct(F.least(F.length(marks), F.lit(3)).alias("level"), F.regexp_extract(line, HEADING, 2).alias("title")))


def list_item(line: Column) -> Column:
    """struct<kind, number, content>, or null."""
    bullet, number = F.regexp_extract(line, LIST_ITEM, 1), F.regexp_extract(line, LIST_ITEM, 2)
    kind = F.when(bullet != "", "itemize").when(number != "", "enumerate")
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), number.alias("number"), F.regexp_extract(line, LIST_ITEM, 3).alias("content")))


def collapse(s: Column) -> Column:
    """Runs of space, tab, form feed and vertical tab become one space; ends are stripped."""
    return strip(F.regexp_replace(s, r"[\t\f\x0B ]+", " "))


def pipe_rows(s: Column) -> Column:
    """array<array<string>>: cells of lines with a pipe, without separator rows."""
    lines = F.filter(F.transform(F.split(s, r"\R"), strip), lambda x: F.contains(x, F.lit("|")))
    rows = F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|"), strip))
    return F.filter(rows, lambda r: ~F.forall(r, lambda c: c.rlike(r"^[-: ]*$")))


def unescape_html(s: Column, only: tuple[str, ...] | None = None) -> Column:
    """The five named references of markup, the hard space, and numeric ones up to U+FFFF; the ampersand last.

    only: the names that count, without numeric ones.
    """
    code = lambda p: F.coalesce(F.conv(F.regexp_extract(p, r"^[xX]([0-9A-Fa-f]{1,4});", 1), 16, 10).try_cast("int"), F.regexp_extract(p, r"^(\d{1,5});", 1).try_cast("int"))
    char = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 4, "0")), "UTF-16BE")
    piece = lambda p, i: F.when((i > 0) & code(p).between(1, 0xD7FF), F.concat(char(code(p)), F.regexp_replace(p, r"^[^;]*;", ""))).when(i > 0, F.concat(F.lit("&#"), p)).otherwise(p)
    if only is None:
        s = F.when(F.contains(s, F.lit("&#")), F.array_join(F.transform(F.split(s, "&#", -1), piece), "")).otherwise(s)
    for name, char_ in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", "\xa0"), ("&amp;", "&")):
        if only is None or name[1:-1] in only:
            s = F.replace(s, F.lit(name), F.lit(char_))
    return s


def tabular(rows: Column, only: tuple[str, ...] | None = None) -> Column:
    """A ruled tabular, short rows padded; empty for no rows. only: as in unescape_html()."""

    def filled(rows: Column, n: Column) -> Column:
        cells = lambda r: F.concat(r, F.array_repeat(F.lit(""), F.greatest(F.lit(0), n - F.size(r))))
        row = lambda r: F.array_join(F.transform(cells(r), lambda c: escape_tex(unescape_html(c, only))), " & ")
        body = F.array_join(F.transform(rows, row), " \\\\ \\hline\n")
        return F.concat(F.lit("\\begin{tabular}{|"), F.repeat(F.lit("l|"), n), F.lit("}\n\\hline\n"), body, F.lit(" \\\\ \\hline\n\\end{tabular}"))

    return once(rows, lambda r: F.when(F.size(r) > 0, once(F.array_max(F.transform(r, F.size)), lambda n: filled(r, n))).otherwise(""))


def asset_id(s: Column) -> Column:
    return F.regexp_replace(s, "[^A-Za-z0-9_.-]", "_")


def clean_json(s: Column) -> Column:
    """From the first opening to the last closing brace; the text without its fence if there are none."""
    v = F.regexp_replace(F.regexp_replace(strip(s), r"(?i)^`{3}(?:json)?\s*", ""), r"\s*`{3}$", "")
    found = F.regexp_extract(v, r"(?s)\{.*\}", 0)
    return F.when(found != "", found).otherwise(v)


def review_note(note: str = REVIEW_NOTE) -> Column:
    return F.concat(F.lit("{\\small\\itshape ["), escape_tex(F.lit(note)), F.lit("]}"))


def figure_fraction(w: Column, page_w: Column) -> Column:
    # rounded by its binary value as in printf, a tie to the even digit: the fraction is a whole number of 2**-54
    x = F.greatest(F.lit(0.25), F.least(F.lit(1.0), w / F.greatest(F.lit(1.0), page_w)))

    def text(n: Column) -> Column:
        k, rest = F.shiftright(n, 51), n.bitwiseAND(F.lit(2**51 - 1))
        k = k + F.when((rest > 2**50) | ((rest == 2**50) & (k % 2 == 1)), 1).otherwise(0)
        return F.format_string("%d.%03d", F.floor(k / 1000), k % 1000)

    return once((x * 2.0**54).cast("long") * 125, text)
