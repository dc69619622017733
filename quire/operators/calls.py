"""Calls of models: functions that are handed in, run over a table's rows, with what each call cost.

A call gets a row's values and gives (text or rows, usage); an exception is a failed call. Nothing here reaches a
network. Spark may run a task twice, so a call's row carries the key that tells a repeated call from another one, and
what is paid for is written before it is read.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.sources import provider

#: The task that goes with a category, and caps on what a call may write.
TASKS = {"text": "document_parsing", "math": "formula_recognition", "table": "table_parsing"}
LAYOUT_TASK, LAYOUT_TOKENS, DECODE_TOKENS = "advanced_recognition", 6144, 4096
VENDOR_FIELD = "ocr_options"
#: What a model is told to write; callers with a model of their own hand in others.
PROMPTS = {"text": "Write down the text as it stands, line by line.", "math": "Write down the formulas in LaTeX.", "table": "Write down the table as a LaTeX tabular."}
RESCUE_PROMPTS = {k: v + " Nothing else." for k, v in PROMPTS.items()}


class Negotiated:
    """A send(payload) -> response text that leaves out the vendor's field once a gateway has refused it.

    It tries with the field until it is refused, then sends the same request once without it, and from then on only so.
    A worker holds one of these, so it asks once and not at every call.
    """

    def __init__(self, send: Callable[[dict], str]):
        self.send, self.refused = send, False

    def __call__(self, payload: dict, task: str) -> str:
        plain = {k: v for k, v in payload.items() if k != VENDOR_FIELD}
        if self.refused:
            return self.send(plain)
        try:
            return self.send({**plain, VENDOR_FIELD: {"task": task}})
        except Exception as error:
            if not refuses_field(str(error)):
                raise
            self.refused = True
            return self.send(plain)


def refuses_field(message: str) -> bool:
    """As provider.unsupported_field(), for one message."""
    low = message.lower()
    return any(c in low for c in ("400", "404", "422")) and VENDOR_FIELD in low and any(w in low for w in ("unknown", "unsupported", "unexpected", "unrecognized", "extra", "not allowed"))


def payload(model: str, prompt: str, image_url: str, max_tokens: int) -> dict:
    """A request for one image."""
    content = [{"type": "text", "text": prompt}, {"type": "image_url", "image_url": {"url": image_url}}]
    return {"model": model, "messages": [{"role": "user", "content": content}], "temperature": 0, "max_tokens": max_tokens}


def _called(f: Callable, *args) -> tuple[str | None, str, str | None]:
    """(response text, usage as JSON, error) of a call that gives a response body."""
    try:
        body = f(*args)
        raw = json.loads(body) if isinstance(body, str) else body
        if not isinstance(raw, dict):
            return None, "{}", "ValueError: not an object"
        usage = raw.get("usage")
        return json.dumps(raw), json.dumps(usage if isinstance(usage, dict) else {}), None
    except Exception as error:  # noqa: BLE001  a failed call is a row, not the end of the job
        return None, "{}", f"{type(error).__name__}: {error}"[:800]


def responses(rows: DataFrame, keys: list[str], inputs: list[str], f: Callable, most: int | None = None) -> DataFrame:
    """(keys, raw, usage, error): f(*inputs) of each row, a response body or dict; most: calls at the same time, at most."""
    return provider.mapped(rows.repartition(most) if most else rows, keys, inputs, lambda *args: [_called(f, *args)], "raw string, usage string, error string")


def decoded(units: DataFrame, keys: list[str], name: str, f: Callable, most: int | None = None) -> DataFrame:
    """(keys, <name>, <name>_usage, <name>_error): texts of units (keys, category, crop) as f(crop, category, task) reads
    them; the text is null where the call fails."""
    task = F.create_map(*[F.lit(x) for kv in TASKS.items() for x in kv])[F.col("category")]
    got = responses(units.withColumn("task", task), keys, ["crop", "category", "task"], f, most)
    text = provider.message_text(F.col("raw"))
    return got.select(*keys, text.alias(name), F.col("usage").alias(f"{name}_usage"), F.coalesce("error", F.when(F.col("raw").isNotNull() & text.isNull(), "no readable message")).alias(f"{name}_error"))


def located(pages: DataFrame, page: str, f: Callable, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(blocks, calls) of pages (page, image, page_w, page_h) whose text lines f(image, task) locates.

    A page on which nothing usable is found has one block that covers it, of score 0. calls (page, raw, usage, error) hold
    one row a page; a page whose call failed has no block.
    """
    calls = responses(pages.withColumn("task", F.lit(LAYOUT_TASK)), [page], ["image", "task"], f, most)
    good = calls.where("error IS NULL").select(page, "raw", F.coalesce(provider.message_text(F.col("raw")), F.lit("")).alias("text"))
    sized = provider.response_items(good, [page]).join(pages.select(page, "page_w", "page_h"), page)
    found = provider.words(sized, F.col("page_w").cast("double"), F.col("page_h").cast("double"))
    blocks = provider.word_blocks(found.select(page, "ord", "x1", "y1", "x2", "y2", "text", "category", "quad"), page)
    empty = good.select(page).join(blocks.select(page).distinct(), page, "left_anti").join(pages.select(page, "page_w", "page_h"), page)
    side = lambda c: F.col(c).cast("double")
    whole = empty.select(
        page, F.format_string("p%04d_fullpage", F.col(page).cast("long")).alias("id"), F.lit("text").alias("category"), F.lit("whole_page_ocr_fallback").alias("source_label"), F.lit(0.0).alias("score"),
        F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), side("page_w").alias("x2"), side("page_h").alias("y2"), F.lit("").alias("hint"), F.lit(None).cast("array<double>").alias("quad"),
    )
    return blocks.unionByName(whole), calls


def detected(pages: DataFrame, page: str, models: list[Callable], most: int | None = None) -> DataFrame:
    """Blocks of pages (page, image) by a local detector: the first of models() that can be made in a worker, a function
    that gives its answer for an image in any of the forms that provider.as_result() reads."""
    made: list = []

    def run(image) -> list[tuple]:
        if not made:
            errors = []
            for make in models:
                try:
                    made.append(make())
                    break
                except Exception as error:  # noqa: BLE001  the next model is smaller
                    errors.append(f"{type(error).__name__}: {error}")
            else:
                raise RuntimeError("; ".join(errors))
        return [(json.dumps(provider.as_result(made[0](image))),)]

    raw = provider.mapped(pages.repartition(most) if most else pages, [page], ["image"], run, "raw string")
    return provider.detector_blocks(raw, page)


def routed(units: DataFrame, keys: list[str], f: Callable | None) -> DataFrame:
    """units with `rescue_asked`: what a router says to a unit's figures (router_state), or null without one or with an error."""
    if f is None:
        return units.withColumn("rescue_asked", F.lit(None).cast("boolean"))
    state = units.withColumn("state", F.to_json(router_state()))
    answers = provider.mapped(state, keys, ["state"], lambda s: [f(json.loads(s))], "status int, body string")
    return units.join(answers.select(*keys, provider.router_answer(F.col("body"), F.col("status")).alias("rescue_asked")), keys)


def router_state():
    """What a router is told of a unit (category, detector_score, score, decoded, member_ids): no text, no pixels."""
    return F.struct(
        "category", F.round("detector_score", 4).alias("detector_score"), F.round("score", 4).alias("validation_score"), F.length("decoded").cast("long").alias("decoded_length"), F.size("member_ids").cast("long").alias("member_count"),
    )


def reviewed(units: DataFrame, keys: list[str], f: Callable, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, calls) of review batches: units (keys, ord, id, page, category, decoded, x1..y2) of a batch go to
    f(metadata, sheet crops) as one call. calls (keys, raw, usage, error) hold a row a batch, whether or not it is read."""
    entry = F.struct("ord", "id", "page", "category", F.col("decoded").alias("ocr_draft"), F.array("x1", "y1", "x2", "y2").alias("target_bbox"))
    batches = units.groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("metadata"))
    calls = responses(batches, keys, ["metadata"], f, most)
    status = calls.withColumn("why", F.when(F.col("error").isNull(), provider.response_error(F.lit(200), F.col("raw"))).otherwise(F.col("error")))
    bodies = status.where("why IS NULL").select(*keys, provider.message_text(F.col("raw")).alias("body"))
    return provider.review_records(bodies, keys), status.select(*keys, "raw", "usage", F.col("why").alias("error"))


def data_url(image: Column) -> Column:
    """A picture's bytes as a data URL."""
    return F.concat(F.lit("data:image/png;base64,"), F.replace(F.base64(image), F.lit("\r\n"), F.lit("")))


def with_figures(blocks: DataFrame, figures: DataFrame, page: str) -> DataFrame:
    """blocks and the figures (page, ord, x1..y2) cut out of the paper that they leave, as blocks of their own."""
    found = figures.select(
        page, F.format_string("p%04d_source_figure_%04d", F.col(page).cast("long"), F.col("ord").cast("long")).alias("id"), F.lit("figure").alias("category"), F.lit("local_source_fragment").alias("source_label"),
        F.lit(1.0).alias("score"), "x1", "y1", "x2", "y2", F.lit("").alias("hint"), F.lit(None).cast("array<double>").alias("quad"),
    )
    return blocks.unionByName(found)

