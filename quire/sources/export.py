"""Exports: uploads checked against limits, JSON and document tables, and archives written on the driver."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.settings import Settings
from quire.sources.provider import KINDS, file_kind, mapped, redacted


def checked_uploads(files: DataFrame, doc: str, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of files (doc, ord, name, length): accepted have a unique name, rejected a reason."""
    n = F.count("*").over(Window.partitionBy(doc))
    reason = (
        F.when(n > settings.max_files, "too many files")
        .when(~file_kind(F.col("name")).isin(*KINDS), "unsupported type")
        .when(F.col("length") > settings.max_upload_mb * 1024 * 1024, "file too large")
    )
    judged = files.withColumn("reason", reason)
    stored = F.format_string("%03d_%s", F.col("ord").cast("long"), F.regexp_replace("name", "[^A-Za-z0-9_.-]", "_"))
    return judged.where("reason IS NULL").drop("reason").withColumn("stored", stored), judged.where("reason IS NOT NULL")


def page_limit(pages: DataFrame, doc: str, most: int) -> DataFrame:
    """pages as they are; the job fails if a document has more than `most`, as too many pages are an error, not a cut."""
    n = F.count("*").over(Window.partitionBy(doc))
    return pages.withColumn("n_pages", n).where(F.assert_true(F.col("n_pages") <= most, "too many pages").isNull()).drop("n_pages")


def json_rows(df: DataFrame, doc: list[str]) -> DataFrame:
    """(doc, json): each row as a JSON text."""
    return df.select(*doc, F.to_json(F.struct(*df.columns)).alias("json"))


def _listed(rows: DataFrame, doc: list[str], order: list[str], fields: list[Column]) -> Column:
    """An aggregate: the rows as structs of fields, in order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("at"), F.struct(*fields).alias("row")))), lambda x: x["row"])


def decoded_row() -> list[Column]:
    """What a decoded unit (id, page, category, x1..y2, decoded, raw_decoded, status, decoder, score) shows."""
    box = F.struct("x1", "y1", "x2", "y2").alias("bbox")
    return [F.col("id"), F.col("page"), F.col("category"), box, F.col("decoded"), F.col("raw_decoded"), F.struct("status").alias("quality_review"), F.col("decoder"), F.col("score").alias("validation"), F.lit("structure").alias("validation_kind")]


def decoded_json(units: DataFrame, doc: list[str]) -> DataFrame:
    """(doc, json): decoded.json of each document, its units by page and id."""
    return units.groupBy(*doc).agg(F.to_json(_listed(units, doc, ["page", "id"], decoded_row())).alias("json"))


def layout_json(pages: DataFrame, blocks: DataFrame, units: DataFrame, doc: list[str]) -> DataFrame:
    """(doc, json): layout.json of each document: its pages (page, page_w, page_h, detector, quality) with their blocks and units."""
    key, box = [*doc, "page"], F.struct("x1", "y1", "x2", "y2").alias("bbox")
    b = blocks.groupBy(*key).agg(_listed(blocks, key, ["id"], [F.col("id"), F.col("category"), F.col("source_label"), F.col("score"), box]).alias("blocks"))
    u = units.groupBy(*key).agg(_listed(units, key, ["id"], [F.col("id"), F.col("category"), box, F.col("member_ids")]).alias("units"))
    full = pages.join(b, key, "left").join(u, key, "left")
    page = [F.col("page").alias("index"), F.col("page_w").alias("width_px"), F.col("page_h").alias("height_px"), F.col("detector"), F.col("quality").alias("detector_quality"), F.coalesce("blocks", F.array()).alias("blocks"), F.coalesce("units", F.array()).alias("units")]
    return full.groupBy(*doc).agg(F.to_json(F.struct(_listed(full, doc, ["page"], page).alias("pages"))).alias("json"))


def detector_rows(pages: DataFrame, doc: list[str]) -> DataFrame:
    """(doc, detectors): which detector read each page, in order of pages."""
    fields = [F.col("page"), F.col("detector").alias("provider"), F.col("quality"), F.col("rescued")]
    return pages.groupBy(*doc).agg(_listed(pages, doc, ["page"], fields).alias("detectors"))


def decoder_rows(units: DataFrame, doc: list[str]) -> DataFrame:
    """(doc, decoders): how each unit was read, by page and id."""
    fields = [F.col("id"), F.col("category"), F.col("decoder"), F.col("score").alias("validation"), F.lit("structure").alias("validation_kind"), F.struct("status").alias("quality_review"), F.col("rescued")]
    return units.groupBy(*doc).agg(_listed(units, doc, ["page", "id"], fields).alias("decoders"))


def manifest_json(documents: DataFrame, doc: list[str]) -> DataFrame:
    """(doc, json): manifest.json from documents (doc, and the manifest's columns)."""
    return documents.select(*doc, F.to_json(F.struct(*(c for c in documents.columns if c not in doc)), {"ignoreNullFields": "false"}).alias("json"))


def quality_review_json(units: DataFrame, summary: DataFrame, doc: list[str]) -> DataFrame:
    """(doc, json): quality_review.json: the summary (doc, and its counts) and each typed unit's review."""
    fields = [F.col("id"), F.col("page"), F.col("raw_decoded").alias("original_text"), F.col("decoded").alias("text"), F.col("category"), F.col("status"), F.col("issues"), F.col("applied"), F.col("merged_into")]
    per = units.where("status <> 'not_applicable'").groupBy(*doc).agg(_listed(units, doc, ["page", "id"], fields).alias("units"))
    s = summary.select(*doc, F.struct(*(c for c in summary.columns if c not in doc)).alias("summary"))
    report = F.struct("summary", F.lit("image-grounded-content").alias("validation_kind"), F.coalesce("units", F.array()).alias("units"))
    return s.join(per, doc, "left").select(*doc, F.to_json(report).alias("json"))


def raw_json(calls: DataFrame, doc: list[str], order: str, secret: str = "") -> DataFrame:
    """(doc, json): quality_review_raw.json or layout_rescue_raw.json: the responses (doc, order, raw) in order, without
    secrets and pictures."""
    shown = redacted(calls, [*doc, order], "raw", secret, images=True)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "shown"))), lambda x: x["shown"]), ", ")
    return shown.groupBy(*doc).agg(F.concat(F.lit("["), listed, F.lit("]")).alias("json"))


def trace_json(trace: DataFrame, doc: list[str], kind: str) -> DataFrame:
    """(doc, json): one of the three trace documents: the payloads of a kind (request, response with error, parsed), page
    by page and attempt by attempt."""
    kinds = ("response", "error") if kind == "response" else (kind,)
    rows = trace.where(F.col("kind").isin(*kinds))
    entry = F.concat(F.lit('{"page": '), F.col("page").cast("string"), F.lit(', "attempt": '), F.col("attempt").cast("string"), F.lit(', "payload": '), F.col("payload"), F.lit("}"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "attempt", entry.alias("e")))), lambda x: x["e"]), ", ")
    return rows.groupBy(*doc).agg(F.concat(F.lit('{"pages": ['), listed, F.lit("]}")).alias("json"))


def warned_sources(pages: DataFrame, warned: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, page, path): where the scans of warned pages are put beside the document."""
    bad = warned.select(*keys, "page").distinct()
    return pages.select(*keys, "page").join(bad, [*keys, "page"], "left_semi").select(*keys, "page", F.format_string("sources/page_%04d.png", F.col("page").cast("long")).alias("path"))


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """(path, length) of files (path, content), each written under folder on any file system that Arrow knows.

    A file is written under a name of its own and then moved, so that a task that is run again leaves whole files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, where = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                target = f"{where}/{path}"
                system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(part := f"{target}.{uuid.uuid4().hex}") as out:
                    out.write(content)
                system.move(part, target)
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([len(c) for c in b.column("content").to_pylist()], pa.int64())], names=["path", "length"])

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, "path string, length bigint")


def read_files(paths: DataFrame, source: str, target: str) -> DataFrame:
    """(path, content) for write_files(): what lies at the column source is to lie at the column target."""

    def run(path: str, to: str) -> list[tuple]:
        from pyarrow import fs

        system, where = fs.FileSystem.from_uri(path if "://" in path else "file://" + path)
        with system.open_input_stream(where) as data:
            return [(to, data.read())]

    return mapped(paths, [], [source, target], run, "path string, content binary")


#: What an error becomes for who asked.
ERRORS = {"too many files": 400, "no files": 400, "file too large": 413, "unsupported type": 415, "pipeline": 502}


def error_code(reason: str) -> int:
    """The code of an error by its reason; 500 for one that is none of ours."""
    return ERRORS.get(reason, 500)


def keeps_failure(debug: bool, names: Iterable[str]) -> bool:
    """Whether a failed conversion leaves an archive: only with a trace among its files, if one was asked for."""
    return debug and "qwen_layout_raw.json" in set(names)


def health(settings: Settings, detector: Callable | None = None) -> dict:
    """What is set up, and whether the detector can be made."""
    report = {"status": "ok", "review": settings.review_enabled, "max_pages": settings.max_pages, "detector": None}
    if detector:
        try:
            report["detector"] = type(detector()).__name__
        except Exception as error:  # noqa: BLE001  that is the report
            report |= {"status": "error", "error": f"{type(error).__name__}: {error}"}
    return report


def archive(files: dict[str, bytes], status: str) -> tuple[bytes, dict[str, str]]:
    """A ZIP of one document's result files, and the header that tells its status. Runs on the driver, for one document."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in sorted(files.items()):
            z.writestr(name, data)
    return out.getvalue(), {"X-Conversion-Status": status}


def tail(text, most: int = 12_000):
    """The end of a log."""
    return F.right(text, F.lit(most))
