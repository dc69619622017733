"""Settings, uploads, limits, archives, scans and straightened crops."""

import io
import struct
import zipfile
import zlib

import numpy as np
import pytest

from quire import settings
from quire.operators import images
from quire.sources import export, provider


def png(rgb: np.ndarray) -> bytes:
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in rgb)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", rgb.shape[1], rgb.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_settings_fall_back():
    s = settings.read({"QUIRE_MAX_PAGES": "x", "QUIRE_MAX_FILES": "3", "QUIRE_REVIEW_ENABLED": " No ", "QUIRE_DECODE_RESCUE": ".7"})
    assert (s.max_pages, s.max_files, s.review_enabled, s.decode_rescue) == (30, 3, False, 0.7)


def test_uploads_and_limits(spark):
    rows = [(1, 0, "a b.PNG", 10), (1, 1, "x.exe", 10), (1, 2, "c.pdf", 99_000_000), *[(2, k, f"{k}.png", 1) for k in range(21)]]
    good, bad = export.checked_uploads(spark.createDataFrame(rows, "doc long, ord long, name string, length long"), "doc", settings.Settings())
    assert [r.stored for r in good.collect()] == ["000_a_b.PNG"]
    assert {(r.doc, r.reason) for r in bad.collect()} == {(1, "unsupported type"), (1, "file too large"), (2, "too many files")}
    pages = spark.range(5).withColumnRenamed("id", "p").selectExpr("p", "1 AS doc")
    assert export.page_limit(pages, "doc", 5).count() == 5
    with pytest.raises(Exception, match="too many pages"):
        export.page_limit(pages, "doc", 4).collect()
    assert export.json_rows(pages, ["doc"]).first().json.startswith('{"p":')


def test_archive():
    data, head = export.archive({"b.tex": b"x", "a.json": b"{}"}, "warning")
    assert zipfile.ZipFile(io.BytesIO(data)).namelist() == ["a.json", "b.tex"] and head["X-Conversion-Status"] == "warning"


def test_scans_read_files(spark, tmp_path):
    rgb = np.zeros((4, 6, 3), np.uint8)
    rgb[..., 0] = 200
    (tmp_path / "p.PNG").write_bytes(png(rgb))
    assert [(r.kind, r.length > 0) for r in provider.scans(spark, f"file://{tmp_path}").collect()] == [("png", True)]
    one = provider.images(spark, f"file://{tmp_path}").first()
    bgr = np.frombuffer(bytes(one.bgr), np.uint8).reshape(one.height, one.width, 3)
    assert (bgr[..., ::-1] == rgb).all()
    page = provider.pages(provider.scans(spark, f"file://{tmp_path}")).first()
    assert (page.source_page, page.width, page.height) == (0, 6, 4) and (images.read_png(bytes(page.png)) == rgb).all()
    (tmp_path / "q.pdf").write_bytes(b"%PDF")
    both = provider.pages(provider.scans(spark, f"file://{tmp_path}"), lambda content, dpi: [np.full((2, 3, 3), k, np.uint8) for k in range(2)]).collect()
    assert sorted((r.path[-1], r.source_page, r.width) for r in both) == [("G", 0, 6), ("f", 0, 3), ("f", 1, 3)]
    with pytest.raises(Exception, match="no decoder for pdf"):
        provider.pages(provider.scans(spark, f"file://{tmp_path}")).collect()
    (tmp_path / "r.txt").write_text("no")
    with pytest.raises(Exception, match="unsupported file"):
        provider.scans(spark, f"file://{tmp_path}").collect()


def test_pictures_as_files():
    rnd = np.random.default_rng(1)
    rgb = rnd.integers(0, 255, (7, 5, 3)).astype(np.uint8)
    assert (images.read_png(images.png_bytes(rgb)) == rgb).all()
    assert (images.read_png(images.png_bytes(rgb[..., 0])) == rgb[..., :1]).all()
    # every row filter, undone
    rows, prev = b"", np.zeros((5, 3), np.int64)
    for y in range(5):
        line = rgb[y].astype(np.int64)
        left, diag = np.vstack([np.zeros((1, 3), np.int64), line[:-1]]), np.vstack([np.zeros((1, 3), np.int64), prev[:-1]])
        p = left + prev - diag
        paeth = np.where((abs(p - left) <= abs(p - prev)) & (abs(p - left) <= abs(p - diag)), left, np.where(abs(p - prev) <= abs(p - diag), prev, diag))
        guess = [np.zeros_like(line), left, prev, (left + prev) // 2, paeth][y]
        rows += bytes([y]) + ((line - guess) & 255).astype(np.uint8).tobytes()
        prev = line
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    assert (images.read_png(data) == rgb[:5]).all()
    with pytest.raises(ValueError, match="no PNG"):
        images.read_png(b"GIF8")


def test_orientation():
    def jpeg(o, order):
        n = lambda v, size: v.to_bytes(size, order)
        tiff = (b"II" if order == "little" else b"MM") + n(42, 2) + n(8, 4) + n(1, 2) + n(0x0112, 2) + n(3, 2) + n(1, 4) + n(o, 2) + n(0, 2)
        part = b"Exif\0\0" + tiff
        return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + (len(part) + 2).to_bytes(2, "big") + part + b"\xff\xda"

    assert [images.exif_orientation(jpeg(o, order)) for o in (1, 3, 6, 8, 9) for order in ("little", "big")] == [1, 1, 3, 3, 6, 6, 8, 8, 1, 1]
    assert images.exif_orientation(b"no") == images.exif_orientation(b"\xff\xd8\xff") == 1
    a = np.arange(6, dtype=np.uint8).reshape(2, 3)
    want = {1: a, 2: a[:, ::-1], 3: a[::-1, ::-1], 4: a[::-1], 5: a.T, 6: np.rot90(a, -1), 7: a[::-1, ::-1].T, 8: np.rot90(a)}
    assert all((images.oriented(a, o) == w).all() for o, w in want.items())


def test_files_are_written_and_copied(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.png", bytearray(b"12")), ("b.json", bytearray(b"{}"))], "path string, content binary")
    assert {(r.path, r.length) for r in export.write_files(rows, f"file://{tmp_path}/out").collect()} == {("a/x.png", 2), ("b.json", 2)}
    assert (tmp_path / "out/a/x.png").read_bytes() == b"12"
    paths = spark.createDataFrame([(f"file://{tmp_path}/out/a/x.png", "assets/p0000_u.png")], "source string, asset string")
    export.write_files(export.read_files(paths, "source", "asset"), str(tmp_path / "doc")).collect()
    assert (tmp_path / "doc/assets/p0000_u.png").read_bytes() == b"12"


def test_review_and_raw_documents(spark):
    import json

    units = spark.createDataFrame([(1, "u1", 0, "text", "new", "old", "corrected", ["why"], True, None), (1, "u2", 0, "figure", "", "", "not_applicable", [], False, None)], "doc long, id string, page long, category string, decoded string, raw_decoded string, status string, issues array<string>, applied boolean, merged_into string")
    summary = spark.createDataFrame([(1, 1, 2)], "doc long, corrected long, batches long")
    report = json.loads(export.quality_review_json(units, summary, ["doc"]).first().json)
    assert report["summary"] == {"corrected": 1, "batches": 2} and [(u["id"], u["original_text"], u["text"]) for u in report["units"]] == [("u1", "old", "new")]
    calls = spark.createDataFrame([(1, 1, '{"api-key": "s", "b": 2}'), (1, 0, '{"u": "data:image/png;base64,AA"}')], "doc long, batch long, raw string")
    assert json.loads(export.raw_json(calls, ["doc"], "batch").first().json) == [{"u": "data:image/png;base64,[OMITTED]"}, {"api-key": "[REDACTED]", "b": 2}]
    manifest = spark.createDataFrame([(1, "ok", None)], "doc long, status string, title string")
    assert json.loads(export.manifest_json(manifest, ["doc"]).first().json) == {"status": "ok", "title": None}


def test_errors_and_health():
    assert [export.error_code(x) for x in ("file too large", "unsupported type", "too many files", "pipeline", "other")] == [413, 415, 400, 502, 500]
    assert export.keeps_failure(True, ["qwen_layout_raw.json"]) and not export.keeps_failure(False, ["qwen_layout_raw.json"]) and not export.keeps_failure(True, [])
    assert export.health(settings.Settings(), dict)["detector"] == "dict"

    def broken():
        raise ImportError("x")

    assert export.health(settings.Settings(), broken)["error"] == "ImportError: x"


def test_straightened_lines():
    page = np.full((200, 300, 3), 255, np.uint8)
    page[50:70, 40:140] = 10
    upright = images.straightened(page, [40, 50, 140, 50, 140, 70, 40, 70])
    assert upright.shape == (20, 100, 3) and (upright == 10).mean() > 0.95
    tilted = images.straightened(page, [40, 50, 140, 60, 138, 80, 38, 70])
    assert tilted.shape[0] in (20, 21) and tilted.shape[1] in (100, 101)
    assert images.straightened(page, [1, 1, 1, 1, 1, 1, 1, 1]) is None
    packed = images.packed_crop(page, [[40, 50, 140, 50, 140, 70, 40, 70]] * 2, 8)
    assert packed.shape == (20 * 2 + 8 + 16, 116, 3)
    union = images.union_crop(page, [[40, 50, 140, 50, 140, 70, 40, 70], [60, 55, 160, 55, 160, 75, 60, 75]], 4)
    assert union.shape == (25 + 8, 120 + 8, 3) and (union[4:24, 4:104] == 10).all()
    quarter = images.rotated(page, 90)
    assert quarter.shape == (300, 200, 3) and (quarter < 100).any()
