"""File ingest: hash, type, text and pages."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labcurate.functions import parsing as P
from labcurate.operators.curate import page_selected

ACCEPTED = (".pdf", ".txt", ".md")
#: Rendering: enlargement, JPEG quality, and the least side and size of a page worth looking at.
ZOOM, QUALITY, LEAST_SIDE, LEAST_BYTES = 3.0, 85, 200, 5 * 1024
MIME_TYPES = ("application/pdf", "text/plain", "text/markdown")


def uploaded(spark: SparkSession, path: str) -> DataFrame:
    """path, extension, file_hash, length, modificationTime, content of the accepted files below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.withColumn("extension", P.extension(F.col("path"))).where(F.col("extension").isin(*ACCEPTED))
    return files.withColumn("file_hash", F.md5("content"))


def client_accepts(mime: Column, name: Column) -> Column:
    return mime.isin(*MIME_TYPES) | name.endswith(".md")


def plain_text(files: DataFrame) -> DataFrame:
    """file_hash, text of text and Markdown files."""
    return files.where(F.col("extension").isin(".txt", ".md")).select("file_hash", F.decode("content", "UTF-8").alias("text"))


def _pdf_texts(content: bytes) -> list[str]:
    import fitz  # on the executors only

    with fitz.open(stream=content, filetype="pdf") as doc:
        return [page.get_text() for page in doc]


def _pdf_image(content: bytes, page_no: int) -> tuple[int, int, bytes]:
    import fitz

    with fitz.open(stream=content, filetype="pdf") as doc:
        pixels = doc[page_no].get_pixmap(matrix=fitz.Matrix(ZOOM, ZOOM))
        return pixels.width, pixels.height, pixels.tobytes("jpeg", jpg_quality=QUALITY)


def pdf_pages(files: DataFrame, read: Callable[[bytes], list[str]] = _pdf_texts) -> DataFrame:
    """file_hash, page_no, text of each page; a file that ``read`` cannot make out gives no rows.  ``read`` runs on the executors."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for h, content in zip(frame["file_hash"], frame["content"], strict=True):
                try:
                    rows += [(h, n, text) for n, text in enumerate(read(bytes(content)))]
                except (RuntimeError, ValueError):
                    continue
            yield pd.DataFrame(rows, columns=["file_hash", "page_no", "text"])

    return files.where(F.col("extension") == ".pdf").select("file_hash", "content").mapInPandas(run, "file_hash string, page_no int, text string")


def page_images(files: DataFrame, pages: DataFrame, render: Callable[[bytes, int], tuple[int, int, bytes]] = _pdf_image) -> DataFrame:
    """file_hash, page_no, image (a JPEG data URI) of the pages (file_hash, page_no) wanted.

    Pages narrower or lower than LEAST_SIDE or with fewer bytes than LEAST_BYTES hold nothing to read; a file with a page that cannot
    be rendered gives none.
    """
    wanted = pages.groupBy("file_hash").agg(F.array_sort(F.collect_set("page_no")).alias("wanted"))  # of one file, so bounded

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for h, content, numbers in zip(frame["file_hash"], frame["content"], frame["wanted"], strict=True):
                try:
                    made = [(h, int(n), *render(bytes(content), int(n))) for n in numbers]
                except (RuntimeError, ValueError):
                    continue
                yield pd.DataFrame([(h, n, jpeg) for h, n, width, height, jpeg in made if min(width, height) >= LEAST_SIDE and len(jpeg) >= LEAST_BYTES], columns=["file_hash", "page_no", "image"])

    found = files.select("file_hash", "content").join(wanted, "file_hash").mapInPandas(run, "file_hash string, page_no int, image binary")
    return found.withColumn("image", data_uri(F.col("image")))


def document_text(pages: DataFrame, drop_empty: bool = False) -> DataFrame:
    """file_hash, text: the pages in order, joined by an empty line; with ``drop_empty`` pages without text do not count."""
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    pages = pages.where(P.strip(F.col("text")) != "") if drop_empty else pages
    return pages.groupBy("file_hash").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n\n").alias("text"))


def selected_pages(pages: DataFrame) -> DataFrame:
    return pages.where(page_selected(F.col("page_no"), F.col("text")))


def _fitted(content: bytes) -> bytes:
    from PIL import Image  # on the executors only

    image = Image.open(io.BytesIO(content)).convert("RGB")
    image.thumbnail((1024, 1024))
    out = io.BytesIO()
    image.save(out, "JPEG", quality=70)
    return out.getvalue()


def small_images(images: DataFrame, column: str = "image", shrink: Callable[[bytes], bytes] = _fitted) -> DataFrame:
    """Images fitted into a square and stored as JPEG; null where one cannot be read.  ``shrink`` runs on the executors."""

    @F.pandas_udf("binary")
    def run(content: pd.Series) -> pd.Series:
        def one(b: bytes | None) -> bytes | None:
            try:
                return shrink(b) if b is not None else None
            except (OSError, ValueError):
                return None

        return content.map(one)

    return images.withColumn(column, run(column))


def data_uri(content: Column, mime: str = "image/jpeg") -> Column:
    """On one line."""
    return F.concat(F.lit(f"data:{mime};base64,"), F.translate(F.base64(content), "\r\n", ""))


def of_data_uri(uri: Column) -> Column:
    return F.unbase64(F.substring_index(uri, ",", -1))
