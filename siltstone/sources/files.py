"""Files as sources: routing by suffix, text documents, and formats whose readers are optional."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import paragraphs, semantic_chunks
from ..operators.store import projected_stats, quota_guard
from ..operators.structure import structured_chunks

MOST_BYTES = 25 << 20
ROUTES = {"text": ["txt", "md", "text"], "pdf": ["pdf"], "docx": ["docx"], "image": ["png", "jpg", "jpeg", "webp"]}
MIME = {"text/": "text", "application/pdf": "pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx", "image/": "image"}
DOCX_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def route(path: Column, length: Column, mime: Column | None = None) -> Column:
    """text, pdf, docx, image, too_large or unsupported. The type counts only for a name without a suffix."""
    name = F.regexp_replace(path, r"^.*/", "")
    suffix = F.lower(F.regexp_extract(name, r"(?<=.)\.([^.]+)$", 1))
    out = F.when(length > MOST_BYTES, "too_large")
    for kind, suffixes in ROUTES.items():
        out = out.when(suffix.isin(suffixes), kind)
    if mime is not None:
        for prefix, kind in MIME.items():
            out = out.when((suffix == "") & F.startswith(mime, F.lit(prefix)), kind)
    return out.otherwise("unsupported")


def document_id(content: Column) -> Column:
    """SHA-256 of a file's bytes."""
    return F.sha2(content, 256)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content, route and document_id (SHA-256 of the bytes) of all files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")
    return files.withColumns({"route": route(F.col("path"), F.col("length")), "document_id": document_id(F.col("content")), "source_file": F.regexp_replace("path", r"^.*/", "")})


def text_documents(files: DataFrame) -> DataFrame:
    """Elements of the text files: UTF-8 without its mark, normalised, a paragraph each."""
    text = F.regexp_replace(F.decode("content", "UTF-8"), r"^\x{FEFF}", "")
    return files.where("route = 'text'").select("document_id", "source_file", paragraphs(text).alias("elements"))


def docx_elements(content: bytes) -> list[tuple]:
    """Paragraphs, headings and tables in the order of the body, from the file's own XML."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{DOCX_NS}body")
    out: list[tuple] = []
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{DOCX_NS}t"))
    for node in body if body is not None else []:
        if node.tag == f"{DOCX_NS}p":
            style = node.find(f"{DOCX_NS}pPr/{DOCX_NS}pStyle")
            heading = style is not None and (style.get(f"{DOCX_NS}val") or "").lower().startswith("heading")
            if text := re.sub(r"[ \t]+", " ", said(node)).strip():
                out.append(("heading" if heading else "paragraph", text))
        elif node.tag == f"{DOCX_NS}tbl":
            rows = [[said(c).strip().replace("|", "\\|") for c in r.findall(f"{DOCX_NS}tc")] for r in node.findall(f"{DOCX_NS}tr")]
            if rows:
                width = max(map(len, rows))
                lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
                out.append(("table", "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])))
    return [(f"p1-e{i + 1}", 1, kind, text, "docx", 1.0) for i, (kind, text) in enumerate(out)]


ELEMENTS = "array<struct<element_id:string,page:int,kind:string,text:string,source:string,confidence:double>>"
_NAMES = ["element_id", "page", "kind", "text", "source", "confidence"]


def docx_documents(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [[dict(zip(_NAMES, e, strict=True)) for e in docx_elements(bytes(c))] for c in batch["content"]]
            yield batch[["document_id", "source_file"]].assign(elements=own)

    return files.where("route = 'docx'").select("document_id", "source_file", "content").mapInPandas(run, f"document_id string, source_file string, elements {ELEMENTS}")


def pdf_documents(files: DataFrame, most_pages: int = 80, recognise: Callable[[bytes], list[tuple[str, float]]] | None = None, dpi: int = 180) -> DataFrame:
    """Pages of PDF files as elements; error says why a file has none (too many pages, unreadable, no reader), so that
    one file never ends the job for others. Needs PyMuPDF on the executors.

    A page's native blocks are its elements. With recognise, a page of poor native text is recognised instead, and one
    with reasons to (quality.merge_reasons) is recognised too, its text added where it adds something.
    """

    def page_elements(page, number: int) -> tuple[list[tuple], float, str]:
        blocks = [b[4].strip() for b in page.get_text("blocks") if len(b) > 4 and b[4].strip()]
        area = max(1.0, page.rect.width * page.rect.height)
        images = sum(r.width * r.height for image in page.get_images(full=True) for r in page.get_image_rects(image[0]))
        return [(f"p{number}-e{i + 1}", number, "paragraph", re.sub(r"\s+", " ", t), "native", 1.0) for i, t in enumerate(blocks)], min(1.0, images / area), "\n\n".join(blocks)

    def recognised(page, number: int, at: int) -> list[tuple]:
        picture = page.get_pixmap(dpi=dpi).tobytes("png")
        return [(f"p{number}-e{at + i + 1}", number, "figure_text", t, "ocr", float(c)) for i, (t, c) in enumerate(recognise(picture))]

    def read(content: bytes) -> tuple[list[dict], str | None]:
        try:
            import fitz

            with fitz.open(stream=content, filetype="pdf") as pdf:
                if pdf.page_count > most_pages:
                    return [], f"more than {most_pages} pages"
                out: list[tuple] = []
                for p in range(pdf.page_count):
                    own, coverage, text = page_elements(pdf[p], p + 1)
                    if recognise and needs_recognition(text, coverage):
                        own += recognised(pdf[p], p + 1, len(own))
                    out += own
            return [dict(zip(_NAMES, x, strict=True)) for x in out], None
        except Exception as e:  # whatever a reader says of a broken file is that file's own error
            return [], f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [read(bytes(c)) for c in batch["content"]]
            yield batch[["document_id", "source_file"]].assign(elements=[e for e, _ in own], error=[x for _, x in own])

    return files.where("route = 'pdf'").select("document_id", "source_file", "content").mapInPandas(run, f"document_id string, source_file string, elements {ELEMENTS}, error string")


#: Native text that a page must have to stand alone, and the share of its area that images may cover.
LEAST_CHARS, MOST_COVERED = 40, 0.35


def needs_recognition(text: str, coverage: float) -> bool:
    return len(text.strip()) < LEAST_CHARS or coverage >= MOST_COVERED


def image_documents(files: DataFrame, recognise) -> DataFrame:
    """recognise(bytes) -> list of (text, confidence): a recogniser that the caller brings."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [[dict(zip(_NAMES, (f"p1-e{i + 1}", 1, "figure_text", t, "ocr", float(c)), strict=True)) for i, (t, c) in enumerate(recognise(bytes(x)))] for x in batch["content"]]
            yield batch[["document_id", "source_file"]].assign(elements=own)

    return files.where("route = 'image'").select("document_id", "source_file", "content").mapInPandas(run, f"document_id string, source_file string, elements {ELEMENTS}")


def chunked(documents: DataFrame, exam: str) -> DataFrame:
    """documents: document_id, source_file, elements. A paper's own chunks (structure.CHUNK), and for documents that are
    none the semantic ones, with nulls for what only papers have."""
    own = structured_chunks(documents, exam)
    rest = documents.join(own.select("document_id").distinct(), "document_id", "left_anti")
    plain = semantic_chunks(rest).join(rest.select("document_id", "source_file"), "document_id")
    return own.unionByName(plain.drop("element_types", "sources"), allowMissingColumns=True)


def ingest(spark: SparkSession, path: str, exam: str, recognise: Callable[[bytes], list[tuple[str, float]]] | None = None) -> DataFrame:
    """Chunks of all files under a path that have a reader: text, DOCX, PDF and, with a recogniser, images. Files with the
    same bytes are one document, under the first name."""
    files = read_files(spark, path)
    first = files.groupBy("document_id").agg(F.min("path").alias("path"))
    files = files.join(first, ["document_id", "path"], "left_semi")
    documents = text_documents(files).unionByName(docx_documents(files)).unionByName(pdf_documents(files, recognise=recognise).drop("error"))
    if recognise:
        documents = documents.unionByName(image_documents(files, recognise))
    return chunked(documents.where("size(elements) > 0"), exam)


def accepted(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """What the store would be with the incoming chunks, and whether its quotas allow it: documents, chunks, accepted."""
    return quota_guard(projected_stats(store, incoming, "", by_document=True))
