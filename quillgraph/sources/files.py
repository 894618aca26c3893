"""Document scans: a directory of files of twelve kinds becomes chunks."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.text import strip, word_count
from quillgraph.operators.chunking import fixed_chunks, sliding_chunks
from quillgraph.schemas import Settings

KINDS = ("md", "txt", "csv", "docx", "xlsx", "pptx", "png", "jpg", "jpeg", "webp", "bmp", "gif")
IMAGES = ("png", "jpg", "jpeg", "webp", "bmp", "gif")
#: Fixed value: the label of a row.
ROW = "行"
CHUNK_COLUMNS = ("id", "source", "index", "text", "word_count", "image_path", "path")
_CHUNK = "id string, source string, index int, text string, word_count int, image_path string, path string"


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """Path, length, content, source (file name), ext of all files of known kinds below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(KINDS) + "}").load(folder)
    return files.select("path", "modificationTime", "length", "content", F.regexp_extract("path", r"([^/]+)$", 1).alias("source"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"))


def _text_chunks(texts: DataFrame, s: Settings) -> DataFrame:
    """Chunks of (path, source, text); keyed by path, so equal file names do not mix."""
    cut = sliding_chunks(texts, s.chunk_size, s.overlap, source="path") if s.strategy == "sliding_window" else fixed_chunks(texts, s.separator, s.chunk_size, source="path")
    name = F.regexp_extract("source", r"([^/]+)$", 1)
    return cut.select(F.concat(name, F.lit("_chunk_"), "index").alias("id"), name.alias("source"), "index", "text", "word_count", F.lit(None).cast("string").alias("image_path"), F.col("source").alias("path"))


def csv_rows(content: bytes, source: str) -> list[tuple[str, int, str]]:
    """(id, index, text) a data row; a row too short or an error ends the file."""
    out: list[tuple[str, int, str]] = []
    try:
        for i, row in enumerate(csv.DictReader(io.StringIO(content.decode("utf-8"), newline=""))):
            parts = [f"{ROW} {i + 1}:"] + [f"{h}={v}" for h, v in row.items() if v.strip()]
            out.append((f"{source}_row_{i}", i, ", ".join(parts)))
    except Exception:
        return out  # rows so far stay
    return out


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_RELS = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def docx_text(content: bytes) -> str:
    """Paragraphs of the body, trimmed, without blank ones, with blank lines between."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")

    def text(p) -> str:
        parts = []
        for e in p.iter():
            parts.append(e.text or "" if e.tag == f"{_W}t" else "\t" if e.tag == f"{_W}tab" else "\n" if e.tag == f"{_W}br" else "")
        return "".join(parts).strip()

    return "\n\n".join(t for p in (body.findall(f"{_W}p") if body is not None else []) if (t := text(p)))


def _targets(z: zipfile.ZipFile, rels: str, base: str) -> dict[str, str]:
    root = ElementTree.fromstring(z.read(rels))
    return {r.get("Id"): (t[1:] if (t := r.get("Target")).startswith("/") else f"{base}/{t}") for r in root.findall(f"{_RELS}Relationship")}


def _number(text: str) -> str:
    """A cell's number as Python prints it."""
    x = float(text)
    return str(int(x)) if x.is_integer() and "e" not in text.lower() and "." not in text else str(x)


def _column_number(ref: str) -> int:
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def xlsx_rows(content: bytes, source: str) -> list[tuple[str, int, str]]:
    """(id, index, text) a row after the first of each sheet."""
    out: list[tuple[str, int, str]] = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
        targets = _targets(z, "xl/_rels/workbook.xml.rels", "xl")
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            rows: list[list[str | None]] = []
            for r in ElementTree.fromstring(z.read(targets[sheet.get(f"{_R}id")])).iter(f"{_S}row"):
                at = int(r.get("r") or len(rows) + 1)
                rows += [[] for _ in range(at - 1 - len(rows))]
                cells: list[str | None] = []
                for c in r.findall(f"{_S}c"):
                    k = _column_number(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (k + 1 - len(cells))
                    v, kind = c.find(f"{_S}v"), c.get("t")
                    if kind == "inlineStr":
                        cells[k] = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                    elif v is not None and v.text is not None:
                        cells[k] = shared[int(v.text)] if kind == "s" else str(v.text == "1") if kind == "b" else v.text if kind in ("str", "e", "d") else _number(v.text)
                rows.append(cells)
            header = [h or "" for h in rows[0]] if rows else []
            for i, cells in enumerate(rows[1:], start=2):
                parts = [f"Sheet={sheet.get('name')}, {ROW} {i}:"] + [f"{h}={v}" for h, v in zip(header, cells, strict=False) if v is not None]
                out.append((f"{source}_{sheet.get('name')}_row_{i}", len(out), ", ".join(parts)))
    return out


def pptx_slides(content: bytes, source: str) -> list[tuple[str, int, str]]:
    """(id, index, text) a slide with text; one empty chunk where no slide has any."""
    out: list[tuple[str, int, str]] = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        targets = _targets(z, "ppt/_rels/presentation.xml.rels", "ppt")
        slides = ElementTree.fromstring(z.read("ppt/presentation.xml")).iter(f"{_P}sldId")
        for i, s in enumerate(slides, start=1):
            found = []
            for p in ElementTree.fromstring(z.read(targets[s.get(f"{_R}id")])).iter(f"{_A}p"):
                t = "".join(e.text or "" for e in p.iter(f"{_A}t")).strip()
                if t:
                    found.append(t)
            if found:
                out.append((f"{source}_slide_{i}", i - 1, "\n".join(found)))
    return out or [(f"{source}_empty", 0, "")]


_ROWS = {"csv": csv_rows, "xlsx": xlsx_rows, "pptx": pptx_slides}


def chunk_files(files: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Chunks of discovered files, each kind by its own reader.

    Plain texts and images stay in the JVM; the office formats and CSV go through Arrow.
    """
    plain = files.where(~F.col("ext").isin("csv", "docx", "xlsx", "pptx", *IMAGES)).select("path", F.decode("content", "UTF-8").alias("text"))

    def docx(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf.path, "text": [docx_text(c) for c in pdf.content]})

    documents = files.where("ext = 'docx'").select("path", "content").mapInPandas(docx, "path string, text string")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(i, s, k, t, len(t.split()), None, p) for p, s, e, c in zip(pdf.path, pdf.source, pdf.ext, pdf.content, strict=True) for i, k, t in _ROWS[e](c, s)]
            yield pd.DataFrame(found, columns=list(CHUNK_COLUMNS))

    tables = files.where(F.col("ext").isin(*_ROWS)).select("path", "source", "ext", "content").mapInPandas(rows, _CHUNK)
    images = files.where(F.col("ext").isin(*IMAGES)).select(F.concat("source", F.lit("_image_0")).alias("id"), "source", F.lit(0).alias("index"), F.concat(F.lit("[Image file: "), "source", F.lit("]")).alias("text"), F.lit(4).alias("word_count"), F.regexp_replace("path", "^file:", "").alias("image_path"), "path")
    return _text_chunks(plain.unionByName(documents), settings).unionByName(tables).unionByName(images)


def csv_chunks(spark: SparkSession, path: str) -> DataFrame:
    """S4 by Spark's own reader, for large well-formed files: text of each row, without numbers."""
    df = spark.read.csv(path, header=True)
    filled = F.filter(F.array(*(F.when(F.trim(c) != "", F.concat(F.lit(f"{c}="), c)) for c in df.columns)), lambda x: x.isNotNull())
    return df.select(F.array_join(filled, ", ").alias("text")).withColumn("word_count", word_count(strip("text")))
