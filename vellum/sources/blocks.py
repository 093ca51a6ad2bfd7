"""Tables of text blocks, from texts and from office files."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from vellum.functions import text as tx
from vellum.operators.rules import GAZETTEERS

BLOCKS = "doc_id long, kind string, part string, block_index int, label string, location_id string, text string"


def text_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind: str = "text", part: str = "body") -> DataFrame:
    """One row for each line of a text that is not blank, with a stable location id."""
    lines = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode_outer(F.split(F.col(text_col), "\n")).alias("block_index", "text"))
    location = F.format_string(f"{kind}:{part}:block[%d]", "block_index")
    return lines.where(F.trim("text") != "").select("doc_id", F.lit(kind).alias("kind"), F.lit(part).alias("part"), "block_index", F.lit("").alias("label"), location.alias("location_id"), "text")


def conversation_blocks(turns: DataFrame) -> DataFrame:
    """Turns of conversations as blocks: a conversation is a document, a role a label."""
    return turns.select(
        F.col("conv_id").alias("doc_id"), F.lit("chat").alias("kind"), F.lit("turns").alias("part"), F.col("turn").cast("int").alias("block_index"),
        F.coalesce("role", F.lit("")).alias("label"), F.format_string("chat:turns:block[%d]", F.col("turn")).alias("location_id"), "text",
    ).where(F.trim("text") != "")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``name, size, content`` of a folder's files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(tx.safe_name(F.col("path")).alias("name"), F.col("length").alias("size"), "content")


#: Bytes that one archive may expand to; beyond them its parts are listed without their text.
EXPANDED_LIMIT = 60 << 20


#: Characters of text that parts of several files gather before they leave a task together.
_TOGETHER = 4 << 20


def _unzip(limit: int):
    def parts(name: str, content: bytes) -> list[tuple]:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                items = [item for item in archive.infolist() if not item.is_dir()]
                whole = sum(item.file_size for item in items) <= limit
                return [(name, item.filename, item.file_size, archive.read(item).decode("utf-8", "replace") if whole and item.filename.endswith(".xml") else None) for item in items]
        except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError, zlib.error):
            return []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, rows, held = ["name", "part", "size", "xml"], [], 0
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"], strict=True):
                found = parts(name, content)
                rows += found
                held += sum(len(xml or "") for _, _, _, xml in found)
                if held >= _TOGETHER:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns)
                rows, held = [], 0

    return run


def ooxml_parts(files: DataFrame, expanded_limit: int = EXPANDED_LIMIT) -> DataFrame:
    """``name, part, size, xml`` of the parts of zipped office files.

    Other files, damaged and encrypted archives have none.  Only XML parts have their
    text, and none has in an archive whose parts exceed ``expanded_limit`` together.
    """
    return files.select("name", "content").mapInPandas(_unzip(expanded_limit), "name string, part string, size long, xml string")


# The parts that hold text, and their labels.
TEXT_PARTS = r"^(?:word/(?:document|header\d+|footer\d+|footnotes|endnotes)|ppt/(?:slides/slide\d+|notesSlides/notesSlide\d+|slideMasters/slideMaster\d+|slideLayouts/slideLayout\d+|diagrams/data\d+))\.xml$"
PART_LABELS = {
    "word/header": "Cabecera", "word/footer": "Pie de página", "word/footnotes": "Notas al pie", "word/endnotes": "Notas finales", "word/": "Documento",
    "ppt/slides/": "Diapositiva", "ppt/notesSlides/": "Notas del presentador", "ppt/slideMasters/": "Patrón de diapositivas",
    "ppt/slideLayouts/": "Diseño de diapositiva", "ppt/diagrams/": "SmartArt", "": "Presentación",
}


def part_label(part: Column) -> Column:
    out = F.lit("")
    for start, label in reversed(PART_LABELS.items()):
        out = F.when(part.startswith(start), label).otherwise(out)
    return out


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _walk(node: ElementTree.Element, label: str, inside: bool) -> Iterator[tuple[str, str]]:
    """``(label, text)`` of the outermost paragraphs below ``node``, in document order."""
    name = _local(node.tag)
    if name == "p" and not inside:
        yield label, "".join(t.text or "" for t in node.iter() if _local(t.tag) == "t")
        return
    if name == "tr":
        cells = [c for c in node if _local(c.tag) == "tc"]
        head = "".join(t.text or "" for t in cells[0].iter() if _local(t.tag) == "t").strip()[:80] if cells else ""
        base = label.split(" · ")[0]
        for child in node:
            own = f"{base} · {head}" if child in cells[1:] and head else base
            yield from _walk(child, own, inside)
        return
    for child in node:
        yield from _walk(child, label, inside)


def _parsed(xml: str) -> ElementTree.Element | None:
    try:
        return ElementTree.fromstring(re.sub(r"<!DOCTYPE[^>]*>", "", xml))
    except ElementTree.ParseError:
        return None


def _paragraphs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for name, part, label, xml in zip(batch["name"], batch["part"], batch["label"], batch["xml"], strict=True):
            root = _parsed(xml) if xml is not None else None
            for i, (own, text) in enumerate(_walk(root, label, False) if root is not None else ()):
                if text.strip():
                    rows.append((name, "docx" if part.startswith("word/") else "pptx", part, i, own, text))
        yield pd.DataFrame(rows, columns=["name", "kind", "part", "block_index", "label", "text"])


def ooxml_blocks(parts: DataFrame) -> DataFrame:
    """Paragraphs of the text parts; the cells of a row after its first are labelled by the first.

    Parts without text or that are no XML give no blocks; :func:`coverage_issues` names them.
    """
    texts = parts.where(F.col("part").rlike(TEXT_PARTS)).select("name", "part", part_label(F.col("part")).alias("label"), "xml")
    found = texts.mapInPandas(_paragraphs, "name string, kind string, part string, block_index int, label string, text string")
    location = F.when(F.col("kind") == "docx", F.format_string("%s:paragraph[%d]", "part", "block_index")).otherwise(F.format_string("%s:%s:block[%d]", "kind", "part", "block_index"))
    return found.select(F.xxhash64("name").alias("doc_id"), "kind", "part", "block_index", "label", location.alias("location_id"), "text", "name")


def intake_audit(files: DataFrame, parts: DataFrame, limit: int = 15 << 20, expanded_limit: int = 60 << 20) -> DataFrame:
    """A verdict a file: its signature against its extension, and its sizes."""
    inside = parts.groupBy("name").agg(F.sum("size").alias("expanded"), F.bool_or(F.col("part") == "word/document.xml").alias("docx"), F.bool_or(F.col("part") == "ppt/presentation.xml").alias("pptx"))
    rows = files.select("name", "size", (F.substring("content", 1, 5) == F.lit(b"%PDF-")).alias("pdf")).join(inside, "name", "left")
    form = F.when(F.col("pdf"), "pdf").when(F.col("docx"), "docx").when(F.col("pptx"), "pptx")
    ext = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    verdict = (
        F.when(F.col("size") == 0, "empty").when(F.col("size") > limit, "too_large").when(F.col("expanded") > expanded_limit, "expands_too_large")
        .when(F.col("format").isNull(), "unknown_format").when(F.col("format") != F.col("extension"), "wrong_extension").otherwise("ok")
    )
    return rows.withColumns({"format": form, "extension": ext}).withColumn("verdict", verdict).select("name", "size", "format", "extension", "verdict")


# Elements of a DOCX text part that refer to content outside its text, and the link of a picture.
LINKING = {f"{{http://schemas.openxmlformats.org/wordprocessingml/2006/main}}{n}" for n in ("object", "altChunk")}
BLIP = "{http://schemas.openxmlformats.org/drawingml/2006/main}blip"
BLIP_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}link"


def _hidden(xml: str | None) -> str | None:
    root = _parsed(xml) if xml is not None else None
    if root is None:
        return "unreadable_part"
    linked = any(node.tag in LINKING or node.tag == BLIP and BLIP_LINK in node.attrib for node in root.iter() if node is not root)
    return "linked_object" if linked else None


@F.pandas_udf(StringType())
def hidden_content(xml: pd.Series) -> pd.Series:
    """What keeps a text part from being wholly inspected: linked pictures, objects or chunks of other formats, or that it is no XML."""
    return xml.map(_hidden).astype(object)


def coverage_issues(parts: DataFrame, id_col: str = "doc_id", unreadable: bool = True) -> DataFrame:
    """Content of each document that no rule can inspect, by kind, with a stable id.

    Linked objects and text parts that cannot be read are found where ``parts`` has the
    column ``xml`` of :func:`ooxml_parts`; the latter are no issue if not ``unreadable``.
    """
    name = F.col("part")
    linked = F.lit(None).cast("string")
    if "xml" in parts.columns:
        parts = parts.withColumn("hidden", F.when(name.rlike(TEXT_PARTS), hidden_content(F.when(name.rlike(TEXT_PARTS), F.col("xml")).otherwise("<x/>"))))
        linked = F.when((F.col("hidden") == "unreadable_part") & F.lit(unreadable) | (F.col("hidden") == "linked_object") & name.startswith("word/"), F.col("hidden"))
    kinds = F.filter(
        F.array(
            F.when(name.startswith("word/media/") | name.startswith("ppt/media/"), "image"),
            F.when(name.startswith("word/embeddings/") | name.startswith("ppt/embeddings/") | name.startswith("ppt/activeX/") | name.startswith("ppt/") & name.endswith("vbaProject.bin"), "embedded_object"),
            F.when(name.startswith("ppt/charts/"), "chart"),
            F.when(F.lower(name).contains("_xmlsignatures"), "signature"),
            linked,
        ),
        lambda k: k.isNotNull(),
    )
    rows = parts.select(F.col(id_col), name, F.explode(kinds).alias("kind"))
    grouped = rows.groupBy(id_col, "kind").agg(F.array_sort(F.collect_set("part")).alias("names"))
    return grouped.select(id_col, tx.coverage_id(F.col("kind"), F.col("names")).alias("id"), "kind", F.lit(True).alias("blocking"), F.lit(True).alias("removable"), F.size("names").alias("parts"))


def gazetteer_dim(spark: SparkSession) -> DataFrame:
    """``entity_type, name, confidence`` of the local gazetteers: some ninety rows."""
    return spark.createDataFrame([(kind, n, conf) for kind, (names, conf) in GAZETTEERS.items() for n in names], "entity_type string, name string, confidence double")


def write_redacted(redacted: DataFrame, path: str) -> None:
    """Redacted blocks as Parquet by kind, each with the name its file would have.

    That is the stem of ``name`` where the blocks have one, else the document's id.
    """
    own = tx.output_filename(F.col("name"), "anonimizado") if "name" in redacted.columns else F.format_string("%d_anonimizado.%s", "doc_id", "kind")
    redacted.withColumn("file", own).write.mode("overwrite").partitionBy("kind").parquet(path)


def page_texts(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, page_index, text`` from Parquet or, for a path that ends in .json, JSON lines."""
    schema = "doc_id long, page_index int, text string"
    return spark.read.schema(schema).json(path) if path.endswith(".json") else spark.read.parquet(path).select("doc_id", F.col("page_index").cast("int").alias("page_index"), "text")
