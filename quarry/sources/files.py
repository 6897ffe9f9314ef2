"""Readers and writers of the corpus's files: JSON lines, tagged records, metadata, chunk files, texts, office documents."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: the fields of any record of a structure file; which are set depends on ``type``
RECORD = "type string, spec_id string, title string, version string, total_pages int, source_pdf string, level int, page int, section_number string, source string, sort_order int, page_number int, text string, headings_found array<string>, message string"
SECTION = "section_id string, spec_id string, section_number string, section_title string, page_start int, page_end int, depth int, parent_section string, content string, content_length int, brief string"
META = "rfc_number int, title string, abstract string, pages int, std_level string, date string, url string, category string"


def read_lines(spark: SparkSession, path: str, schema: str = RECORD) -> tuple[DataFrame, DataFrame]:
    """(records, bad lines) of JSON-line files; blank lines count as neither. Each row has its file's ``path``."""
    fields = StructType.fromDDL(schema).add(StructField("_bad", StringType()))
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path")).where("trim(value) != ''")
    parsed = rows.withColumn("r", F.from_json("value", fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("r._bad").isNotNull()
    return parsed.where(~bad).select("r.*", "path").drop("_bad"), parsed.where(bad).select("path", F.col("value").alias("line"))


def split_by_type(records: DataFrame) -> dict[str, DataFrame]:
    """The tables of a union of records that tell their ``type``; one read, a filter each."""
    columns = {"spec_meta": ["spec_id", "title", "version", "total_pages", "source_pdf"], "toc_entry": ["level", "title", "page", "section_number", "source", "sort_order"], "page_text": ["page_number", "text", "headings_found"], "extraction_warning": ["message", "spec_id"]}
    return {kind: records.where(F.col("type") == kind).select("path", *names) for kind, names in columns.items()}


def discover(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, name, key) of the files below a folder, but empty ones, whose names match a pattern of one group, in order of name."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"))
    return rows.where(F.col("name").rlike(pattern)).withColumn("key", F.regexp_extract("name", pattern, 1)).orderBy("name")


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """(path, and the fields of) one JSON record a file; a file that holds none gives nulls."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return rows.withColumn("m", F.from_json("value", META, {"mode": "PERMISSIVE"})).select("path", "m.*")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(source, text, nth) of chunk files in either shape: records with content and metadata.source, or text and spec; in an array or under ``chunks``."""
    shape = "struct<content:string, metadata:struct<source:string>, text:string, spec:string>"
    rows = spark.read.text(path, wholetext=True)
    whole = F.coalesce(F.from_json(F.get_json_object("value", "$.chunks"), f"array<{shape}>"), F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{shape}>")))
    each = rows.select(F.posexplode(whole).alias("nth", "c"))
    return each.select(F.coalesce("c.metadata.source", "c.spec", F.lit("unknown")).alias("source"), F.coalesce("c.content", "c.text", F.lit("")).alias("text"), "nth")


#: every sign that ends a line of text
LINE_END = r"\r\n|[\n\r\x0b\f\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def text_lines(text) -> F.Column:
    """Lines of a text by any line end; one at the end makes no empty line."""
    return F.split(F.regexp_replace(text, f"(?:{LINE_END})\\z", ""), LINE_END)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, n from 0, line) of whole texts; bytes that are no UTF-8 become the replacement sign."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.select("path", F.posexplode(text_lines(F.col("text"))).alias("n", "line"))


def write_lines(rows: DataFrame, path: str, by: str = "spec_id") -> None:
    """JSON lines, a folder for each value of ``by``."""
    rows.write.mode("overwrite").partitionBy(by).json(path)


W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def paragraphs(data: bytes) -> list[tuple[str, str]]:
    """(style, text) of the paragraphs of an office document, or of all those in an archive, by name."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        if "word/document.xml" not in names:
            return [p for n in sorted(names) if n.lower().endswith(".docx") for p in paragraphs(z.read(n))]
        root = ET.fromstring(z.read("word/document.xml"))
    out = []
    for p in root.iter(f"{W}p"):
        style = p.find(f"{W}pPr/{W}pStyle")
        text = "".join("\t" if t.tag == f"{W}tab" else t.text or "" for t in p.iter() if t.tag in (f"{W}t", f"{W}tab"))
        out.append((style.get(f"{W}val", "") if style is not None else "", text))
    return out


def read_office(spark: SparkSession, path: str) -> DataFrame:
    """(path, n, style, text, level, warning) of the paragraphs of .docx files and archives of them; ``level`` of headings by
    style. A damaged file gives one row with a warning."""
    import pandas as pd

    def run(frames):
        for pdf in frames:
            rows = []
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [(name, i, style, text, int(m[1]) if (m := re.match(r"(?i)heading\s*(\d)", style)) else None, None) for i, (style, text) in enumerate(paragraphs(data))]
                except (zipfile.BadZipFile, ET.ParseError, KeyError) as e:
                    rows.append((name, 0, "", "", None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "n", "style", "text", "level", "warning"]).astype({"level": "Int32"})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, n int, style string, text string, level int, warning string")
