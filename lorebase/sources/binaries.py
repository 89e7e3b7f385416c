"""Text out of binary files. The format parsers are the standard library's, run on Arrow batches of ``binaryFile`` rows."""

from __future__ import annotations

import hashlib
import io
import zipfile
from email import message_from_bytes
from email.policy import default as modern_policy
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from lorebase import rules
from lorebase.functions import html as H
from lorebase.functions.text import normalise_export
from lorebase.functions.values import extractor

_ENCODINGS = ("utf-8-sig", "utf-8", "gb18030", "utf-16")
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_binaries(spark: SparkSession, glob: str) -> DataFrame:
    """path, length, content of the files under a glob."""
    return spark.read.format("binaryFile").load(glob).select("path", "length", "content")


@F.pandas_udf(StringType())
def decode_text(content: pd.Series) -> pd.Series:
    """First encoding that fits, else UTF-8 with replacement characters."""
    def one(data: bytes | None) -> str | None:
        if data is None:
            return None
        for encoding in _ENCODINGS:
            try:
                return data.decode(encoding)
            except UnicodeDecodeError:
                pass
        return data.decode("utf-8", errors="replace")

    return content.map(one)


@F.pandas_udf(StringType())
def docx_text(content: pd.Series) -> pd.Series:
    """Non-blank paragraphs of a Word file, one per line."""
    def one(data: bytes | None) -> str | None:
        if data is None:
            return None
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            body = ElementTree.fromstring(archive.read("word/document.xml"))
        runs = ("".join(t.text or "" for t in p.iter(_WORD + "t")).strip() for p in body.iter(_WORD + "p"))
        return "\n".join(run for run in runs if run)

    return content.map(one)


_MESSAGE = StructType([StructField(c, StringType()) for c in (
    "message_id", "date", "from", "to", "cc", "subject", "plain", "html")])


@F.pandas_udf(_MESSAGE)
def mail_parts(content: pd.Series) -> pd.DataFrame:
    """Headers and bodies of a mail: the plain and the HTML body, attachments left out."""
    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 8
        message = message_from_bytes(data, policy=modern_policy)
        bodies: dict[str, list[str]] = {"text/plain": [], "text/html": []}
        for part in message.walk():
            kind = part.get_content_type()
            if kind not in bodies or part.get_content_disposition() == "attachment":
                continue
            try:
                text = part.get_content()
            except (LookupError, UnicodeDecodeError):
                text = (part.get_payload(decode=True) or b"").decode("utf-8", errors="replace")
            if text.strip():
                bodies[kind].append(text.strip())
        head = [str(message.get(name, "") or "").strip() for name in ("message-id", "date", "from", "to", "cc", "subject")]
        return (*head, "\n\n".join(bodies["text/plain"]), "\n\n".join(bodies["text/html"]))

    return pd.DataFrame([one(data) for data in content], columns=[f.name for f in _MESSAGE.fields])


_ATTACHMENTS = ArrayType(StructType([StructField("file_name", StringType()), StructField("mime_type", StringType()), StructField("size", LongType()),
                                    StructField("sha256", StringType()), StructField("text", StringType())]))


@F.pandas_udf(_ATTACHMENTS)
def mail_attachments(content: pd.Series) -> pd.Series:
    """The attached files of a mail: name, type, size, hash, and the text of those that are text."""
    def one(data: bytes | None) -> list[dict]:
        out = []
        for part in message_from_bytes(data, policy=modern_policy).walk() if data is not None else ():
            name = part.get_filename()
            if part.is_multipart() or not (name or part.get_content_disposition() == "attachment"):
                continue
            raw = part.get_payload(decode=True) or b""
            text = None
            if part.get_content_maintype() == "text" or (name or "").lower().endswith(rules.INDEX_TEXT_SUFFIXES):
                try:
                    text = raw.decode(part.get_content_charset() or "utf-8")
                except (LookupError, UnicodeDecodeError):
                    text = raw.decode("utf-8", errors="replace")
            out.append({"file_name": name or "", "mime_type": part.get_content_type(), "size": len(raw), "sha256": hashlib.sha256(raw).hexdigest(), "text": text})
        return out

    return content.map(one)


@F.pandas_udf(ArrayType(StructType([StructField("kind", StringType()), StructField("text", StringType())])))
def _web_archive_parts(content: pd.Series) -> pd.Series:
    """Kind and text of the text parts of a web archive."""
    def one(data: bytes | None) -> list[dict]:
        parts = message_from_bytes(data).walk() if data is not None else []
        return [
            {"kind": part.get_content_type(), "text": (part.get_payload(decode=True) or b"").decode(
                part.get_content_charset() or "utf-8", errors="replace")}
            for part in parts if part.get_content_type() in ("text/html", "text/plain")
        ]

    return content.map(one)


def web_archive_texts(binaries: DataFrame) -> DataFrame:
    """path, text of web archives: HTML parts through the import extractor, parts joined by a blank line."""
    parts = binaries.select("path", F.posexplode(_web_archive_parts(F.col("content"))).alias("at", "part"))
    read = parts.select("path", "at", F.when(F.col("part.kind") == "text/html", H.text_for_import(F.col("part.text")))
                        .otherwise(F.col("part.text")).alias("text"))
    # the parts of one archive, which was one row a moment ago
    joined = read.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("parts"))
    return joined.select("path", F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n").alias("text"))


def export_files(binaries: DataFrame) -> DataFrame:
    """path, length, sha256, kind, text by file type.

    PDF needs a reader that neither Spark nor the standard library has: PDFs and unsupported files keep a null text,
    and ``kind`` says which they are.
    """
    kinds = binaries.withColumn("kind", F.coalesce(extractor(F.col("path")), F.lit("unsupported")))
    kind = F.col("kind")
    plain = decode_text(F.when(kind.isin("text", "html"), F.col("content")))
    word = docx_text(F.when(kind == "docx", F.col("content")))
    archives = web_archive_texts(kinds.filter(kind == "mhtml")).withColumnRenamed("text", "_archive")
    decoded = kinds.select("path", "length", F.sha2("content", 256).alias("sha256"), "kind", plain.alias("_plain"), word.alias("_word"))
    text = F.when(kind == "text", normalise_export(F.col("_plain"))).when(kind == "html", H.text_for_import(F.col("_plain")))
    return decoded.join(archives, "path", "left").select(
        "path", "length", "sha256", "kind", text.when(kind == "docx", F.col("_word")).when(kind == "mhtml", F.col("_archive")).alias("text"),
    )
