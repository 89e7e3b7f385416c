"""Readers for the files a memory is made of: JSON, JSON lines, Markdown entries, HTML trees, attachments."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from lorebase import rules, schemas
from lorebase.functions import html as H
from lorebase.functions.text import casefold, normalise_entry, sha256, stem, suffix
from lorebase.functions.values import epoch_iso
from lorebase.operators.grouping import numbered_by_range, numbered_within


def or_empty(spark: SparkSession, schema: str, load) -> DataFrame:
    """A missing path is an empty table, as every reader of optional state expects."""
    try:
        return load()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document per file."""
    return or_empty(spark, schema, lambda: spark.read.schema(schema).option("multiLine", True).json(path))


def read_json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """One JSON object per line; lines that are no JSON are skipped, or fail the job when ``strict``."""
    if strict:
        return or_empty(spark, schema, lambda: spark.read.schema(schema).option("mode", "FAILFAST").json(path))
    return or_empty(spark, schema, lambda: parse_json_lines(spark.read.text(path), schema))


def parse_json_lines(lines: DataFrame, schema: str) -> DataFrame:
    """``value`` of each line -> the fields of ``schema``; other columns stay in front.

    Only lines that are no JSON object are left out. Each field is cast by itself: a number written as text is a number,
    a value that doesn't fit is null, and the rest of the record stays.
    """
    record = F.try_parse_json("value")
    parsed = lines.select(*[c for c in lines.columns if c != "value"], record.alias("_json")).where(F.startswith(F.schema_of_variant("_json"), F.lit("OBJECT")))
    return parsed.select(*[c for c in parsed.columns if c != "_json"], *[
        _json_field(F.col("_json"), f"$['{f.name}']", f.dataType).alias(f.name) for f in StructType.fromDDL(schema).fields])


def _json_field(record: Column, path: str, kind: DataType) -> Column:
    here = F.try_variant_get(record, path, "variant")
    if isinstance(kind, StructType):
        fields = F.struct(*[_json_field(record, f"{path}['{f.name}']", f.dataType).alias(f.name) for f in kind.fields])
        return F.when(F.is_variant_null(here) | here.isNull(), F.lit(None)).otherwise(fields)
    if isinstance(kind, ArrayType):
        return F.transform(F.try_variant_get(record, path, "array<variant>"), lambda x: _json_field(x, "$", kind.elementType))
    return F.try_variant_get(record, path, kind.simpleString())


def _relative(root: str) -> Column:
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    clean = F.regexp_replace(path, r"^file:/+", "/")
    return F.substring(clean, len(root.rstrip("/")) + 2, 1 << 20) if "://" not in root else F.element_at(F.split(path, root), -1)


def read_day_records(spark: SparkSession, root: str, folder: str, name: str, schema: str, day: str | None = None,
                     strict: bool = False) -> DataFrame:
    """Records under ``root/<day>/<folder>/<person>/<name>``; adds day, person and record_path from the path.

    With ``day`` only that folder is listed, so a digest reads one day and not the archive.
    """
    pattern = f"{root.rstrip('/')}/{day or '20??-??-??'}/{folder}/*/{name}"
    extra = ", day STRING, person STRING, record_path STRING"

    def load() -> DataFrame:
        parts = F.split(_relative(root), "/")
        place = parts[0].alias("day"), parts[2].alias("person"), F.array_join(parts, "/").alias("record_path")
        if strict:
            return spark.read.schema(schema).option("mode", "FAILFAST").json(pattern).select("*", *place)
        records = parse_json_lines(spark.read.text(pattern).select("value", *place), schema)
        return records.select(*StructType.fromDDL(schema).names, "day", "person", "record_path")

    return or_empty(spark, schema + extra, load)


# --- Markdown entries -----------------------------------------------------------------------------------------
_FRONT = r"(?s)\A---\n(.*?)\n---\n"


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Front-matter Markdown files as memory index records."""
    files = spark.read.text(path, wholetext=True).select(F.url_decode(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("text"))
    return parse_entries(files)


def parse_entries(files: DataFrame) -> DataFrame:
    """``files``: path, text. The header is no YAML: lines ``key: value``, lists in brackets split at commas, outer
    quotes dropped, later keys win."""
    header = F.split(F.regexp_extract("text", _FRONT, 1), "\n")
    lines = F.filter(F.transform(header, lambda l: F.trim(l)), lambda l: F.contains(l, F.lit(":")) & ~F.startswith(l, F.lit("#")))
    pairs = F.transform(lines, lambda l: F.struct(
        F.trim(F.substring_index(l, ":", 1)).alias("key"), F.trim(F.substring(l, F.instr(l, ":") + 1, F.length(l))).alias("value")
    ))
    body = F.when(F.col("text").rlike(_FRONT), F.regexp_replace("text", _FRONT, "")).otherwise(F.col("text"))
    parsed = files.select("path", body.alias("body"), pairs.alias("pairs"))

    def unquote(value: Column) -> Column:
        return F.btrim(value, F.lit("\"'"))

    def raw(key: str) -> Column:
        return F.get(F.reverse(F.filter("pairs", lambda p: p["key"] == key)), F.lit(0))["value"]

    def scalar(key: str, default: Column) -> Column:
        # bare true and false are booleans, and a boolean in a text field reads True or False
        bare = F.when(F.lower(raw(key)).isin("true", "false"), F.initcap(F.lower(raw(key))))
        return F.coalesce(bare, unquote(raw(key)), default)

    def many(key: str) -> Column:
        inner = F.trim(F.regexp_extract(raw(key), r"^\[(.*)\]$", 1))
        items = F.transform(F.split(inner, ","), lambda item: unquote(F.trim(item)))
        return F.when(F.coalesce(inner, F.lit("")) == "", F.array().cast("array<string>")).otherwise(items)

    name = stem(F.col("path"))
    empty = F.lit("")
    return parsed.select(
        "path", scalar("id", name).alias("id"), scalar("title", name).alias("title"), scalar("type", empty).alias("type"),
        scalar("status", empty).alias("status"), scalar("date", empty).alias("date"), many("projects").alias("projects"),
        many("people").alias("people"), many("tags").alias("tags"), many("source_refs").alias("source_refs"),
        scalar("confidence", empty).alias("confidence"), scalar("summary", empty).alias("summary"),
        many("supersedes").alias("supersedes"), scalar("superseded_by", empty).alias("superseded_by"),
        normalise_entry(F.col("body")).alias("body_text"),
    )


# --- HTML trees -------------------------------------------------------------------------------------------------
def read_html_tree(spark: SparkSession, root: str) -> DataFrame:
    """All HTML files under ``root``: rel (relative path) and text."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").text(root, wholetext=True)
    return files.select(_relative(root).alias("rel"), F.col("value").alias("text"))


def tree_manifest(files: DataFrame) -> DataFrame:
    """Pages of an HTML tree with section, order, title, hash, times and preview.

    A section is a top-level page with a folder of the same name. Its pages are those its anchors lead to, in
    anchor order; a section whose anchors lead nowhere lists its folder by name.
    """
    depth = F.size(F.split("rel", "/"))
    index = files.filter(depth == 1).select(stem(F.col("rel")).alias("section"), "text")
    pages = files.filter(depth == 2).withColumn("section", F.substring_index("rel", "/", 1))
    pages = pages.join(index.select("section"), "section", "left_semi")

    href = F.regexp_replace(F.col("href"), r"^(\./)+", "")
    anchors = index.select("section", F.posexplode(F.array_distinct(H.links(F.col("text")))).alias("at", "href"))
    wanted = anchors.filter(F.endswith(F.lower("href"), F.lit(".html"))).select("section", F.col("at").cast("bigint").alias("at"), href.alias("rel"))
    linked = pages.select("section", "rel").join(wanted, ["section", "rel"])
    unlinked = pages.join(linked.select("section").distinct(), "section", "left_anti").select(
        "section", "rel", casefold(F.col("rel")).alias("name"))
    ordered = numbered_within(linked, ["section"], ["at"], F.floor(F.col("at") / 1024), "order")
    by_name = numbered_by_range(unlinked, ["section"], ["name", "rel"], "order")
    places = ordered.select("rel", "order").unionByName(by_name.select("rel", "order"))

    meta = H.meta(F.col("text"))
    title = H.title(F.col("text"))

    def named(key: str) -> Column:
        return F.coalesce(F.try_element_at(meta, F.lit(key)), F.lit(""))

    return pages.join(places, "rel").select(
        "section", "order", F.when(title == "", stem(F.col("rel"))).otherwise(title).alias("title"), F.col("rel").alias("html"),
        sha256(F.col("text")).alias("sha256"), named("X-Original-Page-Id").alias("onenote_page_id"),
        epoch_iso(named("X-Created-Time")).alias("created"), epoch_iso(named("X-Updated-Time")).alias("updated"),
        H.body_preview(F.col("text")).alias("text_preview"), "text",
    )


def flatten_manifest(manifest: DataFrame) -> DataFrame:
    """Nested manifest documents -> one row per page with its section position."""
    sections = manifest.select(F.posexplode("sections").alias("section_index", "s"))
    pages = sections.select("section_index", F.col("s.section").alias("section"), F.explode("s.pages").alias("p"))
    return pages.select("section_index", "section", "p.*")


def flatten_distillation(distillation: DataFrame) -> DataFrame:
    """Nested distillation documents -> one row per page; a page without a section takes the parent's."""
    sections = distillation.select(F.explode("sections").alias("s"))
    pages = sections.select(F.col("s.section").alias("parent"), F.explode("s.pages").alias("p"))
    return pages.select(F.coalesce("p.section", "parent").alias("section"), *[f"p.{c}" for c in (
        "title", "html", "source_sha256", "created", "updated", "attachments", "distilled")])


def read_distillation(spark: SparkSession, path: str) -> DataFrame:
    return flatten_distillation(read_json(spark, path, schemas.DISTILLATION))


# --- attachments --------------------------------------------------------------------------------------------------
def is_text_extract(path: Column) -> Column:
    """Extracts that are read for the index: text suffixes and image descriptions."""
    return suffix(path).isin(*rules.INDEX_TEXT_SUFFIXES) | F.endswith(path, F.lit(".qwen_vision.json"))


def read_extracts(spark: SparkSession, glob: str) -> DataFrame:
    """Text extracts under a glob: extract_path, extract. Joined to records by path; missing files just find no row."""
    def load() -> DataFrame:
        files = spark.read.text(glob, wholetext=True)
        path = F.regexp_replace(F.url_decode(F.col("_metadata.file_path")), r"^file:/+", "/")
        return files.select(path.alias("extract_path"), F.col("value").alias("extract")).filter(is_text_extract(F.col("extract_path")))

    return or_empty(spark, "extract_path STRING, extract STRING", load)
