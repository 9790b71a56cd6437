"""Sources: file corpora, manifests, guides, stored reports, external results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftwright import schemas
from shiftwright.functions.text import normalize_path


def read_corpus(
    spark: SparkSession, root: str, suffixes: list | None = None, project: str | None = None
) -> DataFrame:
    """All files below ``root`` as (project, path, content, readable).

    Without ``project``, the first directory below the root names it. With one
    suffix the listing itself is filtered. Text that is not UTF-8 gets a null
    content and ``readable`` false, so that it still counts as scanned.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if suffixes is not None and len(suffixes) == 1:
        reader = reader.option("pathGlobFilter", f"*{suffixes[0]}")
    loaded = reader.load(root)
    base = root.rstrip("/") + "/"
    relative = normalize_path(F.substring_index(F.col("path"), base, -1))
    if project is None:
        names = (F.substring_index(relative, "/", 1), F.regexp_replace(relative, "^[^/]*/", ""))
    else:
        names = (F.lit(project), relative)
    placed = loaded.select(names[0].alias("project"), names[1].alias("path"), "content")
    if suffixes is not None and len(suffixes) != 1:
        kept = F.lit(False)
        for suffix in suffixes:
            kept = kept | F.col("path").endswith(suffix)
        placed = placed.filter(kept)
    return decoded(placed)


def decoded(raw: DataFrame) -> DataFrame:
    """Decode a binary ``content`` column."""
    text = F.col("content").cast("string")
    valid = F.is_valid_utf8(text)
    return raw.select(
        "project", "path", F.when(valid, text).alias("content"), F.coalesce(valid, F.lit(False)).alias("readable")
    )


def read_files_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table of files. Bucketing it by (project, path) spares its later shuffles."""
    return spark.read.parquet(path).withColumn("path", normalize_path(F.col("path")))


def parse_manifest(content: Column) -> Column:
    """A package manifest; malformed text gives null."""
    parsed = F.from_json(content, schemas.MANIFEST)
    empty = (
        parsed["name"].isNull() & parsed["dependencies"].isNull()
        & parsed["devDependencies"].isNull() & parsed["scripts"].isNull()
    )
    # An object with none of the four fields is valid; text that is no object is not.
    is_object = F.coalesce(F.json_object_keys(content).isNotNull(), F.lit(False))
    return F.when(~empty | is_object, parsed)


def merged_dependencies(manifest: Column) -> Column:
    """Both dependency maps in one; development entries override.

    Entries are filtered before the maps meet, so that no key occurs twice.
    """
    none = F.create_map().cast("map<string,string>")
    dev = F.coalesce(manifest["devDependencies"], none)
    plain = F.map_filter(
        F.coalesce(manifest["dependencies"], none), lambda k, _: ~F.map_contains_key(dev, k)
    )
    return F.map_concat(plain, dev)


def read_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Guides named ``framework__migration.md`` as (framework, migration, text)."""
    loaded = spark.read.text(folder, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.+?)__(.+)\.md$", 1).alias("framework"),
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.+?)__(.+)\.md$", 2).alias("migration"),
        F.col("value").alias("text"),
    )
    return loaded.filter(F.col("framework") != "")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Stored reports: JSON lines of report_sink, or single pretty-printed documents."""
    return spark.read.schema(schemas.REPORTS).json(path, multiLine=False)


def read_report_documents(spark: SparkSession, path: str) -> DataFrame:
    """Reports stored as one indented JSON document per file."""
    return spark.read.schema(schemas.REPORTS).json(
        path, multiLine=True, recursiveFileLookup=True, pathGlobFilter="*.json"
    ).withColumn("project", normalize_path(F.col("project"))).withColumn(
        "files",
        F.transform("files", lambda f: f.withField("file", normalize_path(f["file"]))),
    )


def read_checks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CHECKS).json(path)


def read_tests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TESTS).json(path)
