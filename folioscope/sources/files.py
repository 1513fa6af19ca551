"""Scans of labelled files and versioned saves."""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions.patterns import strip
from folioscope.operators.detect import (
    coalesce_label,
    coalesce_text,
    column_stats,
    detect_label_column,
    detect_text_column,
    records_to_corpus,
)
from folioscope.sources.records import CSV, JSON, read_records

_CSV = {"quote": '"', "escape": '"'}


def csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV files with a header, quoted line breaks and doubled quotes; a large file is read by many tasks.

    Fields go by place, missing ones are null. A quote stands only in quoted fields; a carriage return before a
    record's end is no part of it, and blank lines are no records.
    """
    rows = read_records(spark, path, CSV).filter(~F.col("first"))
    return rows.select(F.from_csv("value", schema, _CSV).alias("row")).select("row.*")


def scan_labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """(text, label) from CSV with quoted newlines and doubled quotes; labels are trimmed."""
    rows = csv_rows(spark, path, "text string, label string")
    return rows.select("text", strip(F.col("label")).alias("label"))


def scan_json_records(spark: SparkSession, path: str, source: str = "JSON", schema: str | None = None) -> DataFrame:
    """(text, label, source) from JSON arrays of objects with unknown keys; a large array is read by many tasks.

    A file may also hold objects one after the other. Without a schema the files are read once more; inferred fields come in name order.
    """
    found = read_records(spark, path, JSON)
    if schema is None:
        seen = found.select(F.schema_of_variant_agg(F.try_parse_json("value")).alias("kind")).first()["kind"]
        schema = re.sub(r"\b(OBJECT|VOID)\b", lambda m: "STRUCT" if m[0] == "OBJECT" else "STRING", seen)
        if not schema.startswith("STRUCT"):
            raise ValueError("found no JSON objects with fields of one kind")
    rows = found.select(F.from_json("value", schema).alias("row")).select("row.*")
    return records_to_corpus(rows, coalesce_text(rows), coalesce_label(rows), source)


def header_of(spark: SparkSession, path: str) -> list[str]:
    """The column names of the first file that has a header."""
    line = read_records(spark, path, CSV).filter("first").select(F.min("value").alias("value")).first()["value"]
    if line is None:
        raise ValueError("found no header")
    return next(csv.reader([line.lstrip("\ufeff")], strict=True))


def without_typed_columns(rows: DataFrame) -> DataFrame:
    """Text columns whose values all read as numbers, truth values or times are cast to that, told in one pass."""
    kinds = ("double", "boolean", "timestamp")
    names = rows.columns
    value = lambda c: F.col(f"`{c}`")
    fits = [F.count_if(value(c).isNotNull() & value(c).try_cast(k).isNull()).alias(f"{k}_{i}") for i, c in enumerate(names) for k in kinds]
    misses = rows.agg(*fits, *[F.count(value(c)).alias(f"n_{i}") for i, c in enumerate(names)]).first()
    typed = {}
    for i, c in enumerate(names):
        kind = next((k for k in kinds if misses[f"{k}_{i}"] == 0), None)
        if kind and misses[f"n_{i}"]:
            typed[c] = value(c).try_cast(kind)
    return rows.withColumns(typed)


def scan_csv_records(spark: SparkSession, path: str, source: str = "CSV", schema: str | None = None) -> DataFrame:
    """(text, label, source) from CSV of unknown columns, found by name or statistics; a large file is read by many tasks.

    Without a schema, columns are named by the header, and those of numbers, truth values or times are no candidates.
    """
    if schema:
        return detected_records(csv_rows(spark, path, schema), source)
    names = ", ".join("`" + n.replace("`", "``") + "` string" for n in header_of(spark, path))
    return detected_records(without_typed_columns(csv_rows(spark, path, names)), source)


def detected_records(rows: DataFrame, source: str) -> DataFrame:
    """(text, label, source) of a table whose text and label columns are detected."""
    stats = column_stats(rows).persist()  # a row per column, asked for twice
    text, label = detect_text_column(rows, stats), detect_label_column(rows, stats, any_size=True)
    stats.unpersist()
    if text is None or label is None:
        raise ValueError("could not detect text and label columns")
    missing = F.lit("nan")
    return records_to_corpus(
        rows,
        F.coalesce(F.col(text).cast("string"), missing),
        F.coalesce(F.col(label).cast("string"), missing),
        source,
    )


def _first_files(spark: SparkSession, folder: str, glob: str, limit: int) -> DataFrame:
    """Paths of the first ``limit`` files by name of each directory; contents are not read.

    Spark lists the files on the driver anyway, so the ranking handles nothing larger.
    """
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(folder)
        .select(F.col("_metadata.file_path").alias("path"))
        .withColumn("dir", F.regexp_replace("path", "[^/]*$", ""))
    )
    rank = F.row_number().over(W.partitionBy("dir").orderBy("path"))
    return listed.withColumn("rank", rank).filter(F.col("rank") <= limit).select("path")


def _of_first_files(rows: DataFrame, folder: str, glob: str, limit: int | None) -> DataFrame:
    if limit is None:
        return rows
    return rows.join(_first_files(rows.sparkSession, folder, glob, limit), "path", "left_semi")


def scan_text_files(spark: SparkSession, folder: str, label: str = "receipt", limit: int | None = None) -> DataFrame:
    """(text, label, source_file): one row per ``*.txt`` file with over ten characters.

    With ``limit`` only the first files by name of each directory.
    """
    rows = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.txt")
        .text(folder, wholetext=True)
        .select(
            strip(F.col("value")).alias("text"),
            F.col("_metadata.file_name").alias("source_file"),
            F.col("_metadata.file_path").alias("path"),
        )
    )
    return (
        _of_first_files(rows, folder, "*.txt", limit)
        .filter(F.length("text") > 10)
        .select("text", F.lit(label).alias("label"), "source_file")
    )


ANNOTATION_SCHEMA = (
    "text string, content string, ocr_text string, extracted_text string, "
    "annotations array<struct<text: string>>"
)


def annotation_text() -> Column:
    """First non-empty of the usual fields, else the annotations' texts joined."""
    named = [F.nullif(F.col(c), F.lit("")) for c in ("text", "content", "ocr_text", "extracted_text")]
    joined = F.concat_ws(" ", F.transform("annotations", lambda a: a["text"]))
    return F.coalesce(*named, joined)


def scan_annotation_json(
    spark: SparkSession, folder: str, label: str = "receipt", limit: int | None = None, lines: bool = False
) -> DataFrame:
    """(text, label, source_file): one row per ``*.json`` file with over ten characters.

    With ``lines`` a file holds one record per line, which lets Spark split large files; with ``limit`` only the
    first files by name of each directory are read.
    """
    rows = (
        spark.read.schema(ANNOTATION_SCHEMA)
        .option("multiLine", str(not lines).lower())
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.json")
        .json(folder)
        .select(
            annotation_text().alias("text"),
            F.col("_metadata.file_name").alias("source_file"),
            F.col("_metadata.file_path").alias("path"),
        )
    )
    return (
        _of_first_files(rows, folder, "*.json", limit)
        .filter(F.length("text") > 10)
        .select("text", F.lit(label).alias("label"), "source_file")
    )


def inventory_sources(spark: SparkSession, folder: str) -> DataFrame:
    """(extension, files, total, chosen): file counts and which kind would be read.

    CSV goes before JSON before text; only paths are read, not contents.
    """
    paths = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    )
    extension = F.regexp_extract("path", r"\.([^./]+)$", 1)
    counts = paths.groupBy(extension.alias("extension")).agg(F.count(F.lit(1)).alias("files"))
    order = F.array(F.lit("csv"), F.lit("json"), F.lit("txt"))
    everything = W.partitionBy()  # over one row per extension
    rank = F.nullif(F.array_position(order, F.col("extension")), F.lit(0))
    return counts.select(
        "extension",
        "files",
        F.sum("files").over(everything).alias("total"),
        F.coalesce(rank == F.min(rank).over(everything), F.lit(False)).alias("chosen"),
    )


def decode_bytes(content: Column) -> Column:
    """Text of a byte column: UTF-8 with or without mark, else Latin-1."""
    utf8 = F.try_validate_utf8(content.cast("string"))
    return F.regexp_replace(F.coalesce(utf8, F.decode(content, "ISO-8859-1")), "^\uFEFF", "")


def _folders(spark: SparkSession, path: str) -> list[str]:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop_path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(hadoop_path)]
    done = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))
    return [n for n in names if done(n)]


def saved_versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the completely written versions."""
    return sorted(
        int(n.removeprefix("version=")) for n in _folders(spark, path) if n.startswith("version=")
    )


def versioned_save(df: DataFrame, path: str) -> int:
    """Write the rows as a new version beside the old ones, which stay as backup.

    A version counts once its write has committed, so a lost job leaves the last one current.
    """
    version = max(saved_versions(df.sparkSession, path), default=0) + 1
    df.write.mode("overwrite").parquet(f"{path}/version={version}")
    return version


def load_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    versions = saved_versions(spark, path)
    return spark.read.parquet(f"{path}/version={versions[-1] if version is None else version}")
