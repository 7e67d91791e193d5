"""Readers: JSON rows strict or tolerant, CSV with a baseline, images, first that exists."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from quillmark.functions.scalars import magic_mime
from quillmark.operators.rows import last_by, overlay


def read_json(spark: SparkSession, path: str, schema: StructType, strict: bool = False, multi_line: bool = False) -> DataFrame:
    """Rows of JSON.  ``strict`` fails on a broken row; else it comes with its text in ``_corrupt`` and nulls."""
    reader = spark.read.option("multiLine", multi_line)
    if strict:
        return reader.schema(schema).option("mode", "FAILFAST").json(path)
    tolerant = StructType([*schema.fields]).add("_corrupt", StringType())
    return reader.schema(tolerant).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_json_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """As :func:`read_json`; a path that isn't there gives no rows."""
    try:
        return read_json(spark, path, schema)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_json_files(spark: SparkSession, path: str, schema: StructType, key: str | None = None, strict: bool = True) -> DataFrame:
    """Rows of JSON files with the name of each row's file in ``_file``; with a ``key`` the row of the last file by
    name counts for each, as if the files were read in that order."""
    rows = read_json(spark, path, schema, strict).withColumn("_file", F.input_file_name())
    return rows if key is None else last_by(rows, [key], ["_file"])


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV with doubled quotes and line breaks in cells; a missing cell is ''."""
    raw = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
    text = StructType([f.__class__(f.name, StringType()) for f in schema.fields])
    cells = raw.schema(text).csv(path).na.fill("")
    cast = {f.name: F.lower(f.name).isin("true", "1") if f.dataType.typeName() == "boolean" else F.trim(f.name).try_cast(f.dataType) for f in schema.fields if not isinstance(f.dataType, StringType)}
    return cells.withColumns(cast) if cast else cells


def with_baseline(current: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """``current`` with the baseline's cells where it has them; the last baseline row of a key counts."""
    cols = [c for c in baseline.columns if c != key and c in current.columns]
    numbered = baseline.withColumn("__n", F.monotonically_increasing_id())
    return overlay(current, last_by(numbered, [key], ["__n"]), key, cols)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files with the type their first bytes tell and their SHA-256."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", magic_mime(F.col("content")).alias("mime"), F.sha2("content", 256).alias("sha256"))


def first_filled_source(*tables: DataFrame) -> DataFrame:
    """The first table with any row; the last one where all are empty."""
    for t in tables[:-1]:
        if not t.isEmpty():
            return t
    return tables[-1]
