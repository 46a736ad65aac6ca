"""The stored chunk relation and the in-memory relations around it."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = "1.0.0"

#: Columns of a stored chunk, in storage order.
CHUNKS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("content", T.StringType()),
        T.StructField("filePath", T.StringType()),
        T.StructField("startLine", T.IntegerType()),
        T.StructField("endLine", T.IntegerType()),
        T.StructField("language", T.StringType()),
        T.StructField("chunkType", T.StringType()),
        T.StructField("isTestFile", T.BooleanType()),
        T.StructField("isLibraryFile", T.BooleanType()),
        T.StructField("fileHash", T.StringType()),
        T.StructField("ingestionTimestamp", T.StringType()),
        T.StructField("_codebaseName", T.StringType()),
        T.StructField("_path", T.StringType()),
        T.StructField("_lastIngestion", T.StringType()),
        T.StructField("_renamedFrom", T.StringType()),
        T.StructField("_renamedAt", T.StringType()),
    ]
)

#: One row per file of the last scan, files without chunks included.
FILES = T.StructType(
    [
        T.StructField("filePath", T.StringType(), False),
        T.StructField("language", T.StringType()),
        T.StructField("fileHash", T.StringType()),
        T.StructField("sizeBytes", T.LongType()),
    ]
)

SCANNED = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("relativePath", T.StringType(), False),
        T.StructField("size", T.LongType(), False),
        T.StructField("content", T.BinaryType()),
    ]
)
