"""File scans: listings, JSON logs, chunk tables, per-document metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.replies import parse_object
from gleaner.functions.text import base_name, strip

# The document formats that can be ingested.
DOCUMENT_EXTENSIONS = ("pdf", "docx", "pptx", "xlsx")


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def scan_files(spark: SparkSession, root: str, extensions=DOCUMENT_EXTENSIONS) -> DataFrame:
    """Files below ``root`` (or ``root`` itself) with a wanted extension, any case.

    Only the listing is read; pruning keeps file contents out of the scan.
    """
    wanted = "|".join(extensions)
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
             .select("path", "length", "modificationTime"))
    return (files.where(F.lower("path").rlike(rf"\.({wanted})$"))
            .withColumn("name", base_name(F.col("path"))))


def scan_jsonl_tolerant(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Well-formed objects of a JSON-lines log; anything else is skipped, a missing log is empty."""
    struct = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    if not _exists(spark, path):
        return spark.createDataFrame([], struct)
    line = strip(F.col("value"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in struct.fields)
    return (spark.read.text(path).where(line.startswith("{"))
            .select(parse_object(line, ddl).alias("o")).where("o IS NOT NULL")
            .select(*[F.col(f"o.`{f.name}`") for f in struct.fields]))


def scan_jsonl_strict(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """As above, but a bad line fails the job and an empty log is an error."""
    rows = spark.read.schema(schema).json(path, mode="FAILFAST")
    if rows.isEmpty():
        raise ValueError(f"no rows in {path}")
    return rows


def scan_chunks(spark: SparkSession, path: str) -> DataFrame:
    """All indexed chunks; the reader prunes columns and partitions."""
    return spark.read.parquet(path)


def scan_doc_metadata(spark: SparkSession, root: str, schema: T.StructType | str,
                      file_glob: str = "metadata.json") -> DataFrame:
    """One row per metadata file below ``root``; unreadable ones are left out."""
    struct = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    bad = T.StructField("_broken", T.StringType())
    rows = (spark.read.schema(T.StructType([*struct.fields, bad]))
            .option("recursiveFileLookup", "true").option("pathGlobFilter", file_glob)
            .option("columnNameOfCorruptRecord", "_broken").json(root, multiLine=True))
    return rows.where(F.col("_broken").isNull()).drop("_broken")
