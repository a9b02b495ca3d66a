"""File catalogue: accepted files become document metadata rows.

Spark's ``binaryFile`` source lists files in parallel; only path, size and
modification time are selected, so file contents are never read.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# File types a clinic document may have.
ALLOWED_EXTENSIONS = ("pdf", "jpg", "jpeg", "png")


def file_extension(name) -> F.Column:
    """Lower-case text after the last '.', or '' when there is none."""
    return F.lower(F.regexp_extract(name, r"\.([^./]*)$", 1))


def catalogue_files(spark: SparkSession, path_glob: str, category: str = "other") -> DataFrame:
    """One row per file under ``path_glob``: accepted when the extension is
    allowed, else rejected with a reason (the upload check, as a batch)."""
    files = spark.read.format("binaryFile").load(path_glob).select("path", "length", "modificationTime")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    ext = file_extension(name)
    ok = ext.isin(*ALLOWED_EXTENSIONS) & name.contains(".")
    return files.select(
        name.alias("file_name"), F.col("path").alias("file_path"), ext.alias("file_type"),
        F.col("length").alias("file_size_bytes"), F.col("modificationTime").alias("uploaded_at"),
        F.lit(category).alias("document_category"), ok.alias("accepted"),
        F.when(~ok, F.lit("file type not allowed")).alias("reason"))


def list_documents(catalogue: DataFrame) -> DataFrame:
    """Accepted documents newest first, without the storage path (PF10)."""
    return catalogue.where("accepted").drop("file_path", "accepted", "reason") \
        .orderBy(F.col("uploaded_at").desc(), F.col("file_name"))


def documents_catalogue(documents: DataFrame) -> DataFrame:
    """Document metadata of the given ``documents`` table: the name ends in a
    file type by language, the size is ``n_chars``, the category the source.
    Only metadata columns are read, never the text."""
    c = F.col
    ext = F.when(c("lang") == "en", "pdf").when(c("lang") == "de", "jpg").when(c("lang") == "fr", "png").otherwise("txt")
    named = documents.select(
        c("doc_id").alias("document_id"), c("doc_id").alias("patient_id"),
        F.concat(F.lit("document "), c("doc_id").cast("string"), F.lit("."), ext).alias("file_name"),
        c("n_chars").cast("bigint").alias("file_size_bytes"), c("source").alias("document_category"),
        F.date_add(F.lit("2000-01-01").cast("date"), (c("doc_id") % 577).cast("int")).alias("uploaded_at"))
    named = named.withColumn("file_type", file_extension(c("file_name")))
    return named.withColumn("accepted", c("file_type").isin(*ALLOWED_EXTENSIONS))
