"""Files and fetched pages as documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def content_type(path: Column) -> Column:
    """Pdf, Markdown or Html by the extension; anything else is Markdown."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.when(ext.isin("html", "htm"), "Html").when(ext == "pdf", "Pdf").otherwise("Markdown")


def stem_of(path: Column) -> Column:
    """File name without folder and extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as documents (doc_id, title, path, content_type, content); markup is not interpreted.
    A path that names nothing is an error."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p):
        raise FileNotFoundError(path)
    raw = spark.read.text(path, wholetext=True).select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("path"))
    return raw.select(F.col("path").alias("doc_id"), stem_of(F.col("path")).alias("title"), "path", content_type(F.col("path")).alias("content_type"), "content")


def fetch_gate(snapshot: DataFrame) -> DataFrame:
    """(url, success, error) of a snapshot (url, status, reason, media_type): what is not 2xx, or neither html nor text,
    fails."""
    media = F.lower(F.coalesce("media_type", F.lit("")))
    error = F.when(~F.col("status").between(200, 299), F.concat(F.lit("HTTP "), F.col("status").cast("string"), F.lit(" "), F.col("reason"))).when(
        ~media.rlike("html|text"), F.concat(F.lit("Non-HTML content type: "), F.col("media_type"))
    )
    return snapshot.select("url", error.isNull().alias("success"), error.alias("error"))


def index_url(pages: DataFrame, url: str, title: str | None = None) -> DataFrame:
    """The page of ``url`` as one document, if it was fetched and has text; a given title goes first."""
    page = pages.where((F.col("url") == url) & F.col("success") & (F.trim(F.coalesce("text_content", F.lit(""))) != "")).limit(1)
    name = F.lit(title) if title is not None else F.coalesce("title", F.col("url"))
    return page.select(F.col("url").alias("doc_id"), name.alias("title"), "url", F.lit("Html").alias("content_type"), F.col("text_content").alias("content"))
