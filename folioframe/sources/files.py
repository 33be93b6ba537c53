"""File inventories: reading, scanning and listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.functions import paths


def read_inventory(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """rel, size and modification time of every file below a folder; contents are not read."""
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    plain = F.regexp_replace("path", "^file:/+", "/")
    return files.select(
        F.when(plain.startswith(base), F.substring(plain, len(base) + 1, 2**30)).otherwise(F.col("path")).alias("rel"),
        F.col("length").alias("size"), F.col("modificationTime").alias("mtime"),
    )


def read_contents(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """rel and content of every file, e.g. for `paths.is_binary` and `paths.has_documentclass`."""
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    plain = F.regexp_replace("path", "^file:/+", "/")
    return files.select(
        F.when(plain.startswith(base), F.substring(plain, len(base) + 1, 2**30)).otherwise(F.col("path")).alias("rel"), "content"
    )


def scan_library(inventory: DataFrame, mappings: DataFrame) -> DataFrame:
    """State of every PDF: organized, failed or raw; mapped but absent ones are missing.

    A supplement mapping counts as raw. `name_key` is the listing order.
    """
    hidden = paths.has_part(F.col("rel"), (paths.INTERNAL_DIR, *paths.GENERATED_DIRS))
    found = inventory.filter(F.col("rel").endswith(".pdf") & ~hidden).select("rel").join(
        mappings.select("rel", "status"), "rel", "left"
    )
    state = (
        F.when(F.col("status") == "organized", "organized").when(F.col("status").isin("failed", "missing"), "failed").otherwise("raw")
    )
    missing = mappings.filter("status = 'organized'").select("rel").join(inventory.select("rel"), "rel", "left_anti")
    listed = found.select("rel", state.alias("state")).unionByName(missing.withColumn("state", F.lit("missing")))
    return listed.withColumn("name_key", F.lower(paths.name(F.col("rel"))))


def list_documents(inventory: DataFrame, actions: DataFrame) -> DataFrame:
    """Files of a known document type that are neither internal nor the output of an action."""
    outputs = actions.select(F.explode("outputs").alias("rel"))
    documents = inventory.filter(paths.is_document(F.col("rel")) & ~paths.has_part(F.col("rel"), (paths.INTERNAL_DIR,)))
    return documents.join(outputs, "rel", "left_anti")


def list_folder(inventory: DataFrame, folder: str = "") -> DataFrame:
    """One level below a folder: folders first, then documents, each by lower-cased name."""
    base = folder.strip("/") + "/" if folder.strip("/") else ""
    below = inventory.filter(F.col("rel").startswith(base)).select(F.substring("rel", len(base) + 1, 2**30).alias("_tail"))
    name = F.substring_index("_tail", "/", 1)
    kind = F.when(F.col("_tail").contains("/"), "folder").otherwise("document")
    children = below.select(name.alias("name"), kind.alias("kind")).filter(
        ~F.col("name").startswith(".") & ((F.col("kind") == "folder") | paths.is_document(F.col("name")))
    ).distinct()
    return children.orderBy(F.desc("kind"), F.lower("name"))
