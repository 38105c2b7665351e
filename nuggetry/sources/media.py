"""Image and audio files: listing, resolution for a review, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import mime_type, without_sentinel

# Kinds of files, and the largest that is sent as it is.
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".webp", ".gif", ".bmp"]
AUDIO_EXTENSIONS = [".wav", ".mp3", ".m4a", ".flac", ".ogg"]
LARGEST = 20 << 20
# End of the fixed values.


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, name (lower-cased file name), stem, extension and length of all files below ``folder``; contents unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    return with_names(files)


def with_names(files: DataFrame) -> DataFrame:
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    return files.withColumn("name", name).withColumn("extension", F.regexp_extract("name", r"(\.[^.]+)$", 1)).withColumn("stem", F.regexp_replace("name", r"\.[^.]+$", ""))


def usable(files: DataFrame, extensions: list[str] = IMAGE_EXTENSIONS, largest: int = LARGEST) -> DataFrame:
    """Files of a known kind that are small enough to be sent as they are, with their type."""
    return files.where(F.col("extension").isin(extensions) & (F.col("length") <= largest)).withColumn("mime_type", mime_type("path"))


def read_contents(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """``files`` with their content and its Base64 text; only the listed files are joined to the scan."""
    data = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content")
    return files.join(data, "path").withColumn("base64", F.base64("content"))


def _stem(entry: Column) -> Column:
    return F.lower(F.replace(entry, F.lit("-"), F.lit("_")))


def resolve(reviews: DataFrame, files: DataFrame, path_col: str, description_col: str) -> DataFrame:
    """Reviews with media_path and media_source: the file that is named (by its base name), else one named after the
    entry (- as _), else the description, else nothing. Of several files the first by path."""
    f = files.select(F.col("path").alias("_path"), "name", "stem")
    named = f.groupBy("name").agg(F.min("_path").alias("_by_name"))
    stemmed = f.groupBy("stem").agg(F.min("_path").alias("_by_stem"))
    r = reviews.withColumn("name", F.lower(F.element_at(F.split(F.coalesce(path_col, F.lit("")), "/"), -1))).withColumn("stem", _stem(F.col("entry_id")))
    r = r.join(named, "name", "left").join(stemmed, "stem", "left")
    described = without_sentinel(description_col) != ""
    source = F.when(F.col("_by_name").isNotNull(), "file").when(F.col("_by_stem").isNotNull(), "entry_id").when(described, "description").otherwise("none")
    return r.withColumns({"media_path": F.coalesce("_by_name", "_by_stem"), "media_source": source}).drop("name", "stem", "_by_name", "_by_stem")


def completeness(resolved: DataFrame, needs: str) -> DataFrame:
    """How many reviews need the medium, have it, or miss it, and which those are (sorted)."""
    need, have = F.col(needs), F.col("media_path").isNotNull()
    return resolved.agg(F.count_if(need).alias("need"), F.count_if(need & have).alias("have"), F.count_if(need & ~have).alias("missing"), F.sort_array(F.collect_list(F.when(need & ~have, F.col("entry_id")))).alias("missing_ids"))
