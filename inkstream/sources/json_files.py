"""JSON files of one object or an array of objects, with absent and null keys told apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def files(spark: SparkSession, folder: str, pattern: str = "*.json", recursive: bool = True) -> DataFrame:
    """file_path, file_name, body of each file; a folder without such files gives no rows."""
    read = spark.read.option("wholetext", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).option("ignoreMissingFiles", True)
    return read.text(folder).select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("body"))


def objects(bodies: DataFrame) -> DataFrame:
    """file_path, file_name, obj_pos, obj (map<string,string>; values that aren't text stay JSON), corrupt.

    A file that is neither an object nor an array of objects, or is broken or empty, is one corrupt row."""
    body = F.trim("body")
    many = F.from_json(body, "array<map<string,string>>")
    one = F.from_json(body, "map<string,string>")
    found = F.when(body.startswith("["), many).when(body.startswith("{") & one.isNotNull(), F.array(one))
    found = F.filter(F.coalesce(found, F.array().cast("array<map<string,string>>")), lambda x: x.isNotNull())
    return (
        bodies.select("file_path", "file_name", F.posexplode_outer(found).alias("obj_pos", "obj"))
        .withColumn("corrupt", F.col("obj").isNull())
    )


def newest(spark: SparkSession, folder: str, pattern: str = "*.json") -> str | None:
    """The path of the file changed last (of equals the last by name)."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime")
    row = listed.agg(F.max(F.struct("modificationTime", "path")).alias("m")).first()
    return row["m"]["path"] if row and row["m"] else None
