"""File, database and stream sources by explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldgraph.storage import scratch_path

FORMATS = ("parquet", "orc", "json", "csv")
#: The folders of a chunked corpus with their fields; ``lang`` names the folder within.
CHUNK_FILES = {"chunks": "id long, place int, chunk string, lang string", "metadata": "id long, source string, chunks long, chars long, lang string", "stats": "documents long, chunks long, chars long, lang string"}


def read(spark: SparkSession, path: str, kind: str, schema: str | None = None) -> DataFrame:
    """A file or folder of one of FORMATS. JSON and CSV take a schema, so no pass is spent on guessing one."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    if kind in ("json", "csv") and schema is None:
        raise ValueError(f"{kind} needs a schema")
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.csv(path, header=True, escape='"', multiLine=True) if kind == "csv" else reader.format(kind).load(path)


def read_table(spark: SparkSession, url: str, table: str, key: str, least: int, most: int, parts: int) -> DataFrame:
    """A database table over JDBC in ranges of a numeric key."""
    return spark.read.jdbc(url, table, column=key, lowerBound=least, upperBound=most, numPartitions=parts)


def read_binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files as rows of path, modificationTime, length and content; filters on length are pushed down."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def write(df: DataFrame, path: str, kind: str) -> None:
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    if kind == "csv":
        df.write.csv(path, header=True, escape='"')
    else:
        df.write.format(kind).save(path)


def round_trip(df: DataFrame, kind: str) -> DataFrame:
    """Written to the shared folder and read back."""
    path = scratch_path(df.sparkSession, kind)
    write(df, path, kind)
    return read(df.sparkSession, path, kind, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields))


def stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def write_chunks(docs: DataFrame, path: str, id_col: str, text: str, folder: str, keep: list[str], size: int) -> None:
    """JSON folders of chunks, of each document's metadata and of each folder's statistics. A null text has no chunk, its metadata say 0."""
    pieces = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), F.col(folder), *keep, pieces.alias("pieces"), F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("chars"))
    rows.select("id", folder, F.posexplode_outer("pieces").alias("place", "chunk")).write.partitionBy(folder).json(f"{path}/chunks")
    metadata = rows.select("id", folder, *keep, F.size("pieces").cast("long").alias("chunks"), "chars")
    metadata.write.partitionBy(folder).json(f"{path}/metadata")
    stats = metadata.groupBy(folder).agg(F.count("*").alias("documents"), F.sum("chunks").alias("chunks"), F.sum("chars").alias("chars"))
    stats.write.partitionBy(folder).json(f"{path}/stats")
