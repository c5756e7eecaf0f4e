"""CSV and Parquet sources and sinks, and frames as SQL tables."""

from __future__ import annotations

import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from touchline import schema as S


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A CSV file with a header, by a fixed schema: no pass over the data to infer one. Byte-order marks and CRLF are fine."""
    return spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").csv(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, S.RESULTS)


def read_goalscorers(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, S.GOALSCORERS)


def read_countries(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, S.COUNTRIES)


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, S.MATCHES)


def read_results_with_goals(spark: SparkSession, path: str) -> DataFrame:
    extra = [f for f in S.GOALSCORERS.fields if f.name not in S.RESULTS.names]
    return read_csv(spark, path, StructType([*S.RESULTS.fields, *extra]))


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names alone."""
    return spark.read.option("header", True).csv(path).columns


#: Rows of a compressed part file at most, as it is read in one piece.
PART_ROWS = 2_000_000


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", compression: str = "none") -> None:
    """CSV part files with a header and without an index; compressed ones (gzip and the like) have PART_ROWS rows at most."""
    out = df.write.mode(mode).option("header", True)
    if compression != "none":
        out = out.option("compression", compression).option("maxRecordsPerFile", PART_ROWS)
    out.csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def query(df: DataFrame, name: str, sql: str, args: list[Any] | dict[str, Any] | None = None) -> DataFrame:
    """SQL over a frame known as {name} in the text (no view is registered, so callers don't meet), with bound parameters."""
    return df.sparkSession.sql(sql, args=args, **{name: df})


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir; in local mode one of our own where that is unset), deleted when the driver ends."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{(root or tempfile.gettempdir()).rstrip('/')}/touchline-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(jpath)  # only what exists is marked for deletion
    fs.deleteOnExit(jpath)
    return f"{path}/files"


def written(df: DataFrame) -> DataFrame:
    """df, written once as Parquet in that folder and read back: cuts lineage, survives lost executors, and is made once however often it is read."""
    path, schema = scratch(df.sparkSession), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a written table before the driver ends."""
    sc = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        jpath = sc._jvm.org.apache.hadoop.fs.Path(folder)
        jpath.getFileSystem(sc._jsc.hadoopConfiguration()).delete(jpath, True)
