"""What the operators of this subpackage share: written intermediate tables, held-out folds and Arrow batch helpers."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes of their texts, that are Python objects at one time.
SLICE_ROWS, SLICE_BYTES = 256, 4 << 20
#: Bytes of a text whose words are Python objects at one time.
PART_BYTES = 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Keys with more than one of so many rows, and more rows than HOT_ROWS, are hot.
HOT_SHARE, HOT_ROWS = 1000, 100
try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode one of our own where that is unset."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="touchline-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors, computes df once.

    The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/touchline-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(schema).parquet(path)


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo folds; a null key hashes as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def text_bytes(name: str = "text") -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


def slices(array: pa.Array, rows: int = SLICE_ROWS, most: int = SLICE_BYTES) -> Iterator[list]:
    """An Arrow array as lists of Python objects: at most ``rows`` at a time and, of texts or lists, ``most`` bytes, though one element at least."""
    at = 0
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    while at < len(array):
        n = min(rows, len(array) - at)
        while n > 1 and array.slice(at, n).nbytes > most:
            n = (n + 1) // 2
        yield array.slice(at, n).to_pylist()
        at += n
    tidy()


def parts(text: bytes, most: int = PART_BYTES) -> Iterator[list[bytes]]:
    """The words (between ASCII white space) of a text, in lists: few objects at a time, however long the text."""
    at = 0
    while len(text) - at > most:
        end = SPACE.search(text, at + most)
        if end is None:
            break
        yield text[at : end.start()].split()
        at = end.start()
    yield (text[at:] if at else text).split()


def words(text: bytes) -> Iterator[list[bytes]]:
    """The words as parts() gives them, A-Z lower-cased."""
    return parts(text.lower())


def tidy() -> None:
    """Gives memory that a worker no longer uses back to the machine, as workers live on for other stages."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def join_hot(rows: DataFrame, known: DataFrame, key: str, how: str = "inner", share: int = HOT_SHARE) -> DataFrame:
    """rows (a written table) joined with ``known``, at most one row a key, by column ``key``; no key's rows meet in one task.

    Keys that hold more than 1/``share`` of all rows are fewer than ``share``, whatever the size: their rows stay where they are and meet a
    broadcast of those keys' facts. The other rows are shuffled by key. Null keys join nothing.
    """
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    hot = [r[0] for r in counts.filter(F.col("n") > max(HOT_ROWS, rows.count() // share)).select(key).collect()]
    if not hot:
        return rows.join(known, key, how)
    few = rows.sparkSession.createDataFrame([(k,) for k in hot], known.select(key).schema)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False)) if len(hot) <= 16 else None
    facts = F.broadcast(known.join(F.broadcast(few), key, "left_semi"))
    if is_hot is not None:
        return rows.filter(is_hot).join(facts, key, how).unionByName(rows.filter(~is_hot).join(known, key, how))
    return rows.join(F.broadcast(few), key, "left_semi").join(facts, key, how).unionByName(rows.join(F.broadcast(few), key, "left_anti").join(known, key, how))
