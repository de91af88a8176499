"""Small pieces that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: anything but ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"
SPACE = "[\\x20\\x09-\\x0D]+"


#: Rows of a batch of the Parquet reader, and bytes of a row group of a stored step: every task holds one of each, and texts may be long.
READER_ROWS = 256
GROUP_BYTES = 16 << 20


def lower(spark: SparkSession, name: str, most: int) -> None:
    """Sets a number of the session to ``most`` unless it is lower already (0 or less: no limit)."""
    if not 0 < int(spark.conf.get(name)) <= most:
        spark.conf.set(name, str(most))


def read(spark: SparkSession, sf_dir: str, table: str, *cols: str) -> DataFrame:
    lower(spark, "spark.sql.parquet.columnarReaderBatchSize", READER_ROWS)
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*cols) if cols else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it (also within lambdas)."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and every executor see: the cluster's ``spark.checkpoint.dir``.

    Where that is unset a temporary folder serves if driver and executors are one process (tests), else there is none.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="countloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/countloom-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Lineage cut by a table written to the shared folder: it survives the loss of executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of ``cut`` tables that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path.getParent(), True)


#: Rows of an Arrow batch: texts may be long, and a batch is in memory on both sides.
BATCH_ROWS = 1000


def by_batches(df: DataFrame, work: Callable, schema: object) -> DataFrame:
    """``df.mapInArrow`` with batches of at most ``BATCH_ROWS`` rows, read by ``READER_ROWS`` (settings of the session, which are only ever lowered)."""
    lower(df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    lower(df.sparkSession, "spark.sql.parquet.columnarReaderBatchSize", READER_ROWS)
    return df.mapInArrow(work, schema)


def give_back() -> None:
    """Hands memory that this process has freed back to the system: an idle Python worker keeps it beside the steps that follow."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def sized(df: DataFrame, rows: int, each: int, least: int = 16) -> DataFrame:
    """``df`` in one partition for each ``each`` of ``rows`` rows, ``least`` at least, where a shuffle has left more (no new shuffle)."""
    return df.coalesce(max(least, -(-rows // each)))


def unit(*parts: Column) -> Column:
    """A deterministic number in (0, 1), uniform over distinct inputs: the first 13 hex digits (52 bits) of an md5, which other SQL engines compute alike."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True where crc32 of the id's decimal text leaves ``fold`` modulo ``folds``; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(True))
