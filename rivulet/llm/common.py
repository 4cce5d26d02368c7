"""What the operators of this subpackage share: the shared folder, tables that
cut lineage, bounded Arrow batches, and splits by document id."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper-case letters that the contracts fold, and what they become.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_LOCAL_SHARED: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset and the master is local, a temporary folder of this
    process; where it is unset on a cluster, an error, since a machine-local
    folder would lose rows there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL_SHARED:
        _LOCAL_SHARED.append("file://" + tempfile.mkdtemp(prefix="rivulet-"))
    return _LOCAL_SHARED[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark removes a query's shuffle files as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Folders of the tables stored within each open ``scratch``, the innermost last.
_SCRATCH: list[list[str]] = []


def stored(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """``df`` written as a table in the shared folder and read again.

    This cuts the lineage: the rows survive the loss of any executor, and the
    shuffle files behind them are let go at once. The table is deleted at the end
    of the ``scratch`` that it is stored in; a ``lasting`` one at the end of the
    next outer one; without a scratch it stays.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if len(_SCRATCH) > lasting:
        _SCRATCH[-1 - lasting].append(path)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(conf).delete(found, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is stored inside is deleted at the end; what leaves must be lasting."""
    own: list[str] = []
    _SCRATCH.append(own)
    try:
        yield
    finally:
        _SCRATCH.pop()
        for path in own:
            delete(spark, path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by ``stored`` that nothing reads any more."""
    spark = df.sparkSession
    root = shared_dir(spark)
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.replace("file:///", "file:/").startswith(root.replace("file:///", "file:/")):
            delete(spark, folder)


def bounded_batches(spark: SparkSession, rows: int = 512, size: str = "16m") -> None:
    """Keep Arrow batches small enough for Python workers that hold whole texts.

    The settings stay, as the plans made under them run later. A value that the
    session's owner lowered further is left alone.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def id_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``: the fixed held-out split."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def fold_ascii(text: Column) -> Column:
    """A-Z to lower case, every other character as it is.

    ``lower`` would fold other alphabets too, so it serves only texts whose
    length in bytes equals their length in characters.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
