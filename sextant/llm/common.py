"""What the training-data operators share: the written-table cut of lineage, text columns and row hashes."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, which ends words; everything else belongs to a word.
SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"
#: Of an Arrow batch, and how the session shows that nobody chose its own limit.
BATCH_BYTES, UNSET = 2 << 20, f"{64 << 20}b"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``. Where that is missing, a temporary one in a local session, as in tests; on a cluster
    nobody else could read it, so there it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.conf.get("spark.master", "").split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is not set: it names the folder that the driver and the executors share")
        base = _folders.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="sextant_"))
    return f"{base.rstrip('/')}/sextant/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there, and every executor can read it again."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few bytes, so that long texts are few in a batch. A limit that the session has set itself stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, UNSET) == UNSET:
        spark.conf.set(key, str(BATCH_BYTES))


def trim() -> None:
    """Gives this process's free memory back to the system, which else stays with the allocator."""
    gc.collect()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give(0)


_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], object] = object) -> object:
    """What a Python worker keeps from task to task for the operator ``name``. Workers serve one operator after the other: what this one
    kept for others goes, and its memory back to the system."""
    if name not in _kept:
        _kept.clear()
        trim()
        _kept[name] = make()
    return _kept[name]


def texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only (doc_id, text): no other column can clash; a null text counts as empty."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def fold(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % mod


