"""How rows are dealt out, and what small tables are sent to every task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table is sent to every task; it is counted first.
SENT = 200_000
_LOCAL: list[str] = []


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores where their files give fewer partitions, for costly work on a few files; large inputs stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def sent(rows: DataFrame, most: int = SENT):
    """A function that marks tables of no more rows than ``rows`` for broadcast if ``rows`` has at most ``most``, else leaves them."""
    return F.broadcast if rows.limit(most + 1).count() <= most else lambda t: t


def workspace(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``). Only a local session may go without it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="evidentia-work-"))
    return _LOCAL[0]


def kept(rows: DataFrame, tag: str) -> DataFrame:
    """``rows`` written to the workspace and read from there: for small tables that are read more than once."""
    path = f"{workspace(rows.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def small_batches(spark: SparkSession | None = None, most: int = 2 << 20) -> None:
    """Lowers the bytes of a session's Arrow batches to ``most``, as rows that are whole texts fill a worker's memory by thousands; a smaller setting stays."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    held = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")  # "67108864b" unless the user wrote a unit
    if not held.isdigit() or int(held) > most:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{most}b")
