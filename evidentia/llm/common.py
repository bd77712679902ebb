"""Helpers shared by the training-data operators: the cluster's shared folder, written intermediates, connected components."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


FILE_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``). Only a local session may go without it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    global _LOCAL
    if _LOCAL is None:
        _LOCAL = "file://" + tempfile.mkdtemp(prefix="evidentia-")
    return _LOCAL


_LOCAL: str | None = None


def written(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends here and a lost executor costs nothing.

    Where a bound of the ``rows`` is known and they are small and cheap to make, a task writes FILE_ROWS of them at least, not a file a
    partition; a bound beyond the partitions changes nothing.
    """
    spark = df.sparkSession
    df = df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._evidentia_path = path
    return out


def reread(df: DataFrame) -> DataFrame:
    """The table of ``written()`` once more, to be joined with itself."""
    out = df.sparkSession.read.schema(df.schema).parquet(df._evidentia_path)
    out._evidentia_path = df._evidentia_path
    return out


def with_fields(schema: T.StructType, ddl: str) -> T.StructType:
    """``schema`` and the fields of ``ddl`` behind it."""
    return T.StructType([*schema.fields, *T.DataType.fromDDL(ddl).fields])


def discard(df: DataFrame) -> None:
    """Removes a table of ``written()`` that no later plan reads."""
    path = getattr(df, "_evidentia_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def runs(texts: list, most: int = 2_000_000):
    """(start, stop) of consecutive rows of about ``most`` characters together; a longer text stands alone."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if texts:
        yield start, len(texts)


def slices(batches, most: int = 2_000_000):
    """The rows of Arrow ``batches`` in order, in batches of about ``most`` bytes each; a longer row stands alone."""
    for b in batches:
        rows = max(1, b.num_rows * most // max(1, b.nbytes))
        for i in range(0, b.num_rows, rows):
            part = b.slice(i, rows)
            if part.nbytes > 2 * most and part.num_rows > 1:  # long texts side by side
                for k in range(part.num_rows):
                    yield part.slice(k, 1)
            else:
                yield part


@functools.cache
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)


#: What a task holds of a table at once: bytes of a batch that goes to Python, rows of a batch that comes from Parquet.
BATCH_BYTES, BATCH_ROWS = 2 << 20, 512


def small_batches() -> None:
    """Lowers the session's batches to ``BATCH_BYTES`` and ``BATCH_ROWS``, as rows here are whole texts; smaller settings stay."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    held = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")  # "67108864b" unless the user wrote a unit
    if not held.isdigit() or int(held) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    if int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) > BATCH_ROWS:
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(BATCH_ROWS))


def lean(run):
    """``run`` for mapInArrow, so that a Python worker holds small batches and gives back its memory when the task ends.

    Sets the session's batch sizes by ``small_batches()``.
    """
    small_batches()

    def go(batches):
        try:
            yield from run(slices(batches))
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return go


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class Recent(dict):
    """key -> value of ``make(key)``, of bounded size: two generations of at most ``most`` keys, of which the older goes when the newer is full."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value


class WordHashes(dict):
    """word -> 64-bit hash, kept for words seen before; emptied when it holds ``most`` words."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def connected(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) for every node of undirected ``edges``: root is the smallest node reachable.

    Alternates large-star and small-star steps, which converge in O(log^2 n) rounds on any graph. Every step groups by node through
    window-free joins, pre-aggregated, and writes its edges to the shared folder. Self-loops are harmless.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v").distinct()
    e = written(e, "cc")
    n = e.count()
    mark = None
    for _ in range(rounds if n else 0):
        # large star: each node's larger neighbours link to the smallest of its neighbourhood
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: each node's smaller neighbours and itself link to the smallest of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        new = written(small, "cc", 2 * n)
        discard(e)
        e = new
        n, nodes, _sum = now = e.agg(F.count("*"), F.countDistinct("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        # stars whose centres link to nothing are done; else a round that changes nothing tells
        if now == mark or (n == nodes and e.join(reread(e).select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()):
            break
        mark = now
    else:
        if n:
            raise RuntimeError(f"components did not converge in {rounds} rounds")
    roots = e.groupBy("u").agg(F.min("v").alias("v"))
    found = roots.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found.unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
