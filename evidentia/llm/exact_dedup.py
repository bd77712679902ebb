"""Exact dedup over a persistent digest index, DataFrame operations only.

Texts are equal when identical after lower-casing A-Z alone. The index is a Parquet table bucketed and sorted by digest; a batch is
reduced to one row a digest, sort-merge anti-joined with the index, and what is new is appended. The index side is neither shuffled
nor sorted again. The bucket count is kept beside the files, so that the index opens alike in any session. An append that broke off can be
repeated: what it has added is not new any more, and it changes no row. So keep_id and group_size of a text are those of the batch that
brought it; later batches' rows of that text are duplicates of keep_id and aren't added to group_size. One writer at a time.

Null text counts as empty; empty texts are equal to each other; a null doc_id loses to any other; of rows equal in text and doc_id one is
kept and all are counted; other columns are ignored or carried along; an empty table gives an empty result.
"""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.common import discard, shared_dir, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_digest(text: Column) -> Column:
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER).cast("binary"), 256)


INDEX = "digest string, keep_id bigint, group_size bigint"


class DigestIndex:
    """digest -> (keep_id, group_size), bucketed and sorted by digest, at ``path``. A new index gets ``buckets`` buckets, an old one keeps its own."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        held = self._held()
        if held and buckets and held != buckets:
            raise ValueError(f"the index at {self.path} has {held} buckets, not {buckets}")
        self.buckets = held or self._hold(buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))

    def _at(self, name: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _held(self) -> int | None:
        """The bucket count beside the files; its name begins with _, so that readers of the table pass it over."""
        fs, at = self._at("_buckets")
        if fs.exists(at):
            file = fs.open(at)
            try:
                return file.readInt()
            finally:
                file.close()
        if fs.exists(at.getParent()) and len(fs.listStatus(at.getParent())):
            raise ValueError(f"{self.path} holds files but no digest index")
        return None

    def _hold(self, buckets: int) -> int:
        fs, at = self._at("_buckets")
        file = fs.create(at, False)
        file.writeInt(buckets)
        file.close()
        return buckets

    @contextlib.contextmanager
    def table(self):
        """The name of a catalog table of the files while the block runs; only such a table tells Spark of the buckets."""
        name = f"digest_index_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {name} ({INDEX}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )
        try:
            yield name
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")  # the files stay

    def read(self) -> DataFrame:
        return self.spark.read.schema(INDEX).parquet(self.path)

    def append(self, groups: DataFrame) -> None:
        """Adds those rows of ``groups`` (digest, keep_id, group_size; one a digest) whose digest the index lacks."""
        with self.table() as name:
            new = groups.repartition(self.buckets, "digest").join(self.spark.table(name).select("digest").hint("merge"), "digest", "left_anti")
            new = written(new.select("digest", "keep_id", "group_size"), "digests")  # the table can't be read and written at once
            new.repartition(self.buckets, "digest").write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(name)
        discard(new)


def digests(docs: DataFrame) -> DataFrame:
    """(digest, doc_id, n): how many rows have this text and id."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_digest(F.col("text")).alias("digest"))
    return written(rows.groupBy("digest", "doc_id").agg(F.count("*").alias("n")), "pairs")


def groups_of(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_dedup(docs: DataFrame, index_path: str | None = None, buckets: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    With ``index_path``, texts that the index at that path already holds are duplicates of its rows; new ones are appended to it. Without,
    the index is a new one in the shared folder.
    """
    spark = docs.sparkSession
    pairs = digests(docs)
    index = DigestIndex(spark, index_path or f"{shared_dir(spark)}/digest-index-{uuid.uuid4().hex}", buckets)
    index.append(groups_of(pairs))
    # read without its buckets: both sides are then shuffled, and Spark can split a digest that a third of the rows share
    known = index.read()
    out = pairs.join(known.hint("merge"), "digest").withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


def drop_exact(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose equal has a larger doc_id; all columns are kept."""
    spark, cols = docs.sparkSession, docs.columns
    index = DigestIndex(spark, f"{shared_dir(spark)}/digest-index-{uuid.uuid4().hex}")
    pairs = digests(docs)
    index.append(groups_of(pairs))
    known = index.read()
    tied = pairs.select(F.col("digest").alias("ev_d_"), F.col("doc_id").alias("ev_k_"), "n")
    stay = known.join(tied, (known.digest == tied.ev_d_) & known.keep_id.eqNullSafe(tied.ev_k_)).select("ev_d_", "ev_k_", F.col("n").alias("ev_n_"))
    rows = docs.withColumn("ev_digest_", text_digest(F.col("text")))
    rows = rows.join(stay.hint("merge"), (rows.ev_digest_ == stay.ev_d_) & rows.doc_id.cast("bigint").eqNullSafe(stay.ev_k_))
    if pairs.filter("n > 1").isEmpty():
        return rows.select(*cols)
    return rows.filter("ev_n_ = 1").select(*cols).unionByName(rows.filter("ev_n_ > 1").dropDuplicates(["ev_digest_", "ev_k_"]).select(*cols))
