"""Shards by best-fit-decreasing bin packing of indivisible groups.

Groups (rows of equal text) stay whole and are the items. Items go, largest first, into the bin with the least room that suffices, found
through a balanced tree. Equal sizes can stand for each other, so the driver packs counts of sizes, not groups: the tightest bin takes as
many of a size as it has room for, and the next tightest the next ones, which is what item by item gives. Distinct sizes are at most the
square root of twice the bytes in number, whatever the groups are. The groups of a size are numbered in salted parts, and a group's number
gives its bin. An even split searches the least capacity for which the bins suffice; a group larger than an even share gets a shard to
itself, as it can't be divided, and so does one larger than a given capacity. No other shard is over capacity.

Null text has no bytes; every row counts 8 besides; ties go by bin; repeated rows are rows of their group; a null doc_id is sharded as any
other; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import discard, written

#: Runs of equal groups up to which the plan of bins is sent to every task; a longer one is joined by shuffle.
SENT = 200_000


class RoomTree:
    """A treap of (room, bin) pairs: insert, and removal of the least pair whose room suffices, each in O(log n)."""

    def __init__(self):
        self.root = None

    def _split(self, t, key):
        """(pairs below key, the others). Nodes are [pair, priority, left, right]."""
        if t is None:
            return None, None
        if t[0] < key:
            t[3], rest = self._split(t[3], key)
            return t, rest
        first, t[2] = self._split(t[2], key)
        return first, t

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def insert(self, room: int, bin_: int) -> None:
        pair = (room, bin_)
        low, high = self._split(self.root, pair)
        self.root = self._merge(self._merge(low, [pair, zlib.crc32(b"%d %d" % pair), None, None]), high)

    def take(self, size: int):
        """Removes and returns the least (room, bin) with room >= size, or None."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        at, above = high, None
        while at[2] is not None:
            at, above = at[2], at
        if above is None:
            high = at[3]
        else:
            above[2] = at[3]
        self.root = self._merge(low, high)
        return at[0]


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """((size, first, last, bin) runs, number of bins): the groups first..last-1 of a size stand in one bin. ``counts``: groups by size.

    A group larger than the capacity has a bin to itself.
    """
    rooms, bins, runs = RoomTree(), 0, []
    for size in sorted(counts, reverse=True):
        done, n = 0, counts[size]
        while done < n:
            found = rooms.take(size)
            if found is None:
                found, bins = (max(capacity, size), bins), bins + 1
            k = min(n - done, found[0] // size)
            runs.append((size, done, done + k, found[1]))
            done += k
            if found[0] > k * size:
                rooms.insert(found[0] - k * size, found[1])
    return runs, bins


def even_shards(counts: dict[int, int], shards: int) -> list[tuple[int, int, int, int]]:
    """The runs of best_fit_decreasing() of the least capacity that needs no more than ``shards`` bins."""
    left, total, alone, runs = dict(counts), sum(s * n for s, n in counts.items()), 0, []
    while left and alone < shards - 1 and (most := max(left)) * (shards - alone) > total:
        at = counts[most] - left[most]
        runs.append((most, at, at + 1, alone))
        total, alone = total - most, alone + 1
        left[most] -= 1
        if not left[most]:
            del left[most]
    if not left:
        return runs
    most, bins = max(left), shards - alone
    even = -(-total // bins)
    low, high = max(even, most) - 1, even + most  # so much always suffices: a bin that lacks room for an item is filled beyond the even share
    placed, _ = best_fit_decreasing(left, high)
    while high - low > max(1, low >> 20):
        mid = (low + high) // 2
        tried, n = best_fit_decreasing(left, mid)
        if n <= bins:
            placed, high = tried, mid
        else:
            low = mid
    before = {s: counts[s] - n for s, n in left.items()}
    return runs + [(s, a + before[s], b + before[s], x + alone) for s, a, b, x in placed]


def _numbered(rows: DataFrame, by: str, order: str, parts: int) -> DataFrame:
    """``rows`` with ``number``, from 0 within each value of ``by``; ranked in salted parts, so that a frequent value needs no single task."""
    rows = rows.withColumn("part", F.pmod(F.xxhash64(order), F.lit(parts)))
    sizes = rows.groupBy(by, "part").agg(F.count("*").alias("n"))
    before = sizes.select(by, "part", (F.sum("n").over(Window.partitionBy(by).orderBy("part")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy(by, "part").orderBy(order))
    return rows.withColumn("number", rank - 1).join(before, [by, "part"]).withColumn("number", F.col("number") + F.col("before")).drop("part", "before")


def shard_documents(docs: DataFrame, shards: int = 24, capacity: int | None = None, part_rows: int = 8192) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard, text_digest.

    ``shards`` even shards, or with ``capacity`` as few shards of that many bytes as best fit needs. law is ``bytes``: sizes as near to
    equal as whole groups let them be; grown_shard is null.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = written(
        docs.select(
            F.col("doc_id"), (F.length(text) + 8).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
            F.md5(text).alias("text_digest"), F.monotonically_increasing_id().alias("rid"),
        ),
        "sizes",
    )
    groups = written(rows.groupBy("text_digest").agg(F.sum("size").alias("bytes"), F.count("*").alias("members")), "groups")
    sizes = [tuple(r) for r in groups.groupBy("bytes").agg(F.count("*").alias("n"), F.sum("members")).collect()]  # distinct sizes
    counts, n = {b: k for b, k, _ in sizes}, sum(m for *_, m in sizes)
    runs = best_fit_decreasing(counts, capacity)[0] if capacity else even_shards(counts, shards)
    bins = spark.createDataFrame(runs, "bin_bytes bigint, first bigint, last bigint, shard int")
    bins = F.broadcast(bins) if len(runs) <= SENT else bins
    parts = max(1, -(-max(counts.values(), default=0) // part_rows))
    placed = _numbered(groups.select("text_digest", "bytes"), "bytes", "text_digest", parts)
    placed = placed.join(bins, (F.col("bytes") == F.col("bin_bytes")) & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("last")))
    placed = written(placed.select("text_digest", "shard"), "placed")
    discard(groups)
    rows = written(rows.join(placed, "text_digest"), "placed-rows")
    discard(placed)
    rows = _numbered(rows, "shard", "rid", max(1, -(-n // (max(1, shards) * part_rows))))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("number").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "text_digest",
    )
