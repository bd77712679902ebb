"""Near-dedup of documents by BagMinHash.

A document is the multiset of its runs of five words (lower-cased word characters). Each distinct shingle of weight w contributes the
points of Poisson processes over the weight axis up to w, discretised at the integers: the axis is cut into (0,1], (1,2], (2,4], (4,8] ...
and each block's process is split in halves hierarchically, so that only the halves below w are followed, and only until their points
come later than every minimum of the signature. A signature component is the earliest point that falls to it; two components agree with a
probability equal to the weighted Jaccard similarity. Signatures are cut into bands; candidates are verified on the whole multisets.

Texts with the same words are one node. In a bucket every node is verified against the bucket's most typical node (the one whose buckets
are largest), not against every other; nodes that this leaves in different components are then verified against each other, so no link
that a bucket shows is lost while groups of near copies cost a row each. Classes are the connected components of the links.

Null, empty and wordless texts link with nothing but equal wordless texts don't form a class either: each is its own. A text of fewer than
five words is one shingle. Rows of equal words are one class; a null doc_id never names a class that has another; repeated rows are rows
of their class, of which one is kept; any length is handled; other columns are ignored or carried along; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import WordHashes, connected, discard, lean, mix64, reread, runs, written
from evidentia.llm.shingles import shingles

SIZE, SIMILARITY, BANDS, ROWS = 5, 0.8, 32, 4
#: Members up to which a bucket is compared by pairs of rows, and members of a block beyond that.
SMALL, BLOCK = 16, 256
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _draw(seed: np.ndarray, k) -> np.ndarray:
    """The k-th word of each seed's random stream."""
    with np.errstate(over="ignore"):
        return mix64(seed + _STEP * np.asarray(k, np.uint64))


def _wait(word: np.ndarray) -> np.ndarray:
    """A standard exponential variate of a random word."""
    return -np.log1p(-((word >> np.uint64(11)).astype(float) * 2.0**-53))


def _seed(element: np.ndarray, low: np.ndarray, width: np.ndarray) -> np.ndarray:
    return mix64(element ^ mix64(low.astype(np.uint64) << np.uint64(32) | width.astype(np.uint64)))


def bag_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, m: int) -> np.ndarray:
    """``docs`` x ``m`` signatures of weighted sets given as (document, element, integer weight) rows. An empty set's is all zero."""
    first, sign = np.full(docs * m, np.inf), np.zeros(docs * m, np.uint64)

    def emit(d, x, point):
        at = d * m + (point % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, at, x)
        won = first[at] == x
        sign[at[won]] = point[won]

    parts, low, high = [], 0, 1
    while True:
        mine = weight > low
        if not mine.any():
            break
        parts.append((doc[mine], element[mine], weight[mine], np.full(mine.sum(), low), np.full(mine.sum(), high - low)))
        low, high = high, 2 * high
    if not parts:
        return sign.reshape(docs, m)
    d, e, w, lo, wd = (np.concatenate(c) for c in zip(*parts, strict=True))
    seed = _seed(e, lo, wd)
    point = _draw(seed, 1)
    x = _wait(_draw(seed, 2)) / (m * wd)
    told, k = np.zeros(len(d), bool), np.zeros(len(d), np.int64)
    while len(d):
        limit = first.reshape(docs, m).max(1)
        live = x <= limit[d]
        d, e, w, lo, wd, x, point, told, k = (c[live] for c in (d, e, w, lo, wd, x, point, told, k))
        new = ~told & (lo + wd <= w)
        emit(d[new], x[new], point[new])
        leaf = wd == 1
        ends = []
        if leaf.any():  # later points of a single cell, more at once when few processes are left
            times = 1 if leaf.sum() > 4000 else 8 if leaf.sum() > 500 else 48
            ld, le, lk, seed = d[leaf], e[leaf], k[leaf], _seed(e[leaf], lo[leaf], wd[leaf])
            nth = 2 * (lk[:, None] + np.arange(1, times + 1))
            points, xs = _draw(seed[:, None], nth + 1), x[leaf][:, None] + np.cumsum(_wait(_draw(seed[:, None], nth + 2)), 1) / m
            if times > 1:
                emit(np.repeat(ld, times), xs.ravel(), points.ravel())
            ends.append((ld, le, w[leaf], lo[leaf], wd[leaf], xs[:, -1], points[:, -1], np.full(len(ld), times > 1), lk + times))
        if not leaf.all():
            s = ~leaf
            half = wd[s] // 2
            seed = _seed(e[s], lo[s], wd[s])
            right = (_draw(seed, 0) >> np.uint64(63)).astype(bool)
            has, other = lo[s] + np.where(right, half, 0), lo[s] + np.where(right, 0, half)
            ends.append((d[s], e[s], w[s], has, half, x[s], point[s], told[s], np.zeros(s.sum(), np.int64)))
            seed = _seed(e[s], other, half)
            ends.append((d[s], e[s], w[s], other, half, x[s] + _wait(_draw(seed, 2)) / (m * half), _draw(seed, 1), np.zeros(s.sum(), bool), np.zeros(s.sum(), np.int64)))
        d, e, w, lo, wd, x, point, told, k = (np.concatenate(c) for c in zip(*ends, strict=True)) if ends else (d[:0],) * 9
        near = lo < w
        if not near.all():
            d, e, w, lo, wd, x, point, told, k = (c[near] for c in (d, e, w, lo, wd, x, point, told, k))
    return sign.reshape(docs, m)


def weighted(doc: np.ndarray, shingle: np.ndarray):
    """(document, element, weight) rows of a batch's shingles. 44 bits of a hash tell the shingles of one document apart here."""
    key = np.sort(doc.astype(np.uint64) << np.uint64(44) | shingle >> np.uint64(20))
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    weight = np.diff(np.r_[first, len(key)])
    key = key[first]
    return (key >> np.uint64(44)).astype(np.int64), mix64(key & np.uint64((1 << 44) - 1)), weight


def band_keys(sign: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.tile(mix64(np.arange(1, bands + 1, dtype=np.uint64)), (len(sign), 1))
    cut = sign.reshape(len(sign), bands, rows)
    for r in range(rows):
        h = mix64(h ^ cut[:, :, r])
    return h.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two (sorted hashes, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / max(1, int(a[1].sum()) + int(b[1].sum()) - both)


def signatures(docs: DataFrame, size: int = SIZE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, text_hash, node, bands): node is a 128-bit hash of the text's words; it and bands are null where there are none."""

    def run(batches):
        known = WordHashes()
        for b in batches:
            texts = b.column(2).to_pylist()
            for i, j in runs(texts, 500_000):
                d, s, words = shingles(texts[i:j], size, known)
                sign = bag_minhash(*weighted(d, s), j - i, bands * rows)
                keys = band_keys(sign, bands, rows)
                node = [xxhash.xxh3_128_digest(" ".join(w)) if w else None for w in words]
                values = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * bands, pa.int32()), pa.array(keys.ravel()))
                some = pa.array([n is not None for n in node])
                values = pa.compute.if_else(some, values, pa.scalar(None, values.type))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(node, pa.binary()), values], names=["doc_id", "text_hash", "node", "bands"])

    rows_ = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text"))
    return rows_.mapInArrow(lean(run), "doc_id bigint, text_hash bigint, node binary, bands array<bigint>")


def verified(pairs: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """Those (a, b) pairs of ids whose weighted Jaccard similarity is at least ``least``."""

    def run(batches):
        known, last, held = WordHashes(), None, None
        for batch in batches:
            a, b, ta, tb = (c.to_pylist() for c in batch.columns)
            keep = []
            for i in range(len(a)):
                if b[i] != last:
                    last, held = b[i], np.unique(shingles([tb[i]], size, known)[1], return_counts=True)
                keep.append(similarity(np.unique(shingles([ta[i]], size, known)[1], return_counts=True), held) >= least)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    both = one.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(lean(run), "a bigint, b bigint")


def elements(texts: list[str], size: int, known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(text, element) of multisets as sets: the k-th occurrence of a shingle is an element of its own."""
    doc, shingle, _ = shingles(texts, size, known)
    order = np.lexsort((shingle, doc))
    doc, shingle = doc[order], shingle[order]
    first = np.r_[True, (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])]
    at = np.arange(len(doc))
    return doc, shingle ^ mix64(at - np.maximum.accumulate(np.where(first, at, 0)))


def linked(a: list[str], b: list[str], size: int, least: float, known: WordHashes, columns: int = 4096) -> np.ndarray:
    """The matrix of which texts of ``a`` and ``b`` have weighted Jaccard similarity >= ``least``, by products of incidence matrices."""
    da, ea = elements(a, size, known)
    db, eb = elements(b, size, known)
    na, nb = np.bincount(da, minlength=len(a)), np.bincount(db, minlength=len(b))
    shared = np.intersect1d(ea, eb)
    both = np.zeros((len(a), len(b)), np.float32)
    ca, cb = np.searchsorted(shared, ea), np.searchsorted(shared, eb)
    ca, cb = (np.where(c < len(shared), np.where(shared[np.minimum(c, len(shared) - 1)] == e, c, -1), -1) if len(shared) else np.full(len(c), -1) for c, e in ((ca, ea), (cb, eb)))
    for low in range(0, len(shared), columns):
        width = min(columns, len(shared) - low)
        x, y = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        for m, d, c in ((x, da, ca), (y, db, cb)):
            mine = (c >= low) & (c < low + width)
            m[d[mine], c[mine] - low] = 1
        both += x @ y.T
    both = both.astype(np.float64)
    return both / np.maximum(na[:, None] + nb - both, 1) >= least


def _blocks(open_: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """Links (a, b) that join the same nodes as all links within the buckets: each task compares two blocks and tells a forest of its links."""
    rows = open_.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = written(rows.join(texts, "id").select("bucket", "id", "root", "text", "blocks", "own"), "open")
    left = rows.withColumn("j", F.explode(F.sequence("own", F.col("blocks") - 1))).withColumnRenamed("own", "i")
    right = reread(rows).withColumn("i", F.explode(F.sequence(F.lit(0), "own"))).withColumnRenamed("own", "j")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple[int, int]] = []
        if len(a) and len(b):
            known, parent = WordHashes(), {}
            an, bn, ar, br = (t[c].to_pylist() for c in ("id", "root") for t in (a, b))

            def root(v):
                while parent.setdefault(v, v) != v:
                    parent[v] = v = parent[parent[v]]
                return v

            for x, y in zip(*np.nonzero(linked(a["text"].to_pylist(), b["text"].to_pylist(), size, least, known)), strict=True):
                u, v = root(ar[x]), root(br[y])
                if u != v:
                    parent[u] = v
                    out.append((an[x], bn[y]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    keys = ("bucket", "i", "j")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "a bigint, b bigint")


def classes(docs: DataFrame, size: int = SIZE, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, text_hash, wordless, class_id, class_rows) for each row of ``docs``; class_id is the smallest doc_id of the class."""
    sigs = written(signatures(docs, size, bands, rows), "signatures")
    # texts of the same words are one node, which has a whole number from here on
    first = F.min_by(F.struct("doc_id", "text_hash", "bands"), F.struct("doc_id", "text_hash"))
    nodes = sigs.filter("node is not null").groupBy("node").agg(first.alias("r"), F.min("doc_id").alias("low"), F.count("*").alias("n"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("id"), "node", "r.doc_id", "r.text_hash", "r.bands", "low", "n"), "nodes")
    n = nodes.count()
    spread = nodes.select("id", F.explode("bands").alias("bucket"))
    many = spread.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = written(spread.join(many, "bucket"), "members", n * bands)
    typical = members.groupBy("id").agg(F.sum(F.log("n")).alias("t"))
    members = members.join(typical, "id").select("bucket", "id", "t")
    members = written(members, "members", n * bands)
    leader = members.groupBy("bucket").agg(F.max(F.struct("t", "id")).getField("id").alias("leader"))
    pairs = written(members.join(leader, "bucket").filter("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct(), "pairs", n * bands)
    # texts of the nodes that share a bucket with another
    wanted = members.select("id").distinct().join(nodes.select("id", "doc_id", "text_hash"), "id")
    text = docs.select(F.col("doc_id").cast("bigint").alias("i_"), F.xxhash64("text").alias("h_"), F.col("text"))
    texts = wanted.join(text, (F.col("h_") == F.col("text_hash")) & F.col("i_").eqNullSafe(F.col("doc_id"))).select("id", "text").dropDuplicates(["id"])
    texts = written(texts, "texts")
    links = written(verified(pairs, texts, size, least), "links")
    part = written(connected(links), "parts", n)
    # what a bucket holds of different components is compared across them: pairs of rows in small buckets, pairs of blocks in others
    placed = members.join(part, members.id == part.node, "left").select("bucket", members.id, F.coalesce("root", members.id).alias("root"))
    split = placed.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("n")).filter("r0 <> r1").select("bucket", "n")
    open_ = written(placed.join(split, "bucket"), "open", n * bands)
    small = open_.filter(F.col("n") <= SMALL)
    left, right = small.select("bucket", F.col("id").alias("a"), F.col("root").alias("ra")), small.select("bucket", F.col("id").alias("b"), F.col("root").alias("rb"))
    cross = left.join(right, "bucket").filter("ra < rb").select("a", "b").distinct()
    done = pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    more = verified(cross.join(done, ["a", "b"], "left_anti"), texts, size, least)
    large = open_.filter(F.col("n") > SMALL)
    if not large.isEmpty():
        more = more.unionAll(_blocks(large, texts, size, least))
    more = written(more, "links")
    if not more.isEmpty():
        part = written(connected(links.unionAll(more)), "parts", n)
    for x in (texts, members, open_, pairs, links, more):
        discard(x)
    # node -> class, then one join with the rows
    held = nodes.select("id", "node", "low", "n").join(part.select(F.col("node").alias("id"), "root"), "id", "left").select("node", "low", "n", F.coalesce("root", "id").alias("class_"))
    held = written(held, "held", n)
    groups = held.groupBy("class_").agg(F.min("low").alias("class_id"), F.sum("n").alias("class_rows"))
    named = written(reread(held).select("node", "class_").join(groups, "class_").select("node", "class_id", "class_rows"), "named", n)
    found = sigs.select("doc_id", "text_hash", "node").join(named, "node", "left")
    alone = F.col("node").isNull()
    return found.select("doc_id", "text_hash", alone.alias("wordless"), F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_rows", F.lit(1)).cast("bigint").alias("class_rows"))


def near_dedup(docs: DataFrame, **how) -> DataFrame:
    """doc_id, class_id, class_rows, kept of each row; of rows that repeat the kept doc_id one is kept."""
    rows = classes(docs, **how)
    first = rows.groupBy("doc_id", "text_hash", "class_id", "class_rows", "wordless").agg(F.count("*").alias("n"))
    first = first.withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")))
    kept = F.col("doc_id").eqNullSafe(F.col("class_id")) & ((F.col("i") == 1) | F.col("wordless"))
    return first.select("doc_id", "class_id", "class_rows", kept.alias("kept"))


def drop_near(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest doc_id. Wordless rows stay."""
    cols = docs.columns
    found = classes(docs, **how).filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
    stay = found.groupBy(F.col("doc_id").alias("i_"), F.col("text_hash").alias("h_")).agg(F.count("*").alias("ev_n_"), F.max("wordless").alias("ev_w_"))
    rows = docs.join(stay, (F.xxhash64("text") == F.col("h_")) & F.col("doc_id").cast("bigint").eqNullSafe(F.col("i_")))
    plain = F.col("ev_w_") | (F.col("ev_n_") == 1)
    return rows.filter(plain).select(*cols).unionByName(rows.filter(~plain).dropDuplicates(["i_", "h_"]).select(*cols))
