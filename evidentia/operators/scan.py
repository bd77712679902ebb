"""Batches of queries against every document in one pass: no posting is moved, a task keeps the best of its own documents only."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from evidentia.functions import text as T
from evidentia.partitions import kept, sent

#: Query terms a pass; documents a block, and terms; queries a group, so that a group's scores of a block are at most 4 million.
PASS, ROWS, TOKENS, GROUP = 1_000_000, 1024, 500_000, 4096
#: Pairs of a query and a posting at once; the share of (query, document) pairs from which a term is multiplied as a dense row, and how many are.
PAIRS, SHARE, DENSE = 1_000_000, 0.02, 512
SPARSE, OVERLAP = 0, 1


def rounded(x: np.ndarray) -> np.ndarray:
    """Spark's ``round(x, 6)`` of doubles that are not negative: half up of what the number is written as."""
    at = x * 1e6
    out = np.floor(at + 0.5) / 1e6
    near = np.flatnonzero(np.abs(at - np.floor(at) - 0.5) < 1e-5)
    if len(near):
        values, place = np.unique(x[near], return_inverse=True)
        exact = [float(Decimal(repr(v)).quantize(Decimal("0.000001"), ROUND_HALF_UP)) for v in values.tolist()]
        out[near] = np.array(exact)[place]
    return out


@dataclass
class Group:
    """Some queries by term: those of term t are ``query[start[t]:start[t + 1]]``. ``row[t]`` is t's row among the dense terms, or -1."""

    first: int
    n: int
    start: np.ndarray
    query: np.ndarray
    times: np.ndarray
    row: np.ndarray
    dense: np.ndarray
    has: np.ndarray


def grouped(queries: list[list[int]], share: np.ndarray, size: int) -> list[Group]:
    """``queries`` as sorted term numbers, repeats kept; ``share`` of the documents that hold each term."""
    out = []
    for first in range(0, len(queries), size):
        some = queries[first : first + size]
        term = np.array([t for q in some for t in q], np.int64)
        query = np.repeat(np.arange(len(some)), [len(q) for q in some])
        code, times = np.unique(term * len(some) + query, return_counts=True)
        term, query = code // len(some), code % len(some)
        by = np.bincount(term, minlength=len(share))
        worth = by / len(some) * share
        common = np.argsort(-worth, kind="stable")[:DENSE]
        common = common[worth[common] > SHARE]
        row = np.full(len(share), -1, np.int64)
        row[common] = np.arange(len(common))
        dense = np.zeros((len(some), len(common)))
        held = row[term] >= 0
        dense[query[held], row[term[held]]] = times[held]
        out.append(Group(first, len(some), np.r_[0, np.cumsum(by)], query.astype(np.int32), times.astype(float), row, dense, (dense > 0).astype(np.float32)))
    return out


def sums(g: Group, term: np.ndarray, doc: np.ndarray, weight: np.ndarray | None, n: int) -> np.ndarray:
    """(queries, documents): the sum of the weights of a query's terms, as often as it has them; without weights, how many distinct terms are held."""
    row = g.row[term]
    common = row >= 0
    held = np.zeros((g.dense.shape[1], n), g.has.dtype if weight is None else float)
    held[row[common], doc[common]] = 1.0 if weight is None else weight[common]
    out = (g.has if weight is None else g.dense) @ held  # counts are exact in 32 bits
    flat = out.reshape(-1)
    rest = np.flatnonzero(~common & (g.start[term + 1] > g.start[term]))
    many = (g.start[term + 1] - g.start[term])[rest]
    ends = np.cumsum(many)
    at = 0
    while at < len(rest):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        p, m = rest[at:stop], many[at:stop]
        p = np.repeat(p, m)
        k = g.start[term[p]] + np.arange(len(p)) - np.repeat(np.cumsum(m) - m, m)
        flat += np.bincount(g.query[k].astype(np.int64) * n + doc[p], None if weight is None else weight[p] * g.times[k], g.n * n).astype(out.dtype, copy=False)
        at = stop
    return out


class Best:
    """The best ``k`` (score, key) of each query among those offered: scores from the greatest, ties by key."""

    def __init__(self, n: int, k: int, kind: pa.DataType):
        self.k, self.least, self.new = k, np.full(n, -np.inf), 0
        self.rows = pa.table({"q": pa.array([], pa.int64()), "s": pa.array([], pa.float64()), "key": pa.array([], kind)})

    def offer(self, first: int, scores: np.ndarray, keys: pa.Array) -> None:
        """A group's raw scores of a block; those that aren't above 0 are none."""
        n, width = scores.shape
        bound = self.least[first : first + n] - 1e-5  # rounding moves a score by less
        ok = (scores > 0) & (scores >= bound[:, None])
        if width > self.k and ok.sum() > 4 * n * self.k:
            ok &= scores >= (np.partition(scores, width - self.k, axis=1)[:, width - self.k] - 1e-5)[:, None]
        q, d = np.nonzero(ok)
        if not len(q):
            return
        self.rows = pa.concat_tables([self.rows, pa.table({"q": q + first, "s": rounded(scores[q, d]), "key": keys.take(pa.array(d)).cast(self.rows["key"].type)})])
        self.new += len(q)
        if self.new >= max(len(self.least) * self.k // 4, 10_000):
            self.trim()

    def trim(self) -> None:
        rows = self.rows.combine_chunks()
        order = pc.sort_indices(rows.select(["q", "s"]).append_column("key", rows["key"]), [("q", "ascending"), ("s", "descending"), ("key", "ascending")], null_placement="at_start")
        rows = rows.take(order)
        q = rows["q"].to_numpy()
        at = np.arange(len(q)) - np.searchsorted(q, q)
        last = np.flatnonzero(at == self.k - 1)
        self.least[q[last]] = rows["s"].to_numpy()[last]
        self.rows, self.new = rows.filter(pa.array(at < self.k)).combine_chunks(), 0


def blocks(batches):
    """The rows of Arrow batches in blocks of at most ROWS documents and about TOKENS terms."""
    for b in batches:
        ends = np.cumsum(pc.list_value_length(b.column("terms")).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOKENS, "right"))
            stop = min(max(stop, at + 1), at + ROWS)
            yield b.slice(at, stop - at)
            at = stop


def candidates(tokens: DataFrame, terms: DataFrame, stats: DataFrame, key: str, queries: DataFrame, qid: str, qtext: str, kinds: list[int], k: int, p) -> DataFrame:
    """(kind, qid, key, score, rank) of each query's ``k`` best documents by each of ``kinds``, SPARSE (BM25) and OVERLAP, from 0; ties by key. Written once.

    Every document is scored against every query where it lies. Queries of equal terms are one. The distinct queries are held by every task,
    up to PASS terms of them; more take more passes over the documents.
    """
    asked = queries.select(F.col(qid).alias("qid_"), T.tokenize(F.col(qtext)).alias("t_")).groupBy("qid_")
    asked = kept(asked.agg(F.array_sort(F.flatten(F.collect_list("t_"))).alias("terms_")).filter(F.size("terms_") > 0), "asked")
    alike = asked.groupBy("terms_").agg(F.min("qid_").alias("rep_"))
    size = alike.agg(F.sum(F.size("terms_")).alias("n")).first().n or 0
    passes = max(1, -(-size // PASS))
    corpus = stats.first()
    found = None
    for i in range(passes):
        some = alike.filter(F.pmod(F.xxhash64("terms_"), F.lit(passes)) == i) if passes > 1 else alike
        part = _one_pass(tokens, terms, corpus, key, some, kinds, k, p)
        found = part if found is None else found.unionAll(part)
    by = Window.partitionBy("kind", "rep_").orderBy(F.desc("score"), key)
    best = found.withColumn("rank", F.row_number().over(by))
    best = best.filter(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)
    named = asked.join(alike, "terms_").select(F.col("qid_").alias(qid), "rep_")
    named = sent(named)(named.withColumnRenamed("rep_", "named_"))
    return kept(best.join(named, best["rep_"].eqNullSafe(named["named_"])).select("kind", qid, key, "score", "rank"), "ranked")


def _one_pass(tokens: DataFrame, terms: DataFrame, corpus, key: str, alike: DataFrame, ranked: list[int], k: int, p) -> DataFrame:
    spark, schema = tokens.sparkSession, alike.schema
    rows = alike.select("rep_", "terms_").collect()  # at most PASS terms, unless one query has more
    words = alike.select(F.explode("terms_").alias("term")).distinct()
    known = {r.term: (r.df, r.idf) for r in terms.join(sent(words, PASS)(words), "term").select("term", "df", "idf").collect()}
    names = sorted(known)
    number = {t: i for i, t in enumerate(names)}
    idf = np.array([known[t][1] for t in names], float)
    share = np.array([known[t][0] for t in names], float) / max(corpus.n, 1)
    queries = [[number[t] for t in r.terms_ if t in number] for r in rows]
    kinds = to_arrow_type(schema["rep_"].dataType), to_arrow_type(tokens.schema[key].dataType)
    shared = spark.sparkContext.broadcast((names, idf, grouped(queries, share, GROUP), [r.rep_ for r in rows], corpus.avgdl))
    k1, b = p.k1, p.b

    def run(batches):
        names, idf, groups, reps, avgdl = shared.value
        best = {kind: Best(len(reps), k, kinds[1]) for kind in ranked}
        known = pa.array(names, pa.string())
        for part in blocks(batches) if names else ():
            n, lists = part.num_rows, part.column("terms")
            ids = pc.index_in(lists.flatten(), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy(zero_copy_only=False))[ids >= 0]
            code, tf = np.unique(ids[ids >= 0].astype(np.int64) * n + doc, return_counts=True)
            term, doc = code // n, code % n
            dl, held = (part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("dl", "held"))
            weight = idf[term] * tf * (k1 + 1) / (tf + (k1 * (1 - b + b * dl / avgdl))[doc])
            keys = part.column(key)
            for g in groups:
                if SPARSE in best:
                    best[SPARSE].offer(g.first, sums(g, term, doc, weight, n), keys)
                if OVERLAP in best:
                    best[OVERLAP].offer(g.first, sums(g, term, doc, None, n) / np.sqrt(np.maximum(held, 1)), keys)
        for kind, found in best.items():
            found.trim()
            got = found.rows.filter(pc.greater(found.rows["s"], 0)) if kind == SPARSE else found.rows
            out = pa.table({"kind": pa.array(np.full(len(got), kind, np.int32)), "rep_": pa.array(reps, kinds[0]).take(got["q"]), key: got["key"], "score": got["s"]})
            yield from out.combine_chunks().to_batches(max_chunksize=100_000)

    ddl = f"kind int, rep_ {schema['rep_'].dataType.simpleString()}, `{key}` {tokens.schema[key].dataType.simpleString()}, score double"
    return tokens.select(key, "dl", "held", "terms").mapInArrow(run, ddl)
