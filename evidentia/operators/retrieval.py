"""Lexical index, ranked retrieval and fusion over batches of queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from evidentia.functions import text as T
from evidentia.operators import scan
from evidentia.partitions import kept, sent


@dataclass(frozen=True)
class Params:
    dense_k: int = 40
    sparse_k: int = 40
    rrf_k: int = 60
    final_k: int = 8
    authority: float = 0.6
    threshold: float = -6.0
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25


def tokens(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, terms, dl, held), a row a document, with or without terms: dl is the text's length in terms, held its distinct ones. No text is moved.

    Rows of one key are one document of one of their lengths; only where there are such rows are texts gathered by key.
    """
    rows = docs.select(key, F.coalesce(T.tokenize(F.col(text)), F.array().cast("array<string>")).alias("terms"))
    rows = rows.select(key, "terms", F.size("terms").cast("bigint").alias("dl"))  # a filter by it would go below and make the terms twice
    if docs.groupBy(key).count().filter("count > 1").limit(1).count():
        rows = rows.groupBy(key).agg(F.flatten(F.collect_list("terms")).alias("terms"), F.max("dl").alias("dl"))
    return rows.withColumn("held", F.size(F.array_distinct("terms")))


def document_counts(index: DataFrame) -> DataFrame:
    """(term, df) of ``tokens``."""
    return index.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(docs: DataFrame, text: str, index: DataFrame) -> DataFrame:
    """One row: n documents and average length in terms of those that have a text, from their ``tokens``."""
    n = docs.agg(F.count("*").alias("n"), F.count(text).alias("texts"))
    return n.crossJoin(F.broadcast(index.agg(F.sum(F.size("terms")).alias("all")))).select("n", (F.coalesce("all", F.lit(0)) / F.nullif("texts", F.lit(0))).alias("avgdl"))  # one row each


def term_stats(df: DataFrame, stats: DataFrame, epsilon: float = 0.25) -> DataFrame:
    """(term, df, idf) of (term, df): negative idf is replaced by epsilon times the mean idf of all terms."""
    raw = df.crossJoin(F.broadcast(stats)).select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))  # one row
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def top_k(rows: DataFrame, by: str, order: list[Column], k: int, rank: str) -> DataFrame:
    """The first k of each group with a rank from 0. The filter is on the rank from 1, which Spark cuts before the shuffle."""
    ranked = rows.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col(rank) <= k)
    return ranked.withColumn(rank, F.col(rank) - 1)


def bm25(docs: DataFrame, key: str, text: str, queries: DataFrame, qid: str, qtext: str, k: int, p: Params = Params()) -> DataFrame:
    """(qid, key, score, rank) of the k best documents of each query; ties by key. For one call: an index that is kept is not built each time."""
    index = kept(tokens(docs, key, text), "tokens")
    stats = kept(corpus_stats(docs, text, index), "stats")
    return ranked(index, term_stats(document_counts(index), stats, p.epsilon), stats, key, queries, qid, qtext, k, p)


def ranked(index: DataFrame, terms: DataFrame, stats: DataFrame, key: str, queries: DataFrame, qid: str, qtext: str, k: int, p: Params = Params()) -> DataFrame:
    """``bm25`` over an index that is there already, in one pass over its ``tokens``."""
    return scan.candidates(index, terms, stats, key, queries, qid, qtext, [scan.SPARSE], k, p).drop("kind")


def both_ranked(index: DataFrame, terms: DataFrame, stats: DataFrame, key: str, queries: DataFrame, qid: str, qtext: str, k: int, p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """(overlap, ``ranked``) in one pass. The first is a lexical ranking where there is no embedder: distinct query terms a document holds over the root of its distinct terms."""
    found = scan.candidates(index, terms, stats, key, queries, qid, qtext, [scan.OVERLAP, scan.SPARSE], k, p)
    return tuple(found.filter(F.col("kind") == kind).drop("kind") for kind in (scan.OVERLAP, scan.SPARSE))


def lexical_score(asked: Column, text: Column, most: int = 2000) -> Column:
    """The second ranker where no model is given: the share of the query's distinct terms that the text's first ``most`` characters hold.

    It stays inside Catalyst. Like models of this kind it reads the beginning of a passage, as passages are cut to such a length.
    """
    want = F.array_distinct(T.tokenize(asked))
    held = F.array_intersect(want, T.tokenize(F.substring(text, 1, most)))
    return F.round(F.coalesce(F.size(held), F.lit(0)) / F.greatest(F.size(want), F.lit(1)), 6)


def dense(vectors: DataFrame, key: str, vector: str, queries: DataFrame, qid: str, qvector: str, k: int, most_bytes: int = 64 << 20) -> DataFrame:
    """(qid, key, score, rank): exact inner products of a checked, bounded query set with every row, in blocks of rows."""
    wide = queries.select(qid, queries[qvector].cast("array<double>").alias("v_"))
    size = wide.agg(F.sum(F.size("v_") * 8 + 64).alias("n")).first().n or 0  # before any vector moves
    if size > most_bytes:
        raise ValueError(f"queries of {size} bytes are too many for one pass: give them in several")
    asked = [(r[0], r[1]) for r in wide.filter("v_ is not null").collect()]
    shared = vectors.sparkSession.sparkContext.broadcast(asked)
    id_type = to_arrow_type(queries.schema[qid].dataType)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        ids, q = [i for i, _ in shared.value], np.array([v for _, v in shared.value], float)
        for b in batches:
            x = np.array(b.column(1).to_pylist(), float)
            if not len(x) or not len(q):
                continue
            s = np.round(q @ x.T, 6)
            keys = b.column(0).to_pylist()
            best = [sorted(range(len(keys)), key=lambda j, r=r: (-r[j], keys[j]))[:k] for r in s]
            asked_by = pa.array([ids[i] for i, js in enumerate(best) for _ in js], id_type)
            yield pa.RecordBatch.from_arrays(
                [asked_by, pa.array([keys[j] for js in best for j in js], b.schema.field(0).type), pa.array([float(s[i][j]) for i, js in enumerate(best) for j in js])],
                names=[qid, key, "score"],
            )

    kinds = dict(vectors.dtypes)[key], dict(queries.dtypes)[qid]
    rows = vectors.select(F.col(key), F.col(vector).cast("array<double>")).mapInArrow(run, f"{qid} {kinds[1]}, {key} {kinds[0]}, score double")
    return top_k(rows, qid, [F.desc("score"), F.col(key)], k, "rank")


def fuse(first: DataFrame, second: DataFrame, qid: str, key: str, k: int = 60, names: tuple[str, str] = ("dense", "sparse")) -> DataFrame:
    """Reciprocal-rank fusion: (qid, key, first_rank, second_rank, rrf, found_by, pool_rank). found_by is by the rankings' ``names``."""
    a = first.select(qid, key, F.col("rank").alias("first_rank"))
    b = second.select(qid, key, F.col("rank").alias("second_rank"))
    part = lambda c: F.coalesce(1.0 / (k + F.col(c) + 1), F.lit(0.0))
    both = a.join(b, [qid, key], "full").withColumn("rrf", F.round(part("first_rank") + part("second_rank"), 9))
    both = both.withColumn("found_by", F.concat_ws("+", F.when(F.col("first_rank").isNotNull(), F.lit(names[0])), F.when(F.col("second_rank").isNotNull(), F.lit(names[1]))))
    order = [F.desc("rrf"), F.asc_nulls_last("first_rank"), F.asc("second_rank")]
    return both.withColumn("pool_rank", F.row_number().over(Window.partitionBy(qid).orderBy(*order)) - 1)


def retrieve(fused: DataFrame, sources: DataFrame, qid: str, key: str, keep: list[str] | None = None, score: Column | None = None, p: Params = Params()) -> DataFrame:
    """Pool, rerank, prior, final cut and tags. ``sources`` has (key, source, authority_rank); ``score`` is the reranker's, else the rrf.

    The source filter stands behind the candidate cut, so a query may keep fewer than final_k. Few candidates are sent to the sources, so that no
    source is moved.
    """
    pool = sent(fused)(fused).join(sources, key)
    if keep is not None:
        pool = pool.filter(F.col("source").isin(keep))
    pool = top_k(pool, qid, [F.col("pool_rank")], max(p.dense_k, p.sparse_k), "pool")
    pool = pool.withColumn("rerank", score if score is not None else F.col("rrf"))
    bonus = p.authority * (4 - F.least(F.coalesce("authority_rank", F.lit(5)), F.lit(4)))
    pool = pool.withColumn("adjusted", F.round(F.col("rerank") + bonus, 9))
    return top_k(pool, qid, [F.desc("adjusted"), F.col("pool")], p.final_k, "final_rank").withColumn("tag", F.concat(F.lit("S"), F.col("final_rank") + 1))


def abstain(queries: DataFrame, results: DataFrame, qid: str, threshold: float) -> DataFrame:
    """(qid, abstain, reason): no candidate, or the raw score of the first by adjusted score is below the threshold."""
    first = results.filter("final_rank = 0").select(qid, F.col("rerank").alias("best"))
    reason = F.when(F.col("best").isNull(), F.lit("no candidates")).when(F.col("best") < threshold, F.lit("low score"))
    return queries.select(qid).join(first, qid, "left").select(qid, reason.isNotNull().alias("abstain"), reason.alias("reason"))
