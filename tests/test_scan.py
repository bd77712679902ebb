import math
import random
from collections import Counter
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidentia.operators import retrieval, scan

half_up = lambda v: float(Decimal(repr(v)).quantize(Decimal("0.000001"), ROUND_HALF_UP))


def brute(docs, queries, k):
    """The two rankings of (id, terms) queries over (id, terms) documents, each as a set of (query, document, score, rank)."""
    n, avgdl = len(docs), sum(len(t) for _, t in docs) / len(docs)
    df = Counter(w for _, t in docs for w in set(t))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    idf = {w: v if v >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, v in raw.items()}
    out = set(), set()
    for q, asked in queries:
        lexical, bm = [], []
        for d, t in docs:
            tf = Counter(t)
            if held := set(asked) & set(t):
                lexical.append((-half_up(len(held) / math.sqrt(len(tf))), d))
                bm.append((-half_up(sum(c * idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / avgdl)) for w, c in Counter(asked).items() if w in held)), d))
        for found, rows in zip(out, (lexical, [r for r in bm if r[0] < 0]), strict=True):
            found |= {(q, d, -s, i) for i, (s, d) in enumerate(sorted(rows)[:k])}
    return out


@pytest.mark.parametrize("small", [False, True])
def test_one_pass_is_brute_force(spark, monkeypatch, small):
    if small:  # several passes over the documents, groups of two queries
        monkeypatch.setattr(scan, "PASS", 9)
        monkeypatch.setattr(scan, "GROUP", 2)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    some = lambda n: [words[min(int(rng.expovariate(0.12)), 39)] for _ in range(n)]
    docs = [(i, some(rng.randint(1, 30))) for i in range(90)]
    docs += [(90 + i, docs[3][1]) for i in range(20)]  # copies: ties go by id
    queries = [(i, some(rng.randint(1, 8))) for i in range(12)] + [(50, ["nowhere"])]
    queries += [(60, queries[0][1][::-1]), (61, queries[0][1])]  # equal terms
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "d long, t string").repartition(3)
    asked = spark.createDataFrame([(i, " ".join(t)) for i, t in queries] + [(70, None), (71, "?")], "q int, t string")
    index = retrieval.tokens(rows, "d", "t").cache()
    stats = retrieval.corpus_stats(rows, "t", index)
    found = retrieval.both_ranked(index, retrieval.term_stats(retrieval.document_counts(index), stats), stats, "d", asked, "q", "t", 6)
    for got, want in zip(found, brute(docs, queries, 6), strict=True):
        assert {(r.q, r.d, r.score, r.rank) for r in got.collect()} == want and got.count() == len(want)


def test_no_posting_is_moved(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "d long, t string")
    index = retrieval.tokens(docs, "d", "t")
    stats = retrieval.corpus_stats(docs, "t", index)
    terms = retrieval.term_stats(retrieval.document_counts(index), stats)
    alike = spark.createDataFrame([(7, ["b"])], "rep_ long, terms_ array<string>")
    plan = scan._one_pass(index, terms, stats.first(), "d", alike, [scan.OVERLAP, scan.SPARSE], 5, retrieval.Params())._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan and "Join" not in plan.split("== Physical Plan ==")[1]


def test_rows_of_one_key_are_one_document(spark):
    docs = spark.createDataFrame([(1, "a b a"), (1, "b c"), (2, None), (3, "")], "d long, t string")
    got = {r.d: (sorted(r.terms), r.dl, r.held) for r in retrieval.tokens(docs, "d", "t").collect()}
    assert got == {1: (["a", "a", "b", "b", "c"], 3, 3), 2: ([], 0, 0), 3: ([], 0, 0)}
    assert {r.term: r.df for r in retrieval.document_counts(retrieval.tokens(docs, "d", "t")).collect()} == {"a": 1, "b": 1, "c": 1}


def test_dense_and_sparse_terms_add_up(monkeypatch):
    monkeypatch.setattr(scan, "PAIRS", 5)
    rng = np.random.default_rng(6)
    queries = [sorted(rng.integers(0, 30, rng.integers(1, 9)).tolist()) for _ in range(11)]
    n = 17
    code = np.unique(rng.integers(0, 30 * n, 200))
    term, doc, weight = code // n, code % n, rng.random(len(code))
    full = np.zeros((30, n))
    full[term, doc] = weight
    for share in (np.zeros(30), np.ones(30), rng.random(30)):
        for g in scan.grouped(queries, share, 4):
            times = np.array([[queries[g.first + i].count(t) for t in range(30)] for i in range(g.n)], float)
            assert np.allclose(scan.sums(g, term, doc, weight, n), times @ full) and np.array_equal(scan.sums(g, term, doc, None, n), (times > 0) @ (full > 0).astype(float))


def test_best_are_those_of_all():
    rng = np.random.default_rng(7)
    best, all_ = scan.Best(5, 3, pa.string()), []
    for _ in range(60):
        keys = [str(v) for v in rng.integers(0, 10**6, 40)]
        scores = rng.integers(0, 30, (5, 40)) / 8.0
        best.offer(0, scores, pa.array(keys))
        all_ += [(q, -scores[q, j], keys[j]) for q in range(5) for j in range(40) if scores[q, j] > 0]
    best.trim()
    want = [r for q in range(5) for r in sorted(x for x in all_ if x[0] == q)[:3]]
    assert [(r["q"], -r["s"], r["key"]) for r in best.rows.to_pylist()] == want


def test_rounding_is_sparks(spark):
    values = [0.0078125, 1 / 3, 2.0000005, 1.0000015, 123.4567895, 4e-7, 5e-7, 17.25] + np.random.default_rng(8).random(500).tolist() + [k / 1e6 + 5e-7 for k in range(500)]
    want = [r.v for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(F.round("v", 6).alias("v")).collect()]
    assert scan.rounded(np.array(values)).tolist() == want
