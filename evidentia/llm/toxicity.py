"""Toxic spans by a linear-chain conditional random field.

A text is a chain of words, each clean or toxic. State features are the word and its beginnings and endings; transitions join neighbours.
Only documents carry labels, so training tokens are labelled from them: in a toxic document a word is toxic if one of its features is at
least ``ratio`` times as common among the sampled toxic documents as among the clean ones, in ``support`` documents or more. The field is
fitted to these tokens by gradient ascent on the conditional likelihood; what it adds to that list is the weight of each feature and the
words around. Forward-backward marginals give each word's probability; their sum, largest value and density aggregate to a document score
by a logistic fit on the sampled documents, and runs of words more likely toxic than not are the offending spans.

Training takes at most ``sample`` documents a class, those of least hash, and of these the first that have ``most_bytes`` of text together
(documented bounds), in one task; scoring reads every whole text. A doc_id with several texts trains with the least, one with a toxic label
among others is toxic. Null and empty texts get the score of a text without words; ties and repeated rows are scored alike; without both
classes to learn from every score is 0; other columns are ignored.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import Recent, lean, runs, with_fields

WORD = re.compile(r"\w+")
#: Letters of the beginnings and endings that are features.
PREFIXES, SUFFIXES = (3, 4, 5, 6, 7, 8), (4, 6)



def features(word: str) -> list[str]:
    return ["=" + word, *("<" + word[:n] for n in PREFIXES if len(word) > n), *(">" + word[-n:] for n in SUFFIXES if len(word) > n)]


def marginals(emit: np.ndarray, start: np.ndarray, link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) for each word of chains that stand one after another, and the log partition of each chain.

    ``emit`` are log-odds of each word, ``start`` where chains begin (non-empty ones), ``link`` the 2x2 transition scores. Chains run side
    by side, longest first; the odds of the two states obey a two-term recursion, so each step is a few vector operations.
    """
    n = np.diff(np.r_[start, len(emit)])
    order = np.argsort(-n, kind="stable")
    begin, size = start[order], n[order]
    a = np.exp(link)
    g = np.exp(np.clip(emit, -30, 30))
    odds, back, logz = np.zeros(len(emit)), np.ones(len(emit)), np.zeros(len(n))
    live = len(n)
    r = g[begin].copy()
    odds[begin] = r
    z = np.zeros(len(n))
    for t in range(1, int(size[0]) if len(size) else 0):
        while size[live - 1] <= t:
            live -= 1
        x = r[:live]
        base = a[0, 0] + a[1, 0] * x
        z[:live] += np.log(base)
        at = begin[:live] + t
        r[:live] = g[at] * (a[0, 1] + a[1, 1] * x) / base
        odds[at] = r[:live]
    logz[order] = z + np.log1p(r)
    live = 0
    b = np.ones(len(n))
    for t in range(int(size[0]) - 2 if len(size) else -1, -1, -1):
        while live < len(size) and size[live] > t + 1:
            live += 1
        nxt = begin[:live] + t + 1
        y = g[nxt] * b[:live]
        b[:live] = (a[1, 0] + a[1, 1] * y) / (a[0, 0] + a[0, 1] * y)
        back[begin[:live] + t] = b[:live]
    x = odds * back
    return x / (1 + x), logz


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text) if text else []


def summary(p: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Per chain: log expected toxic words, logit of the largest marginal, log density."""
    out = np.tile(np.array([-6.0, -9.0, -9.0]), (len(n), 1))
    some = n > 0
    if some.any():
        total, most = np.add.reduceat(p, start[some]), np.maximum.reduceat(p, start[some])
        most = np.clip(most, 1e-6, 1 - 1e-6)
        out[some] = np.c_[np.log(total + 2.5e-3), np.clip(np.log(most / (1 - most)), -9, 9), np.log(total / n[some] + 1.2e-4)]
    return out


def fit(texts: list[str | None], toxic: list[int], ratio: float = 6.0, support: int = 5, steps: int = 30) -> dict:
    """The model: weights of features, transitions, and the logistic layer."""
    y = np.array(toxic, float)
    if not len(y) or y.min() == y.max():
        return {}
    tokens = [[w.lower() for w in words_of(t)] for t in texts]
    vocabulary: dict[str, int] = {}
    ids = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in ws), np.int64, len(ws)) for ws in tokens]
    names: dict[str, int] = {}
    of_word, of_feature = [], []
    for w, k in vocabulary.items():
        for f in features(w):
            of_word.append(k)
            of_feature.append(names.setdefault(f, len(names)))
    of_word, of_feature = np.array(of_word), np.array(of_feature)
    first = np.searchsorted(of_word, np.arange(len(vocabulary) + 1))
    seen = np.zeros((2, len(names)))
    for d, label in zip(ids, toxic, strict=True):
        if len(d):
            u = np.unique(d)
            seen[label][np.unique(np.concatenate([of_feature[first[k] : first[k + 1]] for k in u]))] += 1
    of_class = np.array([(y == 0).sum(), (y == 1).sum()])
    lift = np.log((seen[1] + 0.5) / (of_class[1] + 1)) - np.log((seen[0] + 0.5) / (of_class[0] + 1))
    used = (seen.sum(0) >= support) & (np.abs(lift) > 0.7)
    strong = (lift >= np.log(ratio)) & (seen[1] >= support)
    toxic_word = np.zeros(len(vocabulary), bool)
    toxic_word[of_word[strong[of_feature]]] = True
    column = np.cumsum(used) - 1
    keep = used[of_feature]
    of_word, of_feature = of_word[keep], column[of_feature[keep]]
    n = np.array([len(d) for d in ids])
    some = np.flatnonzero(n > 0)
    flat = np.concatenate([ids[i] for i in some]) if len(some) else np.zeros(0, np.int64)
    start = np.r_[0, np.cumsum(n[some])[:-1]].astype(np.int64) if len(some) else np.zeros(0, np.int64)
    truth = toxic_word[flat] & np.repeat(y[some] == 1, n[some])
    inner = np.ones(len(flat), bool)
    inner[start] = False
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (truth[:-1].astype(int)[inner[1:]], truth[1:].astype(int)[inner[1:]]), 1)
    link = np.log((pairs + 1) / (pairs + 1).sum(1, keepdims=True))
    weights, bias = np.zeros(int(used.sum())), np.log((truth.sum() + 1) / (len(truth) + 2))
    squares, square0 = np.zeros_like(weights), 0.0
    toxic_per_word = np.bincount(flat[truth], minlength=len(vocabulary)).astype(float)
    for _ in range(steps):
        emit = np.bincount(of_word, weights[of_feature], len(vocabulary)) + bias if len(of_word) else np.full(len(vocabulary), bias)
        p, _ = marginals(emit[flat], start, link)
        expected = np.bincount(flat, p, len(vocabulary))
        gradient = np.bincount(of_feature, (toxic_per_word - expected)[of_word], len(weights)) - 0.1 * weights
        squares += gradient**2
        weights += 0.7 * gradient / (np.sqrt(squares) + 1e-8)
        g0 = float(toxic_per_word.sum() - expected.sum())
        square0 += g0**2
        bias += 0.3 * g0 / (np.sqrt(square0) + 1e-8)
    emit = np.bincount(of_word, weights[of_feature], len(vocabulary)) + bias if len(of_word) else np.full(len(vocabulary), bias)
    p, _ = marginals(emit[flat], start, link)
    whole = np.r_[0, np.cumsum(n)[:-1]].astype(np.int64)
    x = summary(p, whole, n)
    mean, spread = x.mean(0), x.std(0) + 1e-6
    design = np.c_[np.ones(len(x)), (x - mean) / spread]
    layer = np.zeros(design.shape[1])
    prior = np.diag([1e-6, *[1e-2] * (design.shape[1] - 1)])
    for _ in range(25):  # Newton steps of the logistic fit
        q = 1 / (1 + np.exp(-np.clip(design @ layer, -30, 30)))
        layer += np.linalg.solve((design * (q * (1 - q) + 1e-9)[:, None]).T @ design + prior, design.T @ (y - q) - prior @ layer)
    by_feature = {f: float(weights[column[k]]) for f, k in names.items() if used[k] and abs(weights[column[k]]) > 1e-3}
    return {"weights": by_feature, "bias": float(bias), "link": link.tolist(), "mean": mean.tolist(), "spread": spread.tolist(), "layer": layer.tolist()}


class Scorer:
    def __init__(self, model: dict):
        self.model = model
        if model:
            get = model["weights"].get
            bias = model["bias"]
            self.emit = Recent(lambda w: bias + sum(get(f, 0.0) for f in features(w.lower())), 150_000).__getitem__
            self.link = np.array(model["link"])

    def chains(self, texts: list[str | None]):
        """(marginals, starts, lengths) of the texts' words."""
        words = [words_of(t) for t in texts]
        n = np.array([len(w) for w in words], np.int64)
        emit = np.fromiter((e for w in words for e in map(self.emit, w)), float, int(n.sum()))
        start = np.r_[0, np.cumsum(n)[:-1]].astype(np.int64)
        p = marginals(emit, start[n > 0], self.link)[0] if len(emit) else emit
        return p, start, n

    def read(self, texts: list[str | None], threshold: float = 0.5) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """Scores and spans of the texts."""
        if not self.model:
            return np.zeros(len(texts)), [[] for _ in texts]
        p, start, n = self.chains(texts)
        x = (summary(p, start, n) - self.model["mean"]) / self.model["spread"]
        scores = 1 / (1 + np.exp(-np.clip(np.c_[np.ones(len(x)), x] @ np.array(self.model["layer"]), -30, 30)))
        found: list[list[tuple[int, int, float]]] = [[] for _ in texts]
        hits = np.flatnonzero(p >= threshold)
        for d in np.unique(np.searchsorted(start + n, hits, side="right")).tolist():
            found[d] = offending(texts[d], p[start[d] : start[d] + n[d]], threshold)
        return scores, found

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return self.read(texts, 2.0)[0]

    def spans(self, text: str | None, threshold: float = 0.5) -> list[tuple[int, int, float]]:
        return self.read([text], threshold)[1][0]


def offending(text: str, p: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
    """(first character, last + 1, largest marginal) of each run of words whose marginals reach the threshold, as offsets into ``text``."""
    out: list[tuple[int, int, float]] = []
    before = False
    for m, q in zip(WORD.finditer(text), p.tolist(), strict=True):
        if q >= threshold:
            if before:
                out[-1] = (out[-1][0], m.end(), max(out[-1][2], q))
            else:
                out.append((m.start(), m.end(), q))
        before = q >= threshold
    return out


def learn(docs: DataFrame, labels: DataFrame, sample: int = 1500, most_bytes: int = 32 << 20) -> dict:
    """Fits on at most ``sample`` documents a class that have a text and a label and aren't held out, in one task."""
    known = labels.filter("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    there = docs.filter("text is not null").select("doc_id").filter(~held_out(F.col("doc_id")))
    ids = known.join(there, "doc_id", "left_semi").withColumn("h", F.xxhash64("doc_id"))
    # as hashes are even, twice the sample's share of them holds the least ones, and only so many are ranked
    share = ids.groupBy("toxic").agg(F.count("*").alias("n")).select("toxic", F.least(F.lit(1.0), 2.0 * sample / F.col("n")).alias("share"))  # two rows
    near = ids.join(F.broadcast(share), "toxic").filter(F.shiftrightunsigned("h", 11) < F.col("share") * F.lit(float(1 << 53)))
    place = F.row_number().over(Window.partitionBy("toxic").orderBy(F.shiftrightunsigned("h", 11), "doc_id"))
    picked = near.withColumn("k", place).filter(F.col("k") <= sample).select("doc_id", "toxic", "k")
    # at most 2 * sample ids: their texts are found without a shuffle of the others
    chosen = docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("toxic", "k").agg(F.min("text").alias("text"))
    size = F.sum(F.octet_length("text")).over(Window.partitionBy("toxic").orderBy("k"))
    chosen = chosen.withColumn("size", size).filter((F.col("size") <= most_bytes) | (F.col("k") == 1))

    def run(batches):
        texts, toxic = [], []
        for b in batches:
            texts += b.column(0).to_pylist()
            toxic += b.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(fit(texts, toxic))])], names=["model"])

    found = chosen.select("text", "toxic").repartition(1).sortWithinPartitions("toxic", "text").mapInArrow(lean(run), "model string").collect()
    return json.loads(found[0].model) if found else {}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def detect(docs: DataFrame, labels: DataFrame, sample: int = 1500) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending spans of every text."""
    model = learn(docs, labels, sample)
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("marginal", pa.float64())]))


def score(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """doc_id, score and spans (first character, last + 1, largest marginal) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def run(batches):
        scorer = Scorer(shared.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in runs(texts, 1_000_000):
                scores, found = scorer.read(texts[i:j], threshold)
                spans = [[{"first": f, "last": t, "marginal": q} for f, t, q in x] for x in found]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(scores), pa.array(spans, SPANS)], names=["doc_id", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), with_fields(docs.select("doc_id").schema, "score double, spans array<struct<first:int,last:int,marginal:double>>"))
