"""Language identification by rank-order profiles.

A profile is the ``profile`` most frequent 1-, 2- and 3-grams of a language, most frequent first; letters are lower-cased and every other
run of characters is one space. A text's own most frequent n-grams are compared with each profile by out-of-place distance: the sum over
its n-grams of how far the rank differs, ``profile`` where the n-gram is missing. The least distance wins, ties by language name.

Profiles are learned from at most ``sample`` texts a language (those of least hash; a documented bound); scoring reads every whole text.
Null texts and texts without a letter are ``und`` with score 0; null lang is not learned from; any length is handled; repeated rows are
scored each; with nothing to learn from every text is ``und``; other columns are carried along.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import lean, runs, with_fields

UND = "und"


@functools.cache
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: list[str | None]):
    """(document, n-gram code, count) arrays, sorted by document and code. A code is up to three code points of 21 bits."""
    low = [t.lower() if t else "" for t in texts]
    joined = "\n".join(low) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])
    points = np.where(letters()[points], points, 32).astype(np.uint64)
    # one space between words; each document ends with one
    keep = points != 32
    keep[1:] |= (points[:-1] != 32) & (doc[1:] == doc[:-1])
    points, doc = points[keep], doc[keep]
    alphabet, small = np.unique(points, return_inverse=True)
    bits = max(1, int(len(alphabet)).bit_length())
    small = small.astype(np.uint64) + np.uint64(1)
    high = np.uint64(3 * bits)
    docs = doc.astype(np.uint64) << high
    letter = points != 32
    parts = [docs[letter] | small[letter]]
    for n in (2, 3):
        if len(small) >= n:
            code, inside, some = small[: len(small) - n + 1].copy(), doc[n - 1 :] == doc[: len(doc) - n + 1], letter[: len(small) - n + 1].copy()
            for k in range(1, n):
                code = code << np.uint64(bits) | small[k : len(small) - n + 1 + k]
                some |= letter[k : len(small) - n + 1 + k]
            inside &= some
            parts.append((docs[: len(code)] | code)[inside])
    keys = np.sort(np.concatenate(parts))
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    count = np.diff(np.r_[first, len(keys)])
    keys = keys[first]
    doc, rest = (keys >> high).astype(np.int64), keys & np.uint64((1 << (3 * bits)) - 1)
    mask, table = np.uint64((1 << bits) - 1), np.r_[np.uint64(0), alphabet]
    code = np.zeros(len(rest), np.uint64)
    for k in (2, 1, 0):
        code = code << np.uint64(21) | table[(rest >> np.uint64(k * bits) & mask).astype(np.int64)]
    return doc, code, count


def safe(texts: list, most: int = 300_000):
    """runs() whose documents and three letters always fit one 64-bit word."""
    for i, j in runs(texts, most):
        for k in range(i, j, 2048):
            yield k, min(j, k + 2048)


def top(doc: np.ndarray, code: np.ndarray, count: np.ndarray, profile: int):
    """The rows of each document's most frequent n-grams with their ranks from 0; ties by code."""
    at = np.argsort(doc.astype(np.uint64) << np.uint64(36) | (np.uint64(1 << 36) - count.astype(np.uint64)), kind="stable")
    doc = doc[at]
    rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
    keep = rank < profile
    return doc[keep], code[at][keep], rank[keep]


def learn(docs: DataFrame, sample: int = 2000, profile: int = 300) -> list[tuple[str, int, int]]:
    """(language, rank, n-gram code) rows; at most ``profile`` a language come to the driver."""
    hashed = docs.filter("lang is not null and text is not null").select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    # the greatest hash that the sample takes of each language, found without moving texts: as hashes are even, twice the sample's share of
    # them holds the least ones, and only so many are ranked
    rows = hashed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()  # a row a language
    if not rows:
        return []
    cuts = [(r.lang, int(-(2**63) + min(1.0, 2 * sample / max(1, r.n)) * (2**64 - 1))) for r in rows]
    cuts = docs.sparkSession.createDataFrame([(lang, min(cut, 2**63 - 1)) for lang, cut in cuts], "lang string, cut bigint")
    near = hashed.select("lang", "h").join(F.broadcast(cuts), "lang").filter("h <= cut").select("lang", "h").distinct()
    ranked = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("k") <= sample)
    most = [tuple(r) for r in ranked.groupBy("lang").agg(F.max("h")).collect()]
    limits = docs.sparkSession.createDataFrame(most, "lang string, most bigint")
    chosen = hashed.join(F.broadcast(limits), "lang").filter("h <= most").groupBy("lang", "h").agg(F.min("text").alias("text"))  # a repeated row once

    def count(batches):
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in safe(texts):
                doc, code, n = grams(texts[i:j])
                names = np.array(langs[i:j], object)[doc]
                for lang in sorted(set(langs[i:j])):
                    mine = names == lang
                    codes, where = np.unique(code[mine], return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes.astype(np.int64)), pa.array(np.bincount(where, n[mine], len(codes)).astype(np.int64))], names=["lang", "code", "n"])

    counted = chosen.select("lang", "text").mapInArrow(lean(count), "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    return [tuple(r) for r in counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= profile).select("lang", F.col("rank") - 1, "code").collect()]


def identify(docs: DataFrame, model: list[tuple[str, int, int]], profile: int = 300, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the language and a score, 1 less the distance over the largest possible one, in columns of these ``names``, which are replaced."""
    langs = sorted({r[0] for r in model})
    codes = np.array(sorted({r[2] for r in model}), np.uint64)
    ranks = np.full((len(codes), len(langs)), -1, np.int32)
    for lang, rank, code in model:
        ranks[np.searchsorted(codes, np.uint64(code)), langs.index(lang)] = rank

    def score(texts):
        found, scores = [UND] * len(texts), [0.0] * len(texts)
        if not langs:
            return found, scores
        for i, j in safe(texts):
            doc, code, rank = top(*grams(texts[i:j]), profile)
            if not len(doc):
                continue
            at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            known = np.where((codes[at] == code)[:, None], ranks[at], -1)
            away = np.where(known < 0, profile, np.minimum(np.abs(known - rank[:, None]), profile))
            first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            total, n = np.add.reduceat(away, first), np.diff(np.r_[first, len(doc)])
            best = total.argmin(1)
            for d, b, t, m in zip(doc[first], best, total.min(1), n, strict=True):
                found[i + d], scores[i + d] = langs[b], float(1 - t / (profile * m))
        return found, scores

    plain = docs.drop(*names)
    at = plain.columns.index("text")

    def run(batches):
        for b in batches:
            found, scores = score(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, *names])

    return plain.mapInArrow(lean(run), with_fields(plain.schema, f"{names[0]} string, {names[1]} double"))


def held_out(doc_id) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def detect(docs: DataFrame, sample: int = 2000, profile: int = 300) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every text; learned from labelled texts that aren't held out."""
    model = learn(docs.filter(~held_out(F.col("doc_id"))), sample, profile)
    return identify(docs.select("doc_id", "text"), model, profile).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
