"""The pipeline against a brute-force version, and what its stages do with odd rows."""

from collections import Counter

import numpy as np
import public_tokenizers
import zlib
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_llm import brute_classes

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without_repeats(texts):
    data = [t.encode() for t in texts]
    seen = Counter(t[p : p + 400] for t in data for p in range(len(t) - 399))
    for t in data:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 399):
            if seen[t[p : p + 400]] > 1:
                gone[p : p + 400] = True
        yield np.frombuffer(t, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")


def test_run_is_the_brute_force_pipeline(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [(d, t) for d, t in rows if t and any(c.isalpha() for c in t)]
    last = {}
    for d, t in rows:
        last[t.translate(LOW)] = max(d, last.get(t.translate(LOW), d))
    rows = sorted((d, t) for d, t in rows if last[t.translate(LOW)] == d)
    classes = brute_classes(rows)
    rows = [(d, t) for d, t in rows if classes[d] == d]
    cut = dict(zip([d for d, _ in rows], without_repeats([t for _, t in rows]), strict=True))
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for d, t in cut.items():
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        want.update((d, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes()), len(ids)) for s in range(0, len(ids), 4096))
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    room = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert room.get(r.sequence_id, 0) == r.offset
        room[r.sequence_id] = r.offset + r.length
    total = sum(room.values())
    assert max(room.values()) <= 4096 and sorted(room) == list(range(len(room))) and len(room) <= -(-total // 4096) + 1


def test_stages_keep_columns_and_odd_rows(spark):
    text = "a text of some length that says a thing or two in plain words and goes on for a while "
    rows = [(1, text * 9, None, "mine", 5), (2, None, "en", "x", 0), (3, "", "en", "x", 0), (4, "12 !!", None, None, 0), (None, text + "without an id", None, "y", 1), (6, text.upper() * 9, None, "z", 2), (1, text * 9, None, "again", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score int")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept.count(), stage(spark, kept, SF)
        assert kept.columns == docs.columns and kept.count() <= before, name
        if name == "language_id":  # nothing to learn from: texts with a letter stay, with the user's columns
            assert sorted(r.lang_pred for r in kept.collect()) == ["again", "mine", "y", "z"]
        if name == "exact_dedup":
            assert sorted(str(r.doc_id) for r in kept.collect()) == ["6", "None"]
    labelled = docs.withColumn("lang", F.lit("en"))
    assert sorted(r.lang_pred for r in corpus_pipeline.STAGES[0][1](spark, labelled, SF).collect()) == ["again", "mine", "y", "z"]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
