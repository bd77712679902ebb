import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evidentia.llm import bpe, embeddings, exact_dedup, langid, licenses, minhash, packing, sharding, shingles, suffix, toxicity
from evidentia.llm.common import connected

SF = "/root/testdata/sf0.001"
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, node string, shard int, length int, n long, score double"
rng = random.Random(5)
LONG = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(60_000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))
COPY = " ".join(f"word{i}" for i in range(120))
NEAR = COPY.replace("word60", "changed")
TEXTS = [
    (1, None), (2, ""), (3, "   "), (4, COPY), (5, COPY.upper()), (6, NEAR), (7, LONG), (8, "x " + PASSAGE + " y" * 300), (9, "z" * 90 + PASSAGE + " w"), (10, "12345 !!! 67"),
    (11, COPY), (11, COPY), (12, "short one"), (13, "short one"), (None, "no id here at all, none"), (14, "é ☃ <|endoftext|> don't\n\n  x"), (15, "ab" * 2000), (16, "Released under the MIT License. " + "fine " * 30),
    (17, "\u0938\u095c\u0915 par, \u095c. \u0130stanbul"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i and i % 2 else None, "s", None, "d", "n", 1, 2, 3, 0.5) for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(t):
    return t or ""


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for f in (
        lambda d: bpe.bpe_digests(d, BYTES), exact_dedup.exact_dedup, exact_dedup.drop_exact, langid.detect, lambda d: packing.pack(d, WORDS), lambda d: toxicity.detect(d, labels),
        sharding.shard_documents, minhash.near_dedup, minhash.drop_near, suffix.cut_repeats, suffix.without_repeats, licenses.scan_licenses,
    ):
        assert f(empty).count() == 0
    assert embeddings.near_vectors(vectors).count() == 0


def test_bpe(docs):
    tok = Tokenizer.from_file(BYTES)
    want = sorted((hashlib.sha256(",".join(map(str, e.ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(e.ids, skip_special_tokens=False).encode()).hexdigest(), len(e.ids)) for e in (tok.encode(plain(t), add_special_tokens=False) for _, t in TEXTS))
    assert sorted((r.ids_sha256, r.decoded_sha256, r.n_tokens) for r in bpe.bpe_digests(docs, BYTES).collect()) == want
    back = bpe.bpe_decode(bpe.bpe_encode(docs.select("doc_id", "text"), BYTES).withColumnRenamed("text", "was"), BYTES)
    assert back.filter(F.coalesce("was", F.lit("")) != F.col("text")).count() == 0


def test_bpe_random():
    enc, tok = bpe.Encoder(BYTES), Tokenizer.from_file(BYTES)
    for _ in range(500):
        t = "".join(rng.choice(" \n\tabceth'1.,é日́🙂<|>aaaa") for _ in range(rng.randint(0, 60)))
        ids = enc.ids(t)
        assert [int(i) for i in ids.split(",") if i] == tok.encode(t, add_special_tokens=False).ids and enc.text(ids) == t


def test_exact(docs):
    rows = exact_dedup.exact_dedup(docs).collect()
    assert len(rows) == len(TEXTS)
    group = [r for r in rows if r.doc_id in (4, 5, 11)]
    assert all(r.keep_id == 11 and r.group_size == 4 for r in group) and sum(r.kept for r in group) == 1
    assert sum(r.kept for r in rows) == len({plain(t).lower() for _, t in TEXTS})
    kept = exact_dedup.drop_exact(docs)
    assert kept.columns == docs.columns and kept.count() == len({plain(t).lower() for _, t in TEXTS})


def test_index_persists(spark, docs, tmp_path):
    path = str(tmp_path / "index")
    exact_dedup.exact_dedup(docs, path, 4).collect()
    n = exact_dedup.DigestIndex(spark, path).read().count()
    more = spark.createDataFrame([(100, COPY), (101, "new text"), (102, "new text")], "doc_id long, text string")
    for _ in range(2):  # the same batch again, as after a failure: the same rows, nothing added
        rows = {r.doc_id: r for r in exact_dedup.exact_dedup(more, path).collect()}
        assert not rows[100].kept and (rows[100].keep_id, rows[100].group_size) == (11, 4)
        assert rows[102].kept and not rows[101].kept and rows[101].group_size == 2
        assert exact_dedup.DigestIndex(spark, path).read().count() == n + 1
    with pytest.raises(ValueError, match="4 buckets"):
        exact_dedup.exact_dedup(more, path, 7)
    assert exact_dedup.DigestIndex(spark, path).buckets == 4
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    try:  # another session's default doesn't matter
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        assert not any(r.kept for r in exact_dedup.exact_dedup(docs.filter("doc_id = 4"), path).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert exact_dedup.DigestIndex(spark, path).read().count() == n + 1
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("digest_index")]
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "file").write_text("x")
    with pytest.raises(ValueError, match="no digest index"):
        exact_dedup.DigestIndex(spark, str(tmp_path / "other"))


def test_language(spark, docs):
    rows = {(r.doc_id, r.text): r for r in langid.identify(docs, langid.learn(docs)).collect()}
    assert {rows[k].lang_pred for k in rows if k[0] in (1, 2, 3, 10)} == {"und"} and all(0 <= r.score <= 1 for r in rows.values())
    table = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.detect(table).join(table.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95


def test_rank_order_matches_brute_force():
    texts = ["Das ist ein Haus und das ist gut", "the house and the mouse", "", "a1b a1b", "x"]
    doc, code, count = langid.grams(texts)
    for k, t in enumerate(texts):
        s = " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
        s = (" " if t and not t[0].isalpha() else "") + s
        want = Counter(s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1))
        want = {g: c for g, c in want.items() if g.strip()}
        got = {"".join(chr(int(x) >> 21 * j & (1 << 21) - 1) for j in (2, 1, 0) if int(x) >> 21 * j & (1 << 21) - 1): int(c) for x, c in zip(code[doc == k], count[doc == k], strict=True)}
        assert got == (want if t else {})


def test_language_is_the_least_distance(spark):
    """Predictions and scores against out-of-place distances counted gram by gram."""
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = {r.doc_id: r for r in langid.detect(spark.read.parquet(f"{SF}/documents.parquet")).collect()}

    def ranked(counts):
        return {g: k for k, (g, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], [0] * (3 - len(x[0])) + [ord(c) for c in x[0]]))[:300])}

    def grams(t):
        s = "".join(c if c.isalpha() else " " for c in (t or "").lower())
        s = (" " if s[:1] == " " else "") + " ".join(s.split()) + " "
        return Counter(g for n in (1, 2, 3) for i in range(len(s) - n + 1) if (g := s[i : i + n]).strip())

    learned = {}
    for d, t, lang in rows:
        if lang is not None and zlib.crc32(str(d).encode()) % 4 != 2:
            learned.setdefault(lang, Counter()).update(grams(t))
    profiles = {lang: ranked(c) for lang, c in learned.items()}
    for d, t, _ in rows:
        mine = ranked(grams(t))
        away = {lang: sum(min(300, abs(p[g] - k)) if g in p else 300 for g, k in mine.items()) for lang, p in profiles.items()}
        best = min(sorted(away), key=away.get) if mine else "und"
        assert out[d].lang_pred == best and abs(out[d].score - (1 - away[best] / (300 * len(mine)) if mine else 0)) < 1e-9
        assert out[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2)


def test_packing(docs):
    tok = Tokenizer.from_file(WORDS)
    ids = [[*tok.encode(plain(t), add_special_tokens=False).ids, 2] for _, t in TEXTS]
    rows = packing.pack(docs, WORDS).collect()
    assert sum(r.length for r in rows) == sum(map(len, ids))
    want = Counter((s, zlib.crc32(np.array(i[s : s + 4096], "<u4").tobytes())) for i in ids for s in range(0, len(i), 4096))
    assert Counter((r.start, r.ids_crc32) for r in rows) == want
    by = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert by.setdefault(r.sequence_id, 0) == r.offset
        by[r.sequence_id] += r.length
    assert max(by.values()) <= 4096 and sorted(by) == list(range(len(by)))


def test_packing_spells_every_letter():
    """Each letter inside, before and behind others, and before punctuation, as the library does."""
    encoder = packing.Tokens(WORDS)
    letters = [c for c in map(chr, range(0x110000)) if c.isalpha() or (0x300 <= ord(c) < 0x370)]
    for form in ("x{0}y", "b{0}, {0}.", "ab{0}; é{0}.) {0}{0}1"):
        for i in range(0, len(letters), 64):
            text = " k ".join(form.format(c) for c in letters[i : i + 64])
            pieces = encoder.pieces(text)
            encoder.meet([pieces])
            assert encoder.encode(pieces) == encoder.all(text), hex(ord(letters[i]))


def test_fullest_is_best():
    for _ in range(200):
        counts, room = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(5)}, rng.randint(1, 60)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * i for s in sums for i in range(n + 1) if s + k * i <= room}
        used = packing.fullest(counts, room)
        assert sum(k * n for k, n in used.items()) == max(sums) and all(n <= counts[k] for k, n in used.items())


def test_crf_marginals():
    import itertools

    link, emit = np.array([[0.3, -1.0], [0.2, 0.9]]), np.array([0.5, -0.7, 1.2, 0.1, -2.0])
    start = np.array([0, 3])
    p, logz = toxicity.marginals(emit, start, link)
    for k, (a, b) in enumerate(((0, 3), (3, 5))):
        weight = {y: np.exp(sum(emit[a + i] * v for i, v in enumerate(y)) + sum(link[u, v] for u, v in zip(y, y[1:], strict=False))) for y in itertools.product((0, 1), repeat=b - a)}
        total = sum(weight.values())
        assert np.isclose(np.log(total), logz[k])
        for i in range(b - a):
            assert np.isclose(p[a + i], sum(w for y, w in weight.items() if y[i]) / total)


def test_toxicity(spark, docs):
    rows = toxicity.detect(docs, spark.createDataFrame([(4, 1), (6, 0), (None, 1)], "doc_id long, toxic int")).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
    texts = ["you idiot of a man, what a fool " + f"w{i}" * 3 for i in range(40)] + [f"a calm and friendly line number{i} here" for i in range(40)]
    model = toxicity.fit(texts, [1] * 40 + [0] * 40)
    s = toxicity.Scorer(model)
    assert s.scores(["idiot and fool"])[0] > 0.5 > s.scores(["a calm line here"])[0]
    for text in ("such an idiot here", "\u0130\u0130\u0130 such an Idiot here", "Idiot"):  # offsets are into the text as it is
        assert [text[a:b].lower() for a, b, _ in s.spans(text)] == ["idiot"]
    scores, spans = s.read(["", None, "calm", "an idiot, then a calm line and a fool"])
    assert [len(x) for x in spans] == [0, 0, 0, 2] and scores[0] == scores[1] < 0.5


def test_toxicity_learns_from_what_it_says(spark):
    """Labels that clash count as toxic, of several texts the least is read, held-out rows and long texts beyond the bound are not."""
    rows = [(i, ("you idiot " if i % 2 else "a calm friend ") + f"word{i}") for i in range(400)]
    rows += [(1, "zzz a calm text that is never read")] * 3
    docs_ = spark.createDataFrame([(i, t, 0.5, "x") for i, t in rows], "doc_id long, text string, score double, predicted string")
    labels = spark.createDataFrame([(i, i % 2, "s") for i in range(400)] + [(3, 0, "s"), (5, 7, "s"), (None, 1, "s")], "doc_id long, toxic int, text string")
    a, b = (toxicity.learn(d, labels) for d in (docs_, docs_.orderBy(F.desc("text")).repartition(5)))
    assert a == b and a["weights"]["=idiot"] > 0 > a["weights"].get("=calm", -1)
    got = toxicity.detect(docs_, labels).collect()
    assert len(got) == 403 and all((r.predicted == 1) == (r.doc_id % 2 == 1) for r in got if r.doc_id != 1)
    assert {r.doc_id: r.held_out for r in got} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(400)}
    assert toxicity.learn(docs_, labels, most_bytes=1) != a


def test_sharding(docs):
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.shard < 24 for r in rows)
    assert sorted((r["size"], r.text_crc32) for r in rows) == sorted((len(plain(t).encode()) + 8, zlib.crc32(plain(t).encode())) for _, t in TEXTS)
    for s in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert len({(r.text_digest, r.shard) for r in rows}) == len({r.text_digest for r in rows})


def test_best_fit():
    """Counts of sizes give what item by item gives."""
    for _ in range(100):
        sizes = [rng.randint(1, 40) for _ in range(60)]
        rooms, want = [], Counter()
        for s in sorted(sizes, reverse=True):
            fit = [i for i, r in enumerate(rooms) if r >= s]
            b = min(fit, key=lambda i: (rooms[i], i)) if fit else len(rooms)
            rooms += [50] * (b == len(rooms))
            rooms[b] -= s
            want[s, b] += 1
        runs, bins = sharding.best_fit_decreasing(Counter(sizes), 50)
        got = Counter()
        for s, first, last, b in runs:
            got[s, b] += last - first
        assert got == want and bins == len(rooms)


def test_even_shards():
    for _ in range(100):
        counts, shards = Counter(rng.randint(1, 40) for _ in range(200)) + Counter([rng.randint(1, 4000)]), rng.randint(1, 9)
        runs, load = sharding.even_shards(counts, shards), Counter()
        for s in counts:
            parts = sorted((first, last) for size, first, last, _ in runs if size == s)
            assert parts[0][0] == 0 and parts[-1][1] == counts[s] and all(x[1] == y[0] for x, y in zip(parts, parts[1:], strict=False))
        for s, first, last, b in runs:
            load[b] += s * (last - first)
        assert set(load) <= set(range(shards))
        small = [n for n in load.values() if n < max(counts)] if max(counts) * shards > load.total() else list(load.values())
        assert max(small, default=0) - min(small, default=0) <= 40  # no further apart than an item


def test_sharding_is_even_and_keeps_to_capacity(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sizes = Counter()
    for r in sharding.shard_documents(table).collect():
        sizes[r.shard] += r["size"]
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) <= 0.01 * max(sizes.values())
    many = spark.range(60_000).selectExpr("id as doc_id", "concat('t', repeat('x', cast(id % 13 as int)), id) as text")  # more shards than any fixed number of bundles
    rows = sharding.shard_documents(many, capacity=60).groupBy("shard").agg(F.sum("size").alias("n"), F.count("*").alias("k")).agg(F.max("n"), F.count("*"), F.sum("k")).first()
    assert rows[0] <= 60 and rows[1] > 16_384 and rows[2] == 60_000
    large = spark.createDataFrame([(1, "a" * 500), (2, "b"), (3, "b"), (4, "c" * 30)], "doc_id long, text string")
    got = {r.doc_id: r.shard for r in sharding.shard_documents(large, capacity=60).collect()}
    assert got[2] == got[3] and list(got.values()).count(got[1]) == 1


def test_minhash(docs):
    rows = minhash.near_dedup(docs).collect()
    assert len(rows) == len(TEXTS)
    assert all(r.class_id == 4 and r.class_rows == 5 for r in rows if r.doc_id in (4, 5, 6, 11))
    assert sum(r.kept for r in rows if r.doc_id in (4, 5, 6, 11)) == 1
    assert all(r.kept and r.class_rows == 1 for r in rows if r.doc_id in (1, 2, 3))
    kept = minhash.drop_near(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in rows)


def shingle_counts(t):
    words = shingles.find_words((t or "").lower())
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def brute_classes(rows):
    """The smallest id of each row's class by the similarity of all pairs, id by id."""
    counts = [shingle_counts(t) for _, t in rows]
    total, root = [c.total() for c in counts], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for i, c in enumerate(counts):
        met = Counter()
        for s, n in c.items():
            for j, m in where.get(s, ()):
                met[j] += min(n, m)
            where.setdefault(s, []).append((i, n))
        for j, both in met.items():
            if both >= 0.8 * (total[i] + total[j] - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


def test_minhash_classes_are_those_of_all_pairs(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute_classes([(r.doc_id, r.text) for r in table.collect()])
    got = {r.doc_id: (r.class_id, r.kept) for r in minhash.near_dedup(table).collect()}
    assert len({c for c in want.values()}) < len(want)
    assert got == {d: (c, c == d) for d, c in want.items()}


def test_bag_minhash_is_unbiased():
    g = np.random.default_rng(0)
    e = minhash.mix64(np.arange(60, dtype=np.uint64))
    a = g.integers(0, 12, 60) ** 2
    b = np.maximum(0, a + g.integers(-4, 5, 60))
    sign = minhash.bag_minhash(np.r_[np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)], np.r_[e[a > 0], e[b > 0]], np.r_[a[a > 0], b[b > 0]], 2, 4096)
    assert abs((sign[0] == sign[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.02


def test_minhash_large_group_without_center(spark):
    """Copies that are alike only along a chain, in buckets compared by blocks."""
    base = [f"w{i}" for i in range(300)]
    texts = []
    for k in range(80):
        base = [f"v{k}" if i == (k * 7) % 300 else w for i, w in enumerate(base)]
        texts.append(" ".join(base))
    rows = minhash.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.class_id for r in rows} == {0} and sum(r.kept for r in rows) == 1


def test_linear_grouping():
    for _ in range(500):
        s = [rng.randint(1, rng.choice([1, 2, 5])) for _ in range(rng.randint(0, 50))] + [0]
        assert suffix.linear_grouping(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute(texts, length):
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    for t in texts:
        m = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                m[p : p + length] = True
        yield len(t), int(m.sum()), int((np.diff(np.r_[0, m.astype(int)]) == 1).sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~m].tobytes()).hexdigest()


def test_suffix(spark, docs):
    want = sorted(brute([plain(t).encode() for _, t in TEXTS], 400))
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.cut_repeats(docs).collect()) == want
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.cut_repeats(docs, most=0).collect()) == want
    out = suffix.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(TEXTS) and out.filter("text is null").count() == 1


def test_suffix_words(spark):
    """Passages of 50 words that 400 bytes don't cover are cut where that is asked for, whatever whitespace they have."""
    g = random.Random(6)
    word = lambda: "".join(g.choice("abcdeé") for _ in range(g.randint(1, 6)))
    some = lambda n: [word() for _ in range(n)]
    passage, short, long = some(52), some(49), some(200)
    lists = [some(60) + passage + some(9), some(9) + passage, some(30) + short + some(9), short + some(70), some(5) + long + some(5), long[20:] + some(30), ["the"] * 70, some(40) + ["the"] * 49, some(10), []]
    texts = [(" " if i % 2 else "\n ").join(w) for i, w in enumerate(lists)]
    seen = Counter(tuple(w[k : k + 50]) for w in lists for k in range(len(w) - 49))
    data = [t.encode() for t in texts]
    strings = Counter(t[p : p + 400] for t in data for p in range(len(t) - 399))
    want = []
    for t, w in zip(data, lists, strict=True):
        gone = np.zeros(len(t), bool)
        place = [m.span() for m in re.finditer(rb"\S+", t)]
        for k in range(len(w) - 49):
            if seen[tuple(w[k : k + 50])] > 1:
                gone[place[k][0] : place[k + 49][1]] = True
        for p in range(len(t) - 399):
            if strings[t[p : p + 400]] > 1:
                gone[p : p + 400] = True
        want.append(np.frombuffer(t, np.uint8)[~gone].tobytes().decode("utf-8", "ignore"))
    docs = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string")
    for how in ({}, {"most": 0}):
        got = {r.doc_id: r.text for r in suffix.without_repeats(docs, words=50, **how).collect()}
        assert got.pop(99) is None and [got[i] for i in range(len(texts))] == want
    plain_ = {r.doc_id: r.text for r in suffix.without_repeats(docs).collect()}
    assert plain_[1] == texts[1] != want[1]  # 400 bytes alone leave it


def test_licenses(docs):
    rows = licenses.scan_licenses(docs).collect()
    assert [(r.doc_id, r.license, r.containment) for r in rows] == [(16, "MIT", 1.0)]
    s = licenses.Scanner(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        words = text.split()
        assert [f[0] for f in s.scan("before " * rng.randint(0, 40) + text + " after" * 9)] == [name]
        if len(words) >= 40:
            assert name in {f[0] for f in s.scan("aa " * 33 + " ".join([*words[:12], "typo", *words[13:]]) + " bb" * 5)}
    both = "Released under the MIT License. Some words between them. Released under the MIT License. " + licenses.TEMPLATES["GPL-3.0"]
    assert [(f[0], f[2]) for f in s.scan(both)] == [("MIT", 0), ("MIT", 9), ("GPL-3.0", 14)]


def test_bands_miss_no_notice(spark):
    """What the bands retrieve is what verifying every window finds."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) < 4000").select("text").limit(150).collect()]
    for text in list(licenses.TEMPLATES.values()):
        words = text.split()
        gone = rng.randrange(len(words))
        texts += ["x " * rng.randint(0, 30) + text, " ".join(words[:gone] + words[gone + 1 :]) + " y" * 9, "Ab " * 70 + text + " " + text]
    s = licenses.Scanner(licenses.TEMPLATES)
    assert s.scan_all(texts) == s.scan_all(texts, every=True)


def test_embeddings(spark):
    g = np.random.default_rng(1)
    x = g.normal(size=(300, 16))
    x[100:200] = x[0] + g.normal(size=(100, 16)) * 0.25
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(300, None), (301, [0.0] * 16), (302, [float("nan")] * 16), (303, [None] * 16), (304, [1.0, 2.0]), (305, [float(v) for v in x[5]]), (306, [])]
    got = {r.vec_id: r for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=40).collect()}
    y = np.vstack([x, x[5]])
    y = y / np.linalg.norm(y, axis=1, keepdims=True)
    near = y @ y.T >= 0.9
    np.fill_diagonal(near, False)
    ids = [*range(300), 305]
    found, true = sum(got[i].n_links for i in ids), near.sum()
    assert all(got[i].n_links <= near[k].sum() for k, i in enumerate(ids)) and found >= 0.99 * true
    if found == true:  # then components are those of all pairs
        low = list(range(301))
        for _ in range(301):
            low = [min([low[k], *(low[j] for j in np.flatnonzero(near[k]))]) for k in range(301)]
        assert [got[i].component_id for i in ids] == [ids[k] for k in low]
    assert all(got[i].n_links == 0 and got[i].kept for i in (300, 301, 302, 303, 304, 306)) and got[305].component_id == 5


def test_embeddings_audit(spark):
    g = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(g.normal(size=(2400, 64)))
    table = lambda v: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    assert {r.audit_recall for r in embeddings.near_vectors(table(x[:60])).collect()} == {None}  # no links, nothing measured
    away = g.normal(size=(500, 64))
    away = unit(away - (away * x[:500]).sum(1, keepdims=True) * x[:500])
    pairs = 0.901 * x[:500] + np.sqrt(1 - 0.901**2) * away
    group = unit(x[2399] + unit(g.normal(size=(200, 64))) * 0.2)  # its links outnumber those of the pairs
    all_ = np.vstack([x, pairs, group])
    near = all_ @ all_.T >= 0.9
    np.fill_diagonal(near, False)
    rows = {r.vec_id: r for r in embeddings.near_vectors(table(all_), block=200, sample=600).collect()}
    assert sum(rows[i].n_links for i in range(500)) >= 0.98 * near[:500].sum()
    assert rows[0].audit_recall >= 0.99 and all(rows[i].n_links <= near[i].sum() for i in rows)


def test_embeddings_far_groups(spark, monkeypatch):
    """Groups far from the medoid are found at the first overlap: the work isn't repeated."""
    g = np.random.default_rng(2)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base = unit(g.normal(size=(1200, 64)) + g.normal(size=(10, 64))[g.integers(0, 10, 1200)])
    x = np.vstack([base, unit(np.repeat(unit(g.normal(size=(60, 64))), 20, 0) + unit(g.normal(size=(1200, 64))) * 0.2)])
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    linked = near.any(1)
    alone = embeddings.build(x)
    r, c, _ = embeddings.search(x, alone, x, 0.9)
    assert (r != c).sum() < 0.5 * near.sum()  # from the medoid alone most are lost
    rounds, sharded = [], embeddings._sharded
    monkeypatch.setattr(embeddings, "_sharded", lambda *a: rounds.append(a[2]) or sharded(*a))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = {r.vec_id: r for r in embeddings.near_vectors(table, sample=1200).collect()}
    found = np.array([rows[i].n_links for i in range(len(x))])
    assert len(rounds) == 1 and rows[0].audit_recall >= 0.99
    assert (found <= near.sum(1)).all() and (found[linked] / near.sum(1)[linked]).mean() >= 0.99


def test_reach():
    g = np.random.default_rng(4)
    x = g.normal(size=(8000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    need = [embeddings.reach(x[:2000], embeddings.centroids(x[2000:], k), 0.9, 0.99) for k in (1, 16, 256, 1024)]
    assert need[0] == 1 and need[0] < need[1] < need[2] <= need[3] and need[3] > 3
    assert embeddings.reach(x[:1], x[:1], 0.9, 0.99) == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 502), (700, 700)]
    roots = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(roots[i] == 0 for i in range(201)) and roots[502] == 500


def test_queries_match_sql(spark):
    import glob
    import os

    import duckdb

    from evidentia.llm import queries

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    for name, sql in queries.SQL.items():
        got = queries.QUERIES[name](spark, SF)
        want = con.execute(sql)
        names = [c[0] for c in want.description]
        assert sorted(names) == sorted(got.columns), name
        rows = lambda table, at: sorted(tuple(round(r[k], 12) if isinstance(r[k], float) else r[k] for k in at) for r in table)
        assert rows(got.collect(), sorted(names)) == rows(want.fetchall(), [names.index(n) for n in sorted(names)]), name
