"""Suffix-array dedup: removes every byte covered by a string of ``length`` bytes that also starts anywhere else.

1. Anchors. A string's anchor is the position of the least hash among its ``gram``-byte substrings, the leftmost of equals. It depends on the
   string's own bytes alone, so equal strings have equal anchors. Consecutive strings of a text with one anchor form a run, told by the
   anchor's gram and a hash of the bytes around it.
2. Runs are counted by gram with map-side combine. A gram that occurs once has no repeated string and goes no further.
3. Of the other grams' runs one of each distinct surrounding is cut out of its text. The surroundings of many grams are laid out one after
   another as symbols of ``BLOCK`` bytes, aligned at the anchors, and a suffix array of the symbols is built by linear grouping. Suffixes
   with the same first symbols are neighbours in it; the remaining bytes on either side of them decide for each string whether it has an
   equal; all strings of a surrounding that occurs twice have one. Grams with more than ``most`` surroundings go another exact way: their
   strings' digests are counted with map-side combine, so no group has to fit one task.
4. Each text's repeated strings are united to spans and cut out. Texts that equal others are copies of them and go whole.

``without_repeats`` also cuts passages of ``words`` words that start anywhere else, if asked to: the same steps over texts whose words (runs
of anything but whitespace) are 64-bit hashes. The whitespace between the words of a passage may differ and goes with it.

Texts are UTF-8 bytes; null is empty; texts below ``length`` bytes stay as they are; matches never cross documents but count inside one;
repeated rows are copies; overlaps count; any length is handled, periodic texts too; other columns are carried along. As text, what is
left of a character cut in two is dropped.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import WordHashes, discard, lean, mix64, with_fields, written

LENGTH, GRAM, BLOCK = 400, 100, 16
WORD = 8  # bytes of a word's hash
_BASE = 0x9E3779B97F4A7C15


def linear_grouping(s: list[int]) -> list[int]:
    """The suffix array of ``s``, whose last symbol is smaller than every other.

    Phase 1 takes groups of suffixes in descending order. For each suffix of a group it finds the nearest earlier position of a smaller
    group (the previous smaller suffix), jumping along pointers found before; the suffixes so pointed to are extended by the group's
    Lyndon prefix, and leave their own groups for new ones right behind, those pointed to more often further up. In the end suffixes are
    grouped by longest Lyndon prefix. Phase 2 walks the order ascending and, along the same pointers, puts each suffix at the head of its group.
    """
    n = len(s)
    sa = sorted(range(n), key=s.__getitem__)
    at, group, size = [0] * n, [0] * n, [0] * (n + 1)
    head = 0
    for k, i in enumerate(sa):
        if k and s[i] != s[sa[k - 1]]:
            head = k
        at[i], group[i] = k, head
        size[head] += 1
    before = [-1] * n
    end = n - 1
    while end > 0:
        head = group[sa[end]]
        if head == end:
            i = sa[end]
            p = i - 1
            while p >= 0 and group[p] >= head:
                p = before[p]
            before[i] = p
            levels = [[p]] if p >= 0 else []
        else:
            times: dict[int, int] = {}
            for i in sorted(sa[head : end + 1]):
                p = i - 1
                while p >= 0 and group[p] >= head:
                    p = before[p]
                before[i] = p
                if p >= 0:
                    times[p] = times.get(p, 0) + 1
            by: dict[int, list[int]] = {}
            for p, k in times.items():
                by.setdefault(k, []).append(p)
            levels = [by[k] for k in sorted(by, reverse=True)]
        for moved in levels:
            for p in moved:  # to the end of its group
                g = group[p]
                size[g] -= 1
                k, other = g + size[g], at[p]
                q = sa[k]
                sa[k], sa[other], at[p], at[q] = p, q, k, other
            heads = [group[p] + size[group[p]] for p in moved]
            for p, g in zip(moved, heads, strict=True):
                group[p] = g
                size[g] += 1
        end = head - 1
    out, free, done = [-1] * n, list(range(n + 1)), bytearray(n)
    out[0] = n - 1
    done[n - 1] = 1
    for k in range(n):
        p = out[k] - 1
        while p >= 0 and not done[p]:
            g = group[p]
            out[free[g]] = p
            free[g] += 1
            done[p] = 1
            p = before[p]
    return out


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            out.append(np.cumprod(p))
    return out[0], out[1]


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))


def anchored(texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """Runs of strings with one anchor: (text, anchor, first start, last start, gram hash, surroundings hash) arrays."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data)
    if n < length:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    room = 1 << max(16, (n + 1).bit_length())
    power, inverse = _powers(room)
    with np.errstate(over="ignore"):
        prefix = np.r_[np.uint64(0), np.cumsum(_BYTE[data] * power[:n])]
        grams = mix64((prefix[gram:] - prefix[:-gram]) * inverse[: n - gram + 1])
    bits = np.uint64((n + 1).bit_length())
    m = grams >> bits << bits | np.arange(len(grams), dtype=np.uint64)  # the position breaks ties
    width, have = length - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        m = np.minimum(m[: len(m) - step], m[step:])
        have += step
    end = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    start = np.arange(n - length + 1)
    fits = start + length <= end[owner[: n - length + 1]]
    start, m = start[fits], m[fits]
    if not len(start):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    new = np.flatnonzero(np.r_[True, (m[1:] != m[:-1])])
    anchor = (m[new] & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    first, last = start[new], start[np.r_[new[1:] - 1, len(start) - 1]]
    whole = memoryview(data)
    around = np.fromiter((xxhash.xxh3_64_intdigest(whole[a:b]) for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)), np.uint64, len(first))
    around = mix64(around ^ mix64(((anchor - first) << 32 | (last - first)).astype(np.uint64)))
    text = owner[first]
    base = (end - sizes)[text]
    return text, anchor - base, first - base, last - base, grams[anchor], around


def repeated(windows: list[tuple[bytes, int, bool]], length: int = LENGTH) -> list[np.ndarray]:
    """For each (bytes around an anchor, anchor's place, whether they occur more than once) a mask over its strings: those that have an equal.

    Windows of one call must stand for different places. The window of ``length + d`` bytes holds d + 1 strings.
    """
    most = -(-length // BLOCK) - 1  # whole blocks that every string has from its first block border on
    tail = length - most * BLOCK  # bytes beside them
    masks = [np.full(len(w) - length + 1, multi) for w, _, multi in windows]
    data = np.frombuffer(b"".join(w for w, _, _ in windows), np.uint8)
    offset = np.r_[0, np.cumsum([len(w) for w, _, _ in windows])].astype(np.int64)
    parts, place = [], []
    for k, (w, a, _) in enumerate(windows):
        b0 = a % BLOCK
        blocks = (len(w) - b0) // BLOCK
        rows = np.arange(blocks) * BLOCK + b0 + offset[k]
        place.append(np.r_[rows, -1])
        parts.append(rows)
    rows = np.concatenate(parts)
    pair = data[rows[:, None] + np.arange(BLOCK)].copy().view(">u8").astype(np.uint64)
    order = np.lexsort((pair[:, 1], pair[:, 0]))
    sorted_ = pair[order]
    rank = np.empty(len(rows), np.int64)
    rank[order] = np.cumsum(np.r_[False, (sorted_[1:] != sorted_[:-1]).any(1)]) + 2
    place = np.concatenate(place)
    symbols = np.ones(len(place) + 1, np.int64)
    symbols[:-1][place >= 0] = rank
    symbols[-1] = 0
    sa = np.array(linear_grouping(symbols.tolist()), np.int64)
    # suffixes with ``most`` blocks before the end of their window, in order; equal beginnings stand together
    breaks = np.r_[np.flatnonzero(place < 0), len(place)]
    left = breaks[np.searchsorted(breaks, np.arange(len(place)))] - np.arange(len(place))
    sa = sa[sa < len(place)]
    sa = sa[left[sa] >= most]
    if len(sa) < 2:
        return masks
    same = np.ones(len(sa) - 1, bool)
    for k in range(most):
        same &= symbols[sa[1:] + k] == symbols[sa[:-1] + k]
    group = np.cumsum(np.r_[False, ~same])
    big = np.bincount(group)[group] > 1
    sa, group = sa[big], group[big]
    if not len(sa):
        return masks
    s = place[sa]
    window = np.searchsorted(offset, s, side="right") - 1
    multi = np.array([m for _, _, m in windows])[window]
    local, last = s - offset[window], offset[window + 1] - offset[window] - length
    for e in range(BLOCK):
        ok = np.flatnonzero((local - e >= 0) & (local - e <= last))
        if e > tail or len(ok) < 2:
            continue
        at = s[ok][:, None]
        beside = np.zeros((len(ok), -(-tail // 8) * 8), np.uint8)
        beside[:, :e] = data[at - e + np.arange(e)]
        beside[:, e:tail] = data[at + most * BLOCK + np.arange(tail - e)]
        words = beside.view(np.uint64)
        keys = [words[:, c] for c in range(words.shape[1])] + [group[ok]]
        o = np.lexsort(keys)
        differs = np.zeros(len(o) - 1, bool)
        for c in keys:
            differs |= c[o][1:] != c[o][:-1]
        cls = np.cumsum(np.r_[False, differs])
        hit = ok[o[(np.bincount(cls) > 1)[cls] | multi[ok[o]]]]
        for w in np.unique(window[hit]):
            masks[w][(local[hit] - e)[window[hit] == w]] = True
    return masks


def intervals(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True))


SPAN = "array<struct<a:int,b:int>>"


def _runs(texts: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        for b in batches:
            key, data = b.column(0), b.column(1).to_pylist()
            i = 0
            while i < len(data):
                j, size = i, 0
                while j < len(data) and (j == i or size + len(data[j]) <= 500_000):
                    size += len(data[j])
                    j += 1
                t, a, first, last, h, c = anchored(data[i:j], length, gram)
                yield pa.RecordBatch.from_arrays(
                    [key.take(pa.array(t + i)), *(pa.array(x.astype(np.int32)) for x in (a, first, last)), pa.array(h.view(np.int64)), pa.array(c.view(np.int64))],
                    names=["text_key", "anchor", "first", "last", "gram", "around"],
                )
                i = j

    return texts.mapInArrow(lean(run), "text_key binary, anchor int, first int, last int, gram bigint, around bigint")


def _windows(rows: DataFrame, length: int) -> DataFrame:
    """(gram, around, place, multi, window): the bytes of each listed run; rows have the text and an array of runs."""

    def run(batches):
        for b in batches:
            for text, listed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out = [(r["gram"], r["around"], r["anchor"] - r["first"], r["multi"], text[r["first"] : r["last"] + length]) for r in listed]
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()), strict=True)], names=["gram", "around", "place", "multi", "window"])

    return rows.mapInArrow(lean(run), "gram bigint, around bigint, place int, multi boolean, window binary")


def _by_array(windows: DataFrame, length: int, symbols: int) -> DataFrame:
    """(gram, around, found): for each surrounding the intervals of its strings, counted from its first, that have an equal."""

    def run(batches):
        held, size, last = [], 0, None

        def flush():
            masks = repeated([(w, p, m) for _, _, p, m, w in held], length)
            found = [[{"a": a, "b": b} for a, b in intervals(m)] for m in masks]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], pa.int64()), pa.array(found, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], names=["gram", "around", "found"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[0] != last and size > symbols * BLOCK:
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
                last = row[0]
        if held:
            yield flush()

    return windows.repartition("gram").sortWithinPartitions("gram", "around").mapInArrow(lean(run), f"gram bigint, around bigint, found {SPAN}")


def _by_digest(windows: DataFrame, length: int) -> DataFrame:
    """As _by_array(), for grams with any number of surroundings: each string's digest is counted."""

    def run(batches):
        for b in batches:
            for g, c, _, m, w in zip(*(x.to_pylist() for x in b.columns), strict=True):
                n = len(w) - length + 1
                yield pa.RecordBatch.from_arrays([pa.array([g] * n, pa.int64()), pa.array([c] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([2 if m else 1] * n, pa.int64()), pa.array([hashlib.md5(w[k : k + length]).digest() for k in range(n)], pa.binary())], names=["gram", "around", "k", "n", "digest"])

    rows = written(windows.mapInArrow(lean(run), "gram bigint, around bigint, k int, n bigint, digest binary"), "strings")
    twice = rows.groupBy("digest").agg(F.sum("n").alias("n")).filter("n > 1").select("digest")
    return rows.join(twice, "digest").groupBy("gram", "around").agg(F.array_sort(F.collect_set(F.struct(F.col("k").alias("a"), F.col("k").alias("b")))).cast(SPAN).alias("found"))


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = 4096, symbols: int = 40_000) -> DataFrame:
    """(text_key, strings): for each text that has any, the intervals of starts of its repeated strings. text_key is text_key(text)."""
    return _spans(docs.select(text_key().alias("text_key"), _bytes().alias("data")), length, gram, most, symbols)


def word_spans(docs: DataFrame, words: int, gram: int = GRAM, most: int = 4096, symbols: int = 40_000) -> DataFrame:
    """As spans(), for strings of ``words`` words; the starts are places in the text's hashes, ``WORD`` bytes a word."""

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            coded = [np.fromiter(map(hashes.__getitem__, t.split()), "<u8").tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(coded, pa.binary())], names=["text_key", "data"])

    texts = docs.select(text_key().alias("text_key"), F.coalesce("text", F.lit("")).alias("text")).filter(F.length("text") >= 2 * words - 1)
    return _spans(texts.mapInArrow(lean(run), "text_key binary, data binary"), words * WORD, min(gram, words * WORD), most, symbols)


def _spans(texts: DataFrame, length: int, gram: int, most: int, symbols: int) -> DataFrame:
    texts = texts.filter(F.length("data") >= length)
    runs = written(_runs(texts, length, gram), "runs")
    # tables on both sides of a join by a key that many rows may share, so that Spark can split the key
    grams = written(runs.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"), "grams")
    again = written(runs.join(grams, "gram"), "runs-again")
    discard(runs)
    distinct = again.groupBy("gram", "around").agg(F.count("*").alias("n"), F.min(F.struct("text_key", "anchor", "first", "last")).alias("r"))
    distinct = distinct.select("gram", "around", (F.col("n") > 1).alias("multi"), "r.*")
    lists = distinct.groupBy("text_key").agg(F.collect_list(F.struct("gram", "around", "anchor", "first", "last", "multi")).alias("listed"))
    one = texts.groupBy("text_key").agg(F.first("data").alias("data"))  # of copies one is moved
    windows = written(_windows(one.join(lists, "text_key").select("data", "listed"), length), "windows")
    hot = windows.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("gram")
    hot = written(hot, "hot")
    if hot.isEmpty():
        found = _by_array(windows, length, symbols)
    else:
        found = _by_array(windows.join(hot, "gram", "left_anti"), length, symbols).unionByName(_by_digest(windows.join(hot, "gram", "left_semi"), length))
    found = written(found.filter(F.size("found") > 0), "found")
    discard(windows)
    parts = again.select("gram", "around", "text_key", "first").join(found, ["gram", "around"]).select("text_key", "first", F.explode("found").alias("s"))
    strings = F.struct((F.col("first") + F.col("s.a")).alias("a"), (F.col("first") + F.col("s.b")).alias("b"))
    # a text's distinct intervals; the copies of a text bring the same ones
    out = written(parts.groupBy("text_key").agg(F.collect_set(strings).alias("strings")), "spans")
    discard(again)
    discard(found)
    return out


def _bytes():
    return F.coalesce(F.col("text"), F.lit("")).cast("binary")


def text_key():
    return F.unhex(F.md5(_bytes()))


def _cuts(strings: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """The bytes that ``strings`` cover, from and to."""
    return [(s["a"], s["b"] + length) for s in strings or ()]


def _word_cuts(text: str, strings: list[dict] | None, words: int) -> list[tuple[int, int]]:
    """The bytes of ``text`` that strings of hashes cover; a string that starts inside a hash is none of words."""
    found = [(-(-s["a"] // WORD), s["b"] // WORD) for s in strings or ()]
    found = sorted((a, b) for a, b in found if a <= b)
    if not found:
        return []
    place = [m.span() for m in re.finditer(r"\S+", text)]
    size = np.r_[0, np.cumsum([len(c.encode()) for c in text])]  # bytes before each character
    return [(int(size[place[a][0]]), int(size[place[b + words - 1][1]])) for a, b in found]


def _kept(data: bytes, cuts: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(bytes left, bytes removed, spans removed)."""
    if not cuts:
        return data, 0, 0
    at, out, spans_, reach = 0, [], 0, -1
    for a, b in sorted(cuts):
        if a > reach:
            spans_ += 1
            out.append(data[at:a])
        reach = max(reach, b)
        at = reach
    left = b"".join([*out, data[at:]])
    return left, len(data) - len(left), spans_


def cut_repeats(docs: DataFrame, length: int = LENGTH, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and text, which is what is left, of each row."""
    found = spans(docs, length, **how)

    def run(batches):
        for b in batches:
            n, removed, count, sha, text = [], [], [], [], []
            for data, strings in zip(b.column(1), b.column(2), strict=True):
                data = data.as_py()
                left, r, s = _kept(data, _cuts(strings.as_py(), length))
                n.append(len(data))
                removed.append(r)
                count.append(s)
                sha.append(hashlib.sha256(left).hexdigest())
                text.append(left.decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha), pa.array(text, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    rows = docs.select("doc_id", text_key().alias("text_key"), _bytes().alias("data")).join(found, "text_key", "left")
    schema = with_fields(docs.select("doc_id").schema, "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, text string")
    return rows.select("doc_id", "data", "strings").mapInArrow(lean(run), schema)


def without_repeats(docs: DataFrame, length: int = LENGTH, words: int | None = None, **how) -> DataFrame:
    """``docs`` with the repeated bytes, and the repeated passages of ``words`` words, cut out of ``text``; all rows and columns stay, a null text stays null."""
    found = spans(docs, length, **how)
    cols = docs.columns

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("text")
            texts = []
            for t, s, w in zip(b.column(at), b.column(b.num_columns - 2), b.column(b.num_columns - 1), strict=True):
                t = t.as_py()
                cuts = _cuts(s.as_py(), length) + _word_cuts(t, w.as_py(), words)
                texts.append(_kept(t.encode(), cuts)[0].decode("utf-8", "ignore") if cuts else t)
            columns = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(b.num_columns - 2)]
            yield pa.RecordBatch.from_arrays(columns, names=cols)

    rows = docs.withColumn("ev_key_", text_key()).join(found.withColumnsRenamed({"text_key": "ev_key_", "strings": "ev_strings_"}), "ev_key_", "left")
    if words is None:
        rows = rows.withColumn("ev_words_", F.lit(None).cast(SPAN))
    else:
        rows = rows.join(word_spans(docs, words, **how).withColumnsRenamed({"text_key": "ev_key_", "strings": "ev_words_"}), "ev_key_", "left")
    return rows.select(*cols, "ev_strings_", "ev_words_").mapInArrow(lean(run), docs.schema)
