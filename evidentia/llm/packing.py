"""Packing by minimum bin slack.

Each text is tokenized and closed with an end id; its ids are cut into full windows and one remainder. Full windows are sequences. For
the remainders only the number of each length matters, so the driver plans over at most ``window - 1`` counts whatever the input: take the
longest length left, find by subset-sum dynamic programming over a bitset the multiset of lengths that fills the window closest to its
capacity, backtrack how many of each length it uses, and repeat that filling while the counts last. The pieces of a length are numbered
in salted parts, and a piece's number gives its sequence and offset by arithmetic.

Null text is empty; an empty text is the end id alone; a text of any length is handled; equal lengths go by row number; repeated rows are
packed each; other columns are ignored; an empty table packs to nothing.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import Recent, lean, runs, written


def unlike() -> str:
    """The letters that aren't letters alone any more when composed and in lower case, such as those with a mark that never composes."""
    letters = (c for c in map(chr, range(0x110000)) if c.isalpha())
    return "".join(c for c in letters if not unicodedata.normalize("NFC", c).lower().isalpha())


class Tokens:
    """Whole texts to ids, as little-endian bytes. A text is split into pieces that are encoded alike anywhere; those are kept for a while."""

    def __init__(self, path: str, most: int = 250_000, together: int = 256):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        self.tok, self.together = tok, together
        vocabulary = tok.get_vocab()
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closing[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.all = lambda text: np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self.kept = Recent(self.all, most)
        self.piece = self.kept.__getitem__
        # white space to Python alone, the start of special tokens, the letter whose lower case depends on its place, letters that become others
        self.odd = re.compile(f"[\x1c-\x1f<\u03a3{unlike()}]").search
        self.joined = re.compile(r"[.,][^\s\w]|[^\s\w][.,]|_").search  # a stop or comma that isn't a token by itself
        self.foreign = re.compile("[^ a-z\u00df-\u00f6\u00f8-\u024f]").search

    def pieces(self, text: str | None) -> list[str]:
        """Words in lower case, stops and commas of most texts; of others, what stands between white space, without the marks behind words."""
        if not text:
            return []
        if self.odd(text):
            return [text]
        if not self.joined(text):
            return text.lower().replace(",", " , ").replace(".", " . ").split()
        out = []
        for run in text.lower().split():
            word = run.rstrip(".,!?;:$%&*#|")
            out += (word, run[len(word) :]) if word.isalpha() and len(word) < len(run) else (run,)
        return out

    def meet(self, texts: list[list[str]]) -> None:
        """Encodes the new words among the pieces of ``texts`` many at a time."""
        seen: set[str] = set()
        for t in texts:
            seen.update(t)
        kept, older = self.kept, self.kept.older
        new = [w for w in seen if w not in kept and w not in older and w.isalpha()]
        for i in range(0, len(new), self.together):
            some = new[i : i + self.together]
            raw, cuts = self.ids_of(some)
            for k, word in enumerate(some):
                kept.put(word, raw[cuts[k] : cuts[k + 1]])

    def ids_of(self, words: list[str]) -> tuple[bytes, list[int]]:
        """The ids of words of letters, as bytes, and where each word's begin and end."""
        text = " ".join(words)
        if not self.foreign(text):  # a word of Latin letters ends at the one token that closes it
            ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.closing[ids]) + 1
            if len(ends) == len(words):
                return ids.tobytes(), [0, *(4 * ends).tolist()]
        got = self.tok.encode(text, add_special_tokens=False)  # where an id's characters begin tells whose word it is of
        begins = np.cumsum([0, *(len(w) + 1 for w in words)])
        cuts = 4 * np.searchsorted([start for start, _ in got.offsets], begins)
        return np.array(got.ids, "<u4").tobytes(), cuts.tolist()

    def encode(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.piece, pieces))


@functools.cache
def tokens(path: str) -> Tokens:
    return Tokens(path)


PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def cut(docs: DataFrame, path: str, end_id: int, window: int) -> DataFrame:
    """The pieces of each text: full windows, then the remainder."""

    def run(batches):
        encoder, end = tokens(path), np.array([end_id], "<u4").tobytes()
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in runs(texts, 1_000_000):
                out, split = [], [encoder.pieces(t) for t in texts[i:j]]
                encoder.meet(split)
                for k in range(i, j):
                    got = encoder.encode(split[k - i]) + end
                    n = len(got) // 4
                    out += [(ids[k], at, min(window, n - at), zlib.crc32(got[4 * at : 4 * (at + window)]), n) for at in range(0, n, window)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(lean(run), PIECES)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length a filling of ``room`` uses that leaves the least slack. Bit t of the set says that t can be filled."""
    reach, items, before = 1, [], []
    full = (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left:
            k = min(k, left)
            items.append((length, k))
            before.append(reach)
            reach |= (reach << length * k) & full
            left, k = left - k, 2 * k
        if reach >> room:
            break
    at, used = reach.bit_length() - 1, {}
    for (length, k), had in zip(reversed(items), reversed(before), strict=True):
        if not had >> at & 1:
            used[length] = used.get(length, 0) + k
            at -= length * k
    return used


def plan(counts: dict[int, int], window: int) -> tuple[list[tuple], int]:
    """(length, first, last, per_sequence, sequence, offset) rows and the number of sequences.

    Pieces first..last-1 of a length stand ``per_sequence`` to a sequence from ``sequence`` on, one after another from ``offset``.
    """
    left, taken, rows, sequence = {k: v for k, v in counts.items() if v}, {}, [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        used = fullest({k: v for k, v in left.items() if v}, window - longest)
        left[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        offset = 0
        for length, n in used.items():
            first = taken.get(length, 0)
            rows.append((length, first, first + n * times, n, sequence, offset))
            taken[length] = first + n * times
            offset += n * length
            left[length] -= n * times
            if not left[length]:
                del left[length]
        sequence += times
    return rows, sequence


def pack(docs: DataFrame, path: str, end_id: int = 2, window: int = 4096, part_rows: int = 4096) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Sequences hold at most ``window`` ids.

    Sequence ids are gapless from 0; full windows come after the filled ones. A sequence is to be padded to ``window`` unless its length is
    a power of two.
    """
    spark = docs.sparkSession
    pieces = written(cut(docs, path, end_id, window).withColumn("rid", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``window`` rows
    full = counts.pop(window, 0)
    rows, sequences = plan(counts, window)
    rows.append((window, 0, full, 1, sequences, 0))
    segments = spark.createDataFrame(rows, "plan_length bigint, first bigint, last bigint, per bigint, seq bigint, at bigint")
    most = max([full, *counts.values()])
    parts = max(1, -(-most // part_rows))
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("rid"), F.lit(parts)))
    sizes = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = sizes.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    number = F.row_number().over(Window.partitionBy("length", "part").orderBy("rid"))
    pieces = pieces.withColumn("number", number - 1).join(before, ["length", "part"]).withColumn("number", F.col("number") + F.col("before"))
    placed = pieces.join(F.broadcast(segments), (F.col("length") == F.col("plan_length")) & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("last")))
    nth = F.col("number") - F.col("first")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("seq") + F.floor(nth / F.col("per"))).cast("bigint").alias("sequence_id"), (F.col("at") + (nth % F.col("per")) * F.col("length")).cast("bigint").alias("offset"),
    )
