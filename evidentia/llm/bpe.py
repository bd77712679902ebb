"""BPE encoding and decoding through a tokenization automaton.

The merge list is compiled into a deterministic automaton over tokens, which starts as one state that every base symbol leads back to. Each
merge (a, b) -> ab, in order, adds a merge gadget where some path spells a b: a new state, the copy of the state that a leads to without its
arc on b, to which all arcs on a are redirected, and arcs on ab, beside those on a that were followed by b, to where b leads. So all arcs on
a token lead to one state, and states are numbered in the order of their gadgets. A copy keeps its original's arcs as a reference: a state
is stored as its moment, its original and the arc that it lacks, and its row of the transition table is filled as words ask for arcs. A word's token
sequence is the only accepted path that spells it; it is found by transitions alone. Decoding emits the arc labels (byte strings) of the ids.

Null text is empty; empty text has no ids; any length is handled; other columns are carried along.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from evidentia.llm.common import Recent, lean, runs, with_fields

#: The pre-split pattern of byte-level BPE.
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Automaton:
    """Tokens are numbered by vocabulary id; ``labels`` gives each arc's byte string. State 0 is the first one, whose arcs are never cut."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]):
        self.labels = labels
        self.born, self.of = [-1], [-1]  # by state: the moment of its gadget, the token whose arcs lead to it
        self.first: dict[int, int] = {}  # token -> the state that the first copy for it was made of
        self.copies: dict[int, tuple[list[int], list[int]]] = {}  # token -> moments and states of the copies for it, each made of the one before
        self.lost: dict[tuple[int, int], int] = {}  # (token, arc) -> the moment of the copy for the token that lacks the arc
        self.leads: dict[int, int] = {}  # token -> state; those of base symbols that no gadget has redirected lead to state 0
        self.made: dict[int, int] = {}  # token -> moment of its gadget; base symbols have none
        self.left: dict[int, int] = {}  # token -> the token beside whose arcs its own were laid
        for moment, (a, b, ab) in enumerate(merges):
            before, onward = self.leads.get(a, 0), self.leads.get(b, 0)
            if not self.arc(before, b):  # no path spells a b
                continue
            moments, states = self.copies.setdefault(a, ([], []))
            self.first.setdefault(a, before)
            self.leads[a] = len(self.born)
            moments.append(moment)
            states.append(len(self.born))
            self.born.append(moment)
            self.of.append(a)
            self.lost[a, b] = moment
            if ab not in self.made:
                self.made[ab], self.left[ab], self.leads[ab] = moment, a, onward
        self.table: dict[int, bool] = {}  # state << 32 | token -> whether there is an arc
        self.spelled = {label: x for x, label in labels.items() if x in self.made or len(label) == 1}
        self.reach: dict[bytes, int] = {}  # four bytes -> the longest label that they begin
        for label in self.spelled:
            if len(label) > 3:
                self.reach[label[:4]] = max(len(label), self.reach.get(label[:4], 0))
        self.to = [self.leads.get(x, 0) for x in range(max(labels, default=-1) + 1)]

    def arc(self, state: int, x: int) -> bool:
        """Whether ``state`` has an arc on x: a copy has its original's but one, and arcs that were laid later follow those they were laid beside."""
        born, made = self.born, self.made
        while state:
            since = made.get(x, -1)
            if born[state] <= since:
                x = self.left[x]
                continue
            token = self.of[state]
            if self.lost.get((token, x), born[state] + 1) <= born[state]:
                return False
            moments, states = self.copies[token]  # back to the last copy that was there when x was made
            k = bisect.bisect_right(moments, since)
            state = states[k - 1] if k else self.first[token]
        return True

    def encode(self, word: bytes) -> list[int]:
        """The ids of the accepted path that spells ``word``: longest arcs first, stepping back from positions that lead nowhere.

        A prefix has one accepted path, so a position that was left is never entered again.
        """
        spelled, labels, to, table, reach, n = self.spelled, self.labels, self.to, self.table, self.reach.get, len(word)
        whole = spelled.get(word)
        if whole is not None:
            return [whole]
        out, states, at, state, dead = [], [], 0, 0, set()
        end = min(n, reach(word[:4], 3))
        while at < n:
            while end > at:
                x = spelled.get(word[at:end])
                if x is not None and end not in dead:
                    key = state << 32 | x
                    ok = table.get(key)
                    if ok is None:
                        if len(table) > 1_000_000:
                            table.clear()
                        ok = table[key] = self.arc(state, x)
                    if ok:
                        break
                end -= 1
            if end > at:
                out.append(x)
                states.append(state)
                state, at = to[x], end
                end = at + reach(word[at : at + 4], 3)
                if end > n:
                    end = n
            else:
                dead.add(at)
                end = at - 1
                at -= len(labels[out.pop()])
                state = states.pop()
        return out


@functools.cache
def load(path: str):
    """(automaton, special tokens) of a byte-level BPE file in the public JSON form."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte = byte_symbols()
    vocab = spec["model"]["vocab"]
    label = lambda token: bytes(byte[c] for c in token)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    labels = {i: label(t) for t, i in vocab.items() if t not in special}
    return Automaton(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]), special


class Encoder:
    """Whole texts to ids. Words, and runs between single spaces, are spelled once and kept for a while."""

    def __init__(self, path: str, words: int = 400_000, spaced: int = 250_000):
        import regex

        self.automaton, self.special = load(path)
        self.words = regex.compile(PRE_SPLIT).findall
        self.at_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.rare = re.compile(r"[^\S \n]|[\x1c-\x1f]").search  # white space but blanks and line ends
        encode = self.automaton.encode
        self.word = Recent(lambda w: ",".join(map(str, encode(w.encode()))), words).__getitem__
        self.spaced = Recent(self._spaced, spaced).__getitem__
        self.arcs = {str(i): b for i, b in self.automaton.labels.items()} | {str(i): s.encode() for s, i in self.special.items()}

    def _spaced(self, run: str) -> str:
        if run.isalpha():
            return self.word(" " + run)
        if run[-1] in ".," and run[:-1].isalpha():
            return self.word(" " + run[:-1]) + "," + self.word(run[-1])
        return self._spell(" " + run)

    def _spell(self, text: str) -> str:
        return ",".join(map(self.word, self.words(text)))

    def _plain(self, text: str) -> str:
        if not text:
            return ""
        # a blank that has no white space beside it begins a word; anything else is left to the pattern
        if text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or self.rare(text):
            return self._spell(text)
        first, *rest = text.split(" ")
        return ",".join([self._spell(first), *map(self.spaced, rest)])

    def ids(self, text: str | None) -> str:
        """Decimal ids joined by commas."""
        if not text:
            return ""
        if self.at_special is None or "<" not in text:
            return self._plain(text)
        out, at = [], 0
        for m in self.at_special.finditer(text):
            out += [self._plain(text[at : m.start()]), str(self.special[m[0]])]
            at = m.end()
        return ",".join(x for x in [*out, self._plain(text[at:])] if x)

    def text(self, ids: str) -> str:
        """The text that the arcs spell."""
        return b"".join(map(self.arcs.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def bpe_encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with an array<int> column of the ids of each whole text."""

    def run(batches):
        enc = encoder(path)
        for b in batches:
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            ids = pa.array([[int(i) for i in x.split(",")] if (x := enc.ids(t)) else [] for t in texts], pa.list_(pa.int32()))
            keep = [i for i, n in enumerate(b.schema.names) if n != out]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), ids], names=[*(b.schema.names[i] for i in keep), out])

    schema = with_fields(docs.drop(out).schema, f"{out} array<int>")
    return docs.mapInArrow(lean(run), schema)


def bpe_decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``docs`` with a string column of what each row's ids spell; a null array spells the empty text."""

    def run(batches):
        enc = encoder(path)
        for b in batches:
            texts = pa.array([enc.text(",".join(map(str, x or ()))) for x in b.column(b.schema.get_field_index(ids)).to_pylist()], pa.string())
            keep = [i for i, n in enumerate(b.schema.names) if n != out]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), texts], names=[*(b.schema.names[i] for i in keep), out])

    return docs.mapInArrow(lean(run), with_fields(docs.drop(out).schema, f"{out} string"))


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded, its ids decoded, both digested in one pass without a shuffle."""

    def run(batches):
        enc = encoder(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in runs(texts):
                n, a, d = [], [], []
                for t in texts[i:j]:
                    ids = enc.ids(t)
                    n.append(ids.count(",") + 1 if ids else 0)
                    a.append(hashlib.sha256(ids.encode()).hexdigest())
                    d.append(hashlib.sha256(enc.text(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(a), pa.array(d)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), with_fields(docs.select("doc_id").schema, "n_tokens bigint, ids_sha256 string, decoded_sha256 string"))
