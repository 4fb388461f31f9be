"""Encoding of texts with a public byte-level BPE tokenizer through a tokenization automaton.

The merges are compiled one after the other into a deterministic automaton over tokens that accepts exactly the correct
tokenizations. A merge (u, v) -> w adds one gadget: the state that u leads to is copied without its v-arc, all u-arcs go
to the copy from then on, and every state from which u and then v could be read gets a w-arc to the state behind v. So a
state is described by the state it was copied from, the time of the copy and the arc it lost, and there are at most as
many states as merges. A word is encoded by reading it along the arcs; exactly one path spells it. Decoding emits the
bytes of the arc labels.

Texts are split into words by the tokenizer's pattern, computed with arrays over whole batches; each distinct word of a
batch is encoded once and looked up for its other occurrences.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Characters of text that are split into words at a time.
CHUNK_CHARS = 1_000_000
#: Distinct words that a worker remembers at most; beyond it, the memory starts anew (words are encoded again).
REMEMBERED = 400_000
DEFAULT = "/opt/tokenizers/byte_bpe_50k.json"

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
# White space of Unicode.
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    out = np.zeros(0x110000, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    category = unicodedata.category
    for c in range(0x110000):
        if k := kinds.get(category(chr(c))[0]):
            out[c] = k
    out[WHITE] = SPACE
    return out


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable bytes for themselves, others shifted."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Deterministic automaton of a byte-level BPE vocabulary; states are made by the merges' gadgets."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        letters = byte_letters()
        spell = lambda s: bytes(letters[c] for c in s)
        self.ids: dict[bytes, int] = {}
        self.label: dict[int, bytes] = {}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        vocab = model["vocab"]
        for ch, b in letters.items():
            self.ids[bytes([b])] = vocab[ch]
            self.label[vocab[ch]] = bytes([b])
        #: token -> (rule number, left, right); bytes have none
        self.rule: dict[int, tuple[int, int, int]] = {}
        # States: parent, time of the copy, arc that the copy lost. State 0 has all byte arcs.
        self.parent, self.born, self.lost = [-1], [-1], [-1]
        #: token -> times and states that its arcs lead to, oldest first
        self.leads: dict[int, tuple[list[int], list[int]]] = {t: ([-1], [0]) for t in self.label}
        self._memo: dict[tuple[int, int, int], bool] = {}
        for k, (left, right) in enumerate(merges):
            u, v, w = vocab[left], vocab[right], vocab[left + right]
            self.label[w] = spell(left + right)
            self.ids[self.label[w]] = w
            self._gadget(k, u, v, w)
        self._memo = {}
        self.now = len(merges)
        self.arcs: dict[tuple[int, int], bool] = {}
        self.longest = max(map(len, self.ids))
        self.state_of = {t: s[-1] for t, (_, s) in self.leads.items()}

    def _lead(self, token: int, time: int) -> int:
        """State behind ``token`` just before rule ``time``."""
        times, states = self.leads[token]
        for t, s in zip(reversed(times), reversed(states)):
            if t < time:
                return s
        raise KeyError(token)

    def _has(self, state: int, token: int, time: int) -> bool:
        """Is there an arc ``token`` from ``state`` just before rule ``time``?"""
        key = (state, token, time if token in self.rule else -1)
        known = self._memo.get(key)
        if known is not None:
            return known
        s, out = state, None
        r = self.rule.get(token)
        while out is None:
            if self.lost[s] == token:
                out = False
            elif r is None:
                if s == 0:
                    out = True
                else:
                    s = self.parent[s]
            elif r[0] >= time:
                out = False
            elif self.born[s] > r[0]:
                s = self.parent[s]  # the arc was there, or not, when the state was copied
            else:
                out = self._has(s, r[1], r[0]) and self._has(self._lead(r[1], r[0]), r[2], r[0])
        self._memo[key] = out
        return out

    def _gadget(self, k: int, u: int, v: int, w: int) -> None:
        q = self._lead(u, k)
        behind = self._lead(v, k)
        if self._has(q, v, k):
            self.parent.append(q)
            self.born.append(k)
            self.lost.append(v)
            self.leads[u][0].append(k)
            self.leads[u][1].append(len(self.parent) - 1)
        self.rule[w] = (k, u, v)
        if w not in self.leads:
            self.leads[w] = ([k], [behind])

    def step(self, state: int, token: int) -> bool:
        key = (state, token)
        known = self.arcs.get(key)
        if known is None:
            known = self.arcs[key] = self._has(state, token, self.now)
            if len(self._memo) > 2_000_000:
                self._memo.clear()
        return known

    def encode_word(self, word: bytes) -> list[int]:
        """Labels of the one path that spells ``word``; longest arcs are tried first, dead ends are remembered."""
        n, ids, longest, state_of, step = len(word), self.ids, self.longest, self.state_of, self.step
        out: list[int] = []
        ends: list[int] = []  # next length to try at each place on the path
        dead: set[tuple[int, int]] = set()
        at, state, length = 0, 0, min(longest, n)
        while at < n:
            found = False
            while length > 0:
                t = ids.get(word[at : at + length])
                if t is not None and (at + length, t) not in dead and step(state, t):
                    found = True
                    break
                length -= 1
            if found:
                out.append(t)
                ends.append(length)
                at += length
                state = state_of[t]
                length = min(longest, n - at)
            else:
                t = out.pop()
                length = ends.pop()
                dead.add((at, t))
                at -= length
                state = state_of[out[-1]] if out else 0
                length -= 1
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.label.__getitem__, ids))


def word_starts(codes: np.ndarray, doc_start: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Marks where words begin in concatenated texts.

    The pattern: contractions 's 't 're 've 'm 'll 'd; runs of letters, of numbers or of other characters, each with one
    blank before it; white space, whose last character goes to what follows (a blank joins it, others stand alone).
    ``doc_start`` marks the first character of each text.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, bool)
    cls = classes[codes]
    start = doc_start.copy()
    start[1:] |= cls[1:] != cls[:-1]
    start[0] = True
    white = cls == SPACE
    ends_white = np.zeros(n, bool)  # white space before something else in the same text
    ends_white[:-1] = white[:-1] & ~white[1:] & ~doc_start[1:]
    after_blank = np.zeros(n, bool)
    after_blank[1:] = ends_white[:-1] & (codes[:-1] == 32)
    start |= ends_white
    start &= ~after_blank
    # Contractions begin where a run of other characters begins with an apostrophe.
    at = np.flatnonzero((codes == 39) & start)
    if len(at):
        room = np.full(len(at), 2)  # characters left in the text, as far as they matter
        follow = np.zeros((len(at), 2), np.uint32)
        for j in (1, 2):
            ok = at + j < n
            inside = ok.copy()
            inside[ok] = ~doc_start[at[ok] + j]
            if j == 2:
                inside &= room >= 1
            follow[inside, j - 1] = codes[at[inside] + j]
            room[~inside] = np.minimum(room[~inside], j - 1)
        one = np.isin(follow[:, 0], [ord(c) for c in "stmd"])
        pair = follow[:, 0] * 256 + follow[:, 1]
        two = np.isin(pair, [ord(p[0]) * 256 + ord(p[1]) for p in ("re", "ve", "ll")])
        length = np.where(one, 1, np.where(two, 2, 0))
        at, length = at[length > 0], length[length > 0]
        start[at + 1] = False
        end = at + 1 + length
        inner = end < n
        start[end[inner]] |= ~white[end[inner]] | start[end[inner]]
        # What follows a contraction begins a word, be it the rest of a run of letters or not.
        start[end[inner]] = True
    return start


def _split_long(text: str, size: int) -> Iterator[str]:
    """Parts of at most about ``size`` characters, cut where a blank between visible characters begins a word anyway."""
    i, n = 0, len(text)
    while n - i > size:
        cut = text.find(" ", i + size)
        while cut != -1 and cut + 1 < n and (text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.find(" ", cut + 1)
        if cut == -1 or cut + 1 >= n:
            break
        yield text[i:cut]
        i = cut
    yield text[i:]


class Encoder:
    """Encodes batches of texts; keeps the words it has seen."""

    def __init__(self, automaton: Automaton, classes: np.ndarray | None = None):
        self.automaton = automaton
        self.classes = char_classes() if classes is None else classes
        self.known: dict[bytes, list[int]] = {}

    def words(self, texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
        """Words of the texts in order, as a dictionary array, and the number of words of each text."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        first = np.zeros(len(codes), bool)
        begins = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
        first[begins[lengths > 0]] = True
        at = np.flatnonzero(word_starts(codes, first, self.classes))
        width = 1 + (codes >= 0x80).astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000)
        byte_at = np.concatenate(([0], np.cumsum(width, dtype=np.int64)))
        offsets = byte_at[np.append(at, len(codes))].astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(joined.encode())])
        counts = np.searchsorted(at, begins + lengths) - np.searchsorted(at, begins)
        return words.dictionary_encode(), counts

    def ids_of(self, words: list[bytes]) -> list[list[int]]:
        known, encode = self.known, self.automaton.encode_word
        if len(known) > REMEMBERED:
            known.clear()
        out = []
        for w in words:
            ids = known.get(w)
            if ids is None:
                ids = encode(w)
                if len(w) < 64:
                    known[w] = ids
            out.append(ids)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All token ids in order, and the number of tokens of each text."""
        words, counts = self.words(texts)
        per = self.ids_of(words.dictionary.to_pylist())
        sizes = np.fromiter(map(len, per), np.int64, len(per))
        flat = np.fromiter((t for ids in per for t in ids), np.int32, int(sizes.sum()))
        which = words.indices.to_numpy(zero_copy_only=False)
        n = sizes[which]
        total = int(n.sum())
        begin = np.concatenate(([0], np.cumsum(sizes)))[:-1][which]
        # Positions of all tokens: runs that begin at ``begin`` with lengths ``n``.
        out = flat[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(total)] if total else np.zeros(0, np.int32)
        words_end = np.cumsum(counts)
        tokens_before = np.concatenate(([0], np.cumsum(n)))
        return out, tokens_before[words_end] - tokens_before[words_end - counts]

    def batches(self, texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Encode in groups of bounded size: (first text, end, ids, sizes); a very long text is encoded in parts."""
        i = 0
        while i < len(texts):
            held, chars, j = [], 0, i
            while j < len(texts) and (not held or chars + len(texts[j] or "") <= CHUNK_CHARS):
                held.append(texts[j] or "")
                chars += len(held[-1])
                j += 1
            if len(held) == 1 and chars > CHUNK_CHARS:
                parts = [self.encode([p])[0] for p in _split_long(held[0], CHUNK_CHARS)]
                ids = np.concatenate(parts)
                yield i, j, ids, np.array([len(ids)], np.int64)
            else:
                yield (i, j, *self.encode(held))
            i = j


_encoders: dict[str, Encoder] = {}


def shipped(spark, path: str):
    """The compiled automaton for the executors: its size is that of the vocabulary (a few MB), not of the data."""
    compiled = compiled_automaton(path)
    return spark.sparkContext.broadcast((path, compiled, char_classes()))


@lru_cache(4)
def compiled_automaton(path: str) -> Automaton:
    return Automaton(path)


def encoder_of(value) -> Encoder:
    """One encoder per worker process and vocabulary."""
    path, automaton, classes = value
    if path not in _encoders:
        _encoders[path] = Encoder(automaton, classes)
    return _encoders[path]


def encode_column(df: DataFrame, key: str, text: str, path: str = DEFAULT) -> DataFrame:
    """(key, ids): token ids of each row's text, without special tokens.

    Defined cases: null and empty texts give an empty list; white space is text; what looks like a special token is
    ordinary text; repeated rows are encoded each; other columns are not carried.
    """
    shared = shipped(df.sparkSession, path)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(shared.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j, ids, sizes in enc.batches(texts):
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), lists], ["key", "ids"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode_column(df: DataFrame, ids: str, out: str, path: str = DEFAULT) -> DataFrame:
    """Adds ``out``: the bytes that the ids spell, as text."""
    shared = shipped(df.sparkSession, path)

    @F.pandas_udf("string")
    def run(col):
        a = encoder_of(shared.value).automaton
        return col.map(lambda v: None if v is None else a.decode(list(v)).decode("utf-8", "replace"))

    return df.withColumn(out, run(F.col(ids)))
