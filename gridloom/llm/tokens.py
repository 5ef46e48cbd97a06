"""Encoding a corpus with a public byte-level BPE: the tokenization automaton.

Over token sequences the correct tokenizations of a byte-level BPE form a
regular language. Its automaton is built merge by merge: a state is the token
just read, at first only single bytes, each of which may follow any other. The
gadget of a merge (a, b) -> c adds the arc c wherever a could be read, lets c
be followed by what may then follow b, and takes the arc b away after a. A
token thus has the arcs its gadget copied, minus those later gadgets took; the
arc table of 50,000 x 50,000 is never laid out, an arc is looked up by
replaying the copies from the later gadget to the earlier (``Automaton.follows``)
and remembered.

A correct tokenization of a prefix stays a path of the automaton, so a word is
encoded left to right: a byte-level table gives the tokens that end at each
byte, longest first, and the one that the automaton allows after the path up to
its start is the only one. Decoding emits the arcs' byte labels.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The split pattern that belongs to the public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Where the public vocabulary files are; see ``vocabulary``.
TOKENIZERS = "/opt/tokenizers"
#: Words remembered by a worker, and the longest one it remembers.
WORDS, WORD_LEN = 200_000, 48
_NEVER = 1 << 60


def vocabulary(folder: str = TOKENIZERS, name: str = "byte_bpe_50k.json") -> str:
    return str(Path(folder) / name)


def _byte_letters() -> dict[str, int]:
    """The vocabulary file writes printable Latin-1 bytes as themselves and the others, in order, from U+0100."""
    plain = [b for b in range(256) if chr(b).isprintable() and b != 0x20 and b not in (0xA0, 0xAD)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Compiled from a vocabulary file; pickles small, and holds what it has looked up while it lives."""

    def __init__(self, file: str):
        model = json.loads(Path(file).read_text(encoding="utf-8"))["model"]
        letter = _byte_letters()
        raw = lambda s: bytes(letter[c] for c in s)
        ids = {raw(s): i for s, i in model["vocab"].items() if all(c in letter for c in s)}
        self.labels: dict[int, bytes] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # token: (left, right, turn of its gadget)
        self.gadget: dict[tuple[int, int], int] = {}  # (left, right): turn of the gadget that takes the arc away
        for b in range(256):
            self.labels[ids[bytes([b])]] = bytes([b])
        for turn, m in enumerate(model["merges"]):
            a, b = (raw(s) for s in (m if isinstance(m, list) else m.split(" ")))
            self._merge(turn, ids[a], ids[b], ids[a + b], a + b)
        self._byte_table()
        self._ready()

    def _merge(self, turn: int, a: int, b: int, c: int, label: bytes) -> None:
        self.gadget.setdefault((a, b), turn)
        if c not in self.labels:  # a second way to the same token never applies: its first gadget took the bytes
            self.labels[c] = label
            self.made[c] = (a, b, turn)

    def _byte_table(self) -> None:
        """Byte transitions between the prefixes of labels, with the longest label that ends in each, and each label's next shorter ending."""
        self.step: dict[int, int] = {}
        own = [-1]
        for t, label in self.labels.items():
            s = 0
            for x in label:
                nxt = self.step.get(s << 8 | x)
                if nxt is None:
                    nxt = self.step[s << 8 | x] = len(own)
                    own.append(-1)
                s = nxt
            own[s] = t
        n = len(own)
        self.back = [0] * n
        self.ends = own[:]
        self.shorter = {}
        kids: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for k, to in self.step.items():
            kids[k >> 8].append((k & 255, to))
        level = [0]
        while level:
            nxt = []
            for s in level:
                for x, to in kids[s]:
                    f = self.back[s]
                    if s:
                        while f and (f << 8 | x) not in self.step:
                            f = self.back[f]
                        self.back[to] = self.step.get(f << 8 | x, 0)
                    tail = self.ends[self.back[to]]
                    if own[to] >= 0:
                        self.shorter[own[to]] = tail
                    else:
                        self.ends[to] = tail
                    nxt.append(to)
            level = nxt

    def _ready(self) -> None:
        self.arcs: dict[int, bool] = {}
        self.size = {t: len(b) for t, b in self.labels.items()}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("arcs", "size")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def follows(self, u: int, v: int) -> bool:
        """Whether the finished automaton has the arc v after token u."""
        key = u << 20 | v
        known = self.arcs.get(key)
        if known is not None:
            return known
        a, b, until = u, v, _NEVER
        while True:
            turn = self.gadget.get((a, b))
            if turn is not None and turn < until:
                out = False
                break
            left, right = self.made.get(a), self.made.get(b)
            if left is None and right is None:
                out = True
                break
            # the later of the two had its row copied from its right part before its gadget took the arc away, or its column from its left part after
            if right is None or left is not None and left[2] > right[2]:
                until, a = left[2], left[1]
            else:
                until, b = right[2] + 1, right[0]
        if len(self.arcs) > 2_000_000:
            self.arcs.clear()
        self.arcs[key] = out
        return out

    def encode_word(self, word: bytes) -> list[int]:
        """The tokens of one pre-split word."""
        step, back, ends, shorter, size, follows = self.step, self.back, self.ends, self.shorter, self.size, self.follows
        last: list[int] = [-1]
        s = 0
        for i, x in enumerate(word, 1):
            nxt = step.get(s << 8 | x)
            while nxt is None:
                s = back[s]
                nxt = step.get(s << 8 | x)
            s = nxt
            t = ends[s]
            while True:
                at = i - size[t]
                if at == 0 or follows(last[at], t):
                    break
                t = shorter[t]
            last.append(t)
        out, i = [], len(word)
        while i:
            out.append(last[i])
            i -= size[last[i]]
        out.reverse()
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.labels.__getitem__, ids))


class Encoder:
    """Text to ids with an automaton; repeated words are looked up."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.split = regex.compile(PATTERN).findall

        class Words(dict):
            def __missing__(words, w: str) -> list[int]:
                ids = automaton.encode_word(w.encode("utf-8", "replace"))
                if len(w) <= WORD_LEN:
                    if len(words) >= WORDS:
                        words.clear()
                    words[w] = ids
                return ids

        self.words = Words()

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.words.__getitem__, self.split(text))))


def _shared_automaton(spark, file: str):
    """The automaton as a broadcast of a few MB; its size is the vocabulary's."""
    return spark.sparkContext.broadcast(pickle.dumps(Automaton(file).__getstate__(), protocol=5))


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", file: str | None = None) -> DataFrame:
    """(key, ids): the token ids of every text, without special tokens; an empty list for empty and null texts.

    Rows with a null key are kept, repeated rows stay repeated, the strings of
    special tokens are ordinary text, an empty table gives an empty result and
    further columns are ignored. Whole texts are encoded, in time linear in
    their length.
    """
    packed = _shared_automaton(docs.sparkSession, file or vocabulary())
    src = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder_of(packed)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for at in range(0, len(texts), 512):
                part = [enc.encode(t) if t else [] for t in texts[at : at + 512].to_pylist()]
                offsets = np.zeros(len(part) + 1, dtype=np.int32)
                np.cumsum([len(p) for p in part], out=offsets[1:])
                flat = np.fromiter(chain.from_iterable(part), dtype=np.int32, count=int(offsets[-1]))
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([keys[at : at + 512], ids], ["doc_id", "ids"])

    return src.mapInArrow(run, "doc_id bigint, ids array<int>").withColumnRenamed("doc_id", key)


def count_tokens(docs: DataFrame, keep: list[str], text: str = "text", file: str | None = None) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` of every row; 0 for empty and null texts."""
    packed = _shared_automaton(docs.sparkSession, file or vocabulary())
    src = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    kept = src.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder_of(packed)
        for batch in batches:
            n = pa.array([len(enc.encode(t)) if t else 0 for t in batch.column(len(batch.schema) - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], [*batch.schema.names[:-1], "n_tokens"])

    from pyspark.sql.types import LongType, StructField, StructType

    return src.mapInArrow(run, StructType([*kept.fields, StructField("n_tokens", LongType())]))


def _encoder_of(packed) -> Encoder:
    """One encoder a worker process, kept between its tasks."""
    import sys

    # functions come by value, so what a process keeps must hang on something every task sees
    kept = sys.modules.setdefault("_gridloom_encoders", type(sys)("_gridloom_encoders"))
    mark = hash(packed.value)
    if getattr(kept, "mark", None) != mark:
        automaton = Automaton.__new__(Automaton)
        automaton.__setstate__(pickle.loads(packed.value))
        kept.encoder, kept.mark = Encoder(automaton), mark
    return kept.encoder


def decode_corpus(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", file: str | None = None) -> DataFrame:
    """(key, text): the texts back from their ids; null ids give a null text."""
    packed = _shared_automaton(encoded.sparkSession, file or vocabulary())
    src = encoded.select(F.col(key).alias("doc_id"), F.col(ids).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _encoder_of(packed).automaton
        for batch in batches:
            texts = [None if x is None else a.decode(x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return src.mapInArrow(run, "doc_id bigint, text string").withColumnRenamed("doc_id", key)
