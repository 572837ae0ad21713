"""Byte-level BPE by a tokenization automaton.

Compilation starts from the one-state automaton over bytes and takes the merges in order. The gadget of a
merge (a, b) -> c: every arc labelled a is led to a copy of its target that lacks the arc b, and beside each
such arc an arc c is added to where b led. As all arcs of one label lead to one state, a state is fully
described by segments (token v, rank until): "the right operands that v was merged with before that rank have
lost their arcs". An arc x still leaves a state unless, at the time an arc on x's left spine was used to build
the next one, that arc was already lost. The automaton accepts exactly the token sequences that BPE makes.

For encoding the automaton is made deterministic over bytes. BPE gives every prefix of a word one path, and the path
without its last arc is the path of a shorter prefix. So after each byte exactly one arc is the last, and a state
needs to know the longest end of what was read that begins some label, and the last arc at each place within it: no
other place can matter to a label that is yet to end. A state and a byte determine the next state: of the labels
that end there, the one whose arc leaves the state known for the place where it begins. States are named when first
reached and their transitions kept in a table (bounded, per worker); a word is read by one look-up a byte, and its
arcs are read off backwards from the end. Nothing is tried twice. Paths of frequent words are remembered (bounded).
Decoding emits the labels (byte strings) of the arcs.

Nulls and empty texts have no tokens. Strings of added tokens inside a text become their ids, as the tokenizers
library does. A text is read whole, whatever its length. Rows are independent: repeated rows and null ids are encoded
like others; other columns pass through, but those with the names added here are replaced. An empty table gives an
empty table with the same columns.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .text import mapped, read

#: The pattern by which byte-level BPE splits text before merging (a fixed value of the tokenizer's format).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words' paths kept per Python worker, in each of two generations, and states with their transitions.
KEPT_WORDS = 220_000
KEPT_STATES = 120_000
#: The same pattern for texts below U+0250, with the letters and numbers there spelled out for the faster engine.
_LETTERS, _NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
SPLIT_LATIN = SPLIT.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{_LETTERS}{_NUMBERS}]").replace(r"\p{L}", f"[{_LETTERS}]").replace(r"\p{N}", f"[{_NUMBERS}]")
_beyond_latin = re.compile("[^\x00-\x1b\x20-ɏ]").search  # \x1c to \x1f are white space for one engine only
_split_latin = re.compile(SPLIT_LATIN).findall
_split_any = regex.compile(SPLIT).findall
_NEVER = 1 << 60


def _split(text: str) -> list[str]:
    return _split_any(text) if _beyond_latin(text) else _split_latin(text)


def _alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    def __init__(self, spec: dict):
        model, chars = spec["model"], _alphabet()
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        label = lambda s: bytes(chars[c] for c in s)
        size = max([*model["vocab"].values(), *self.added.values()]) + 1
        self.arcs: list[bytes] = [b""] * size
        self.ids: dict[bytes, int] = {}
        for s, i in model["vocab"].items():
            if s in self.added:
                continue
            self.arcs[i] = label(s)
            self.ids[self.arcs[i]] = i
        for s, i in self.added.items():
            self.arcs[i] = s.encode()
        self.lost: dict[int, dict[int, int]] = {}
        self.state: list[tuple[tuple[int, int], ...]] = [((i, _NEVER),) for i in range(size)]
        self.left: dict[int, tuple[int, int]] = {}
        self.spines: dict[int, tuple[tuple[int, int], ...]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self._gadget(self.ids[label(a)], self.ids[label(b)], self.ids[label(a + b)], rank)
        self.spines.clear()
        self.ids = {label: i for label, i in self.ids.items() if self._whole(i)}  # the others have no arc
        self.heads = {x[:k] for x in self.ids for k in range(1, len(x) + 1)}
        self._restart()
        self.paths = _Paths(self)
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None

    def _gadget(self, a: int, b: int, c: int, rank: int) -> None:
        if self._whole(a) and self._whole(b) and self._leads(a, b):
            target = tuple((v, min(until, rank)) for v, until in self.state[b])
            self.state[c] = ((c, _NEVER), *target)
            self.left[c] = (a, rank)
            self.lost.setdefault(a, {})[b] = rank

    def spine(self, x: int) -> tuple[tuple[int, int], ...]:
        """x and its left operands down to a byte, each with the rank at which it was used for the next."""
        got = self.spines.get(x)
        if got is None:
            if x in self.left:
                a, rank = self.left[x]
                got = ((x, _NEVER), (a, rank), *self.spine(a)[1:])
            else:
                got = ((x, _NEVER),)
            self.spines[x] = got
        return got

    def _leads(self, last: int, x: int) -> bool:
        spine = self.spine(x)
        for v, until in self.state[last]:
            lost = self.lost.get(v)
            if lost:
                for y, used in spine:
                    at = lost.get(y)
                    if at is not None and at < until and at <= used:
                        return False
        return True

    def _restart(self) -> None:
        """Only the state at a word's beginning, where any arc may leave."""
        self.tails: list[bytes] = [b""]
        self.lasts: list[tuple[int, ...]] = [(-1,)]
        self.named: dict[tuple[bytes, tuple[int, ...]], int] = {(b"", (-1,)): 0}
        self.table: dict[int, int] = {}
        self.last: list[int] = [-1]

    def _step(self, state: int, byte: int) -> int:
        """The state that byte leads to; it and the transition are kept."""
        tail, lasts, ids = self.tails[state] + bytes((byte,)), self.lasts[state], self.ids
        for k in range(len(tail), 0, -1):
            x = ids.get(tail[-k:])
            if x is not None and (lasts[-k] < 0 or self._leads(lasts[-k], x)):
                break
        else:
            raise ValueError("no accepted path: the vocabulary lacks a byte")
        while tail not in self.heads:
            tail = tail[1:]
        key = (tail, (*lasts, x)[-len(tail) - 1 :])
        got = self.named.setdefault(key, len(self.tails))
        if got == len(self.tails):
            self.tails.append(tail)
            self.lasts.append(key[1])
            self.last.append(x)
        self.table[state << 8 | byte] = got
        return got

    def _room(self, state: int) -> int:
        """The state's name once there is room for more: a full table is emptied but for this state."""
        if len(self.tails) < KEPT_STATES and len(self.table) < 2 * KEPT_STATES:
            return state
        key = (self.tails[state], self.lasts[state])
        self._restart()
        if self.named.setdefault(key, 1):
            self.tails.append(key[0])
            self.lasts.append(key[1])
            self.last.append(key[1][-1])
        return self.named[key]

    def path(self, word: bytes) -> tuple[int, ...]:
        """The one accepted path."""
        state, last = 0, array("i")
        for byte in word:
            there = self.table.get(state << 8 | byte)
            if there is None:
                state = self._room(state)
                there = self._step(state, byte)
            state = there
            last.append(self.last[state])
        out, at = [], len(word)
        while at:
            x = last[at - 1]
            out.append(x)
            at -= len(self.arcs[x])
        return tuple(out[::-1])

    def _whole(self, x: int) -> bool:
        """Whether x is a byte or was made by a merge that can happen."""
        return x in self.left or len(self.arcs[x]) == 1

    def encode(self, text: str) -> list[int]:
        if self.parts is None:
            return list(chain.from_iterable(map(self.paths.__getitem__, _split(text))))
        out: list[int] = []
        for piece in self.parts(text):
            if piece in self.added:
                out.append(self.added[piece])
            elif piece:
                out += chain.from_iterable(map(self.paths.__getitem__, _split(piece)))
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.arcs.__getitem__, ids)).decode("utf-8", "replace")


class _Paths(dict):
    """Words' paths. When a generation is full the one before it goes, but for words met again meanwhile."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton
        self.old: dict[str, tuple[int, ...]] = {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        got = self.old.get(word)
        if got is None:
            got = self.automaton.path(word.encode())
        if len(word) <= 40:
            if len(self) >= KEPT_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = got
        return got


_COMPILED: dict[str, Automaton] = {}


def _automaton(name: str, spec: str) -> Automaton:
    if name not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[name] = Automaton(json.loads(spec))
    return _COMPILED[name]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _with(df: DataFrame, column: str, path: str | None, make, fields: list[T.StructField]) -> DataFrame:
    """The vocabulary file is read here and sent out: its size is that of the file."""
    with open(path or default_vocabulary(), encoding="utf-8") as f:
        spec = f.read()
    name = hashlib.sha256(spec.encode()).hexdigest()
    shared = df.sparkSession.sparkContext.broadcast(spec)
    return mapped(df, lambda batch: make(_automaton(name, shared.value), batch.column(column)), fields)


def encoded(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """df with token_ids."""

    def make(a: Automaton, column: pa.Array) -> list[pa.Array]:
        ids, ends = array("i"), [0]
        for x in column:
            ids.extend(a.encode(x.as_py() or ""))
            ends.append(len(ids))
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, np.int32)))]

    return _with(df, text, path, make, [T.StructField("token_ids", T.ArrayType(T.IntegerType()))])


def decoded(df: DataFrame, ids: str = "token_ids", path: str | None = None) -> DataFrame:
    """df with decoded_text; null ids read as none."""

    def make(a: Automaton, column: pa.Array) -> list[pa.Array]:
        return [pa.array([a.decode(x.as_py() or []) for x in column], pa.string())]

    return _with(df, ids, path, make, [T.StructField("decoded_text", T.StringType())])


def tokenized(df: DataFrame, text: str = "text", path: str | None = None, ids: bool = True) -> DataFrame:
    """df with n_tokens, ids_sha256 and decoded_sha256 of encoding each text and decoding the ids again; with token_ids if asked."""

    def make(a: Automaton, column: pa.Array) -> list[pa.Array]:
        names = _names(a)
        held, ends, ids_sha, text_sha = array("i"), [0], [], []
        for x in column:
            own = a.encode(x.as_py() or "")
            ends.append(ends[-1] + len(own))
            if ids:
                held.extend(own)
            ids_sha.append(hashlib.sha256(",".join(map(names.__getitem__, own)).encode()).hexdigest())
            text_sha.append(hashlib.sha256(a.decode(own).encode()).hexdigest())
        out = [pa.array(np.diff(ends), pa.int64()), pa.array(ids_sha), pa.array(text_sha)]
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(held, np.int32))), *out] if ids else out

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _with(df, text, path, make, [T.StructField("token_ids", T.ArrayType(T.IntegerType())), *fields] if ids else fields)


def _names(a: Automaton) -> list[str]:
    if not hasattr(a, "names"):
        a.names = [str(i) for i in range(len(a.arcs))]
    return a.names


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: see the contract; one row per document."""
    return tokenized(read(spark, sf_dir, "documents").select("doc_id", "text"), ids=False).drop("text")
