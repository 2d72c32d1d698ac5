"""Byte-level BPE encoding and decoding (operator 7).

A whole chunk of texts is turned into one code-point array, each code point into a symbol of a small
alphabet, and each symbol stands for a transition function of a ten-state automaton that marks where
tokens begin. Composition of such functions is associative, so the states before every character come
from a doubling scan over function numbers (the functions form a small monoid with a composition
table) that stops as soon as every prefix has become constant. The slices between the marks are looked
up in a cache; slices not seen yet are merged together, many at once. Offsets are kept per text, and
decoding gathers the bytes of the ids again.

Defined results: a null text is the empty text (no ids, hashes of nothing); repeated rows give repeated
rows; other columns are not read, so clashing names do no harm.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm._arrays import chunks, distinct_slices, offsets_of, ragged
from canopy.llm._classes import LETTER, NUMBER, SPACE, classes, codepoints
from canopy.llm._merge import PairTable, WordCache

# Symbols: letter, number, other, apostrophe that may open a one- or two-letter contraction,
# white space inside a run (or at the end of the text), last of a run: a blank, another white space.
_L, _N, _O, _A1, _A2, _S, _P, _W = range(8)
# States: after nothing, a letter, a number, another sign, inner white space, a last blank, a last other
# white space; one or two contraction letters still to come, contraction over. The last three act as "letter".
_START, _AL, _AN, _AO, _AS, _AP, _AW, _C1, _C2, _END = range(10)
_STATES = 10


def _next(state: int, symbol: int) -> int:
    if symbol == _L:
        return {_C2: _C1, _C1: _END}.get(state, _AL)
    if symbol in (_A1, _A2):
        return _AO if state in (_AO, _AP) else (_C1 if symbol == _A1 else _C2)
    return {_N: _AN, _O: _AO, _S: _AS, _P: _AP, _W: _AW}[symbol]


def _begins(state: int, symbol: int) -> bool:
    """Whether a token begins at a character of this symbol when the automaton is in this state."""
    if state == _START:
        return True
    if symbol in (_P, _W):
        return True
    if symbol == _S:
        return state != _AS
    if state == _AP:
        return False
    if symbol == _L:
        return state not in (_AL, _C1, _C2)
    if symbol == _N:
        return state != _AN
    return state != _AO


@cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the eight generators, the composition table, which functions are constant, each one's
    result from the start state, and the table of token beginnings."""
    generators = [tuple(_next(s, c) for s in range(_STATES)) for c in range(8)]
    # the first character of a text is read from the start state whatever came before
    resets = [tuple([f[_START]] * _STATES) for f in generators]
    known = {f: i for i, f in enumerate(dict.fromkeys([*generators, *resets]))}
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in list(known):
            for h in (tuple(g[x] for x in f), tuple(f[x] for x in g)):
                if h not in known:
                    known[h] = len(known)
                    todo.append(h)
    if len(known) > 256:
        raise AssertionError("the monoid must fit in one byte")
    functions = list(known)
    compose = np.zeros((256, 256), np.uint8)
    for f, i in known.items():
        for g, j in known.items():
            compose[i, j] = known[tuple(g[x] for x in f)]  # f, then g
    constant = np.zeros(256, bool)
    constant[[i for i, f in enumerate(functions) if len(set(f)) == 1]] = True
    value = np.zeros(256, np.uint8)
    value[: len(functions)] = [f[_START] for f in functions]
    begins = np.array([[_begins(s, c) for c in range(8)] for s in range(_STATES)])
    return np.array([[known[f] for f in generators], [known[f] for f in resets]], np.uint8), compose.ravel(), constant, value, begins


def token_starts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions at which a token of the split pattern begins. ``first``: where the texts begin."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[codes]
    ends = np.zeros(n + 1, bool)
    ends[first[first < n]] = True
    ends[n] = True
    space = kind == SPACE
    last = np.zeros(n, bool)  # white space followed, in its text, by something else
    last[:-1] = space[:-1] & ~space[1:] & ~ends[1:n]
    symbol = np.full(n, _O, np.uint8)
    symbol[kind == LETTER], symbol[kind == NUMBER], symbol[space] = _L, _N, _S
    symbol[last] = np.where(codes[last] == 0x20, _P, _W)
    quote = np.flatnonzero(codes == 0x27)
    if len(quote):
        padded = np.append(codes, [0, 0])
        stop = np.append(ends, [True, True])
        one, two = padded[quote + 1], padded[quote + 2]
        inside1, inside2 = ~stop[quote + 1], ~stop[quote + 1] & ~stop[quote + 2]
        symbol[quote[inside1 & np.isin(one, [ord(c) for c in "stmd"])]] = _A1
        pairs = [("r", "e"), ("v", "e"), ("l", "l")]
        symbol[quote[inside2 & np.any([(one == ord(a)) & (two == ord(b)) for a, b in pairs], axis=0)]] = _A2
    generators, compose, constant, value, begins = _monoid()
    scan = generators[ends[:n].astype(np.uint8), symbol]
    step = 1
    while step < n:
        open_ = ~constant[scan[step:]]
        if not open_.any():
            break
        at = np.flatnonzero(open_) + step
        scan[at] = compose[scan[at - step].astype(np.int64) * 256 + scan[at]]
        step *= 2
    state = np.full(n, _START, np.uint8)
    state[1:] = value[scan[:-1]]
    state[ends[:n]] = _START
    return np.flatnonzero(begins[state, symbol])


class ByteBpe:
    """Encoder and decoder for one rank file (lines of base64 token and rank)."""

    def __init__(self, ranks_path: str):
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, filter(None, map(bytes.strip, lines)))}
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for t, r in ranks.items():
            tokens[r] = t
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        joins = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        left, right, rank = (np.array(x, np.int64) for x in zip(*joins, strict=True))
        self.pairs = PairTable(left, right, rank, rank)
        self.whole = ranks
        self.bytes_lengths = np.fromiter(map(len, tokens), np.int64, size)
        self.bytes_starts = offsets_of(self.bytes_lengths)[:-1]
        self.bytes_all = np.frombuffer(b"".join(tokens), np.uint8)
        digits = [b"%d " % i for i in range(size)]
        self.digit_lengths = np.fromiter(map(len, digits), np.int64, size)
        self.digit_starts = offsets_of(self.digit_lengths)[:-1]
        self.digits_all = np.frombuffer(b"".join(digits), np.uint8)
        self.cache = WordCache(self._merge)

    def _merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [w.encode("utf-8", "replace") for w in words]
        symbols = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        whole = [self.whole.get(b, -1) for b in raw]  # a slice that is itself a token needs no merging
        offsets = offsets_of(np.fromiter(map(len, raw), np.int64, len(raw)))
        hit = np.array(whole, np.int64) >= 0
        rest = np.flatnonzero(~hit)
        lengths = np.diff(offsets)[rest]
        ids, cuts = self.pairs.merge(symbols[ragged(offsets[:-1][rest], lengths)], offsets_of(lengths))
        counts = np.ones(len(raw), np.int64)
        counts[rest] = np.diff(cuts)
        bounds = offsets_of(counts)
        out = np.zeros(int(bounds[-1]), np.int32)
        out[bounds[:-1][hit]] = np.array(whole, np.int64)[hit]
        out[ragged(bounds[:-1][rest], counts[rest])] = ids
        return out, bounds

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and the offsets of each text's ids."""
        joined = "".join(texts)
        codes = codepoints(joined)
        bounds = offsets_of(np.fromiter(map(len, texts), np.int64, len(texts)))
        starts = token_starts(codes, np.unique(bounds[:-1]))
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        ends = np.append(starts[1:], len(codes))
        at, inverse = distinct_slices(codes, starts, ends)
        words = [joined[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        ids, lengths = self.cache.lookup(words, inverse)
        return ids, offsets_of(lengths)[np.searchsorted(starts, bounds)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids on end, and the offsets of each text's bytes."""
        lengths = self.bytes_lengths[ids]
        return self.bytes_all[ragged(self.bytes_starts[ids], lengths)], offsets_of(lengths)[offsets]

    def decimals(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decimal ids, each with a space behind it, and the offsets of each text's."""
        lengths = self.digit_lengths[ids]
        return self.digits_all[ragged(self.digit_starts[ids], lengths)], offsets_of(lengths)[offsets]


@cache
def load(ranks_path: str) -> ByteBpe:
    return ByteBpe(ranks_path)


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>)`` of every whole text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(ranks_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in chunks(texts):
                ids, offsets = model.encode(texts[lo:hi])
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))], names=[id_col, "ids"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, decoded binary)``: the bytes that the ids stand for."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(ranks_path)
        for batch in batches:
            rows = [np.asarray(x or [], np.int64) for x in batch.column(1).to_pylist()]
            offsets = offsets_of(np.fromiter(map(len, rows), np.int64, len(rows)))
            raw, cuts = model.decode(np.concatenate(rows) if rows else np.zeros(0, np.int64), offsets)
            data = raw.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=[id_col, "decoded"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, decoded binary")


def digests(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)``: encode, decode the ids, and hash both."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(ranks_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in chunks(texts):
                ids, offsets = model.encode(texts[lo:hi])
                text_ids, id_cuts = model.decimals(ids, offsets)
                raw, raw_cuts = model.decode(ids, offsets)
                sha = lambda data, cuts, less: [hashlib.sha256(data[a : max(a, b - less)]).hexdigest() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], pa.array(np.diff(offsets), pa.int64()), pa.array(sha(text_ids, id_cuts, 1)), pa.array(sha(raw, raw_cuts, 0))],
                    names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
