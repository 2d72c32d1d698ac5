"""Packing of tokenised documents into fixed-length sequences (operator 3).

Each input partition is tokenised and packed on its own, without a shuffle, in blocks of a bounded
number of documents. A document longer than a sequence gives full sequences and a remainder. The
remainders of a block are counted by length; each window takes the longest remainder left and then the
multiset of remaining lengths whose sum comes closest to the capacity: reachable sums are a bitset
(one big integer) that grows by one shift for each length and power-of-two count, kept per step, and
the chosen counts are read back through these steps. What no multiset can fill waits for the next
block. Only a partition's last window can have slack; there tokens may be cut freely, so it is
written as sequences whose lengths are powers of two, which need no padding.

Defined results: a null or empty text is the end id alone; repeated rows are packed once for each row;
an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm._arrays import chunks, distinct_slices, offsets_of
from canopy.llm._classes import LETTER, NUMBER, SPACE, classes, codepoints
from canopy.llm._merge import PairTable, WordCache


def minimum_slack(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Counts by length, at most those given, whose total length comes closest to ``capacity``."""
    mask, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted((x for x in counts if counts[x] and x <= capacity), reverse=True):
        left, part = min(counts[length], capacity // length), 1
        while left:
            take = min(part, left)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            left, part = left - take, part * 2
        if reach >> capacity & 1:
            break
    total, chosen = reach.bit_length() - 1, defaultdict(int)
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            chosen[length] += take
    return dict(chosen)


def plan_windows(counts: dict[int, int], capacity: int, final: bool) -> list[dict[int, int]]:
    """Windows, each a multiset of lengths; unless ``final``, ends at the first that cannot be filled."""
    counts, out = {k: v for k, v in counts.items() if v}, []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        chosen = minimum_slack(counts, capacity - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        if not final and sum(k * v for k, v in chosen.items()) < capacity:
            counts[longest] += 1
            break
        counts[longest] += 1
        for k, v in chosen.items():
            counts[k] -= v
        counts = {k: v for k, v in counts.items() if v}
        out.append(chosen)
    return out


class Packer:
    """Packs the documents of one partition; yields (document, start, length, sequence, offset)."""

    def __init__(self, capacity: int, first_sequence: int, hold: int):
        self.capacity, self.sequence, self.hold = capacity, first_sequence, hold
        self.waiting: dict[int, deque] = defaultdict(deque)
        self.count = 0

    def add(self, doc: int, length: int) -> Iterator[tuple[int, int, int, int, int]]:
        full, rest = divmod(length, self.capacity)
        for k in range(full):
            yield doc, k * self.capacity, self.capacity, self.sequence, 0
            self.sequence += 1
        if rest:
            self.waiting[rest].append((doc, full * self.capacity))
            self.count += 1
            if self.count >= self.hold:
                yield from self.flush(final=False)

    def flush(self, final: bool) -> Iterator[tuple[int, int, int, int, int]]:
        windows = plan_windows({k: len(v) for k, v in self.waiting.items()}, self.capacity, final)
        if not final and not windows:
            windows = plan_windows({k: len(v) for k, v in self.waiting.items()}, self.capacity, True)[:1]
        for chosen in windows:
            pieces = [(*self.waiting[k].popleft(), k) for k, n in sorted(chosen.items(), reverse=True) for _ in range(n)]
            self.count -= len(pieces)
            yield from self._write(pieces)

    def _write(self, pieces: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int, int]]:
        """One sequence if full; else one for each power of two in the total length."""
        total = sum(x[2] for x in pieces)
        sizes = [total] if total == self.capacity else [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
        at = 0
        for doc, start, length in pieces:
            while length:
                take = min(length, sizes[0] - at)
                yield doc, start, take, self.sequence, at
                start, length, at = start + take, length - take, at + take
                if at == sizes[0]:
                    sizes.pop(0)
                    self.sequence, at = self.sequence + 1, 0


class WordBpe:
    """Ids of a lower-casing BPE tokenizer file with word ends, as its library gives them.

    White space is dropped and no merge crosses a piece of the split pattern, so distinct pieces are
    encoded once and cached. Texts that hold a special token go to the library as a whole.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        suffix = spec["model"]["end_of_word_suffix"]
        self.special = re.compile("|".join(re.escape(x["content"]) for x in spec["added_tokens"]))
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left, right = np.array([vocab[a] for a, _ in pairs]), np.array([vocab[b] for _, b in pairs])
        self.pairs = PairTable(left, right, np.arange(len(pairs)), np.array([vocab[a + b] for a, b in pairs]))
        signs = _byte_signs()
        self.inner = np.array([vocab[c] for c in signs], np.int32)
        self.final = np.array([vocab[c + suffix] for c in signs], np.int32)
        self.cache = WordCache(self._merge)

    def _merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [w.encode("utf-8", "replace") for w in words]
        offsets = offsets_of(np.fromiter(map(len, raw), np.int64, len(raw)))
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        symbols[offsets[1:] - 1] = self.final[data[offsets[1:] - 1]]
        return self.pairs.merge(symbols, offsets)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and the offsets of each text's ids."""
        odd = [i for i, t in enumerate(texts) if self.special.search(t)]
        if not odd:
            return self._encode(texts)
        ids, offsets = self._encode([("" if self.special.search(t) else t) for t in texts])
        parts = [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        for i in odd:
            parts[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.int32)
        return np.concatenate(parts), offsets_of(np.fromiter(map(len, parts), np.int64, len(parts)))

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        clean = [unicodedata.normalize("NFC", t).replace("Σ", "σ").lower() for t in texts]
        joined = " ".join(clean)
        codes = codepoints(joined)
        bounds = offsets_of(np.fromiter(map(len, clean), np.int64, len(clean)) + 1)
        starts, ends = _pieces(codes)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        at, inverse = distinct_slices(codes, starts, ends)
        words = [joined[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        ids, lengths = self.cache.lookup(words, inverse)
        return ids, offsets_of(lengths)[np.searchsorted(starts, bounds)]


def _byte_signs() -> list[str]:
    """The printable sign that byte-level vocabularies write for each byte: printable Latin-1 bytes
    stand for themselves, the others for the code points from 256 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _pieces(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of contractions, letter runs, single numbers and runs of other signs."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes()[codes]
    cut = np.ones(n + 1, bool)
    cut[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    quote = np.flatnonzero(codes == 0x27)
    quote = quote[cut[quote]]  # inside a run of signs it opens nothing
    padded = np.append(codes, [0, 0])
    one, two = padded[quote + 1], padded[quote + 2]
    short = quote[np.isin(one, [ord(c) for c in "stmd"])]
    long_ = quote[np.any([(one == ord(a)) & (two == ord(b)) for a, b in ("re", "ve", "ll")], axis=0)]
    for at, size in ((short, 2), (long_, 3)):
        cut[at + 1] = False
        if size == 3:
            cut[at + 2] = False
        cut[at + size] = True
    starts = np.flatnonzero(cut[:n])
    ends = np.append(starts[1:], n)
    keep = kind[starts] != SPACE
    return starts[keep], ends[keep]


@cache
def load(path: str) -> WordBpe:
    return WordBpe(path)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", hold: int = 2000, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and the
    piece's ``ids``). ``hold``: documents' remainders that a task keeps before it packs them."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(tokenizer_path)
        packer = Packer(capacity, TaskContext.get().partitionId() << 40, hold)
        held: dict[int, tuple] = {}
        number = 0

        def table(pieces: list[tuple[int, int, int, int, int]]) -> pa.RecordBatch:
            columns: list[list] = [[] for _ in names]
            for doc, start, length, sequence, offset in pieces:
                key, ids = held[doc]
                part = ids[start : start + length]
                row = (key, start, length, zlib.crc32(part.tobytes()), len(ids), sequence, offset, *([part] if with_ids else []))
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
                if start + length == len(ids):
                    done.append(doc)
            types = [key_type, *[pa.int64()] * 6, *([pa.list_(pa.int32())] if with_ids else [])]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        key_type, done = pa.int64(), []
        for batch in batches:
            key_type = batch.column(0).type
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in chunks(texts):
                ids, offsets = model.encode(texts[lo:hi])
                pieces = []
                for i in range(hi - lo):
                    own = np.append(ids[offsets[i] : offsets[i + 1]], end_id).astype("<u4")
                    held[number] = (keys[lo + i], own)
                    pieces += packer.add(number, len(own))
                    number += 1
                yield table(pieces)
                for d in done:
                    held.pop(d, None)
                done.clear()
        if held:
            yield table(list(packer.flush(final=True)))

    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
