"""Document fingerprints by invertible Bloom lookup sketches (operator 11).

A text is a multiset of paragraphs: its lines, each cut further behind words whose hash is 0 modulo ``every``, so
that an edit inside a long line leaves the rest of it alone. A paragraph's key is a hash of its bytes and of how
often it occurred before in the text. The fingerprint holds three cells for each key, in a table of ``cells``
cells, and each cell the number, the exclusive or and the checksums' exclusive or of its keys.

Two fingerprints are subtracted cell by cell, which leaves the keys that only one side has. Cells with one key are
peeled, round by round, until nothing is left: what was peeled is the exact difference, and so the likeness
(common paragraphs over all) is exact as well. Where peeling gets stuck, both texts are sketched again in a table
of twice the size, until it succeeds. All documents of a chunk are sketched and peeled together, as arrays.

Each document's successor comes by one shuffle of the texts: a narrow sort of ids and text hashes gives the ranges
and the first key of each, every text goes to its range, and a range's first text also to the range before.

Defined results: a null text is an empty one, which is one empty line; equal texts have equal fingerprints and
likeness 1; a null id comes behind all others, rows of one id by their texts' hashes; repeated rows follow
each other; one row is its own successor; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm._arrays import U64, _SPACE, chunks, mix, offsets_of, slice_hashes

#: Cells of a fingerprint (three equal parts), and the words of a line after which a cut comes on average.
CELLS, EVERY = 48, 16
#: Characters of a range of documents.
RANGE_CHARS = 1 << 25
_CELL = np.dtype([("n", "<i4"), ("key", "<u8"), ("check", "<u4")])
_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def paragraph_keys(texts: list[str], every: int = EVERY) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all paragraphs, and the offsets of each text's keys."""
    parts = [t.encode("utf-8", "replace") for t in texts]
    raw = np.frombuffer(b"".join(x for p in parts for x in (p, b"\n")), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    solid = np.zeros(len(raw) + 2, bool)
    np.logical_not(_SPACE[raw], out=solid[1:-1])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    word_end = edge[1::2]
    hit = word_end[slice_hashes(raw, edge[0::2], word_end) % U64(every) == 0]
    cut = np.union1d(np.flatnonzero(raw == 10) + 1, hit[raw[hit] != 10])
    start = np.concatenate([[0], cut[:-1]])
    digest, doc = slice_hashes(raw, start, cut), np.searchsorted(ends, start, side="right")
    order = np.lexsort((digest, doc))
    digest, doc = digest[order], doc[order]
    first = np.ones(len(doc), bool)
    first[1:] = (digest[1:] != digest[:-1]) | (doc[1:] != doc[:-1])
    run = np.maximum.accumulate(np.where(first, np.arange(len(doc)), 0))
    occurrence = (np.arange(len(doc)) - run).astype(U64)
    return mix(digest + occurrence * U64(_SEEDS[0])), np.searchsorted(doc, np.arange(len(texts) + 1))


def _places(keys: np.ndarray, cells: int) -> list[np.ndarray]:
    third = cells // 3
    return [(mix(keys ^ U64(seed) + U64(cells)) % U64(third)).astype(np.int64) + j * third for j, seed in enumerate(_SEEDS)]


def _checks(keys: np.ndarray) -> np.ndarray:
    return (mix(keys * U64(5) + U64(1)) >> U64(32)).astype(np.uint32)


def _put(table: np.ndarray, owner: np.ndarray, keys: np.ndarray, sign: np.ndarray, cells: int) -> None:
    """Adds (sign 1) or takes out (sign -1) each key in the table of its owner, a row of ``table``."""
    at = np.concatenate([owner * cells + p for p in _places(keys, cells)])
    flat = table.reshape(-1)
    flat["n"] += np.bincount(at, np.tile(sign, 3), len(flat)).astype(np.int32)
    order = np.argsort(at)
    at = at[order]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else at
    for name, values in (("key", keys), ("check", _checks(keys))):
        if len(at):
            flat[name][at[first]] ^= np.bitwise_xor.reduceat(np.tile(values, 3)[order], first)


def sketches(keys: np.ndarray, offsets: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """A row of cells for each text."""
    out = np.zeros((len(offsets) - 1, cells), _CELL)
    _put(out, np.repeat(np.arange(len(out)), np.diff(offsets)), keys, np.ones(len(keys)), cells)
    return out


def subtract(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a.copy()
    out["n"] -= b["n"]
    out["key"] ^= b["key"]
    out["check"] ^= b["check"]
    return out


def peel(table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, sign) of all keys that come out of subtracted sketches, and which rows are empty in the end."""
    table, cells = table.copy(), table.shape[1]
    rows, keys, signs = [np.zeros(0, np.int64)], [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for _ in range(4 * cells):
        row, cell = np.nonzero((np.abs(table["n"]) == 1) & (_checks(table["key"]) == table["check"]))
        if not len(row):
            break
        key, sign = table["key"][row, cell], table["n"][row, cell].astype(np.int64)
        order = np.lexsort((key, row))
        row, key, sign = row[order], key[order], sign[order]
        first = np.ones(len(row), bool)
        first[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
        row, key, sign = row[first], key[first], sign[first]
        _put(table, row, key, -sign, cells)
        for held, new in ((rows, row), (keys, key), (signs, sign)):
            held.append(new)
    done = ~(table["n"].any(1) | table["key"].any(1) | table["check"].any(1))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(signs), done


def _gather(keys: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(offsets)[rows]
    to = offsets_of(sizes)
    return keys[np.arange(to[-1]) + np.repeat(offsets[rows] - to[:-1], sizes)], to


def differences(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], cells: int = CELLS, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, key, sign) of the keys that only the left (1) or only the right text (-1) of a pair has.

    ``left`` and ``right``: keys and offsets; ``first``: the subtracted sketches of ``cells`` cells, if at hand.
    """
    todo, out = np.arange(len(left[1]) - 1), []
    size = np.full(len(todo), cells)
    while len(todo):
        cells = int(size[todo].min())
        now, later = todo[size[todo] == cells], todo[size[todo] > cells]
        if first is None:
            first = subtract(sketches(*_gather(*left, now), cells), sketches(*_gather(*right, now), cells))
        # the share of cells without a key tells how many keys there are; far too many are not peeled at all
        untouched = ((first["n"] == 0) & (first["key"] == 0)).mean(1)
        load = np.log(1 / np.maximum(untouched, 1 / cells)) / 3
        row, key, sign, done = peel(first[load < 1])
        some = np.flatnonzero(load < 1)
        row, good = some[row], done[row]
        out.append((now[row[good]], key[good], sign[good]))
        stuck = np.ones(len(now), bool)
        stuck[some[done]] = False
        size[now[stuck]] = cells << np.maximum(1, np.ceil(np.log2(1.5 * load[stuck]))).astype(np.int64)
        todo, first = np.concatenate([later, now[stuck]]), None
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64))


def likeness(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], cells: int = CELLS, first: np.ndarray | None = None) -> np.ndarray:
    """Common paragraphs over all paragraphs of each pair."""
    pair, _, _ = differences(left, right, cells, first)
    total, differ = np.diff(left[1]) + np.diff(right[1]), np.bincount(pair, minlength=len(left[1]) - 1)
    return (total - differ) / (total + differ)


def texts_of(sketch: np.ndarray) -> list[str]:
    """A fingerprint's text: its cells in base 64."""
    return [base64.b64encode(row.tobytes()).decode() for row in sketch]


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS, every: int = EVERY) -> DataFrame:
    """``(doc_id, fingerprint)``, one row for each input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in chunks(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(texts_of(sketches(*paragraph_keys(texts[lo:hi], every), cells)))], names=["id", "fingerprint"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(run, f"id {kind}, fingerprint string").select(F.col("id").alias(id_col), "fingerprint")


def compare(df: DataFrame, left_col: str, right_col: str, id_col: str = "doc_id", cells: int = CELLS, every: int = EVERY) -> DataFrame:
    """``(doc_id, likeness, removed, added)``: keys of the paragraphs that only the left or the right text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([t or "" for t in batch.column(k).to_pylist()] for k in (1, 2))
            for lo, hi in chunks([x + y for x, y in zip(a, b, strict=True)]):
                left, right = paragraph_keys(a[lo:hi], every), paragraph_keys(b[lo:hi], every)
                pair, key, sign = differences(left, right, cells)
                total, differ = np.diff(left[1]) + np.diff(right[1]), np.bincount(pair, minlength=hi - lo)
                sides = []
                for s in (1, -1):
                    order = np.lexsort((key, pair))
                    order = order[sign[order] == s]
                    sides.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(pair[order], np.arange(hi - lo + 1)).astype(np.int32)), pa.array(key[order].astype(np.int64))))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array((total - differ) / (total + differ)), *sides], names=["id", "likeness", "removed", "added"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(left_col).alias("l"), F.col(right_col).alias("r")).mapInArrow(run, f"id {kind}, likeness double, removed array<long>, added array<long>")
    return out.withColumnRenamed("id", id_col)


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many first characters of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def against_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS, every: int = EVERY, range_chars: int = RANGE_CHARS) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).isNull().alias("none"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    ranges = 1 + (rows.agg(F.sum(F.length("text"))).first()[0] or 0) // range_chars

    def first_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.slice(0, 1)
                break
        for _ in batches:
            pass

    order = ["none", "id", "h"]
    narrow = rows.select(*order).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # one row for each range of ``range_chars`` characters
    starts = sorted((r["none"], r["id"] or 0, r["h"]) for r in narrow.mapInArrow(first_keys, "none boolean, id long, h long").collect())
    firsts = spark.sparkContext.broadcast(np.array(starts, [("none", "?"), ("id", "i8"), ("h", "i8")]))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = firsts.value
        for batch in batches:
            key = np.empty(batch.num_rows, first.dtype)
            key["none"], key["h"] = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
            key["id"] = batch.column(1).fill_null(0).to_numpy()
            part = np.maximum(np.searchsorted(first, key, side="right") - 1, 0)
            ahead = np.flatnonzero(first[part] == key)
            back = (part[ahead] - 1) % len(first)
            for flag, at, to in ((0, None, part), (1, ahead, back)):
                own = batch.columns if at is None else [c.take(pa.array(at)) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int64)), pa.array(np.full(len(to), flag, np.int32)), *own], names=["part", "ahead", *order, "text"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, part = [], [], 0, None
        closed = False
        for batch in batches:
            for p, ahead, i, t in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 5)), strict=True):
                if p != part:
                    part, closed = p, False
                if closed:
                    continue
                ids.append(i)
                texts.append(t)
                size += len(t)
                if ahead:
                    closed = True
                if ahead or size > 1 << 20 and len(texts) > 1:
                    yield finish(ids[:-1], texts)
                    ids, texts = ([], []) if ahead else (ids[-1:], texts[-1:])
                    size = sum(map(len, texts))

    def finish(ids: list[int | None], texts: list[str]) -> pa.RecordBatch:
        """Results of all texts but the last, each followed by the next."""
        n, new = len(ids), [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        keys, offsets = paragraph_keys(texts, every)
        own, sketch = (keys, offsets[:-1]), sketches(keys, offsets, cells)
        after, changed = (keys, offsets[1:]), paragraph_keys(new, every)
        new_sketch = sketches(*changed, cells)
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in new], pa.string()),
            pa.array(texts_of(sketch[:n]), pa.string()), pa.array(texts_of(new_sketch), pa.string()),
            pa.array(likeness(own, changed, cells, subtract(sketch[:n], new_sketch))), pa.array(likeness(own, after, cells, subtract(sketch[:n], sketch[1:]))),
        ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    if not starts:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("doc_id", id_col)
    dealt = rows.mapInArrow(deal, "part long, ahead int, none boolean, id long, h long, text string")
    sorted_ = dealt.repartition("part").sortWithinPartitions("part", "ahead", *order)
    out = sorted_.mapInArrow(follow, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("doc_id", id_col)
