"""Line deduplication by a segment-partition edit join (operator 4).

Lines (split at line feeds, blanks at both ends ignored) within the threshold of each other, or linked
by a chain of such lines, are one class, and every class keeps its first occurrence: smallest document id,
then position. The threshold follows the shorter line's length: one edit for every ``per_edit`` characters, ``threshold``
edits at most, so that the shortest lines are matched exactly; blank lines stay.

A line of length l is cut into one segment more than its threshold, of nearly equal length. Two lines within the threshold
share at least one segment of the shorter line, at a place which the lengths and the segment's number
narrow down to a few; each line posts its own segments and those substrings of it that may be a segment
of a shorter line within that line's threshold. Lines that meet in a posting are verified by a banded
bit-parallel edit distance: the band's diagonals are the bits of one integer for each number of edits.
Postings shared by very many lines are cut into blocks of ``block`` lines that meet pairwise, and only a
spanning set of links leaves a posting.

Texts cross a shuffle once, to be rebuilt; all else moves as hashes and positions. Lines are equal if two
64-bit hashes are. Defined results: a null text stays null; documents that repeat (same id and text) count
as one and are changed alike, and a null id or text equals no other; a null id sorts behind all others; other columns pass through whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm._spark import checkpoint, components, runs, small_enough

_BLANKS = " \t\r\v\f"


def line_hash(line: str) -> int:
    """The hash that Spark's xxhash64 gives this string."""
    h = xxhash.xxh64_intdigest(line.encode("utf-8", "replace"), 42)
    return h - (1 << 64) if h >> 63 else h


def segments(length: int, parts: int) -> list[tuple[int, int]]:
    """(start, length) of each of ``parts`` nearly equal segments; the last ones are the longer."""
    base, more = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        size = base + (i >= parts - more)
        out.append((at, size))
        at += size
    return out


def allowed(length: int, threshold: int, per_edit: int) -> int:
    """Edits within which a line of this length and a longer one are near."""
    return min(threshold, length // per_edit)


def postings(line: str, threshold: int, per_edit: int) -> set[int]:
    """Hashes of (length, segment number, content) for the line's own segments and all it must probe."""
    out, n = set(), len(line)
    data = line.encode() if line.isascii() else None
    for length in range(max(1, n - threshold), n + 1):
        edits, shift = allowed(length, threshold, per_edit), n - length
        if not edits or shift > edits:
            continue
        for i, (start, size) in enumerate(segments(length, edits + 1)):
            right = edits - i
            lo = max(0, start - i, start + shift - right)
            hi = min(n - size, start + i, start + shift + right)
            seed = length * (threshold + 1) + i
            for at in range(lo, hi + 1):
                part = data[at : at + size] if data is not None else line[at : at + size].encode("utf-8", "replace")
                out.add(xxhash.xxh3_64_intdigest(part, seed))
    return out


def within(a: str, b: str, threshold: int) -> bool:
    """Whether the edit distance is at most ``threshold``, in a band of 2 * threshold + 1 diagonals."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > threshold:
        return False
    lo, end = 0, min(len(a), len(b))
    while lo < end:  # the common beginning, by halves
        mid = (lo + end + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            end = mid - 1
    a, b = a[lo:], b[lo:]
    places: dict[str, int] = {}
    for j, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << j + threshold
    width = 2 * threshold + 1
    band = (1 << width) - 1
    # bit d of reach[e]: with at most e edits, i characters of a and i + d - threshold of b are used up
    reach = [((1 << e + 1) - 1) << threshold & band for e in range(threshold + 1)]
    inside = ((1 << len(b) + 1) - 1) << threshold
    for i, c in enumerate(a):
        # b[j] is c, j = i + d - threshold: staying on a diagonal uses both characters
        match = places.get(c, 0) >> i & band
        legal = inside >> i + 1 & band
        new, last = [], 0
        for e in range(threshold + 1):
            r = reach[e] & match
            if e:
                r |= reach[e - 1] | reach[e - 1] >> 1 | last << 1
            last = r & band & legal
            new.append(last)
        reach = new
        if not reach[threshold]:
            return False
    at = len(b) - len(a) + threshold
    return bool(reach[threshold] >> at & 1)


def spanning_links(lines: list[str], side: list[int], threshold: int, per_edit: int) -> list[tuple[int, int]]:
    """A spanning set (i, j) of the lines within the threshold; where there are two sides, only across these."""
    order = sorted(range(len(lines)), key=lambda i: len(lines[i]))
    length, root, out = [len(x) for x in lines], list(range(len(lines))), []
    both = len(set(side)) > 1

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k, i in enumerate(order):
        for m in range(k - 1, -1, -1):
            j = order[m]
            if length[i] - length[j] > threshold:
                break
            if both and side[i] == side[j]:
                continue
            a, b, edits = find(i), find(j), allowed(length[j], threshold, per_edit)
            if a != b and length[i] - length[j] <= edits and within(lines[i], lines[j], edits):
                root[a] = b
                out.append((i, j))
    return out


def _trim(c: Column) -> Column:
    return F.trim(c, F.lit(_BLANKS))


def line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, dk, pos, h, g)``, one row per line that is not blank; dk identifies id and text."""
    keyed = docs.select(F.col(id_col).alias("id"), doc_key(id_col, text_col).alias("dk"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "line"))
    lines = keyed.withColumn("line", _trim(F.col("line"))).where("line <> ''")
    return lines.select("id", "dk", "pos", F.xxhash64("line").alias("h"), F.xxhash64("line", F.lit(1)).alias("g"), F.length("line").alias("chars"), "line")


def doc_key(id_col: str, text_col: str) -> Column:
    """Identity of a document by id and text, either of which may be null."""
    return F.xxhash64(F.col(id_col).isNull(), F.col(id_col).cast("string"), F.col(text_col).isNull(), F.col(text_col))


def near_lines(docs: DataFrame, threshold: int, per_edit: int, text_col: str, block: int = 256) -> DataFrame:
    """``(v, c)``: lines (by hash) that link with another line within the threshold, and their class."""
    # a shorter line has neither a threshold of its own nor is it a longer one's partner
    shortest = max(per_edit, 1)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, owners = [], []
            for text in batch.column(0).to_pylist():
                for line in (text or "").split("\n"):
                    line = line.strip(_BLANKS)
                    if len(line) < shortest or (h := line_hash(line)) in seen:
                        continue
                    seen.add(h)
                    own = postings(line, threshold, per_edit)
                    keys.extend(own)
                    owners.append((h, len(own)))
                    if len(keys) > 200_000:
                        yield table(keys, owners)
                        keys, owners = [], []
            if len(seen) > 2_000_000:
                seen.clear()
            if keys:
                yield table(keys, owners)

    def table(keys: list[int], owners: list[tuple[int, int]]) -> pa.RecordBatch:
        h, n = np.array(owners, np.int64).T
        return pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).astype(np.int64)), pa.array(np.repeat(h, n))], names=["key", "h"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Postings of two lines or more, with their number of lines."""
        for found, marks in runs(batches, ["key"]):
            h = found["h"].to_numpy()
            first = np.zeros(len(h), bool)
            first[marks[:-1]] = True
            first[1:] |= h[1:] != h[:-1]
            count = np.add.reduceat(first.astype(np.int64), marks[:-1])
            keep = first & np.repeat(count > 1, np.diff(marks))
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(found["key"].to_numpy()[keep]), pa.array(h[keep]), pa.array(np.repeat(count, np.diff(marks))[keep])], names=["key", "h", "n"])

    posted = docs.select(F.col(text_col)).mapInArrow(post, "key long, h long")
    met = checkpoint(posted.repartition("key").sortWithinPartitions("key", "h").mapInArrow(meet, "key long, h long, n long"))
    # lines that meet in several postings in the same company need to meet only once
    company = met.groupBy("key").agg(F.min("h").alias("low"), F.sum(F.xxhash64("h").cast("decimal(38,0)")).alias("s"), F.first("n").alias("n"))
    chosen = company.groupBy("low", "s", "n").agg(F.min("key").alias("key")).select("key")
    met = met.join(chosen, "key", "left_semi")
    wanted = small_enough(checkpoint(met.select("h").distinct()))
    lines = line_table(docs.withColumn("_canopy_id", F.lit(0)), "_canopy_id", text_col).where(F.col("chars") >= shortest).select("h", "line")
    lines = lines.join(wanted, "h", "left_semi").dropDuplicates(["h"])
    parts = F.ceil(F.col("n") / block).cast("int")
    spread = met.select("key", "h", parts.alias("parts"), F.pmod(F.xxhash64("h"), parts).cast("int").alias("own"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    spread = spread.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "h").join(lines, "h")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, marks in runs(batches, ["key", "lo", "hi"]):
            h, text, own = found["h"].to_numpy(), found["line"].to_pylist(), found["own"].to_pylist()
            first, second = found["lo"].to_numpy(), found["hi"].to_numpy()
            left, right = [], []
            for lo, hi in zip(marks[:-1].tolist(), marks[1:].tolist(), strict=True):
                side = own[lo:hi]
                if first[lo] != second[lo] and len(set(side)) < 2:
                    continue  # one of the two blocks is empty
                for i, j in spanning_links(text[lo:hi], side, threshold, per_edit):
                    left.append(h[lo + i])
                    right.append(h[lo + j])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    edges = spread.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "h").mapInArrow(verify, "a long, b long")
    return components(edges)


def repeated_lines(docs: DataFrame, threshold: int = 2, per_edit: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(dk, gone array<int>)``: positions of the lines of each document that repeat an earlier line."""
    lines = line_table(docs, id_col, text_col).select("id", "dk", "pos", "h", "g")
    place = F.struct(F.col("id").isNull().alias("null"), "id", "dk", "pos")
    first = checkpoint(lines.groupBy("h", "g").agg(F.min(place).alias("first"), F.count("*").alias("n")))
    near = near_lines(docs, threshold, per_edit, text_col)
    tied = first.join(near.withColumnRenamed("v", "h"), "h", "left")
    low = tied.where("c IS NOT NULL").groupBy("c").agg(F.min("first").alias("class_first"))
    # only lines that occur twice or have a near line can lose an occurrence
    repeated = tied.where("n > 1 OR c IS NOT NULL").join(low, "c", "left").select("h", "g", F.coalesce("class_first", "first").alias("first"))
    hit = lines.join(repeated, ["h", "g"]).where(place != F.col("first"))
    return hit.groupBy("dk").agg(F.collect_set("pos").alias("gone"))


def dedupe_lines(docs: DataFrame, threshold: int = 2, per_edit: int = 10, id_col: str = "doc_id", text_col: str = "text", report: bool = False) -> DataFrame:
    """``docs`` without repeated lines (``n_chars``, where there is one, is counted anew).

    With ``report``: ``(doc_id, n_lines, n_removed, text)`` instead.
    """
    gone = repeated_lines(docs, threshold, per_edit, id_col, text_col)
    at, columns = docs.columns.index(text_col), docs.columns
    names = [f"c{i}" for i in range(len(columns))]
    plain = docs.toDF(*names)
    plain = plain.withColumn("_dk", doc_key(names[columns.index(id_col)], names[at]))
    joined = plain.join(gone.select(F.col("dk").alias("_dk"), F.col("gone").alias("_gone")), "_dk", "left").drop("_dk")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone = batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()
            total, removed = [], []
            for k, g in enumerate(gone):
                parts = (texts[k] or "").split("\n")
                total.append(len(parts) if texts[k] else 0)
                removed.append(len(g or ()))
                if g:
                    drop = set(g)
                    texts[k] = "\n".join(p for i, p in enumerate(parts) if i not in drop)
            own = list(batch.columns[:-1])
            own[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*own, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], names=[*names, "_total", "_removed"])

    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema, strict=True))
    out = joined.select(*names, "_gone").mapInArrow(rebuild, f"{schema}, _total long, _removed long")
    if report:
        return out.select(F.col(names[columns.index(id_col)]).alias(id_col), F.col("_total").alias("n_lines"), F.col("_removed").alias("n_removed"), F.col(names[at]).alias(text_col))
    if "n_chars" in columns:
        k = names[columns.index("n_chars")]
        out = out.withColumn(k, F.when(F.col("_removed") > 0, F.length(names[at])).otherwise(F.col(k)).cast(docs.schema["n_chars"].dataType))
    return out.drop("_total", "_removed").toDF(*columns)
