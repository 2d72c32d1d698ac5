"""Cheapest repair of conversations by Four-Russians block tables (operator 12).

A conversation is legal if its roles' initials spell ``(s?(ua)+)?``. Each row may be kept, given the role user or
assistant, or deleted, and empty user or assistant turns may be inserted; blank and repeated rows must be deleted,
and a row that ends without ``.``, ``!`` or ``?`` costs more unless it is deleted.

What matters of a row is one of nine symbols (initial s, u, a or other, with or without an end; to be deleted).
The costs to finish from each state of the automaton, less their minimum, are one of a few vectors. For every
vector and every block of ``BLOCK`` symbols a table holds the vector in front of the block and what the minimum
grew by, so that costs run from the last block to the first by look-up. The edits are then read from the front:
each block is expanded backward from the vector behind it, which gives the true remaining cost at every row, and
of the edits that keep the optimum the one with the smallest letter is taken; expansions are kept for reuse.

Rows are range-partitioned and sorted by (conversation, turn, role, text), so that no conversation, however long, has
to fit into a task. Conversations inside a partition are finished there. Those at a partition's ends, or with more
than ``hold`` characters, are cut into segments: a segment gives its map of vectors, the maps are composed from the
last segment to the first, each segment is traced from every state, and the traces are chained. Only the digest of
one conversation's text is sequential by nature: a stream in one task with memory for one segment's letters.

Defined results: null roles and texts are one space, a null ``conv_id`` is a conversation; null turns come first and rows of one
turn by role, then their text's first 64 characters, then its hash; an empty role has no legal initial; a conversation all of whose rows were dropped has zeros,
an empty audit and nothing repaired; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm._spark import checkpoint, runs

BLOCK = 4
#: Costs of the edits; ``CUT`` is added for a row without an end that stays.
DELETE, INSERT, REROLE, CUT = 2, 5, 1, 5
#: Symbols: twice the initial's place in INITIALS, plus 1 without an end; one to be deleted; filling of the last block.
INITIALS, GONE, NOTHING, KINDS = "sua", 8, 9, 10
#: States by what came last: nothing, a system, a user or an assistant row; where each row or edit leads.
START, SYSTEM, USER, ASSISTANT = range(4)
_KEEP = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
_NEXT = (USER, USER, ASSISTANT, USER)
_NAME = {USER: "user", ASSISTANT: "assistant"}
_BLANKS = " \t\n\x0b\f\r"


def _before(after: tuple[int, ...], symbol: int) -> list[int]:
    """Costs to finish in front of a row from those behind it, without insertions before the row."""
    if symbol == NOTHING:
        return list(after)
    out = []
    for q in range(4):
        best = DELETE + after[q]
        if symbol != GONE:
            stay = CUT * (symbol % 2)
            best = min(best, REROLE + stay + after[_NEXT[q]])
            if (q, symbol // 2) in _KEEP:
                best = min(best, stay + after[_KEEP[q, symbol // 2]])
        out.append(best)
    return out


def _with_insertions(costs: list[int]) -> tuple[int, ...]:
    for _ in range(4):
        costs = [min(c, INSERT + costs[_NEXT[q]]) for q, c in enumerate(costs)]
    return tuple(costs)


class Tables:
    """Vectors, the step of each over one symbol, the block table, and the letters of each step."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        self.end = _with_insertions([0, 1 << 20, 1 << 20, 0])
        self.vectors, self.step, self.grow = [self.end], [], []
        index = {self.end: 0}
        for v in self.vectors:  # grows while it is read
            to, more = [], []
            for symbol in range(KINDS):
                costs = _with_insertions(_before(v, symbol))
                low = min(costs)
                new = tuple(c - low for c in costs)
                if new not in index:
                    index[new] = len(self.vectors)
                    self.vectors.append(new)
                to.append(index[new])
                more.append(low)
            self.step.append(to)
            self.grow.append(more)
        step, grow = np.array(self.step), np.array(self.grow)
        n = len(self.vectors)
        blocks = np.arange(KINDS**block)
        at, off = np.repeat(np.arange(n)[:, None], len(blocks), 1), np.zeros((n, len(blocks)), np.int64)
        for d in range(block):  # the last symbol of a block first
            symbol = np.broadcast_to(blocks // KINDS**d % KINDS, at.shape)
            off += grow[at, symbol]
            at = step[at, symbol]
        self.over, self.cost = at.astype(np.int16), off.astype(np.int16)
        self.expanded: dict[tuple[int, int, int], tuple[str, int]] = {}

    def codes(self, symbols: bytes) -> list[int]:
        """The blocks of a sequence of symbols as numbers."""
        s = np.frombuffer(symbols + bytes([NOTHING]) * (-len(symbols) % self.block), np.uint8).reshape(-1, self.block)
        return (s @ KINDS ** np.arange(self.block - 1, -1, -1)).tolist()

    def choose(self, after: int, symbol: int, q: int) -> tuple[str, int]:
        """Letters up to and with the row's own, and the state behind it."""
        behind = self.vectors[after]
        plain = _before(behind, symbol)
        costs = _with_insertions(plain)
        letters = ""
        while True:
            if costs[q] == DELETE + behind[q]:
                return letters + "D", q
            if costs[q] == INSERT + costs[_NEXT[q]]:
                letters, q = letters + "I", _NEXT[q]
                continue
            keep = _KEEP.get((q, symbol // 2))
            if keep is not None and costs[q] == CUT * (symbol % 2) + behind[keep]:
                return letters + "K", keep
            return letters + "R", _NEXT[q]

    def expand(self, after: int, code: int, q: int) -> tuple[str, int]:
        """Letters of a block and the state behind it, from the vector behind it and the state before it."""
        key = (after, code, q)
        if key not in self.expanded:
            symbols = [code // KINDS**d % KINDS for d in range(self.block - 1, -1, -1)]
            behind = [after]
            for symbol in reversed(symbols[1:]):
                behind.append(self.step[behind[-1]][symbol])
            letters = ""
            for symbol, v in zip(symbols, reversed(behind), strict=True):
                if symbol != NOTHING:
                    more, q = self.choose(v, symbol, q)
                    letters += more
            self.expanded[key] = letters, q
        return self.expanded[key]

    def finish(self, q: int) -> str:
        letters = ""
        while self.end[q]:
            letters, q = letters + "I", _NEXT[q]
        return letters

    def solve(self, symbols: bytes) -> tuple[int, str]:
        """Least cost and letters of a whole conversation."""
        codes = self.codes(symbols)
        behind, v, total = [], 0, 0
        for code in reversed(codes):
            behind.append(v)
            total += int(self.cost[v, code])
            v = int(self.over[v, code])
        letters, q = self.trace(codes, behind[::-1], START)
        return total + self.vectors[v][START], letters + self.finish(q)

    def trace(self, codes: list[int], behind: list[int], q: int) -> tuple[str, int]:
        out = []
        for code, v in zip(codes, behind, strict=True):
            letters, q = self.expand(v, code, q)
            out.append(letters)
        return "".join(out), q

    def segment(self, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
        """For every vector behind a segment: the vector before it and the minimum's growth."""
        v, total = np.arange(len(self.vectors)), np.zeros(len(self.vectors), np.int64)
        for code in reversed(self.codes(symbols)):
            total += self.cost[v, code]
            v = self.over[v, code].astype(np.int64)
        return v, total

    def trace_segment(self, symbols: bytes, after: int) -> list[tuple[str, int]]:
        """Letters and last state from each first state, with the vector behind the segment known."""
        codes, behind, v = self.codes(symbols), [], after
        for code in reversed(codes):
            behind.append(v)
            v = int(self.over[v, code])
        return [self.trace(codes, behind[::-1], q) for q in range(4)]


@cache
def tables() -> Tables:
    return Tables()


class _Counts:
    """Counts over a conversation's rows in order."""

    def __init__(self) -> None:
        self.low = self.high = self.last_turn = self.first_initial = self.last_initial = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        """``fault``: 0 none, 1 without an end, 2 blank, 3 repeated."""
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        self.truncated += fault == 1
        self.blank += fault == 2
        self.duplicate += fault == 3
        if self.first_initial is None:
            self.first_initial = initial
        else:
            self.illegal += self.last_initial + initial not in ("su", "ua", "au")
        self.last_initial = initial

    def append(self, other: dict) -> None:
        """Counts of the rows that follow, as ``state`` gave them."""
        if other["low"] is not None:
            self.low = other["low"] if self.low is None else self.low
            self.turns += other["turns"] - (self.high == other["low"])
            self.high = other["high"]
        for name in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + other[name])
        if other["first_initial"] is not None:
            if self.first_initial is None:
                self.first_initial = other["first_initial"]
            else:
                self.illegal += self.last_initial + other["first_initial"] not in ("su", "ua", "au")
            self.last_initial = other["last_initial"]

    def state(self) -> dict:
        return {k: getattr(self, k) for k in ("low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "first_initial", "last_initial")}

    def results(self) -> tuple[int, ...]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal


class _Repaired:
    """What is left after the edits: rows, or the digest of ``role:text`` lines."""

    def __init__(self, digest: bool):
        self.rows: list[dict] = []
        self.hash = hashlib.sha256() if digest else None
        self.any, self.q = False, START

    def put(self, role: str, text: str) -> None:
        if self.hash is None:
            self.rows.append({"role": role, "text": text})
            return
        self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode("utf-8", "replace"))
        self.any = True

    def insert(self) -> None:
        self.q = _NEXT[self.q]
        self.put(_NAME[self.q], "")

    def apply(self, letter: str, role: str, text: str) -> None:
        if letter == "K":
            self.q = _KEEP[self.q, INITIALS.index(role[0])]
            self.put(role, text)
        elif letter == "R":
            self.q = _NEXT[self.q]
            self.put(_NAME[self.q], text)

    def result(self) -> str | list[dict]:
        return self.rows if self.hash is None else self.hash.hexdigest()


def _symbol(role: str, fault: int) -> int:
    if fault > 1:
        return GONE
    initial = INITIALS.find(role[0]) if role else -1
    return 2 * (initial if initial >= 0 else 3) + fault


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_STATE = "low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string"
_SEGMENT = pa.schema([("conv", pa.string()), ("part", pa.int64()), *((n, pa.string() if n.endswith("initial") else pa.int64()) for n in (f.split()[0] for f in _STATE.split(", "))), ("symbols", pa.binary()), ("over", pa.binary()), ("grow", pa.binary())])


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows of ``conversations`` with the faults that a hash of ``conv_id:turn`` deals out, and ``gone`` for dropped ones."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(said(conv_col), F.lit(":"), said(turn_col)).cast("binary")) % 20
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), said(role_col).alias("role"), said(text_col).alias("text"), code.alias("code"))
    text = F.when(F.col("code") <= 1, F.lit("")).when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("code") == 0).alias("gone"), copies.alias("_copy")).drop("_copy")


def _keyed(rows: DataFrame) -> DataFrame:
    solid = F.rtrim(F.col("text"), F.lit(_BLANKS))
    fault = F.when(solid == "", 2).when(F.substring(solid, -1, 1).isin(".", "!", "?"), 0).otherwise(1).cast("int")
    return rows.select("conv_id", "turn", "role", "text", "gone", fault.alias("fault"), F.xxhash64("role", "text").alias("h"), F.xxhash64(F.lit(1), "role", "text").alias("g"), F.left("text", F.lit(64)).alias("head"), F.monotonically_increasing_id().alias("spread"))


def repair(rows: DataFrame, digest: bool = False, hold: int = 1 << 23) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired)``, one row per conversation.

    ``rows``: conv_id, turn, role, text and, if wanted, ``gone`` for rows that only keep their conversation listed.
    ``repaired`` holds the rows left, in order; with ``digest`` it is ``repaired_sha256``, their text's SHA-256.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    said = lambda c: F.coalesce(F.col(c), F.lit(" "))
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), gone.alias("gone"))
    order = ["conv_id", "turn", "role", "head", "h", "spread"]
    sorted_ = _keyed(plain).repartitionByRange(*order).sortWithinPartitions(*order)
    left = "repaired_sha256" if digest else "repaired"
    left_type = pa.string() if digest else pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    result_fields = [*((n, pa.int64()) for n in _COUNTS), ("audit", pa.string()), (left, left_type)]
    row_fields = [("part", pa.int64()), ("seq", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.int32()), ("gone", pa.bool_()), ("first", pa.bool_()), ("h", pa.int64()), ("g", pa.int64())]
    result_ddl = ", ".join(f"{n} long" for n in _COUNTS) + f", audit string, {left} " + ("string" if digest else "array<struct<role:string,text:string>>")
    row_ddl = "part long, seq long, turn long, role string, text string, fault int, gone boolean, first boolean, h long, g long"

    def solved(held: list[tuple]) -> tuple:
        """Results of a whole conversation's (turn, role, text, fault), in order."""
        counts, kept = _Counts(), _Repaired(digest)
        for turn, role, _, fault in held:
            counts.add(turn, role[:1], fault)
        cost, audit = tables().solve(bytes(_symbol(r, f) for _, r, _, f in held))
        at = 0
        for _, role, text, _ in held:
            while audit[at] == "I":
                kept.insert()
                at += 1
            kept.apply(audit[at], role, text)
            at += 1
        for _ in audit[at:]:
            kept.insert()
        return (*counts.results(), cost, audit, kept.result())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """kind 0: results of conversations inside the partition; 1: rows of those at its ends or too long to hold."""
        part = TaskContext.get().partitionId()
        ids: pa.DataType | None = None
        results, loose = [], []
        conv, held, seen, size, seq, through, any_ = None, [], set(), 0, 0, True, False

        def batch_of() -> pa.RecordBatch:
            n, m = len(results), len(loose)
            first = list(zip(*results, strict=True)) if n else [()] * (1 + len(result_fields))
            rest = list(zip(*loose, strict=True)) if m else [()] * (1 + len(row_fields))
            cols = [pa.array([0] * n + [1] * m, pa.int32()), pa.array([*first[0], *rest[0]], ids)]
            cols += [pa.array([*x, *[None] * m], t) for x, (_, t) in zip(first[1:], result_fields, strict=True)]
            cols += [pa.array([*[None] * n, *x], t) for x, (_, t) in zip(rest[1:], row_fields, strict=True)]
            results.clear()
            loose.clear()
            return pa.RecordBatch.from_arrays(cols, names=["kind", "conv", *(n for n, _ in result_fields), *(f"r_{n}" for n, _ in row_fields)])

        for batch in batches:
            ids = batch.schema.field(0).type
            for own, turn, role, text, drop, fault, h, g in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                if not any_ or own != conv:
                    if any_ and not through:
                        results.append((conv, *solved([r[2:6] for r in held if not r[6]])))
                    through, any_ = not any_, True  # the partition's first conversation may begin before it
                    conv, held, seen, size, seq = own, [], set(), 0, 0
                first = not drop and fault < 2 and (h, g) not in seen
                if first:
                    seen.add((h, g))
                elif not drop and fault < 2:
                    fault = 3
                row = (part, seq, turn, role, "" if drop or fault > 1 else text, fault, drop, first, h, g)
                seq += 1
                size += len(text)
                if through:
                    loose.append((conv, *row))
                else:
                    held.append(row)
                    if size > hold:
                        loose.extend((conv, *r) for r in held)
                        held, through = [], True
                if len(loose) > 5000 or len(results) > 5000:
                    yield batch_of()
        if any_ and not through:
            loose.extend((conv, *r) for r in held)
        if results or loose:
            yield batch_of()

    found = checkpoint(sorted_.select("conv_id", "turn", "role", "text", "gone", "fault", "h", "g").mapInArrow(scan, f"kind int, conv {kind}, {result_ddl}, " + ", ".join(f"r_{x}" for x in row_ddl.split(", "))))
    done = found.where("kind = 0").select(F.col("conv").alias("conv_id"), *_COUNTS, "audit", left)
    names = [n for n, _ in row_fields]
    key = F.concat(F.when(F.col("conv").isNull(), "-").otherwise("+"), F.coalesce(F.col("conv").cast("string"), F.lit("")))
    loose = found.where("kind = 1").select(key.alias("conv"), F.col("conv").alias("id"), *(F.col(f"r_{n}").alias(n) for n in names))

    # rows that repeat a row of an earlier segment: at most one first row a segment meets in a group
    firsts = loose.where("first").select("conv", "h", "g", "part", "seq")
    again = firsts.groupBy("conv", "h", "g").agg(F.min("part").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n")
    late = firsts.join(again, ["conv", "h", "g"]).where("part > low").select("conv", "part", "seq")
    narrow = loose.select("conv", "part", "seq", "turn", F.left("role", F.lit(1)).alias("initial"), "fault", "gone", F.lit(1).alias("row"))
    marks = late.select("conv", "part", "seq", F.lit(None).cast("long").alias("turn"), F.lit("").alias("initial"), F.lit(3).alias("fault"), F.lit(False).alias("gone"), F.lit(0).alias("row"))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in runs(batches, ["conv", "part"]):
            cols = [table[c].to_pylist() for c in ("conv", "part", "seq", "turn", "initial", "fault", "gone", "row")]
            out = []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                counts, symbols, marked = _Counts(), bytearray(), None
                for k in range(lo, hi):
                    _, _, seq, turn, initial, fault, drop, row = (c[k] for c in cols)
                    if not row:
                        marked = seq
                    elif not drop:
                        fault = 3 if marked == seq else fault
                        counts.add(turn, initial, fault)
                        symbols.append(_symbol(initial, fault))
                over, grow = tables().segment(bytes(symbols))
                out.append({"conv": cols[0][lo], "part": cols[1][lo], **counts.state(), "symbols": bytes(symbols), "over": over.astype(np.int16).tobytes(), "grow": grow.tobytes()})
            yield pa.RecordBatch.from_pylist(out, _SEGMENT)

    ddl = f"conv string, part long, {_STATE}, symbols binary, over binary, grow binary"
    cut = narrow.unionByName(marks).repartition("conv", "part").sortWithinPartitions("conv", "part", "seq", "row").mapInArrow(segments, ddl)
    cut = checkpoint(cut)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The vector behind each segment, the last segment first, and the cost up to the end."""
        conv, v, total = None, 0, 0
        for batch in batches:
            out = []
            for own, part, over, grow in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != conv:
                    conv, v, total = own, 0, 0
                behind = v
                total += int(np.frombuffer(grow, np.int64)[v])
                v = int(np.frombuffer(over, np.int16)[v])
                out.append((own, part, behind, total + tables().vectors[v][START]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["conv", "part", "behind", "cost"])

    composed = cut.select("conv", "part", "over", "grow").repartition("conv").sortWithinPartitions("conv", F.col("part").desc()).mapInArrow(compose, "conv string, part long, behind long, cost long")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters, ends = [], []
            for symbols, behind in zip(batch.column("symbols").to_pylist(), batch.column("behind").to_pylist(), strict=True):
                traced = tables().trace_segment(symbols, behind)
                letters.append([x for x, _ in traced])
                ends.append([q for _, q in traced])
            names = [n for n in batch.schema.names if n not in ("symbols", "behind")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(letters, pa.list_(pa.string())), pa.array(ends, pa.list_(pa.int64()))], names=[*names, "letters", "ends"])

    state = [f.split()[0] for f in _STATE.split(", ")]
    traced = cut.select("conv", "part", *state, "symbols").join(composed, ["conv", "part"]).select("conv", "part", *state, "cost", "symbols", "behind")
    traced = traced.mapInArrow(trace, f"conv string, part long, {_STATE}, cost long, letters array<string>, ends array<long>")
    info = traced.withColumn("seq", F.lit(-1).cast("long"))
    texts = loose.select("conv", "id", "part", "seq", "role", "text", "gone")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segment by segment, its traces first and then its rows: memory for one segment's letters and the audit."""
        conv, own, ids = None, None, None
        counts, kept, q, cost, audit, letters, at = _Counts(), _Repaired(digest), START, None, [], "", 0

        def close() -> pa.RecordBatch:
            end = tables().finish(q)
            for _ in end:
                kept.insert()
            row = (own, *counts.results(), cost, "".join([*audit, end]), kept.result())
            return pa.RecordBatch.from_arrays([pa.array([row[0]], ids), *(pa.array([x], t) for x, (_, t) in zip(row[1:], result_fields, strict=True))], names=["conv_id", *(n for n, _ in result_fields)])

        for batch in batches:
            ids = batch.schema.field("id").type
            for r in batch.to_pylist():
                if r["conv"] != conv:
                    if conv is not None:
                        yield close()
                    conv, counts, kept, q, cost, audit = r["conv"], _Counts(), _Repaired(digest), START, None, []
                if r["seq"] < 0:
                    counts.append(r)
                    cost = r["cost"] if cost is None else cost
                    letters, at = r["letters"][q], 0
                    audit.append(letters)
                    q = r["ends"][q]
                    continue
                own = r["id"]
                if r["gone"]:
                    continue
                while letters[at] == "I":
                    kept.insert()
                    at += 1
                kept.apply(letters[at], r["role"], r["text"])
                at += 1
        if conv is not None:
            yield close()

    stream = info.unionByName(texts, allowMissingColumns=True).repartition("conv").sortWithinPartitions("conv", "part", "seq")
    chained = stream.mapInArrow(chain, f"conv_id {kind}, {result_ddl}")
    return done.unionByName(chained)


def _edit(state: str, cost: str, letter: str, line: str) -> str:
    """SQL of a state (six digits of cost, letters, a bar, lines each behind a line feed) after an edit."""
    return f"lpad((substr({state}, 1, 6)::INTEGER + {cost})::VARCHAR, 6, '0') || substr({state}, 7, strpos({state}, '|') - 7) || '{letter}' || substr({state}, strpos({state}, '|')) || {line}"


def oracle() -> str:
    """The query's rows by a row-wise search for the cheapest and smallest edits, in DuckDB's SQL."""
    line = lambda role, text="text": f"chr(10) || {role} || ':' || {text}"
    insert = lambda s, role: _edit(s, str(INSERT), "I", f"chr(10) || '{role}:'")
    stay = f"CASE WHEN fault = 1 THEN {CUT} ELSE 0 END"
    delete = lambda s: _edit(s, str(DELETE), "D", "''")
    keep = lambda s, i: f"CASE WHEN fault < 2 AND left(role, 1) = '{i}' THEN {_edit(s, stay, 'K', line('role'))} END"
    name = lambda s, role: f"CASE WHEN fault < 2 THEN {_edit(s, f'{REROLE} + {stay}', 'R', line(chr(39) + role + chr(39)))} END"
    start = f"SELECT conv_id, 0 AS i, '000000|' AS s0, NULL::VARCHAR AS s1, {insert(chr(39) + '000000|' + chr(39), 'user')} AS s2 FROM (SELECT DISTINCT conv_id FROM conversations)"
    return rf"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([n::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) r(n)
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations
), coded AS (
  SELECT keyed.*, xor(list_reduce(list_prepend(4294967295, list_transform(generate_series(1, length(s)), lambda k: ord(s[k])::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS code FROM keyed, crc
), hurt AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE WHEN code = 1 THEN '' WHEN code = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM coded JOIN (SELECT unnest([0, 1]) AS copy) ON copy = 0 OR code = 3 WHERE code > 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid FROM hurt
), marked AS (
  SELECT *, CASE WHEN solid = '' THEN 2 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 3 WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault,
    lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS following FROM placed
), begun AS (
  SELECT *, {insert("s2", "assistant")} AS s3 FROM ({start})
), reach AS (
  SELECT * FROM begun
  UNION ALL
  SELECT conv_id, i, p0 AS s0, p1 AS s1, p2 AS s2, least(p3, {insert("p2", "assistant")}) AS s3 FROM (
    SELECT conv_id, i, p0, p1, p3, least(p2, {insert("p0", "user")}, {insert("p1", "user")}, {insert("p3", "user")}) AS p2 FROM (
      SELECT m.conv_id, m.i, {delete("s0")} AS p0, least({delete("s1")}, {keep("s0", "s")}) AS p1,
        least({delete("s2")}, {", ".join(f"{keep(s, 'u')}, {name(s, 'user')}" for s in ("s0", "s1", "s3"))}) AS p2,
        least({delete("s3")}, {keep("s2", "a")}, {name("s2", "assistant")}) AS p3
      FROM reach JOIN marked m ON m.i = reach.i + 1 AND m.conv_id IS NOT DISTINCT FROM reach.conv_id))
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 2) AS blank, count(*) FILTER (fault = 3) AS duplicate, count(*) FILTER (fault = 1) AS truncated,
    count(*) FILTER (following IS NOT NULL AND left(role, 1) || following NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM marked GROUP BY conv_id
), best AS (
  SELECT reach.conv_id, least(s0, s3) AS s, c.* EXCLUDE (conv_id) FROM reach LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM reach.conv_id WHERE reach.i = coalesce(n, 0)
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  substr(s, 1, 6)::BIGINT AS cost, substr(s, 7, strpos(s, '|') - 7) AS audit, sha256(substr(s, strpos(s, '|') + 2)) AS repaired_sha256
FROM best
"""
