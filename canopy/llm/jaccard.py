"""Exact n-gram Jaccard join with skipping by set relations (operator 8).

Documents with equal shingle sets are one node. Nodes are joined at Jaccard similarity num/100 or more:

1. Shingles get one global order: rare before frequent, by counts over all documents in a fixed-size
   array of hashed counters (any fixed order is correct; a good one keeps frequent shingles out of
   prefixes), then by hash.
2. Each node posts the prefix of its ordered set that a similar set must meet, with the shingle's position. A
   list (the nodes posting one shingle) is sorted by set size and position; pairs of its blocks are skipped
   whole where their sizes, or the elements before and behind the position, leave too small an overlap.
3. Short lists give candidate pairs, and the number of lists a pair shares bounds its overlap from above.
   Long lists are first compared with one leader each. Those answers are reused for the rest of a
   list: members linked to each other already need no comparison, and a pair whose distances to the
   leader differ by more than the allowed distance cannot link (the Jaccard distance is a metric). What
   stays open is gathered as spanning sets, and these groups are compared in blocks of bounded size.
4. Candidates are verified on their whole texts; components of the links give the groups. No step emits
   the pairs of a long list or of a group.

No bound drops a pair that could link, so only links between nodes that are in one component already are
left unchecked. Shingles are compared by 64-bit hashes, and so are rows (id and text).

Defined results: a null or empty text, or one without words, has an empty set and links with nothing; with
fewer words than the shingle width, all its words are one shingle; repeated rows and equal texts share a
node, and so a component; one id, or the null id, may stand on rows of different texts, each with its own node;
a null id stands alone unless another document links; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm._arrays import U64, chunks, mix, shingle_sets
from canopy.llm._spark import checkpoint, components, join_hot, local_roots, runs, small_enough, written

#: Counters of the frequency order: 2^24; a byte each, 16 MB, goes to every executor.
COUNTER_BITS = 24
_PART = 1 << 16
#: Longer lists are compared with a leader first.
SHORT_LIST = 8
#: Members of a longer list that a task compares with as many others.
LIST_BLOCK = 512


def node_of(s: np.ndarray) -> int:
    """Identity of a set: a 64-bit hash of its content."""
    if not len(s):
        return 0
    h = mix(np.array([np.add.reduce(mix(s)), np.bitwise_xor.reduce(s), len(s)], U64))
    return int(mix(h[:1] * U64(3) + h[1:2] * U64(5) + h[2:])[0].astype(np.int64))


def packed(counts: np.ndarray) -> bytes:
    """32-bit counts as compressed planes of bytes: most counts are small."""
    return zlib.compress(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def prefix_length(n: int, num: int) -> int:
    """Elements of an ordered set of n that any set with similarity num/100 or more must meet."""
    return n - -(-num * n // 100) + 1


def needed_overlap(a, b, num: int):
    """Least overlap of sets of sizes a and b with similarity num/100 or more."""
    return -(-num * (a + b) // (100 + num))


def near_sets(docs: DataFrame, num: int = 75, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per document: component by links, smallest id."""
    member, nodes = linked_nodes(docs, num, width, id_col, text_col)
    low = nodes.groupBy("c").agg(F.min("low").alias("component"), F.count("*").alias("n"))
    named = join_hot(nodes.select("node", "c"), low.select("c", "component"), "c", low.select("c", "n")).select("node", "component")
    rows = join_hot(member.where("n > 0"), named, "node", nodes.select("node", F.col("rows").alias("n")))
    rows = rows.unionByName(member.where("n = 0"), allowMissingColumns=True)
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def row_key(id_col: str, text_col: str) -> Column:
    """Identity of a row by its id and text, both of which may be null."""
    return F.xxhash64(F.col(id_col).isNull(), F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def linked_rows(docs: DataFrame, num: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, key, c)`` of the documents with words: c is the same for linked ones."""
    member, nodes = linked_nodes(docs, num, width, id_col, text_col)
    return join_hot(member.where("n > 0").select("id", "key", "node"), nodes.select("node", "c"), "node", nodes.select("node", F.col("rows").alias("n")))


def linked_nodes(docs: DataFrame, num: int, width: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``(id, key, node, n)``, one row per document, and ``(node, rows, low, key, c)`` of the sets that are not empty:
    the documents that have it, their smallest id and one's key, and the same c for linked ones."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), row_key(id_col, text_col).alias("key"))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in chunks(texts):
                sets = shingle_sets(texts[lo:hi], width)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(2)[lo:hi], pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())], names=["id", "key", "node", "n"])

    def counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTER_BITS, np.uint32)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo, hi in chunks(texts):
                s = np.concatenate(shingle_sets(texts[lo:hi], width))
                slot, n = np.unique((s >> U64(64 - COUNTER_BITS)).astype(np.int64), return_counts=True)
                total[slot] += n.astype(np.uint32)
        for k in range(0, len(total), _PART):
            if total[k : k + _PART].any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([packed(total[k : k + _PART])], pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, marks in runs(batches, ["part"]):
            parts, rows = table["part"].to_pylist(), table["counts"].to_pylist()
            for lo, hi in zip(marks[:-1], marks[1:], strict=True):
                total = np.zeros(_PART, np.int64)
                for r in rows[lo:hi]:
                    total += unpacked(r)
                size_class = np.frexp(total.astype(float))[1].astype(np.uint8)  # the count's number of bits
                yield pa.RecordBatch.from_arrays([pa.array([parts[lo]], pa.int64()), pa.array([size_class.tobytes()], pa.binary())], names=["part", "counts"])

    member = checkpoint(source.mapInArrow(members, f"id {kind}, key long, node long, n long"))
    bits = np.zeros(1 << COUNTER_BITS, np.uint8)
    summed = source.select("text").mapInArrow(counters, "part long, counts binary").repartition("part").sortWithinPartitions("part").mapInArrow(add, "part long, counts binary")
    for row in summed.collect():  # a fixed number of parts, whatever the data's size
        bits[row["part"] : row["part"] + _PART] = np.frombuffer(row["counts"], np.uint8)
    order = spark.sparkContext.broadcast(bits)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, seen = order.value, set()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo, hi in chunks(texts):
                tokens, nodes, metas = [], [], []
                for s in shingle_sets(texts[lo:hi], width):
                    node = node_of(s)
                    if not len(s) or node in seen:
                        continue
                    seen.add(node)
                    if len(seen) > 500_000:
                        seen.clear()
                    k = prefix_length(len(s), num)
                    key = (rank[(s >> U64(64 - COUNTER_BITS)).astype(np.int64)].astype(U64) << U64(58)) | (s >> U64(6))
                    pick = np.argpartition(key, k - 1)[:k] if k < len(s) else np.arange(len(s))
                    pick = pick[np.argsort(key[pick])]
                    tokens.append(s[pick].astype(np.int64))
                    nodes.append(np.full(k, node, np.int64))
                    metas.append((len(s) << 32) + np.arange(k, dtype=np.int64))
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, nodes, metas)], names=["token", "node", "meta"])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """kind 0: a pair of a short list with both sizes (n: a's, m: b's); 1: a member of a long list (a: the
        token, b: the node, n: its size and position); 2: leader and member."""
        for table, marks in runs(batches, ["token"]):
            token, node, meta = (table[c].to_numpy() for c in ("token", "node", "meta"))
            sizes = np.diff(marks)
            out: list[tuple[np.ndarray, ...]] = []
            two = marks[:-1][sizes == 2]  # by far the most lists
            i, j = [two], [two + 1]
            for lo, hi in zip(marks[:-1][sizes > 2].tolist(), marks[1:][sizes > 2].tolist(), strict=True):
                at = lo + np.unique(node[lo:hi], return_index=True)[1]
                if len(at) > SHORT_LIST:
                    z, leader = np.full(len(at), 1, np.int32), np.full(len(at), node[at].min())
                    none = np.zeros(len(at), np.int64)
                    out.append((z, np.full(len(at), token[lo]), node[at], meta[at], none))
                    out.append((z + 1, leader, node[at], none, none))
                else:
                    at = at[np.argsort(meta[at], kind="stable")]
                    a, b = np.triu_indices(len(at), 1)
                    i.append(at[a])
                    j.append(at[b])
            i, j = np.concatenate(i), np.concatenate(j)
            keep = may_link(meta[i], meta[j], num) & (node[i] != node[j])
            i, j = i[keep], j[keep]
            swap = node[i] > node[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            out.append((np.zeros(len(i), np.int32), node[i], node[j], meta[i] >> 32, meta[j] >> 32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["kind", "a", "b", "n", "m"])

    posted = source.select("text").mapInArrow(prefixes, "token long, node long, meta long")
    found = checkpoint(posted.repartition("token").sortWithinPartitions("token", "meta", "node").mapInArrow(lists, "kind int, a long, b long, n long, m long").where("a <> b OR kind = 1"))
    shared = found.where("kind = 0").groupBy("a", "b").agg(F.count("*").alias("c"), F.first("n").alias("na"), F.first("m").alias("nb"))
    long_ = found.where("kind = 1").select(F.col("a").alias("token"), F.col("b").alias("node"), F.shiftright("n", 32).alias("n"), F.col("n").bitwiseAND(0xFFFFFFFF).alias("pos"))
    has_long = not long_.isEmpty()

    def bounded(pairs: DataFrame, more: Column) -> DataFrame:
        """Pairs whose shared prefix elements (c, and ``more`` at most) leave a sufficient overlap possible."""
        rest = lambda n: F.ceil(n * num / 100) - 1
        need = F.ceil((F.col("na") + F.col("nb")) * num / (100 + num))
        return pairs.where(F.col("c") + more + F.greatest(rest(F.col("na")), rest(F.col("nb"))) >= need).select("a", "b")

    star = found.where("kind = 2").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = F.lit(0)
    counted = shared
    if has_long:  # elements shared in long lists are not in c
        extra = long_.groupBy("node").agg(F.count("*").alias("e"))
        for side in ("a", "b"):
            counted = counted.join(extra.select(F.col("node").alias(side), F.col("e").alias(f"e{side}")), side, "left")
        more = F.least(F.coalesce("ea", F.lit(0)), F.coalesce("eb", F.lit(0)))
    first = checkpoint(bounded(counted, more).union(star).distinct())
    # one row a set: its documents are counted before anything joins them
    per_node = checkpoint(member.where("n > 0").groupBy("node").agg(F.count("*").alias("rows"), F.min("id").alias("low"), F.min("key").alias("key")))
    repeats = _repeats(member)
    judged = verify(first, per_node, source, num, width, repeats)
    links = judged.where("linked").select("a", "b")
    group = components(links).withColumnRenamed("v", "node")
    if has_long:
        # distance of every member of a long list to its leader, from the answers of the first round
        away = judged.select("a", "b", "distance").union(judged.select("b", "a", "distance"))
        leader = long_.groupBy("token").agg(F.min("node").alias("leader"), F.ceil(F.count("*") / LIST_BLOCK).cast("int").alias("parts"))
        rest = long_.join(leader, "token").join(group, "node", "left").join(extra, "node")
        rest = rest.join(away.select(F.col("a").alias("leader"), F.col("b").alias("node"), "distance"), ["leader", "node"], "left")
        rest = rest.select("token", "parts", "node", "n", "pos", "e", F.coalesce("c", "node").alias("c"), F.when(F.col("node") == F.col("leader"), 0.0).otherwise(F.coalesce("distance", F.lit(-9.0))).alias("d"))

        def unsettled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A spanning set of a long list's pairs that the first round has not settled.

            A pair that also meets in a short list was bounded, and if need be verified, in the first round.
            Any other pair shares elements in long lists only: at most the smaller of both counts (e).
            """
            for table, marks in runs(batches, ["token", "lo", "hi"]):
                node, n, pos, e, c, d, own, first, second = (table[x].to_numpy() for x in ("node", "n", "pos", "e", "c", "d", "own", "lo", "hi"))
                left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for lo, hi in zip(marks[:-1].tolist(), marks[1:].tolist(), strict=True):
                    if not (c[lo:hi] == c[lo]).all():
                        side = own[lo:hi] if first[lo] != second[lo] else np.arange(hi - lo)
                        i, j = open_pairs(n[lo:hi], pos[lo:hi], e[lo:hi], c[lo:hi], d[lo:hi], side, num)
                        left.append(node[lo + i])
                        right.append(node[lo + j])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

        # a list is dealt to blocks that meet pairwise, so that no list is one task
        rest = rest.withColumn("own", F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        rest = rest.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("other", "parts")
        open_ = rest.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi", "n", "pos", "node").mapInArrow(unsettled, "a long, b long")
        wide = components(open_).withColumnRenamed("v", "node").withColumnRenamed("c", "g")
        more_links = compare_blocks(wide, group, per_node, source, num, width, repeats)
        if not more_links.isEmpty():
            group = components(links.union(more_links)).withColumnRenamed("v", "node")
    return member, written(per_node.join(group, "node", "left").withColumn("c", F.coalesce("c", "node")))


def open_pairs(n: np.ndarray, pos: np.ndarray, e: np.ndarray, c: np.ndarray, d: np.ndarray, side: np.ndarray, num: int, block: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Spanning set (i, j) of the pairs of one list that may link and are in no common component yet.

    The list is sorted by size n and position pos. Two blocks are skipped if none of their pairs can link by
    size, or by what is before (pos) and behind it (n - pos) at most. e: elements shared in long lists at
    most, c: component, d: distance to the list's leader (negative: unknown). Only pairs of two sides are compared.
    """
    past, rest = -(-num * n // 100) - 1, n - pos  # elements behind the prefix; from the position on
    label, allowed = np.arange(len(n)), (100 - num) / 100 + 1e-9
    starts = np.arange(0, len(n), block)
    ends = np.minimum(starts + block, len(n))
    low, high = n[starts], n[ends - 1]
    top_pos, top_rest = np.maximum.reduceat(pos, starts), np.maximum.reduceat(rest, starts)
    out: list[tuple[int, int]] = []

    for a in range(len(starts)):
        others = np.arange(a, len(starts))
        most = np.minimum(top_rest[a], top_rest[others]) + np.minimum(top_pos[a], top_pos[others])
        go = (num * low[others] <= 100 * high[a]) & (most >= needed_overlap(low[a], low[others], num))
        i = np.arange(starts[a], ends[a])
        for b in others[go].tolist():
            j = np.arange(starts[b], ends[b])
            x, y = i[:, None], j[None, :]
            need = needed_overlap(n[x], n[y], num)
            hit = (c[x] != c[y]) & (side[x] != side[y]) & (x < y) & (num * n[y] <= 100 * n[x])
            hit &= (np.minimum(rest[x], rest[y]) + np.minimum(pos[x], pos[y]) >= need) & (np.minimum(e[x], e[y]) + np.maximum(past[x], past[y]) >= need)
            hit &= (np.abs(d[x] - d[y]) <= allowed) | (d[x] < 0) | (d[y] < 0)
            hit &= label[x] != label[y]
            at, to = np.nonzero(hit)
            while len(at):
                p, q = int(i[at[0]]), int(j[to[0]])
                out.append((p, q))
                label[label == label[q]] = label[p]
                keep = label[i[at]] != label[j[to]]
                at, to = at[keep], to[keep]
    i, j = np.array(out, np.int64).reshape(-1, 2).T
    return i, j


def may_link(x: np.ndarray, y: np.ndarray, num: int) -> np.ndarray:
    """By size and position (size << 32 | position of the shared element): can the overlap suffice?"""
    a, b, i, j = x >> 32, y >> 32, x & 0xFFFFFFFF, y & 0xFFFFFFFF
    return np.minimum(a - i, b - j) + np.minimum(i, j) >= needed_overlap(a, b, num)


def texts_of(nodes: DataFrame, per_node: DataFrame, source: DataFrame, repeats: bool) -> DataFrame:
    """``(node, text)``: the whole text of one document of each node."""
    keys = checkpoint(per_node.select("node", "key").join(nodes, "node"))
    texts = source.join(small_enough(keys), "key").select("node", "text")
    return texts.groupBy("node").agg(F.max("text").alias("text")) if repeats else texts


def overlaps(sets: list[np.ndarray], step: int = 4096) -> np.ndarray:
    """Sizes of all intersections of a bounded number of sets, by products of incidence matrices."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = count[column] > 1
    owner, column = owner[keep], column[keep]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], np.unique(column[order], return_inverse=True)[1]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, [lo, lo + step])
        part = np.zeros((len(sets), step), np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        total += part @ part.T
    return total


def compare_blocks(wide: DataFrame, group: DataFrame, per_node: DataFrame, source: DataFrame, num: int, width: int, repeats: bool, block: int = 192) -> DataFrame:
    """Links ``(a, b)`` inside the groups (node, g), as a spanning set for each pair of blocks.

    A group of m nodes is dealt to m / block blocks that meet pairwise, so a task holds two blocks at a time.
    Pairs of blocks whose nodes share one component already (``group``) are not compared.
    """
    sized = wide.groupBy("g").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = wide.join(sized, "g").join(group, "node", "left").withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    own = own.select("g", "node", F.coalesce("c", "node").alias("c"), "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    own = own.select("g", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node", "c")
    spread = own.join(texts_of(wide.select("node"), per_node, source, repeats), "node").select("g", "lo", "hi", "node", "c", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, marks in runs(batches, ["g", "lo", "hi"]):
            node, c, texts = table["node"].to_numpy(), table["c"].to_numpy(), table["text"].to_pylist()
            for lo, hi in zip(marks[:-1].tolist(), marks[1:].tolist(), strict=True):
                if (c[lo:hi] == c[lo]).all():
                    continue
                sets = [s for a, b in chunks(texts[lo:hi]) for s in shingle_sets(texts[lo:hi][a:b], width)]
                both = overlaps(sets)
                size = np.array([len(s) for s in sets])
                i, j = np.nonzero(np.triu(100 * both >= num * (size[:, None] + size[None, :] - both), 1))
                root = local_roots(hi - lo, i, j)
                at = np.flatnonzero(root != np.arange(hi - lo))
                yield pa.RecordBatch.from_arrays([pa.array(node[lo + root[at]]), pa.array(node[lo + at])], names=["a", "b"])

    return checkpoint(spread.repartition("g", "lo", "hi").sortWithinPartitions("g", "lo", "hi").mapInArrow(compare, "a long, b long"))


def verify(pairs: DataFrame, per_node: DataFrame, source: DataFrame, num: int, width: int, repeats: bool) -> DataFrame:
    """``(a, b, distance, linked)`` of node pairs, from the whole texts of one document of each node."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = texts_of(wanted, per_node, source, repeats)
    chunked = pairs.groupBy("a").agg(F.ceil(F.count("*") / 256).cast("int").alias("parts"))
    asks = pairs.join(chunked, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    other = asks.join(texts.withColumnRenamed("node", "b"), "b").select("a", "part", F.lit(1).alias("role"), "b", "text")
    own = chunked.join(texts.withColumnRenamed("node", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("a").alias("b"), "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, base_key = np.zeros(0, U64), None
        for batch in batches:
            texts, a, part, role, b = batch.column(4).to_pylist(), *(batch.column(k).to_numpy() for k in range(4))
            for lo, hi in chunks(texts):
                rows: list[tuple[int, int, float, bool]] = []
                for k, s in zip(range(lo, hi), shingle_sets(texts[lo:hi], width), strict=True):
                    if role[k] == 0:
                        base, base_key = s, (a[k], part[k])
                        continue
                    if base_key != (a[k], part[k]):
                        raise AssertionError("a pair came before its first set")
                    both = len(base) + len(s)
                    common = both - len(np.unique(np.concatenate([base, s])))
                    rows.append((a[k], b[k], 1 - common / max(1, both - common), 100 * common >= num * (both - common)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["a", "b", "distance", "linked"])

    both = other.unionByName(own).repartition("a", "part").sortWithinPartitions("a", "part", "role")
    return checkpoint(both.mapInArrow(check, "a long, b long, distance double, linked boolean"))


def _repeats(member: DataFrame) -> bool:
    """Whether an id and text stand on several rows, so that a key gives a text more than once."""
    return not member.groupBy("key").count().where("count > 1").isEmpty()


def drop_copies(docs: DataFrame, num: int = 75, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of linked documents, all rows with an empty set among them.

    It is the one of smallest id (nulls last); of several texts of that id any one, and of repeated rows one.
    """
    rows = checkpoint(linked_rows(docs, num, width, id_col, text_col))
    best = rows.groupBy("c").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("best")).select("best.key")
    counts = rows.groupBy("key").agg(F.count("*").alias("times"))
    gone = counts.join(best, "key", "left_anti").select("key")
    twice = checkpoint(counts.join(best, "key", "left_semi").where("times > 1").select("key"))
    keyed = docs.withColumn("__key", row_key(id_col, text_col))
    on = lambda keys: keys.withColumnRenamed("key", "__key")
    if twice.isEmpty():
        return keyed.join(on(gone), "__key", "left_anti").select(*docs.columns)
    once = keyed.join(on(gone.union(twice)), "__key", "left_anti")
    return once.union(keyed.join(on(twice), "__key", "left_semi").dropDuplicates(["__key"]).select(*once.columns)).select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), low AS (
  SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a
)
SELECT documents.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, documents.doc_id)::BIGINT AS component_id
FROM documents LEFT JOIN sizes ON documents.doc_id = sizes.doc_id LEFT JOIN low ON documents.doc_id = low.a
"""
