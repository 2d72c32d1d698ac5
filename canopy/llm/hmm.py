"""Hidden Markov language model (operator 10).

A text is its words and one end token. A latent state emits a symbol: each frequent word and the end token have
a symbol of their own (``COMMON`` words at most, those that occur ``OFTEN`` times or more), all others share
``BUCKETS`` symbols by a hash of the word. Such a bucket emits the word by its smoothed share of the
bucket's training tokens:

    P(w | bucket) = (c_w + 1) / (N_bucket + V_bucket + 1)

Counts c cover all training words. They stay distributed: documents post their words without a symbol of their
own, the postings meet the counts in a join on the word, and only sums come back to the documents. Frequent words
are counted where the text is, so no word's postings are more than a small share of all. Start, transition and
symbol probabilities (a few hundred thousand numbers, whatever the corpus's size) are trained by
Baum-Welch: in each round every partition adds up expected counts over its whole training texts, and Spark
sums slices of these in two steps. Rounds end when the log likelihood grows by less than ``GAIN`` of itself.
Scores are exact: the forward recursion is scaled at every step.

To run many texts side by side, they are cut into segments of ``SEGMENT`` tokens. The product of step
matrices over a segment is found for all segments at once; chaining these gives the exact forward and
backward vectors at all borders, from which the inner steps follow, again for all segments at once.

Defined results: a null or empty text is the end token alone; a null id is never held out but never learned
from either; repeated rows count as often as they occur and get equal scores; a table without training
rows scores by uniform starts (all counts 0); other columns are not read. Words are told apart by 64-bit
hashes, rows (id and text) by two.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm._arrays import chunks, offsets_of, ragged, word_arrays
from canopy.llm._spark import checkpoint, written

STATES, BUCKETS, ROUNDS, SEGMENT = 4, 8192, 4, 64
COMMON, OFTEN, GAIN = 32768, 20, 1e-3
#: Hash of the end token (a word's hash is spread over all 64-bit values).
END = 1
#: Numbers in a slice of the expected counts, and the groups that add these up first.
_SLICE, _SALTS = 4096, 64


def held_out(id_: Column, mod: int = 7, rest: int = 2) -> Column:
    return F.coalesce(F.crc32(id_.cast("string")) % mod == rest, F.lit(False))


def token_arrays(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes (words, then the end) of all texts on end, and the offsets of each text's."""
    hashes, owner, *_ = word_arrays(texts)
    count = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), np.int64)
    offsets = offsets_of(count + 1)
    out = np.full(int(offsets[-1]), END, np.int64)
    keep = np.ones(len(out), bool)
    keep[offsets[1:] - 1] = False
    out[keep] = hashes.astype(np.int64)
    return out, offsets


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return ((hashes.astype(np.uint64) >> np.uint64(20)) % np.uint64(BUCKETS)).astype(np.int64)


class Words:
    """Words with a symbol of their own, the end token first, and their counts; by open addressing."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        self.counts = counts
        bits = max(4, int(8 * len(words)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.place = np.zeros(1 << bits, np.int64), np.full(1 << bits, -1, np.int32)
        todo, slot = np.arange(len(words)), self._slot(words)
        while len(todo):
            first = np.zeros(len(todo), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = first & (self.place[slot] < 0)
            self.keys[slot[put]], self.place[slot[put]] = words[todo[put]], todo[put]
            todo, slot = todo[~put], (slot[~put] + 1) & self.mask

    def _slot(self, words: np.ndarray) -> np.ndarray:
        return (words.astype(np.uint64) >> self.shift).astype(np.int64)

    def find(self, words: np.ndarray) -> np.ndarray:
        """Position of each word, -1 for others."""
        slot = self._slot(words)
        todo = np.flatnonzero((self.keys[slot] != words) & (self.place[slot] >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            todo = todo[(self.keys[slot[todo]] != words[todo]) & (self.place[slot[todo]] >= 0)]
        return self.place[slot]

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """The own symbol of each word, or that of its bucket behind all of these."""
        place = self.find(words)
        return np.where(place >= 0, place, len(self.counts) + bucket_of(words))


@dataclass
class Hmm:
    """start[s], move[s, t], emit[s, bucket]; rows sum to one."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @classmethod
    def fresh(cls, shares: np.ndarray, states: int, seed: int) -> Hmm:
        """Bucket shares of the corpus, disturbed differently in each state; states like to stay."""
        rng = np.random.default_rng(seed)
        emit = shares * rng.gamma(2.0, 0.5, (states, len(shares)))
        move = np.full((states, states), 0.02 / max(1, states - 1))
        np.fill_diagonal(move, 0.98 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(1, keepdims=True))

    def _segments(self, tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets as (segments, SEGMENT) padded with -1, each text's first segment, segments in a text."""
        lengths = np.diff(offsets)
        per = -(-lengths // SEGMENT)
        first = offsets_of(per)
        block = np.full((int(first[-1]), SEGMENT), -1, np.int64)
        block.ravel()[ragged(first[:-1] * SEGMENT, lengths)] = tokens
        return block, first, per

    def _products(self, block: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per segment the scaled product of its step matrices (from the state before its first token) and
        the logarithm of the scale. In a text's first segment the start row replaces the first move."""
        k, n = len(self.start), len(block)
        product, log = np.broadcast_to(np.eye(k), (n, k, k)).copy(), np.zeros(n)
        opening = np.zeros(n, bool)
        opening[first[:-1]] = True
        # longest first, so that the segments still running at a step are a slice
        order = np.argsort(-(block >= 0).sum(1), kind="stable")
        block, opening = block[order], opening[order]
        active = (block >= 0).sum(0)
        emit = np.ascontiguousarray(self.emit.T)
        for t in range(block.shape[1]):
            m = active[t]
            if not m:
                break
            b = emit[block[:m, t]]
            if t:
                p = (product[:m].reshape(-1, k) @ self.move).reshape(m, k, k) * b[:, None, :]
            else:
                p = np.where(opening[:m, None, None], self.start[None, None, :], self.move[None]) * b[:, None, :]
            scale = p.sum((1, 2))
            product[:m] = p / scale[:, None, None]
            log[:m] += np.log(scale)
        back = np.empty_like(order)
        back[order] = np.arange(n)
        product, log = product[back], log[back]
        return product, log

    def log10(self, tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Exact log10 probability of each text's bucket sequence."""
        block, first, per = self._segments(tokens, offsets)
        product, log = self._products(block, first)
        alpha, _, total = self._chain(product, log, first, per, False)
        return total / np.log(10)

    def _chain(self, product: np.ndarray, log: np.ndarray, first: np.ndarray, per: np.ndarray, back: bool):
        """Forward vector before each segment, backward vector behind it, log probability of each text."""
        k, n = len(self.start), len(product)
        alpha, beta, total = np.zeros((n, k)), np.ones((n, k)), np.zeros(len(per))
        alpha[first[:-1]] = 1 / k  # the product's rows are all the start row here, so any unit mass does
        order = np.argsort(-per, kind="stable")
        counts = np.bincount(per, minlength=1)
        deep = len(per) - np.cumsum(counts)  # texts with more than t segments
        now = np.full((len(per), k), 1 / k)
        for t in range(int(per.max(initial=0))):
            docs = order[: deep[t]]
            at = first[docs] + t
            alpha[at] = now[docs]
            a = np.einsum("nk,nkj->nj", now[docs], product[at])
            scale = a.sum(1)
            now[docs] = a / scale[:, None]
            total[docs] += np.log(scale) + log[at]
        if back:
            for t in range(int(per.max(initial=0)) - 2, -1, -1):
                docs = order[: deep[t + 1]]
                at = first[docs] + t
                b = np.einsum("nkj,nj->nk", product[at + 1], beta[at + 1])
                beta[at] = b / b.sum(1, keepdims=True)
        return alpha, beta, total

    def expected(self, tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected start, move and emission counts of whole texts, and their log likelihood."""
        k = len(self.start)
        block, first, per = self._segments(tokens, offsets)
        product, log = self._products(block, first)
        alpha, beta, total = self._chain(product, log, first, per, True)
        n = len(block)
        opening = np.zeros(n, bool)
        opening[first[:-1]] = True
        order = np.argsort(-(block >= 0).sum(1), kind="stable")
        block, alpha, beta, opening = block[order], alpha[order], beta[order], opening[order]
        active = (block >= 0).sum(0)
        forward, gammas = np.zeros((block.shape[1], n, k)), np.zeros((block.shape[1], n, k))
        table = np.ascontiguousarray(self.emit.T)
        for t in range(block.shape[1]):
            m = active[t]
            if not m:
                break
            b = table[block[:m, t]]
            a = alpha[:m] @ self.move if not t else forward[t - 1, :m] @ self.move
            if not t:
                a = np.where(opening[:m, None], self.start, a)
            a = a * b
            forward[t, :m] = a / a.sum(1, keepdims=True)
        start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((k, self.emit.shape[1]))
        for t in range(block.shape[1] - 1, -1, -1):
            m = active[t]
            if not m:
                continue
            gamma = forward[t, :m] * beta[:m]
            gamma /= gamma.sum(1, keepdims=True)
            gammas[t, :m] = gamma
            # what the step into this token carries: before it, its emission and what follows
            after = table[block[:m, t]] * beta[:m]
            before = alpha[:m] if not t else forward[t - 1, :m]
            inner = ~opening[:m] if not t else np.ones(m, bool)
            z = ((before[inner] @ self.move) * after[inner]).sum(1)
            move += self.move * ((before[inner] / z[:, None]).T @ after[inner])
            if not t:
                start += gamma[opening[:m]].sum(0)
            b = after @ self.move.T
            beta[:m] = b / b.sum(1, keepdims=True)
        used = block >= 0
        for s in range(k):
            emit[s] = np.bincount(block[used], gammas[:, :, s].T[used], minlength=emit.shape[1])
        return start, move, emit, float(total.sum())

    def updated(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, prior: np.ndarray) -> Hmm:
        """Maximisation, with a little of the uniform start and moves and of the corpus's bucket shares."""
        start, move, emit = start + 0.1, move + 0.1, emit + prior * 10
        return Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of each slice in this partition; there are as many slices as the model has."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[part] = np.frombuffer(v) + total.get(part, 0.0)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["part", "v"])


def word_counts(train: DataFrame) -> DataFrame:
    """``(word, c)``: exact counts of all tokens of ``train(text)``, the end token included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo, hi in chunks(texts, 1 << 22):
                held.append(np.unique(token_arrays(texts[lo:hi])[0], return_counts=True))
                size += len(held[-1][0])
                if size > 1_000_000:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if size > 500_000:
                        yield rows(held.pop())
                        size = 0
        if held:
            yield rows(merged(held))

    def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        words, at = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
        return words, np.bincount(at, np.concatenate([c for _, c in held])).astype(np.int64)

    def rows(pair: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["word", "c"])

    return train.select("text").mapInArrow(count, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def coded_chunks(lists: pa.ListArray, limit: int = 1 << 18) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows of about ``limit`` symbols (one row at least), their symbols on end and the offsets of each row's."""
    ends = np.cumsum(lists.value_lengths().to_numpy())
    at = 0
    while at < len(ends):
        start = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, start + limit, side="right")))
        part = lists.slice(at, stop - at)
        yield slice(at, stop), part.flatten().to_numpy().astype(np.int64), np.append(0, ends[at:stop] - start)
        at = stop


def train_hmm(train: DataFrame, shares: np.ndarray, states: int = STATES, rounds: int = ROUNDS, seed: int = 11) -> Hmm:
    """Baum-Welch over all texts of ``train(symbols)``; ``shares``: the corpus's symbol shares."""
    sc = train.sparkSession.sparkContext
    model, last = Hmm.fresh(shares, states, seed), None
    for _ in range(rounds):
        shared = sc.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = shared.value
            start, move, emit, likelihood = np.zeros_like(m.start), np.zeros_like(m.move), np.zeros_like(m.emit), 0.0
            for batch in batches:
                for _, symbols, offsets in coded_chunks(batch.column(0)):
                    a, b, c, d = m.expected(symbols, offsets)
                    start, move, emit, likelihood = start + a, move + b, emit + c, likelihood + d
            all_ = np.concatenate([start, move.ravel(), [likelihood], emit.ravel()])
            rows = [all_[k : k + _SLICE].tobytes() for k in range(0, len(all_), _SLICE)]
            salt = np.full(len(rows), TaskContext.get().partitionId() % _SALTS)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.binary()), pa.array(salt, pa.int32())], names=["part", "v", "salt"])

        some = train.select("symbols").mapInArrow(expect, "part long, v binary, salt int").repartition("part", "salt").mapInArrow(_added, "part long, v binary")
        parts = {r["part"]: np.frombuffer(r["v"]) for r in some.repartition("part").mapInArrow(_added, "part long, v binary").collect()}  # the model's slices
        if not parts:
            break
        start, move, likelihood, emit = np.split(np.concatenate([parts[k] for k in sorted(parts)]), np.cumsum([states, states * states, 1]))
        model = model.updated(start, move.reshape(states, states), emit.reshape(states, -1), shares)
        if last is not None and likelihood[0] - last < GAIN * abs(last):
            break
        last = likelihood[0]
    return model


def score(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every document."""
    sc = docs.sparkSession.sparkContext
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    learned = source.where(F.col("id").isNotNull() & ~held_out(F.col("id"))).select("text")
    counts = checkpoint(word_counts(learned))
    bucket = (F.shiftrightunsigned("word", 20) % BUCKETS).cast("int")  # as in bucket_of
    per_bucket = counts.groupBy(bucket.alias("bucket")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()  # BUCKETS rows at most
    size, kinds = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in per_bucket:
        size[r["bucket"]], kinds[r["bucket"]] = r["n"], r["v"]
    total, distinct = int(size.sum()), int(kinds.sum())
    top = counts.where((F.col("c") >= OFTEN) & (F.col("word") != END)).orderBy(F.col("c").desc(), "word").limit(COMMON).collect()
    ends = counts.where(F.col("word") == END).agg(F.coalesce(F.max("c"), F.lit(0))).first()[0]
    own_words, own_counts = np.array([END, *(r["word"] for r in top)], np.int64), np.array([ends, *(r["c"] for r in top)], float)
    np.subtract.at(size, bucket_of(own_words), own_counts)
    np.subtract.at(kinds, bucket_of(own_words), own_counts > 0)
    known = Words(own_words, own_counts)
    shares = (np.append(own_counts, size) + 1) / (total + BUCKETS + len(own_words))
    words = sc.broadcast(known)
    # what a token adds to the base score's sum, and what its symbol takes from the latent score
    log_own = sc.broadcast(np.append(np.log10(own_counts + 1), np.zeros(BUCKETS)))
    log_bucket = sc.broadcast(np.append(np.zeros(len(own_words)), np.log10(size + kinds + 1)))

    # each row's key: id and text, so that repeated ids with other texts stay apart
    keys = [F.xxhash64(F.col("id").cast("string"), "text", F.lit(seed)).alias(n) for seed, n in enumerate(("key", "more"))]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Symbols of every text, written once: the rounds and the scores read these."""
        for batch in batches:
            texts = batch.column(4).to_pylist()
            for lo, hi in chunks(texts, 1 << 21):
                tokens, offsets = token_arrays(texts[lo:hi])
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(words.value.symbols(tokens).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k)[lo:hi] for k in range(4)), lists], names=["id", "key", "more", "learn", "symbols"])

    def latent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, symbols, offsets in coded_chunks(batch.column(3)):

                def sums(values: np.ndarray, offsets: np.ndarray = offsets) -> np.ndarray:
                    running = np.append(0.0, np.cumsum(values))
                    return running[offsets[1:]] - running[offsets[:-1]]

                seen = np.append(words.value.counts > 0, np.zeros(BUCKETS, bool))[symbols]
                hidden = model.value.log10(symbols, offsets) - sums(log_bucket.value[symbols])
                columns = [np.diff(offsets), hidden, sums(log_own.value[symbols]), sums(seen)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k)[rows.start : rows.stop] for k in range(3)), *map(pa.array, columns)], names=["id", "key", "more", "n_tokens", "latent", "own", "seen"])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per distinct word of a chunk without a symbol of its own: the documents that hold it, and how often."""
        for batch in batches:
            keys, more, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            for lo, hi in chunks(texts, 1 << 22):
                tokens, offsets = token_arrays(texts[lo:hi])
                rare = words.value.find(tokens) < 0
                tokens, owner = tokens[rare], np.repeat(np.arange(hi - lo), np.diff(offsets))[rare]
                if not len(tokens):
                    continue
                order = np.lexsort((owner, tokens))
                tokens, owner = tokens[order], owner[order]
                new = np.ones(len(tokens), bool)
                new[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
                at = np.flatnonzero(new)
                times = np.diff(np.append(at, len(tokens))).astype(np.int32)
                word = tokens[at]
                first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
                cuts = pa.array(np.append(first, len(word)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (keys[lo:hi][owner[at]], more[lo:hi][owner[at]], times)]
                yield pa.RecordBatch.from_arrays([pa.array(word[first]), *lists], names=["word", "keys", "more", "times"])

    kind = docs.schema[id_col].dataType.simpleString()
    keyed = source.select("id", *keys, "text")
    learn = F.col("id").isNotNull() & ~held_out(F.col("id"))
    coded = written(source.select("id", *keys, learn.alias("learn"), "text").mapInArrow(code, f"id {kind}, key long, more long, learn boolean, symbols array<int>"))
    model = sc.broadcast(train_hmm(coded.where("learn"), shares, states, rounds))
    own = coded.select("id", "key", "more", "symbols").mapInArrow(latent, f"id {kind}, key long, more long, n_tokens long, latent double, own double, seen double")
    posted = keyed.select("key", "more", "text").mapInArrow(post, "word long, keys array<long>, more array<long>, times array<int>")
    met = posted.join(counts, "word", "left").select(F.explode(F.arrays_zip("keys", "more", "times")).alias("p"), F.coalesce("c", F.lit(0)).alias("c"))
    sums = met.groupBy(F.col("p.keys").alias("key"), F.col("p.more").alias("more")).agg(F.sum(F.col("p.times") * F.log10(F.col("c") + 1)).alias("s"), F.sum(F.when(F.col("c") > 0, F.col("p.times")).otherwise(0)).alias("k"))
    # equal rows post together; each gets its share
    rows = own.groupBy("key", "more").agg(*[F.first(n).alias(n) for n in ("id", "n_tokens", "latent", "own", "seen")], F.count("*").alias("copies"))
    out = rows.join(sums, ["key", "more"], "left").withColumn("s", F.coalesce(F.col("s") / F.col("copies"), F.lit(0.0))).withColumn("k", F.coalesce(F.col("k") / F.col("copies"), F.lit(0.0)))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    base = F.col("own") + F.col("s") - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1)))
    return out.select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "n_tokens", F.round(F.col("seen") + F.col("k")).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("s") + F.col("latent")).alias("score"),
    )
