"""Phrase collocations by top-order marginalisation (operator 13).

Texts are cut into pieces and words. Each word position gives one row of lead-window columns, the word and the next
ones up to ``longest`` words, padded at the end of its piece; only these longest windows are counted. A ROLLUP over
(lang, w1, ..., wk) then sums them over successively shorter prefixes, which are the counts of all shorter phrases
and, at its first level, each language's number of words.

Windows are padded early where a phrase cannot reach ``min_count``: passes over the texts count words and pairs, then
triples and so on in a fixed number of hashed counters (``2^bits`` bytes a task), each pass only where all shorter
parts may be frequent; a window ends where its counter stays below. A counter counts at least what its phrases count,
so every phrase that is frequent enough keeps all its occurrences and counts are exact; where data outgrow the counters
(more than about 2^bits * min_count / 2 words) ever more windows are counted, so raise ``bits`` or ``min_count`` with them.

Scores are integers from decimals of 38 digits. A candidate's least cut, its longer candidates and the ranks are
joins, grouped aggregates and two ranking steps (``_DEAL`` parts of a language first).

Defined results: a null text is empty, a null language ``und``; repeated rows count as often as they stand; ties go to the
phrase that is smaller in bytes; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopy.llm._arrays import _LOWER, U64, chunks, distinct_slices, mix, slice_hashes
from canopy.llm._spark import checkpoint, runs, small_enough

_PART = 1 << 16
#: Words that are turned into windows at once, and parts of a language that are ranked first.
_SLICE, _DEAL = 1 << 20, 64
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


class Words:
    """The words of some texts: distinct ones, and for each position its word's, piece's and text's number."""

    def __init__(self, texts: list[str]):
        parts = [t.encode("utf-8", "replace") for t in texts]
        self.raw = _LOWER[np.frombuffer(b"\n".join([*parts, b""]), np.uint8)]
        kind = _KIND[self.raw]
        solid = np.zeros(len(self.raw) + 2, bool)
        solid[1:-1] = kind == 0
        edge = np.flatnonzero(solid[1:] != solid[:-1])
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.piece = np.cumsum(kind == 2)[self.starts]
        self.text = np.searchsorted(np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1), self.starts, side="right")


class Grams:
    """Hashes of the phrases of 1, 2, ... words at each position, apart for every language."""

    def __init__(self, words: Words, langs: list[str], bits: int):
        seeds = np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "replace")) for x in langs], U64)
        self.piece, self.bits, self.order = words.piece, bits, 1
        self.word = slice_hashes(words.raw, words.starts, words.ends)
        self.hash = mix(self.word ^ seeds[words.text])

    def slots(self) -> np.ndarray:
        return (self.hash >> U64(64 - self.bits)).astype(np.int64)

    def longer(self) -> np.ndarray:
        """Goes on to phrases of one word more; which positions have one in their piece."""
        k = self.order
        self.order += 1
        if k >= len(self.word):
            return np.zeros(len(self.word), bool)
        self.hash = np.append(mix(self.hash[:-k] * U64(3) + self.word[k:]), np.zeros(k, U64))
        return np.append(self.piece[k:] == self.piece[:-k], np.zeros(k, bool))


def _alive(grams: Grams, reached: np.ndarray, counted: int) -> Iterator[np.ndarray]:
    """For phrases of 1, 2, ... words the positions where they and all their parts may be frequent; without
    end, so that those of ``counted`` words and more are only known by their parts."""
    have = lambda slot: reached[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1 > 0
    alive = have(grams.slots()) if counted else np.ones(len(grams.word), bool)
    while True:
        yield alive
        inside = grams.longer()
        alive = alive & inside & np.append(alive[1:], np.zeros(min(1, len(alive)), bool))
        if grams.order <= counted:
            alive &= have(grams.slots())


def frequent_slots(source: DataFrame, limit: int, bits: int, longest: int) -> np.ndarray:
    """One bit for each counter of phrases that reaches ``limit``; ``source``: lang, text."""
    limit, spark = min(limit, 255), source.sparkSession

    def reached_in(orders: list[int], before: np.ndarray) -> np.ndarray:
        known = spark.sparkContext.broadcast(before)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 << bits, np.uint8)
            for batch in batches:
                langs, texts = (batch.column(k).to_pylist() for k in (0, 1))
                for lo, hi in chunks(texts):
                    grams, slots = Grams(Words(texts[lo:hi]), langs[lo:hi], bits), []
                    for order, alive in zip(range(1, orders[-1] + 1), _alive(grams, known.value, orders[0] - 1), strict=False):
                        if order in orders:
                            slots.append(grams.slots()[alive])
                    slot, n = np.unique(np.concatenate(slots), return_counts=True)
                    total[slot] = np.minimum(total[slot] + n, limit)
            for k in range(0, len(total), _PART):
                if total[k : k + _PART].any():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([zlib.compress(total[k : k + _PART].tobytes(), 1)], pa.binary())], names=["part", "counts"])

        out = before.copy()
        summed = source.mapInArrow(count, "part long, counts binary").repartition("part").sortWithinPartitions("part").mapInArrow(add, "part long, bits binary")
        for row in summed.collect():  # a bit for each of a fixed number of counters
            out[row["part"] // 8 : (row["part"] + _PART) // 8] |= np.frombuffer(row["bits"], np.uint8)
        return out

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, None

        def reached() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([np.packbits(total >= limit).tobytes()], pa.binary())], names=["part", "bits"])

        for batch in batches:
            for own, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != part:
                    if part is not None:
                        yield reached()
                    part, total = own, np.zeros(_PART, np.int64)
                counts = np.frombuffer(zlib.decompress(counts), np.uint8)
                total[: len(counts)] += counts
        if part is not None:
            yield reached()

    out = np.zeros(max(_PART, 1 << bits) // 8, np.uint8)
    for orders in ([1, 2], *([k] for k in range(3, longest + 1))):
        out = reached_in([k for k in orders if k <= longest], out)
    return out


def window_lengths(grams: Grams, reached: np.ndarray, longest: int) -> np.ndarray:
    """Words of the window at each position: up to the end of its piece or of what may be frequent."""
    return sum(alive.astype(np.int64) for _, alive in zip(range(longest), _alive(grams, reached, longest), strict=False))


def count_windows(source: DataFrame, min_count: int, longest: int, bits: int) -> DataFrame:
    """``(lang, w1, ..., wk, n)``: the distinct padded windows with their counts; '' is padding."""
    reached = source.sparkSession.sparkContext.broadcast(frequent_slots(source, min_count, bits, longest))
    columns = [f"w{k}" for k in range(1, longest + 1)]

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = (batch.column(k).to_pylist() for k in (0, 1))
            for lo, hi in chunks(texts):
                words = Words(texts[lo:hi])
                names = sorted(set(langs[lo:hi]))
                place = {x: k for k, x in enumerate(names)}
                number = np.array([place[x] for x in langs[lo:hi]], np.int64)
                length = window_lengths(Grams(words, langs[lo:hi], bits), reached.value, longest)
                for at in range(0, len(length), _SLICE):
                    own = slice(at, min(at + _SLICE, len(length)))
                    more = slice(at, at + _SLICE + longest)
                    first, word = distinct_slices(words.raw, words.starts[more], words.ends[more])
                    n = own.stop - own.start
                    lead = np.zeros((longest + 1, n), np.int64)
                    lead[0] = number[words.text[own]]
                    for k in range(longest):
                        part = word[k : k + n] + 1
                        lead[k + 1, : len(part)] = np.where(length[own][: len(part)] > k, part, 0)
                    order = np.lexsort(lead[::-1])
                    lead = lead[:, order]
                    new = np.flatnonzero(np.append(True, (lead[:, 1:] != lead[:, :-1]).any(0)))
                    raw, a, b = words.raw.tobytes(), words.starts[more][first].tolist(), words.ends[more][first].tolist()
                    spelled = pa.array(["", *(raw[i:j].decode("utf-8", "replace") for i, j in zip(a, b, strict=True))])
                    cols = [pa.array(names).take(pa.array(lead[0, new])), *(spelled.take(pa.array(x)) for x in lead[1:, new])]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(np.append(new, n)))], names=["lang", *columns, "n"])

    found = source.mapInArrow(windows, f"lang string, {', '.join(f'{c} string' for c in columns)}, n long")
    return found.groupBy("lang", *columns).agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, min_count: int = 100, longest: int = 5, bits: int = 26, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``(lang, k, phrase, f)``: every phrase of up to ``longest`` words with at least ``min_count`` occurrences, and
    with k 0 the number of all words of each language."""
    source = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    columns = [f"w{k}" for k in range(1, longest + 1)]
    rolled = count_windows(source, min_count, longest, bits).rollup("lang", *columns).agg(F.sum("n").alias("f"), F.grouping_id().alias("rolled"))
    k = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    padded = F.coalesce(*(F.when(F.col(c).isNotNull(), F.col(c) == "") for c in reversed(columns)), F.lit(False))
    kept = rolled.where((F.col("rolled") < 2**longest) & ((F.col("rolled") == 2**longest - 1) | (~padded & (F.col("f") >= min_count))))
    return kept.select("lang", k.alias("k"), F.concat_ws(" ", *columns).alias("phrase"), "f")


def collocations(
    docs: DataFrame, min_count: int = 100, longest: int = 5, top: int = 2000, absorb: int = 100, bits: int = 26, lang_col: str = "lang", text_col: str = "text",
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's first ``top`` collocations.

    A candidate goes if a longer one that holds it has at least ``absorb`` percent of its count.
    """
    counted = checkpoint(phrase_counts(docs, min_count, longest, bits, lang_col, text_col))
    totals = small_enough(counted.where("k = 0").select("lang", F.col("f").alias("n")))
    counts = counted.where("k > 0").select("lang", "phrase", "f")
    words = counted.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))

    held = words.where("k > 2").select("lang", "a", "w", "k", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("m"))
    held = held.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("m") + 1)).alias("at"))
    held = held.groupBy("lang", F.array_join(F.slice("w", F.col("at"), F.col("m")), " ").alias("phrase")).agg(F.max("a").alias("held"))
    left = words.join(held, ["lang", "phrase"], "left").where(F.col("held").isNull() | (100 * F.col("held") < absorb * F.col("a")))

    cuts = left.select("lang", "phrase", "a", "w", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("head"), F.array_join(F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("tail"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]).join(totals, "lang")
    score = F.expr("CAST(1000 * CAST(a AS DECIMAL(19,0)) * CAST(n AS DECIMAL(19,0)) DIV (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0))) AS LONG)")
    least = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("least"))
    scored = least.select("lang", "phrase", "a", "least.l", "least.r", "n", "least.score", F.pmod(F.xxhash64("phrase"), F.lit(_DEAL)).alias("deal"))
    ranked = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    for by in (["lang", "deal"], ["lang"]):
        scored = scored.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*ranked)).cast("long")).where(F.col("rank") <= top)
    return scored.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), words AS (
  SELECT lang, list_filter(regexp_split_to_array(p, '[ \t]+'), lambda x: x <> '') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang
), places AS (
  SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM words, (SELECT unnest(generate_series(1, 5)) AS k) WHERE len(w) >= k
), f AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM places GROUP BY ALL HAVING count(*) >= 100
), candidates AS (
  SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1
), held AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS held FROM (
    SELECT lang, w, a, m, unnest(generate_series(1, k - m + 1)) AS i FROM candidates, (SELECT unnest(generate_series(2, 4)) AS m) WHERE m < k
  ) GROUP BY ALL
), kept AS (
  SELECT c.* FROM candidates c LEFT JOIN held USING (lang, phrase) WHERE held IS NULL OR 100 * held < 100 * a
), cuts AS (
  SELECT kept.lang, kept.phrase, a, n, j, h.f AS l, t.f AS r, (1000::HUGEINT * a * n) // (h.f::HUGEINT * t.f) AS score
  FROM kept JOIN (SELECT unnest(generate_series(1, 4)) AS j) ON j < kept.k JOIN totals USING (lang)
  JOIN f h ON h.lang = kept.lang AND h.phrase = array_to_string(w[1:j], ' ') JOIN f t ON t.lang = kept.lang AND t.phrase = array_to_string(w[j + 1:], ' ')
), least AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM least QUALIFY rank <= 2000
"""
