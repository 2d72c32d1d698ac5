"""Toxicity by a weighted lexicon (operator 2).

Texts are folded (compatibility decomposition without marks, lower case, look-alike letters of other
scripts, digits and signs that stand for letters inside words) and searched for all lexicon terms at once
with an Aho-Corasick automaton. A term is a whole word or the beginning of words. Matches inside an
exception phrase do not count. The weights found are summed, both as such and for each word of the text,
and a logistic function of the two turns them into a score.

The lexicon is learned from labelled rows: terms that occur in at least ``share`` of the toxic texts (so
their number is at most a text's mean number of terms over ``share``, whatever the corpus's size), weighted
by the log ratio of their document frequencies in toxic and clean texts. Frequencies cover all labelled
training rows. The logistic function is fitted to a histogram of the training rows (``_CELLS`` squared
cells at most).

Defined results: a null text scores as the empty text; a row with a null id or label is never learned from;
repeated labelled rows with one text and label count once in the lexicon and in the fit; a table without labelled rows of both
classes gives the lexicon of no terms and scores of 0.5 times nothing known, that is the share of toxic
rows (0 if there are none); other columns pass through ``apply`` untouched, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm._spark import checkpoint, small_enough, written

#: Letters that look like Latin ones (Cyrillic, Greek), then signs used for letters.
HOMOGLYPHS = str.maketrans("авеікмнорстухѕјԁɡҽοαερντικυχγβ", "abeikmhopctyxsjdgeoaepvtikuxyb")
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
#: Phrases in which a term is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "clown fish", "class clown", "stupid question", "sore loser", "idiot proof", "scum line", "pond scum")
_SWAP = re.compile(r"[01345@$7]+|!+")
_GAP = re.compile(r"[\W_]+")
#: Lengths of word beginnings that can be terms.
PREFIXES = range(4, 9)
_CELLS = 100


def _letters(m: re.Match) -> str:
    """Signs and digits directly behind a letter, or before one at the beginning of a word, as letters;
    exclamation marks only between letters."""
    text, (start, end) = m.string, m.span()
    before, after = text[start - 1 : start].isalpha() if start else False, text[end : end + 1].isalpha()
    if m[0][0] == "!":
        inside = before and after
    else:
        inside = before or after and not (start and text[start - 1].isalnum())
    return "".join(SUBSTITUTES[c] for c in m[0]) if inside else m[0]


def fold(text: str) -> str:
    """Folded words, with one blank before, between and behind them."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = "".join(c for c in text if not unicodedata.combining(c)) if not text.isascii() else text
    text = text.lower()
    if not text.isascii():
        text = text.translate(HOMOGLYPHS)
    text = _SWAP.sub(_letters, text)
    return f" {_GAP.sub(' ', text).strip()} "


def terms_of(folded: str) -> set[str]:
    """Candidate terms of a folded text: `` word `` and `` begin`` (of longer words)."""
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in PREFIXES if k < len(w))
    return out


@dataclass
class Model:
    """Weights by term, exception phrases, and the logistic function's three coefficients."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    coefficients: tuple[float, float, float] = (0.0, 0.0, 0.0)
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for t, w in self.weights.items():
                a.add_word(t, (len(t), w))
            for e in self.exceptions:
                phrase = fold(e)
                # a phrase that is itself a term stays a phrase
                a.add_word(phrase, (len(phrase), None))
            if len(a):
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def evidence(self, text: str) -> tuple[float, int]:
        """Sum of the weights matched (the heaviest term of each word) and the number of words."""
        folded = fold(text)
        a = self.automaton()
        if not len(a):
            return 0.0, folded.count(" ") - 1
        found, spans = {}, []
        for end, (length, weight) in a.iter(folded):
            start = end - length + 1
            if weight is None:
                spans.append((start, end))
            else:
                found[start] = max(weight, found.get(start, 0.0))
        if spans:
            found = {s: w for s, w in found.items() if not any(a <= s < b for a, b in spans)}
        return sum(found.values()), max(0, folded.count(" ") - 1)

    def features(self, text: str) -> tuple[float, float]:
        total, words = self.evidence(text)
        return float(np.log1p(total)), float(np.log1p(1000 * total / max(1, words)))

    def score(self, text: str) -> float:
        x, y = self.features(text)
        a, b, c = self.coefficients
        z = a + b * x + c * y
        return float(1 / (1 + np.exp(-min(700.0, max(-700.0, z)))))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``(text, toxic)`` of the labelled rows whose crc32(id) mod 3 is not 1, each text once a label.

    Texts are told apart by two 64-bit hashes in a shuffle, so the rows do not depend on the partitions.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("toxic"))
    known = small_enough(known.where(F.crc32(F.col("_id").cast("string")) % 3 != 1))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(known, "_id")
    keyed = rows.select("text", "toxic", F.xxhash64("text").alias("h"), F.xxhash64("text", F.lit(1)).alias("g"))
    return written(keyed.dropDuplicates(["h", "g", "toxic"]).select("text", "toxic"))


def learn(train: DataFrame, share: float = 0.002, least: int = 3, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """Lexicon and logistic function from ``(text, toxic)`` rows."""
    sc = train.sparkSession.sparkContext

    def counted(keep=None, toxic: int = 1):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted = keep.value if keep is not None else None
            counts, rows = Counter(), 0
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    rows += 1
                    terms = terms_of(fold(text))
                    counts.update(terms if wanted is None else terms & wanted)
                    if len(counts) > 1_000_000:
                        yield table(counts)
                        counts.clear()
            counts[""] += rows  # the number of texts
            yield table(counts)

        table = lambda c: pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["term", "n"])
        return train.where(F.col("toxic") == toxic).select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))

    bad = checkpoint(counted())
    texts = bad.where("term = ''").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    common = {r["term"]: r["n"] for r in bad.where((F.col("term") != "") & (F.col("n") >= max(least, share * texts))).collect()}
    clean = {r["term"]: r["n"] for r in counted(sc.broadcast(frozenset(common) | {""}), 0).collect()}
    fine = clean.get("", 0)
    weights: dict[str, float] = {}
    if texts and fine:
        ratio = lambda t: float(np.log((common[t] + 0.5) / (texts + 1)) - np.log((clean.get(t, 0) + 0.5) / (fine + 1)))
        for t in sorted(common, key=len):
            expected = (common[t] + clean.get(t, 0)) * texts / (texts + fine)
            if (w := ratio(t)) < 2 or (common[t] - expected) ** 2 / expected < 12:
                continue
            # a longer term says nothing new if a beginning of its word is a term of about its weight
            if not any(weights.get(t[:k], 0) >= w - 0.7 for k in range(5, len(t))):
                weights[t] = w
    model = Model(weights, exceptions)
    shared = sc.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = shared.value.features(text)
                cells[(min(_CELLS - 1, round(x * 10)), min(_CELLS - 1, round(y * 10)), int(label > 0))] += 1
            x, y, label = zip(*cells, strict=True) if cells else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (x, y, label, cells.values())], names=["x", "y", "label", "n"])

    cells = train.mapInArrow(measure, "x long, y long, label long, n long").groupBy("x", "y", "label").agg(F.sum("n").alias("n")).collect()
    model.coefficients = _fit(np.array([(r["x"] / 10, r["y"] / 10, r["label"], r["n"]) for r in sorted(cells)], float).reshape(-1, 4))
    return model


def _fit(rows: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Logistic regression of the label on two features, rows weighted, by Newton's method."""
    n, toxic = rows[:, 3].sum(), (rows[:, 2] * rows[:, 3]).sum()
    if not toxic or toxic == n:
        return (700.0 if n and toxic else -700.0, 0.0, 0.0)
    x = np.column_stack([np.ones(len(rows)), rows[:, 0], rows[:, 1]])
    beta = np.array([np.log(toxic / (n - toxic)), 0.0, 0.0])
    penalty = np.diag([1e-6, ridge, ridge])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        w = rows[:, 3] * np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve(x.T @ (x * w[:, None]) + penalty, x.T @ (rows[:, 3] * (rows[:, 2] - p)) - penalty @ beta)
        size = np.abs(step).max()
        beta += step / max(1.0, size / 2)
        if size < 1e-8:
            break
    beta[1:] = np.maximum(beta[1:], 0.0)  # more evidence never lowers a score
    return tuple(float(b) for b in beta)


def apply(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score column behind all others."""
    return _scored(docs, model, text_col).toDF(*docs.columns, score_col)


def _scored(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    """The columns of ``docs`` as c0, c1, ... and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    names = [f"c{i}" for i in range(len(docs.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.score
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([score(t or "") for t in batch.column(at).to_pylist()], pa.float64())], names=[*names, "score"])

    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema, strict=True))
    return docs.toDF(*names).mapInArrow(run, f"{schema}, score double")


def score_documents(docs: DataFrame, labels: DataFrame, cut: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document."""
    model = learn(training_rows(docs, labels, id_col, text_col, label_col))
    scored = apply(docs.select(F.col(id_col), F.col(text_col)), model, text_col)
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def held_out(id_: Column, mod: int = 3, rest: int = 1) -> Column:
    return F.coalesce(F.crc32(id_.cast("string")) % mod == rest, F.lit(False))


def drop_toxic(docs: DataFrame, labels: DataFrame, cut: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``docs`` without those that score ``cut`` or more."""
    model = learn(training_rows(docs, labels, id_col, text_col, label_col))
    return _scored(docs, model, text_col).where(F.col("score") < cut).drop("score").toDF(*docs.columns)
