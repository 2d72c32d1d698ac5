import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from pyspark.sql import functions as F

from canopy.llm import byte_bpe, hmm, jaccard, line_dedup, packing, queries, toxicity
from tests.conftest import SF

SCHEMA = "doc_id long, text string, lang string, score double, node long, key string, n_chars long"


def documents(spark, texts, ids=None):
    """Documents with further columns whose names the operators use inside."""
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", 0.5, 7, "k", len(t or "")) for i, t in zip(ids, texts, strict=True)], SCHEMA).repartition(3)


def thue_morse(n):
    """Two different words of n letters whose polynomial hashes modulo 2^64 are equal for every odd base."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


ODD = [" ".join(thue_morse(1024)), " ".join(thue_morse(4096)), None, "", " ", "\n\n", "a", "it's 'tis ''s\n\n  x", "é" * 300, "word " * 5000, "word " * 5000, "日本語 テキスト 123", "x" * 4000]


def words(rnd, n, vocabulary=60):
    return [f"w{rnd.randrange(vocabulary)}" for _ in range(n)]


# ------------------------------------------------------------------------------------- byte BPE
def reference_bpe():
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), path


def test_byte_bpe_equals_library_and_round_trips(spark):
    library, path = reference_bpe()
    rnd = random.Random(3)
    alphabet = ["a", "b", "'", "'s", "'re", "'ll", " ", "  ", "\n", "\t", "7", "é", "Σ", "。", "\xa0", "!", "S", "👍", "'d", "\r\n"]
    texts = ODD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(40))) for _ in range(300)]
    docs = documents(spark, texts)
    got = {r["doc_id"]: r for r in byte_bpe.digests(docs, path).collect()}
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    back = {r["doc_id"]: bytes(r["decoded"]) for r in byte_bpe.decode(byte_bpe.encode(docs, path), path).collect()}
    assert all(back[i] == (t or "").encode() for i, t in enumerate(texts))
    assert byte_bpe.digests(docs.where("false"), path).count() == 0


def test_regular_words_have_hashes_of_their_own():
    from canopy.llm._arrays import distinct_slices, shingle_sets

    for n in (1024, 4096):
        one, two = thue_morse(n)
        a, b = shingle_sets([one, two])
        assert a[0] != b[0] and len(np.unique(hmm.token_arrays([f"{one} {two}"])[0])) == 3


def test_slices_of_equal_hash_are_told_apart(monkeypatch):
    from canopy.llm import _arrays

    monkeypatch.setattr(_arrays, "slice_hashes", lambda codes, starts, ends: np.zeros(len(starts), np.uint64))
    codes = np.frombuffer(b"aabbaabcaab", np.uint8)
    starts, ends = np.array([0, 2, 4, 6, 8]), np.array([2, 4, 6, 8, 11])
    at, inverse = _arrays.distinct_slices(codes, starts, ends)
    part = lambda i: codes[starts[i] : ends[i]].tobytes()
    assert [part(at[k]) for k in inverse] == [part(i) for i in range(5)] and len(at) == 4


# -------------------------------------------------------------------------------------- packing
def test_minimum_slack_is_optimal():
    rnd = random.Random(5)
    for _ in range(200):
        counts = Counter(rnd.randrange(1, 30) for _ in range(rnd.randrange(1, 8)))
        capacity = rnd.randrange(1, 80)
        sums = {0}
        for length, n in counts.items():
            for _ in range(n):
                sums |= {s + length for s in sums}
        chosen = packing.minimum_slack(dict(counts), capacity)
        assert all(chosen[k] <= counts[k] for k in chosen)
        assert sum(k * v for k, v in chosen.items()) == max(s for s in sums if s <= capacity)


def test_packing_covers_every_id_once(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rnd = random.Random(1)
    texts = ODD + ["<|endoftext|> special", "İstanbul Σίσυφος's"] + [" ".join(words(rnd, rnd.randrange(1, 900))) for _ in range(60)]
    docs = documents(spark, texts)
    pieces = packing.pack(docs, path, with_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        rows = sorted(by_doc[i], key=lambda p: p["start"])
        assert [x for p in rows for x in p["ids"]] == ids
        assert all(p["doc_tokens"] == len(ids) and p["length"] == len(p["ids"]) for p in rows)
        assert all(p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes()) for p in rows)
    for rows in by_sequence.values():
        at = 0
        for p in sorted(rows, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == 2048 or at & (at - 1) == 0
    assert packing.pack(docs.where("false"), path).count() == 0


# ------------------------------------------------------------------------------------ toxicity
def test_folding():
    assert toxicity.fold("You 1d10t, l0ser! Zürich $tupid іdіоt 2024") == " you idiot loser zurich stupid idiot 2024 "


def test_toxicity_learns_terms_and_exceptions(spark):
    rnd = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        w = words(rnd, 40, 200)
        if bad:
            for _ in range(3):
                w[rnd.randrange(40)] = rnd.choice(["sc0undrel", "Scoundrel", "roguexx", "rogueyy"])
        rows.append(" ".join(w))
        labels.append((i, int(bad), None))
    rows += [None, "", "a polite scoundrel act"]
    labels.append((None, 1, 1))
    docs = documents(spark, rows)
    label_table = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    out = {r["doc_id"]: r for r in toxicity.score_documents(docs, label_table).collect()}
    assert len(out) == len(rows)
    held = [i for i in range(600) if out[i]["held_out"]]
    assert held and all((zlib.crc32(str(i).encode()) % 3 == 1) == out[i]["held_out"] for i in out)
    assert all(out[i]["predicted"] == int(i % 5 == 0) for i in held)
    assert out[600]["score"] == out[601]["score"] < 0.7
    model = toxicity.Model({" scoundrel ": 5.0}, ("scoundrel act",), (-3.0, 2.0, 1.0))
    assert model.evidence("a scoundrel act")[0] == 0 and model.evidence("a scoundrel acts")[0] == 5
    assert toxicity.drop_toxic(docs, label_table).columns == docs.columns
    none = toxicity.score_documents(docs, label_table.where("false")).collect()
    assert all(r["predicted"] == 0 for r in none)
    assert toxicity.score_documents(docs.where("false"), label_table).count() == 0


def naive_score(model, text):
    """Every term and phrase searched on its own."""
    folded = toxicity.fold(text or "")

    def places(term):
        return [i for i in range(len(folded)) if folded.startswith(term, i)]

    spans = [(i, i + len(toxicity.fold(e))) for e in model.exceptions for i in places(toxicity.fold(e))]
    found = defaultdict(float)
    for term, weight in model.weights.items():
        for i in places(term):
            if not any(a <= i < b for a, b in spans):
                found[i] = max(found[i], weight)
    total, n = sum(found.values()), len(folded.split())
    a, b, c = model.coefficients
    return 1 / (1 + np.exp(-(a + b * np.log1p(total) + c * np.log1p(1000 * total / max(1, n)))))


def test_toxicity_query_equals_brute_force_however_rows_are_dealt(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    twice = docs.union(docs.where("doc_id % 3 = 0"))
    learn = lambda n: toxicity.learn(toxicity.training_rows(twice.repartition(n), labels, "doc_id", "text", "toxic"))
    model = learn(1)
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    rows = docs.collect()
    seen = {(r["text"] or "", toxic[r["doc_id"]]) for r in rows if r["doc_id"] in toxic}
    counts = [Counter(t for text, y in seen if y == k for t in toxicity.terms_of(toxicity.fold(text))) for k in (0, 1)]
    sizes = [sum(y == k for _, y in seen) for k in (0, 1)]
    assert model.weights
    for t, w in model.weights.items():
        assert w == pytest.approx(np.log((counts[1][t] + 0.5) / (sizes[1] + 1)) - np.log((counts[0][t] + 0.5) / (sizes[0] + 1)))
    for n in (4, 16):
        other = learn(n)
        assert other.weights == model.weights and other.coefficients == pytest.approx(model.coefficients)
    got = {r["doc_id"]: r for r in queries.op2_toxicity(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        s = naive_score(model, r["text"])
        assert got[r["doc_id"]]["score"] == pytest.approx(s) and (abs(s - 0.7) < 1e-9 or got[r["doc_id"]]["predicted"] == int(s >= 0.7))
    clash = docs.withColumn("_canopy_score", F.lit("x")).withColumn("score", F.lit(2))
    kept = toxicity.drop_toxic(clash, labels)
    assert kept.columns == clash.columns and kept.count() == sum(r["score"] < 0.7 for r in got.values())


# ------------------------------------------------------------------------------------ line dedup
def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
    return row[-1]


def test_banded_distance_and_postings():
    rnd = random.Random(4)
    for _ in range(1500):
        a = "".join(rnd.choice("abcé") for _ in range(rnd.randrange(4, 14)))
        b = list(a)
        for _ in range(rnd.randrange(4)):
            b.insert(rnd.randrange(len(b) + 1), rnd.choice("abcé")) if rnd.random() < 0.5 else b and b.pop(rnd.randrange(len(b)))
        b = "".join(b)
        for t in (1, 2, 3):
            near = edit_distance(a, b) <= t
            assert line_dedup.within(a, b, t) == near
            if near and min(len(a), len(b)) > t:
                assert line_dedup.postings(a, t, 1) & line_dedup.postings(b, t, 1)


def brute_line_dedup(rows, threshold, per_edit):
    lines = [(i, k, x.strip(" \t\r\v\f")) for i, t in rows for k, x in enumerate((t or "").split("\n")) if t and x.strip(" \t\r\v\f")]
    lines.sort(key=lambda x: (x[0], x[1]))
    kinds = list(dict.fromkeys(x for _, _, x in lines))
    root = {x: x for x in kinds}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(kinds)):
        for b in range(a):
            x, y = kinds[a], kinds[b]
            edits = min(threshold, min(len(x), len(y)) // per_edit)
            if abs(len(x) - len(y)) <= edits and edit_distance(x, y) <= edits:
                root[find(x)] = find(y)
    seen, gone = set(), defaultdict(set)
    for i, k, x in lines:
        c = find(x)
        if c in seen:
            gone[i].add(k)
        seen.add(c)
    return {i: t if i not in gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in rows}


def test_line_dedup_leaves_null_ids_and_texts_alone(spark):
    rows = [(1, "5"), (None, "5"), (5, None), (None, None), (6, "12345678901\n12345678902\n123456789\n123456780"), (6, "12345678901\n12345678902\n123456789\n123456780"), (7, "5")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r["doc_id"], r["n_removed"], r["text"]) for r in line_dedup.dedupe_lines(docs, report=True).collect())
    # lines of 10 letters or more may differ by one edit, shorter ones may not; repeated rows are changed alike
    left = "12345678901\n123456789\n123456780"
    assert got == Counter({(1, 0, "5"): 1, (None, 1, ""): 1, (5, 0, None): 1, (None, 0, None): 1, (6, 1, left): 2, (7, 1, ""): 1})


def test_line_dedup_equals_brute_force(spark):
    rnd = random.Random(6)
    base = [" ".join(words(rnd, rnd.randrange(1, 9))) for _ in range(12)]

    def near(line):
        s = list(line)
        for _ in range(rnd.randrange(3)):
            s[rnd.randrange(len(s))] = rnd.choice("abé ")
        return "".join(s)

    texts = ["\n".join(near(rnd.choice(base)) for _ in range(rnd.randrange(1, 8))) for _ in range(40)] + [None, "", "\n \n", "one\none", "x" * 9000]
    rows = list(enumerate(texts))
    expected = brute_line_dedup(rows, 2, 10)
    docs = documents(spark, texts)
    out = line_dedup.dedupe_lines(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    got = {r["doc_id"]: r for r in out.collect()}
    assert {i: r["text"] for i, r in got.items()} == expected
    assert all(r["n_chars"] == len(r["text"] or "") for r in got.values())
    assert line_dedup.dedupe_lines(docs.where("false")).count() == 0


def test_line_dedup_blocks_do_not_change_links(spark):
    rnd = random.Random(8)
    text = "\n".join(f"this line has a number {rnd.randrange(400):03d} at its end" for _ in range(60))
    docs = documents(spark, [text])
    sizes = [{frozenset(r["v"] for r in g) for g in _groups(line_dedup.near_lines(docs, 2, 10, "text", block=b).collect())} for b in (4, 1000)]
    assert sizes[0] == sizes[1]


def _groups(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["c"]].append(r)
    return out.values()


# --------------------------------------------------------------------------------- Jaccard join
def brute_sets(text, width=5):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_components(sets, num=75):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for a in keys:
        for b in keys:
            if b < a and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("short_list", [8, 1])
def test_jaccard_equals_brute_force(spark, monkeypatch, short_list):
    monkeypatch.setattr(jaccard, "SHORT_LIST", short_list)
    monkeypatch.setattr(jaccard, "LIST_BLOCK", 512 if short_list == 8 else 3)
    rnd = random.Random(9)
    texts = list(ODD) + ["A b", "a B", "a b c d e", "A B C D E", None]
    for _ in range(6):
        base = words(rnd, rnd.randrange(20, 80), 500)
        for _ in range(rnd.randrange(3, 16)):
            w = list(base)
            for _ in range(rnd.randrange(5)):
                w[rnd.randrange(len(w))] = f"z{rnd.randrange(99)}"
            texts.append(" ".join(w[: len(w) - rnd.randrange(4)]))
    texts += [texts[-1]] * 12
    sets = {i: brute_sets(t) for i, t in enumerate(texts)}
    expected = brute_components(sets)
    docs = documents(spark, texts)
    got = {r["doc_id"]: r for r in jaccard.near_sets(docs).collect()}
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r["component_id"] for i, r in got.items()} == expected
    if short_list == 8:
        kept = jaccard.drop_copies(docs)
        assert kept.columns == docs.columns
        assert {r["doc_id"] for r in kept.collect()} == {i for i, c in expected.items() if i == c}
        assert jaccard.near_sets(docs.where("false")).count() == 0


def test_skipping_blocks_loses_no_pair():
    rng = np.random.default_rng(3)
    for block in (1, 4, 64):
        sets = [np.unique(rng.integers(0, 60, rng.integers(5, 40))) for _ in range(40)]
        sets += [np.unique(np.append(s[: len(s) - rng.integers(0, 3)], rng.integers(0, 60, 1))) for s in sets]
        rows = []
        for k, s in enumerate(sets):
            at = np.flatnonzero(s == 7)  # the list of element 7, sets being ordered by element
            if len(at) and at[0] < jaccard.prefix_length(len(s), 75):
                rows.append((len(s), int(at[0]), k))
        n, pos, who = np.array(sorted(rows)).T
        none = np.full(len(n), -9.0)
        i, j = jaccard.open_pairs(n, pos, n, np.arange(len(n)), none, np.arange(len(n)), 75, block)
        root = {k: k for k in range(len(n))}
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            old, new = root[a], root[b]
            root = {k: new if r == old else r for k, r in root.items()}
        for a in range(len(n)):
            for b in range(a):
                both = len(np.intersect1d(sets[who[a]], sets[who[b]]))
                if 100 * both >= 75 * (n[a] + n[b] - both):
                    assert root[a] == root[b]


def test_jaccard_tells_texts_of_one_id_apart(spark):
    rnd = random.Random(4)
    text = [words(rnd, 40, 5000) for _ in range(8)]
    near = lambda k: " ".join([*text[k][:-1], "zz"])
    a, b, c, d, e, f, g, h = (" ".join(t) for t in text)
    rows = [(1, a), (1, b), (1, c), (2, near(1)), (3, near(2)), (4, d), (4, near(0)), (5, e), (5, e), (5, e), (6, "")]
    rows += [(6, ""), (None, f), (None, near(5)), (None, near(3)), (None, g), (None, g), (None, h), (7, near(7)), (8, None)]
    root = brute_components({i: brute_sets(t) for i, (_, t) in enumerate(rows)})
    groups = [[rows[j][0] for j in root if root[j] == root[i]] for i in root]
    expected = [(k, len(brute_sets(t)), min((x for x in groups[i] if x is not None), default=None)) for i, (k, t) in enumerate(rows)]
    docs = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(rows)], "doc_id long, text string, at long").repartition(3)
    order = lambda x: [-1 if v is None else v for v in x]
    got = jaccard.near_sets(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=order) == sorted(expected, key=order)
    kept = jaccard.drop_copies(docs)
    assert kept.columns == docs.columns
    kept = [tuple(r) for r in kept.collect()]
    assert all(rows[i] == (k, t) for k, t, i in kept)
    assert sorted(root[i] for *_, i in kept) == sorted(set(root.values()))
    for k, _, i in kept:  # the smallest id of the group
        assert k == min((x for x in groups[i] if x is not None), default=None)


# ---------------------------------------------------------------------------- hidden Markov model
def plain_forward(model, buckets):
    a = model.start * model.emit[:, buckets[0]]
    total = np.log10(a.sum())
    a = a / a.sum()
    for b in buckets[1:]:
        a = (a @ model.move) * model.emit[:, b]
        total += np.log10(a.sum())
        a = a / a.sum()
    return total


def test_segmented_recursions_equal_plain_ones(monkeypatch):
    monkeypatch.setattr(hmm, "SEGMENT", 4)
    rng = np.random.default_rng(0)
    model = hmm.Hmm.fresh(np.full(11, 1 / 11), 3, 1)
    model.start, model.move = np.array([0.5, 0.3, 0.2]), rng.dirichlet([1, 1, 1], 3)
    lengths = [1, 4, 5, 13, 1, 8]
    offsets = np.append(0, np.cumsum(lengths))
    tokens = rng.integers(0, 11, offsets[-1])
    parts = [tokens[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert np.allclose(model.log10(tokens, offsets), [plain_forward(model, p) for p in parts])
    start, move, emit, _ = model.expected(tokens, offsets)
    s2, m2, e2 = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 11))
    for p in parts:
        alpha, beta = [model.start * model.emit[:, p[0]]], [np.ones(3)]
        for b in p[1:]:
            alpha.append((alpha[-1] @ model.move) * model.emit[:, b])
        for b in p[:0:-1]:
            beta.insert(0, model.move @ (model.emit[:, b] * beta[0]))
        z = alpha[-1].sum()
        for t, b in enumerate(p):
            gamma = alpha[t] * beta[t] / z
            e2[:, b] += gamma
            s2 += gamma if t == 0 else 0
            if t:
                m2 += np.outer(alpha[t - 1], model.emit[:, b] * beta[t]) * model.move / z
    assert np.allclose(start, s2) and np.allclose(move, m2) and np.allclose(emit, e2)


def test_hmm_scores(spark):
    rnd = random.Random(12)
    texts = [" ".join(rnd.choice([["le", "la", "mot"], ["the", "a", "word"]][i % 2]) for _ in range(30)) for i in range(200)] + [None, "", "The unseen", "The unseen"]
    docs = documents(spark, texts, [*range(203), 202])
    rows = hmm.score(docs).collect()
    assert len(rows) == 204
    train = Counter()
    for i, t in zip([*range(203), 202], texts, strict=True):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            train.update([*(t or "").lower().split(), 0])
    n, v = sum(train.values()), len(train)
    for r in rows:
        t = [*(texts[r["doc_id"]] or "").lower().split(), 0]
        assert r["n_tokens"] == len(t) and r["train_tokens"] == n
        assert r["n_known"] == sum(train[w] > 0 for w in t)
        assert r["base_score"] == pytest.approx(sum(np.log10((train[w] + 1) / (n + v + 1)) for w in t))
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 200]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert hmm.score(docs.where("false")).count() == 0
