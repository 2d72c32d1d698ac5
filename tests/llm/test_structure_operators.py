"""Fingerprints, conversation repair and collocations against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.llm import collocation, conversation, fingerprint


def brute_paragraphs(text):
    keys, offsets = fingerprint.paragraph_keys([text])
    return set(keys.tolist())


def test_sketches_peel_to_the_exact_difference():
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    text = lambda n: "".join(rnd.choice(words) + rnd.choice("    \n") for _ in range(n))
    left = [text(rnd.randrange(900)) for _ in range(120)] + ["", "", "a\n", "a", "x" * 90_000, "z\n" * 500, "same"]
    right = [fingerprint.edited(a, b) for a, b in zip(left, [*left[1:], left[0]], strict=True)][:-1] + ["same"]
    a, b = fingerprint.paragraph_keys(left), fingerprint.paragraph_keys(right)
    pair, key, sign = fingerprint.differences(a, b, cells=12)
    assert len(set(zip(pair.tolist(), key.tolist(), strict=True))) == len(pair)
    for i, (x, y) in enumerate(zip(left, right, strict=True)):
        own, other = brute_paragraphs(x), brute_paragraphs(y)
        assert set(key[(pair == i) & (sign == 1)].tolist()) == own - other
        assert set(key[(pair == i) & (sign == -1)].tolist()) == other - own
        assert fingerprint.likeness(*(fingerprint.paragraph_keys([t]) for t in (x, y)))[0] == pytest.approx(len(own & other) / len(own | other))
    # paragraphs that occur again have keys of their own
    assert len(brute_paragraphs("z\n" * 500)) == 501


def test_fingerprints_against_edits_equal_brute_force(spark):
    rnd = random.Random(5)
    texts = ["", None, "é", "one line", "a b c\n" * 40, "x" * 30_000] + [" ".join(f"w{rnd.randrange(300)}" for _ in range(rnd.randrange(200))) for _ in range(60)]
    rows = [(7 * i % 101, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, "twice"), (3, "twice"), (3, "another")]
    docs = spark.createDataFrame([(i, t, "p", 1) for i, t in rows], "doc_id long, text string, part string, h int").repartition(5)
    hashes = {r["t"]: r["h"] for r in spark.createDataFrame([(t or "",) for _, t in rows], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted(((i is None, i or 0, hashes[t or ""], t or "") for i, t in rows))
    want = []
    for k, (_, i, _, t) in enumerate(order):
        following = order[(k + 1) % len(order)][3]
        new = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        own, other, after = brute_paragraphs(t), brute_paragraphs(new), brute_paragraphs(following)
        want.append((None if order[k][0] else i, len(t), hashlib.sha256(new.encode()).hexdigest(), len(own & other) / len(own | other), len(own & after) / len(own | after)))
    for range_chars in (1 << 25, 2000):
        got = fingerprint.against_edits(docs, range_chars=range_chars).collect()
        assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == Counter((*w[:3], round(w[3], 9), round(w[4], 9)) for w in want)
    by_text = defaultdict(set)
    for r in got:
        by_text[r["n_chars"], r["doc_id"] == 3 and r["edited_sha256"]].add(r["fingerprint"])
    both = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(docs.where("doc_id <> 3")).collect()}
    assert all(both[r["doc_id"]] == r["fingerprint"] for r in got if r["doc_id"] in both)
    assert fingerprint.against_edits(docs.where("false")).count() == 0
    one = fingerprint.against_edits(docs.where("doc_id = 0")).first()
    assert one["near_next"] == 1


def test_compare_gives_removed_and_added_paragraphs(spark):
    pairs = spark.createDataFrame([(1, "a\nb\nc", "a\nc\nd"), (2, None, ""), (3, "x", "x\nx")], "doc_id long, old string, new string")
    got = {r["doc_id"]: r for r in fingerprint.compare(pairs, "old", "new").collect()}
    assert (len(got[1]["removed"]), len(got[1]["added"]), got[1]["likeness"]) == (1, 1, 0.5)
    assert (got[2]["removed"], got[2]["added"], got[2]["likeness"]) == ([], [], 1.0)
    assert (len(got[3]["removed"]), len(got[3]["added"])) == (0, 1)


KEEPS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def with_insertions(best):
    for _ in range(3):
        for q in list(best):
            to = "a" if q == "u" else "u"
            cost, audit, left = best[q]
            new = (cost + 5, audit + "I", [*left, ("user" if to == "u" else "assistant", "")])
            if to not in best or new[:2] < best[to][:2]:
                best[to] = new
    return best


def brute_repair(rows):
    seen, faults = set(), []
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("b" if not solid else "d" if (role, text) in seen else "" if solid[-1] in ".!?" else "t")
        seen.add((role, text))
    best = with_insertions({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}

        def put(q, found, new=new):
            if q not in new or found[:2] < new[q][:2]:
                new[q] = found

        for q, (cost, audit, left) in best.items():
            put(q, (cost + 2, audit + "D", left))
            if fault in ("", "t"):
                stay = 5 * (fault == "t")
                if (q, role[:1]) in KEEPS:
                    put(role[0], (cost + stay, audit + "K", [*left, (role, text)]))
                to = "assistant" if q == "u" else "user"
                put(to[0], (cost + stay + 1, audit + "R", [*left, (to, text)]))
        best = with_insertions(new)
    cost, audit, left = min((best[q] for q in ("", "a") if q in best), key=lambda x: x[:2])
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(rows, rows[1:], strict=False))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, left)


def by_conversation(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv].append((turn, " " if role is None else role, " " if text is None else text))
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def conversations(rnd, n):
    rows = []
    for c in range(n):
        for t in range(rnd.choice([0, 1, 2, 5, 9, 40])):
            role = rnd.choice(["user", "assistant", "system", "user", "assistant", "tool", "usr", None, ""])
            text = rnd.choice(["Yes.", "No!", "cut", " \t\n", "", None, "What? \n", "ends...", f"row {t}.", f"row {t}."])
            rows.append((None if c == 3 else c, rnd.choice([t, t, t, None, t - 1]), role, text))
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, conv string, kind int, part int").repartition(6)


@pytest.mark.parametrize("hold", [1 << 23, 20])
def test_repair_equals_brute_force(spark, hold):
    rnd = random.Random(6)
    rows = conversations(rnd, 60) + [(500, t // 3, rnd.choice(["user", "assistant"]), rnd.choice([f"{t}.", f"{t % 7}!", "cut"])) for t in range(900)]
    want = {c: brute_repair(r) for c, r in by_conversation(rows).items()}
    got = conversation.repair(table(spark, rows), hold=hold).collect()
    assert len(got) == len(want)
    for r in got:
        assert (*r[1:8], [tuple(x) for x in r["repaired"]]) == want[r["conv_id"]], r["conv_id"]
    assert conversation.repair(table(spark, rows).where("false")).count() == 0


def test_block_tables_equal_row_by_row_search():
    rnd, tables = random.Random(7), conversation.tables()
    names = {0: ("system", "."), 1: ("system", ""), 2: ("user", "."), 3: ("user", ""), 4: ("assistant", "."), 5: ("assistant", ""), 6: ("tool", "."), 7: ("tool", ""), 8: ("user", None)}
    for _ in range(1500):
        symbols = [rnd.randrange(9) for _ in range(rnd.randrange(23))]
        rows = [(k, names[s][0], " " if s == 8 else f"{k}{names[s][1]}") for k, s in enumerate(symbols)]
        cost, audit = tables.solve(bytes(symbols))
        assert (cost, audit) == brute_repair(rows)[5:7]
        at = rnd.randrange(len(symbols) + 1)
        (v, grow), (w, more) = tables.segment(bytes(symbols[at:])), tables.segment(bytes(symbols[:at]))
        assert grow[0] + more[v[0]] + tables.vectors[w[v[0]]][0] == cost


def test_damaged_conversations_equal_sql_and_brute_force(spark):
    rows = conversations(random.Random(8), 300)
    df = table(spark, rows)
    hurt = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        hurt += [] if code == 0 else [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    left = by_conversation(hurt)
    want = {c: brute_repair(left.get(c, [])) for c in {r[0] for r in rows}}
    want = {c: (*w[:7], hashlib.sha256("\n".join(f"{a}:{b}" for a, b in w[7]).encode()).hexdigest()) for c, w in want.items()}
    got = conversation.repair(conversation.damaged(df), digest=True)
    assert {r["conv_id"]: tuple(r)[1:] for r in got.collect()} == want
    con = duckdb.connect()
    con.register("conversations", df.toPandas())
    con.execute("CREATE TABLE t AS SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, text FROM conversations")
    sql = con.execute(conversation.oracle().replace("FROM conversations", "FROM t")).fetchall()
    assert {r[0]: r[1:] for r in sql} == want
    names = con.execute(conversation.oracle().replace("FROM conversations", "FROM t")).df().columns
    assert sorted(names) == sorted(got.columns)


def brute_collocations(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang or "und", tuple(words[i : i + k])] += 1
    f = {k: v for k, v in f.items() if v >= least}
    found = [k for k in f if len(k[1]) > 1]
    gone = {(lang, p[i : i + m]) for lang, p in found for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * f[lang, p] >= 100 * f[lang, p[i : i + m]]}
    ranked = defaultdict(list)
    for lang, p in found:
        if (lang, p) not in gone:
            cuts = [(int(Fraction(1000 * f[lang, p] * n[lang], f[lang, p[:k]] * f[lang, p[k:]])), k) for k in range(1, len(p))]
            score, k = min(cuts)
            ranked[lang].append((-score, -f[lang, p], " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return [(lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, rows in ranked.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]


def test_collocations_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(9)
    words = ["the", "of", "Été", "a", "b", "c", "d e", "x-y", "long" * 400, *(f"w{i}" for i in range(30))]
    text = lambda: "".join(rnd.choice(words[: rnd.choice([3, 9, 39])]) + rnd.choice(["  ", "\t", " ", " ", " ", ". ", "\n", ",", "\x0b"]) for _ in range(rnd.randrange(120)))
    rows = [(rnd.choice(["en", "de", None, "und"]), text()) for _ in range(300)] + [("en", None), ("en", ""), ("fr", "never twice here"), (None, "a a a a a a a"), ("en", "Stock phrase of five words")] + [("en", "stock phrase of five words")] * 40
    docs = spark.createDataFrame([(*r, "w1", 1) for r in rows], "lang string, text string, w1 string, n int").repartition(5)
    monkeypatch.setattr(collocation, "_SLICE", 100)
    for bits, top in ((20, 2000), (8, 30)):  # with few counters next to nothing is padded early
        got = [tuple(r) for r in collocation.collocations(docs, min_count=6, top=top, bits=bits).collect()]
        assert sorted(got) == sorted(brute_collocations(rows, 6, top))
    assert {r[0] for r in got} == {"en", "de", "und"}
    assert collocation.collocations(docs.where("false"), bits=10).count() == 0


def test_scores_beyond_64_bits_are_exact(spark):
    counts = spark.createDataFrame([("en", 0, "", 9 * 10**15), ("en", 1, "a", 3 * 10**12 + 1), ("en", 1, "b", 7 * 10**11 + 3), ("en", 2, "a b", 5 * 10**11 + 7)], "lang string, k int, phrase string, f long")
    held, collocation.phrase_counts = collocation.phrase_counts, lambda *_: counts
    try:
        row = collocation.collocations(counts.withColumn("text", F.lit(""))).first()
    finally:
        collocation.phrase_counts = held
    assert row["score"] == 1000 * (5 * 10**11 + 7) * 9 * 10**15 // ((3 * 10**12 + 1) * (7 * 10**11 + 3))
    assert np.iinfo(np.int64).max < (5 * 10**11 + 7) * 9 * 10**15
