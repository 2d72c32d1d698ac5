import random
from collections import Counter, defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from canopy.llm import queries, toxicity
from tests.llm.test_text_operators import brute_components, brute_sets, edit_distance, naive_score

BLANKS = " \t\r\v\f"


def test_all_thirteen_are_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 14)]


def brute_lines(rows):
    """Texts without lines equal to an earlier one, or within two edits of it (one below 20 letters, none below 10)."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    lines = [(i, k, x.strip(BLANKS)) for i in order for k, x in enumerate((rows[i][1] or "").split("\n")) if x.strip(BLANKS)]
    kinds = list(dict.fromkeys(x for _, _, x in lines))
    root = {x: x for x in kinds}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in enumerate(kinds):
        for y in kinds[:a]:
            edits = min(2, min(len(x), len(y)) // 10)
            if abs(len(x) - len(y)) <= edits and edit_distance(x, y) <= edits:
                root[find(x)] = find(y)
    first, gone = {}, defaultdict(set)
    for i, k, x in lines:
        where = first.setdefault(find(x), (rows[i], k))
        if where != (rows[i], k):  # repeated rows are one document
            gone[i].add(k)
    return [(r[0], r[1] if r[1] is None or not gone[i] else "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in gone[i])) for i, r in enumerate(rows)]


def brute_copies(rows):
    sets = {i: brute_sets(t) for i, (_, t) in enumerate(rows)}
    root = brute_components(sets)
    groups = defaultdict(list)
    for i, c in root.items():
        groups[c if sets[i] else ("empty", i)].append(i)
    return [min((rows[i] for i in g), key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def test_pipeline_equals_brute_force_stages(spark, tmp_path):
    rnd = random.Random(3)
    sentence = lambda n: " ".join(f"w{rnd.randrange(3000)}" for _ in range(n))
    texts = [f"{sentence(30)}\n{sentence(25)}" for _ in range(60)]
    texts += [t.replace("w1", "v1", 1) for t in texts[:8]] + texts[8:12]  # near and exact copies
    texts += [f"{sentence(12)}\nThis very line stands in many of the documents {k % 3}\n{sentence(12)}" for k in range(12)]
    texts += [f"{sentence(9)} scoundrel {sentence(5)} Scoundrel {sentence(4)}" for _ in range(20)] + [None, "", "\n \n", "x" * 5000, "one word"]
    rows = list(enumerate(texts)) + [(None, sentence(40)), (None, sentence(40)), (5, sentence(35)), (5, texts[5]), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "more") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, node string")
    labels = spark.createDataFrame([(i, 1, int("scoundrel" in (t or ""))) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    model = toxicity.learn(toxicity.training_rows(docs, labels, "doc_id", "text", "toxic"))
    want = [r for r in rows if naive_score(model, r[1]) < 0.7]
    assert 0 < len(want) < len(rows)
    stages, at = dict(corpus_pipeline.STAGES), docs
    for name, twin in (("toxicity", lambda r: want), ("line dedup", brute_lines), ("n-gram Jaccard join", brute_copies)):
        want = twin(want)
        at = stages[name](spark, at, str(tmp_path))
        assert at.columns == docs.columns, name
        got = [(r["doc_id"], r["text"]) for r in at.collect()]
        assert Counter(got) == Counter(want), name
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = defaultdict(list)
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[p["doc_id"], p["doc_tokens"]].append((p["start"], p["length"], p["ids"]))
    ids = defaultdict(list)
    for i, t in want:
        own = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        ids[i, len(own)].append(own)
    assert set(pieces) == set(ids)
    for key, found in pieces.items():
        assert sum(n for _, n, _ in found) == sum(map(len, ids[key]))
        assert Counter(x for _, _, part in found for x in part) == Counter(x for own in ids[key] for x in own)
        if len(ids[key]) == 1:
            assert [x for _, _, part in sorted(found) for x in part] == ids[key][0]


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
