"""Null ids, repeated rows, very long texts and empty tables, operator by operator."""

import random

import public_tokenizers
import pytest

from canopy.llm import byte_bpe, hmm, jaccard, near_vectors, packing, sharding, toxicity, url_filter


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(11)
    words = lambda n: " ".join(f"w{rnd.randrange(50)}" for _ in range(n))
    rows = [(i, words(rnd.randrange(30))) for i in range(40)] + [(None, "a text without an id."), (7, "a text without an id."), (7, "a text without an id."), (None, None), (8, "")]
    return spark.createDataFrame([(*r, "node", 1) for r in rows], "doc_id long, text string, node string, n int").repartition(3)


def test_null_ids_are_rows_like_others(spark, docs):
    tokens = [(r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()]
    assert len(tokens) == 45
    own = [t[1:] for t in tokens if t[0] is None and t[1]]
    assert len(own) == 1 and sum(t[1:] == own[0] for t in tokens) == 3
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sum(p["length"] for p in pieces if p["doc_id"] is None) == sum({(p["doc_tokens"]) for p in pieces if p["doc_id"] is None})
    scored = hmm.score(docs).collect()
    mine = [r for r in scored if r["doc_id"] is None and r["n_tokens"] == 6]
    alike = [r for r in scored if r["n_tokens"] == 6 and r["base_score"] == pytest.approx(mine[0]["base_score"])]
    assert len(scored) == 45 and len(mine) == 1 and len(alike) >= 3 and all(r["score"] == pytest.approx(mine[0]["score"]) for r in alike)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(40)], "doc_id long, toxic int")
    toxic = toxicity.score_documents(docs, labels).collect()
    assert len(toxic) == 45 and all(0 <= r["score"] <= 1 for r in toxic)


def test_sets_of_very_long_and_repeated_texts(spark):
    rnd = random.Random(12)
    long = " ".join(f"w{rnd.randrange(5000)}" for _ in range(120_000))
    rows = [(5, long), (3, long.replace("w17 ", "v17 ")), (9, long), (9, long), (None, long), (1, "other words than those of the long one"), (None, None)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, component_id string").repartition(3)
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"], r["n_shingles"] > 100_000) for r in jaccard.near_sets(df).collect()), key=repr)
    assert [g for g in got if g[3]] == sorted([(False, i, 3, True) for i in (3, 5, 9, 9)] + [(True, 0, 3, True)], key=repr)
    assert (False, 1, 1, False) in got and len(got) == 7


def test_urls_of_null_pages_and_repeated_rows(spark):
    rows = [(None, "http://example.org/es/a"), (1, "http://x.org/"), (1, "http://x.org/"), (None, None)]
    got = [tuple(r) for r in url_filter.judge(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, verdict int")).collect()]
    assert len(got) == 4 and got.count((1, "x.org", "/", "org/", "allow")) == 2
    assert (None, "example.org", "/es/a", "example.org/es/", "block") in got and (None, "", "", None, "allow") in got


def test_sharding_of_nothing(spark, docs):
    assert sharding.shard(docs.where("false"), "doc_id").count() == 0


def test_vectors_of_several_lengths_and_null_ids_in_one_label(spark):
    rnd = random.Random(13)
    rows = [(k, [rnd.gauss(0, 1) for _ in range(8 + 8 * (k % 2))], 1) for k in range(300)]
    rows += [(1000, rows[0][1], 1), (None, rows[2][1], 1), (1001, rows[1][1][:8], 1), (None, [1.0] * 3, 1)]
    df = spark.createDataFrame([(*r, "g") for r in rows], "vec_id long, embedding array<double>, label int, g string").repartition(4)
    got = near_vectors.near_vectors(df).collect()
    by = {r["vec_id"]: r for r in got if r["vec_id"] is not None}
    assert len(got) == 304 and (by[1000]["n_links"], by[1000]["component_id"], by[1000]["kept"]) == (1, 0, False)
    assert (by[2]["n_links"], by[2]["component_id"]) == (1, 2) and by[1]["n_links"] == 0
    nulls = sorted((r["n_links"], r["component_id"] is None) for r in got if r["vec_id"] is None)
    assert nulls == [(0, True), (1, False)]
