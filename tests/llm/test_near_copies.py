"""The pipeline's near-duplicate stage against all pairs."""

import corpus_pipeline
import numpy as np

from barloom.llm import near_copies, simhash


def words(rnd, n):
    return [f"w{rnd.randrange(100_000)}" for _ in range(n)]


def grams(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def similar(a, b):
    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


def kept_by_all_pairs(texts):
    part = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if similar(texts[i], texts[j]) >= 0.8:
                part = [part[j] if p == part[i] else p for p in part]
    return {part.index(p) for p in part}


def distance(a, b):
    return bin((simhash.fingerprint(a.encode(), 1, True) ^ simhash.fingerprint(b.encode(), 1, True)) & (1 << 64) - 1).count("1")


def test_near_copies_are_those_of_five_word_similarity(spark, rnd):
    texts = []
    for i in range(30):
        base = words(rnd, 200)
        texts.append(" ".join(base))
        # a longer copy: similarity 0.8 or more, fingerprints of words often more than five bits away
        texts.append(" ".join(base + words(rnd, 20 + i)))
        # the same words in another order of blocks: few bits away, but no copy
        parts = [base[k : k + 4] for k in range(0, 200, 4)]
        rnd.shuffle(parts)
        texts.append(" ".join(sum(parts, [])))
    assert any(distance(a, b) > 5 and similar(a, b) >= 0.8 for a, b in zip(texts[::3], texts[1::3]))
    assert any(distance(a, b) <= 5 and similar(a, b) < 0.8 for a, b in zip(texts[::3], texts[2::3]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == kept_by_all_pairs(texts)


def test_near_copies_of_odd_rows(spark):
    rows = [(0, None), (1, ""), (2, " \n"), (3, "a b"), (4, "A  b"), (None, "a b"), (5, "a c"), (5, "a c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_copies.keep_one(docs).collect()) == [0, 3, 5]
    assert near_copies.keep_one(docs.limit(0)).count() == 0


def test_blocks_lose_no_link(spark, rnd):
    base = words(rnd, 100)
    texts = [" ".join(base[k : k + 60]) for k in range(0, 41, 4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [near_copies.shingle_set(t.encode(), 5) for t in texts]
    for sides in (None, np.arange(len(sets)) % 2 == 0):
        part = list(range(len(sets)))
        for a, b in near_copies.confirmed(sets, sides, 0.8):
            assert similar(texts[a], texts[b]) >= 0.8
            part = [part[a] if p == part[b] else p for p in part]
        assert len(set(part)) == 1
    facts = near_copies._facts(docs, "doc_id", "text", 5).selectExpr("sid", "fp", "n", "bands", "struct(false as none, doc_id, __k1, __k2) as first")
    root = facts.selectExpr("sid as node", "1L as root")
    found = near_copies.confirmed_links(docs, facts, root, shingle=5, least=0.8, shingles=150).collect()
    assert len({r["a"] for r in found} | {r["b"] for r in found}) == len(texts)
