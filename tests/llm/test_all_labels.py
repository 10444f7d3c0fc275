"""The ratio model and its threshold are fitted on every labelled row."""

import math

import pytest

from barloom.llm import likelihood


def test_every_label_is_known(spark):
    n = 200_500
    labels = spark.range(n).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality", "cast(id % 3 = 0 AS int) AS toxic")
    known = likelihood.known_labels(labels, "doc_id", "quality", "toxic").selectExpr("count(*)", "sum(__good)", "count_if(__trusted)").first()
    assert tuple(known) == (n, n // 2, sum(i % 2 == 1 and i % 3 != 0 for i in range(n)))


def test_scores_follow_from_all_rows_and_labels(spark):
    texts = [" ".join(f"w{(i * 5 + j * (1 + i % 3)) % 23}" for j in range(4 + i % 5)) for i in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), (None, "w1 w2 w3"), (7, None), (8, "w9 w9")], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([*((i, i % 2, int(i % 10 == 1)) for i in range(40)), (7, 0, 0), (None, 1, 0), (9, None, 0), (10, 1, 1)], "doc_id long, quality int, toxic int")
    rows = likelihood.with_words(docs.select("doc_id", docs.text.alias("__text"))).select("doc_id", "__text", "__hashes").collect()
    pair = {r["k"]: r["h"] for r in spark.createDataFrame(
        [(f"{r['doc_id']} {r['__text']} {i}", a, b) for r in rows for i, (a, b) in enumerate(zip(r["__hashes"], r["__hashes"][1:]))], "k string, a long, b long").selectExpr("k", "xxhash64(a, b) AS h").collect()}
    grams = [(r["doc_id"], [*r["__hashes"], *(pair[f"{r['doc_id']} {r['__text']} {i}"] for i in range(len(r["__hashes"]) - 1))]) for r in rows]
    # 7 is bad by one of its labels, 9 has its number's, 10 stays bad
    trusted = {i for i in range(40) if i % 2 and i % 10 != 1} - {7}
    raw, good = [0] * likelihood.BUCKETS, [0] * likelihood.BUCKETS
    for doc, hs in grams:
        for h in hs:
            raw[h % likelihood.BUCKETS] += 1
            good[h % likelihood.BUCKETS] += doc in trusted
    smooth = 0.5 * likelihood.BUCKETS
    ratio = [math.log((g + 0.5) / (sum(good) + smooth)) - math.log((r + 0.5) / (sum(raw) + smooth)) for g, r in zip(good, raw)]
    want = sorted((str(doc), sum(ratio[h % likelihood.BUCKETS] for h in hs) / len(hs) if hs else 0.0) for doc, hs in grams)
    got = sorted((str(r["doc_id"]), r["score"]) for r in likelihood.quality_rules(docs, labels).collect())
    assert [d for d, _ in got] == [d for d, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-9)


def test_the_map_of_ids_loses_none(spark):
    ids = spark.range(0, 4000, 3).withColumnRenamed("id", "__id")
    rows = spark.range(-2000, 6000).withColumnRenamed("id", "doc_id").union(spark.sql("SELECT cast(null AS bigint)"))
    found = {r["doc_id"] for r in likelihood.perhaps_in(rows, ids).collect()}
    assert found >= set(range(0, 4000, 3)) and len(found) < 1400
