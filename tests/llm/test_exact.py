"""Exact groups against a plain reading."""

import hashlib
from collections import defaultdict
from string import ascii_lowercase, ascii_uppercase

import pytest
from odd import odd_docs

from barloom.llm import exact

LOWER = str.maketrans(ascii_uppercase, ascii_lowercase)


def plain(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[(text or "").translate(LOWER)].append(doc)
    out = []
    for text, ids in groups.items():
        ranked = sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True)
        out += [(i, ranked[0], len(ids), at == 0, hashlib.sha256(text.encode()).hexdigest()) for at, i in enumerate(ranked)]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


@pytest.mark.parametrize("share", [0.001, 0.2, 1.0])
def test_equals_plain_reading_with_and_without_heavy_groups(spark, rnd, share):
    rows = [(i, "HOT text" if i % 3 == 0 else "Ünï ÀB" if i % 7 == 0 else f"Text {rnd.randrange(60)}") for i in range(400)]
    rows += [(None, "hot TEXT"), (None, "alone"), (5, None), (6, ""), (396, "Hot Text"), (399, "hot text"), (399, "hot text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert found(exact.exact_groups(docs, share=share)) == plain(rows)


def test_heavy_digests_are_exact_and_all_named(spark):
    rows = [(i, f"{i % 2 and 'a' or i % 5}") for i in range(1000)]
    place = spark.createDataFrame(rows, "n long, digest string").selectExpr("struct(n) AS place", "cast(digest AS binary) AS digest").repartition(9)
    got = {bytes(r["digest"]): (r["first"]["n"], r["group_size"]) for r in exact.heavy_digests(place, 0.3).collect()}
    assert got == {b"a": (999, 500)}
    assert exact.heavy_digests(place.limit(0), 0.3).count() == 0


def test_odd_rows(spark):
    docs = odd_docs(spark).selectExpr("*", "text AS digest", "lang AS place", "lang AS first", "lang AS group_size")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(exact.exact_groups(docs)) == plain(rows)
    kept = exact.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({(t or "").translate(LOWER) for _, t in rows})
    assert exact.exact_groups(docs.limit(0)).count() == 0 == exact.keep_one(docs.limit(0)).count()


def test_long_text_and_lower_casing_of_other_scripts(spark):
    rows = [(1, "AbC " * 200_000), (2, "abc " * 200_000), (3, "İÀ"), (4, "i̇à"), (5, "İà"), (6, "K"), (7, "k")]
    assert found(exact.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)
