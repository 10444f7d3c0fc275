"""The manifest against a plain reading of the tree."""

import hashlib
import os
import zlib
from collections import defaultdict
from string import ascii_lowercase, ascii_uppercase

import pytest
from odd import odd_docs
from pyspark.sql import functions as F

from barloom.llm import exact, merkle, queries

SF_DIR = os.environ.get("BARLOOM_TEST_DIR", "/root/testdata/sf0.001")
LOWER = str.maketrans(ascii_uppercase, ascii_lowercase)
NAMES = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    """The root and, for every node, its siblings and positions."""
    ways = [[] for _ in nodes]
    level = [(n, [i]) for i, n in enumerate(nodes)]
    while len(level) > 1:
        above = []
        for i in range(0, len(level), 8):
            run = level[i : i + 8]
            for pos, (_, below) in enumerate(run):
                for j in below:
                    ways[j].append((pos, [n for n, _ in run]))
            above.append((sha(*[n for n, _ in run]), [j for _, below in run for j in below]))
        level = above
    return level[0][0], ways


def up(node, way):
    for pos, run in way:
        node = sha(*run[:pos], node, *run[pos + 1 :])
    return node


def plain(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r, leaf(r)))
    order = sorted(groups, key=lambda v: (v is not None, (v or "").encode()))
    built = {}
    for v in order:
        groups[v].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        built[v] = tree([x[1] for x in groups[v]])
    root, above = tree([built[v][0] for v in order]) if order else (None, [])
    out = []
    for v, high in zip(order, above):
        for (r, true), low in zip(groups[v], built[v][1]):
            way = low + high
            told = true
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                told = leaf([*r[:4], r[4] and r[4].translate(LOWER)])
            proof = sha(*[n for pos, run in way for n in run[:pos] + run[pos + 1 :]])
            folded = up(told, way)
            out.append((r[0], true, built[v][0], root, proof, folded, folded == root))
    return sorted(out, key=str)


def found(spark, docs, **how):
    third = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    got = merkle.manifest(docs, fields=NAMES, group="lang", claimed={"text": exact.ascii_lower(F.col("text"))}, when=third, **how)
    return sorted((tuple(r[c] for c in ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]) for r in got.collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")


@pytest.mark.parametrize("sizes, takers", [([1], 4096), ([8, 9, 1], 4096), ([64, 65, 0, 513, 1, 8, 7, 3, 70, 2], 4096), ([600, 1, 1], 2)])
def test_blocks_of_eight_leaves_equal_the_whole_tree(spark, monkeypatch, sizes, takers):
    monkeypatch.setattr(merkle, "TAKERS", takers)
    langs = [None, "de", "en", "zz", "é", "日", "aa", "ab", "ac", "ad"]
    rows = [(1000 * g + i, f"s{i % 3}", langs[g], i, f"Text {i}" if i % 4 else None) for g, n in enumerate(sizes) for i in range(n)]
    assert found(spark, table(spark, rows).repartition(5), height=1) == plain(rows)


def test_query_equals_plain_reading(spark):
    rows = [tuple(r[c] for c in NAMES) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    got = sorted((tuple(r[c] for c in ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]) for r in queries.op12(spark, SF_DIR).collect()), key=str)
    assert got == plain(rows)
    assert {r[-1] for r in got} == {True, False}


def test_odd_rows(spark):
    docs = odd_docs(spark).withColumn("n_chars", F.length("text").cast("long")).selectExpr("*", "fp AS tree", "fp AS block", "fp AS value", "fp AS root", "fp AS tie")
    rows = [tuple(r[c] for c in NAMES) for r in docs.collect()]
    assert found(spark, docs) == plain(rows)
    assert found(spark, docs, height=1) == plain(rows)
    assert found(spark, docs.limit(0)) == []


def test_proofs_fold_to_the_root(spark):
    rows = [(i, "s", "en" if i % 3 else "de", i, f"t{i}") for i in range(90)]
    got = merkle.manifest(table(spark, rows), fields=["doc_id", "text"], proofs=True, height=1).collect()
    assert len(got) == 90 and len({r["root"] for r in got}) == 1
    for r in got:
        node = r["leaf"]
        for s in r["proof"]:
            node = sha(*s["nodes"][: s["pos"]], node, *s["nodes"][s["pos"] :])
        assert node == r["root"] and r["verified"]
