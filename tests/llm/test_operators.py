"""Every operator against a plain reading, on odd rows and on the small tables."""

import base64
import gzip
import hashlib
import os
import struct
import sys
import zlib
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus_brute as brute  # noqa: E402
from odd import ODD, odd_docs  # noqa: E402

from barloom.llm import decontaminate, likelihood, packing, queries, shards, simhash, site_lines, suffixes, token_prefixes, units, warc  # noqa: E402

SF_DIR = os.environ.get("BARLOOM_TEST_DIR", "/root/testdata/sf0.001")
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def texts(spark):
    """Texts of the small table by doc_id."""
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}


@pytest.fixture
def odd(spark):
    return odd_docs(spark)


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_units_keep_the_earliest(spark):
    docs = spark.createDataFrame([(2, "One  TWO three\nother line"), (1, "x\none two three"), (3, None), (4, "One two three\none two three"), (None, "one two three")], "doc_id long, text string")
    got = {(r["doc_id"], r["start"], r["kept_doc_id"], r["kept_start"]) for r in units.repeated_units(docs, min_words=2).collect()}
    assert got == {(2, 0, 1, 2), (4, 0, 1, 2), (4, 14, 1, 2), (None, 0, 1, 2)}
    kept = {r["doc_id"]: r["kept_text"] for r in units.drop_repeated_units(docs, min_words=2).collect()}
    assert kept == {2: "\nother line", 1: "x\none two three", 3: None, 4: "\n", None: ""}


def plain_repeats(rows, unit, least):
    """Later occurrences of units that lie in a passage of repeated ones, and all units of repeated rows."""
    first, want, seen = {}, [], set()
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        found, again = [], (doc, text) in seen
        seen.add((doc, text))
        for a, b in units.unit_spans(text or "", unit):
            plain = units.normalised((text or "")[a:b])
            if plain:
                found.append((a, b, len(plain.split()), first.setdefault(plain, (doc, a))))
        gone = [i for i, (a, _, _, at) in enumerate(found) if again or at != (doc, a)]
        strong = set()
        for i in gone:
            run = [i]
            while run[-1] + 1 in gone and found[run[-1] + 1][3][0] == found[i][3][0]:
                run.append(run[-1] + 1)
            if sum(found[j][2] for j in run) >= least:
                strong |= set(run)
        for step in (1, -1):
            for i in gone[::step]:
                if i - step in strong:
                    strong.add(i)
        want += [(doc, found[i][0], found[i][1], *found[i][3]) for i in gone if again or i in strong]
    return sorted(want, key=str)


def found_repeats(df):
    return sorted(((r["doc_id"], r["start"], r["end"], r["kept_doc_id"], r["kept_start"]) for r in df.collect()), key=str)


def test_units_equal_plain_loop(spark, texts):
    got = sorted(((r["doc_id"], r["unit_start"], r["unit_end"], r["kept_doc_id"], r["kept_start"]) for r in queries.op1(spark, SF_DIR).collect()), key=str)
    assert got == plain_repeats(list(texts.items()), "sentence", 8) and got


def test_short_units_go_with_their_passage(spark):
    rows = [(1, "a b c. d e. f g h. i j k l m n o p. q."), (2, "d e. f g h. i x."), (3, "new. d e. f g h. i j k l m n o p. q. z."), (4, "q. z. d e."), (5, None), (3, "new. d e. f g h. i j k l m n o p. q. z."), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text AS k1", "text AS copy", "doc_id AS at")
    for unit, least in (("sentence", 8), ("sentence", 5), ("sentence", 1), ("line", 1), ("paragraph", 3)):
        assert found_repeats(units.repeated_units(docs, unit=unit, min_words=least)) == plain_repeats(rows, unit, least), (unit, least)
    kept = sorted((r["doc_id"], r["kept_text"]) for r in units.drop_repeated_units(docs, unit="sentence", min_words=8).where("doc_id = 3").collect())
    # one of the two equal rows keeps what is its own, the other nothing
    assert [k.split() for _, k in kept] == [[], ["new.", "z."]]


def test_site_lines_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    cur = con.execute(queries.ORACLES["op2_site_lines"])
    cols = [c[0] for c in cur.description]
    assert {tuple(r[c] for c in cols) for r in queries.op2(spark, SF_DIR).collect()} == set(cur.fetchall())


def test_site_lines_near_the_threshold(spark):
    rows = [(i, f"on ten sites here\nonly {i} own line\n on nine sites here" if i < 9 else "on ten sites here", f"s{i}") for i in range(10)]
    rows += [(10 + i, "many times one site", "s0") for i in range(30)]
    cut = by_id(site_lines.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), sites=10))
    assert [cut[i]["n_removed"] for i in range(11)] == [0] + [1] * 9 + [0]
    assert cut[1]["kept_text"] == "only 1 own line\n on nine sites here" and cut[9]["kept_text"] == ""


def test_token_prefixes_equal_library(spark, texts, odd):
    library = Tokenizer.from_file(BYTE)
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    got = by_id(token_prefixes.token_prefixes(spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string"), vocabulary=BYTE))
    for i, t in enumerate(ODD):
        table, t = got[i]["prefix_tokens"], t or ""
        assert len(table) == len(t) + 1 and got[i]["n_tokens"] == table[-1] == count(t)
        assert [table[n] for n in range(min(len(t), 60) + 1)] == [count(t[:n]) for n in range(min(len(t), 60) + 1)]
    for r in queries.op3(spark, SF_DIR).collect():
        t = texts[r["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((t or "").encode()), count(t), count(t) > 512)
    assert token_prefixes.token_prefixes(odd, vocabulary=BYTE).count() == odd.count()


def test_decontamination_equals_all_windows(spark):
    item = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix some rare jade potions for the old king"
    near = item.replace("jade", "red")
    rows = [(1, f"before it all, {item.upper()}! and after"), (2, near + " and more words follow here"), (3, "nothing in common with any item at all"), (4, None), (5, ""), (None, item), (6, item[: len(item) // 2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, None), (9, ""), (None, "gone"), (7, item)], "item_id long, text string")

    def grams(w):
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    def plain(t):
        return decontaminate.plain_words((t or "").encode())

    want = {}
    for doc, t in rows:
        w, n, best = plain(t), len(plain(item)), 0.0
        for i in range(max(len(w) - n + 1, 1)):
            a, b = grams(w[i : i + n]), grams(plain(item))
            best = max(best, sum((a & b).values()) / sum((a | b).values()))
        want[doc] = round(best, 9) if best >= 0.8 else None
    got = {r["doc_id"]: round(r["leaks"][0]["similarity"], 9) if r["leaks"] else None for r in decontaminate.find_leaks(docs, items, items_per_pass=1).collect()}
    assert got == want and got[1] == 1.0 and got[3] is None
    assert all(not r["leaks"] for r in decontaminate.find_leaks(docs, items.limit(0)).collect())


def test_base_rules_equal_plain_loop(spark, texts):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for r in queries.op5(spark, SF_DIR).collect():
        assert tuple(r[c] for c in names) == brute.base(texts[r["doc_id"]]), r["doc_id"]
        assert r["kept"] == (not r["base_failed"] and r["score"] >= r["threshold"])


def test_likelihood_rejects_other_text_and_takes_odd_rows(spark, odd):
    good = [" ".join(f"plain{(i + j * 7) % 40}" for j in range(30)) for i in range(20)]
    bad = [" ".join(f"noise{(i + j * 11) % 40}" for j in range(30)) for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 20), 0) for i in (*range(10), *range(20, 30))], "doc_id long, quality int, toxic int")
    verdicts = likelihood.quality_rules(docs, labels)
    assert {r["doc_id"] for r in likelihood.kept_rows(verdicts).collect()} == set(range(20))
    out = likelihood.quality_rules(odd, labels.limit(0))
    assert out.count() == odd.count() and likelihood.kept_rows(out).columns == odd.columns


@pytest.mark.parametrize("n", [0, 5, 1000])
def test_shards_are_contiguous_and_equal(spark, n):
    docs = spark.createDataFrame([(i % 7 if i % 3 else None, "é" * (i % 40) if i % 11 else None) for i in range(n)], "doc_id long, text string").repartition(5)
    rows = shards.byte_shards(docs, shards=8).collect()
    held = defaultdict(list)
    for r in rows:
        held[r["shard"]].append(r)
    assert len(rows) == n and all(sorted(r["slot"] for r in s) == list(range(len(s))) for s in held.values())
    at = 0
    for r in sorted(rows, key=lambda r: (r["shard"], r["slot"])):
        assert r["bytes_before"] == at
        at += r["size"]
    if n == 1000:
        bytes_ = [sum(r["size"] for r in s) for s in held.values()]
        assert len(held) == 8 and max(bytes_) - min(bytes_) <= 2 * max(r["size"] for r in rows)


def test_shards_of_documents(spark, texts):
    for r in queries.op6(spark, SF_DIR).collect():
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "bytes", None)


def test_simhash_equals_all_pairs(spark, texts):
    got, ids = by_id(queries.op7(spark, SF_DIR)), sorted(texts)
    prints = [brute.simhash(texts[i]) for i in ids]
    roots, least = brute.linked(prints, 3), {}
    for i, r in zip(ids, roots):
        least[r] = min(i, least.get(r, i))
    assert {i: (g["fingerprint"], g["component_id"]) for i, g in got.items()} == {i: (f"{p:016x}", least[r]) for i, p, r in zip(ids, prints, roots)}


@pytest.mark.parametrize("radius,segments,block", [(3, 8, 4096), (3, 8, 16), (5, 16, 32)])
def test_pigeonring_loses_no_link(spark, rnd, radius, segments, block):
    values = set()
    for _ in range(30):
        x = rnd.getrandbits(64)
        for _ in range(8):
            values.add(x)
            for b in rnd.sample(range(64), rnd.randint(1, radius + 2)):
                x ^= 1 << b
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    table = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = simhash.links(table, radius=radius, segments=segments, block=block).collect()
    place, parts = {v: i for i, v in enumerate(signed)}, list(range(len(values)))
    for r in found:
        assert bin((r["a"] ^ r["b"]) & (1 << 64) - 1).count("1") <= radius
        old, new = parts[place[r["a"]]], parts[place[r["b"]]]
        parts = [new if p == old else p for p in parts]
    want = brute.linked(values, radius)
    assert len(set(zip(parts, want))) == len(set(parts)) == len(set(want))


def test_simhash_keeps_one_of_each_group(spark, odd):
    kept = simhash.keep_one(odd).collect()
    assert len({brute.simhash(r["text"]) for r in kept}) == len(kept) and kept[0].asDict().keys() == set(odd.columns)
    assert simhash.keep_one(odd.limit(0)).count() == 0


def test_packing_round_trip(spark, texts, odd):
    library = Tokenizer.from_file(WORD)
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts.items()}
    rows = queries.op8(spark, SF_DIR).collect()
    pieces, sequences = defaultdict(dict), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]][r["piece"]] = r
        sequences[r["sequence_id"]].append(r)
    assert pieces.keys() == ids.keys()
    for i, want in ids.items():
        assert len(pieces[i]) == -(-len(want) // 4096)
        for n, r in pieces[i].items():
            part = want[4096 * n : 4096 * (n + 1)]
            assert (r["start"], r["length"], r["ids_crc32"]) == (4096 * n, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
    for held in sequences.values():
        at = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    assert len(sequences) <= -(-sum(map(len, ids.values())) // 4096) * 1.02 + 1
    assert packing.pack(odd, vocabulary=WORD).select("doc_id", "piece").count() >= odd.count()
    assert packing.pack(odd.limit(0), vocabulary=WORD).count() == 0


def test_plan_uses_every_piece_once(rnd):
    histogram = Counter(rnd.choice([1, 7, 30, 33, 50, 64, 99, 100]) for _ in range(3000))
    used = Counter()
    for config, n in packing.plan(histogram, 100):
        assert sum(config) <= 100 and n > 0
        for m in config:
            used[m] += n
    assert used == histogram


def _b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_warc_equals_pages(spark):
    pages, largest = {}, {}
    for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect():
        pages[r["page_id"]] = (r["html"] or "").encode()
        largest[pages[r["page_id"]]] = max(r["page_id"], largest.get(pages[r["page_id"]], r["page_id"]))
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in queries.op9(spark, SF_DIR).collect()}
    assert got == {i: (len(p), _b32(p), "response", None) if largest[p] == i else (len(p), _b32(p), "revisit", largest[p]) for i, p in pages.items()}


@pytest.mark.parametrize("packed", [False, True])
def test_warc_salvage(spark, tmp_path, packed):
    pages = spark.createDataFrame([(1, "http://a", "one"), (2, None, None), (3, "http://c d", "three\r\n\r\n3"), (None, "u", "x"), (4, "http://a", "one")], "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write_archives(pages, path)
    records = [b"\r\n\r\n".join([r["payload"] or b"", r["type"].encode()]) for r in warc.read_archives(spark, path).where("kind = 'record'").collect()]
    assert len(records) == 5 and sum(r.endswith(b"revisit") for r in records) == 1
    parts = []
    for file in sorted(os.listdir(path)):
        if file.startswith("part-"):
            data = open(f"{path}/{file}", "rb").read()
            parts += [data[a : a + n] for _, a, n, _, _ in warc.salvage(data)]
    broken = [p[:-20] + b"!" + p[-19:] if i == 1 else p for i, p in enumerate(parts)]
    data = b"".join(map(gzip.compress, broken)) if packed else b"".join(broken)
    found = list(warc.salvage(b"junk" + data + b"WARC/1.1\r\ncut"))
    assert [k for k, *_ in found] == ["gap", "record", "gap", "record", "record", "record", "gap"]
    assert sum(n for _, _, n, _, _ in found) == len(data) + 17


def test_warc_salvage_inside_a_member(spark, tmp_path):
    path = str(tmp_path / "w")
    pages = spark.createDataFrame([(i, "u", f"page {i} " + hashlib.sha256(str(i).encode()).hexdigest() * 40) for i in range(60)], "page_id long, url string, html string")
    warc.write_archives(pages.coalesce(1), path, compression="gzip", file_bytes=1 << 30)
    assert warc.read_archives(spark, path).where("kind = 'record'").count() == 60
    name = max((f for f in os.listdir(path) if f.startswith("part-")), key=lambda f: os.path.getsize(f"{path}/{f}"))
    data = open(f"{path}/{name}", "rb").read()
    whole = list(warc.salvage(data))
    plain = gzip.decompress(data)
    # a byte of one record is changed before packing: only that record goes
    at = plain.index(b"page ", len(plain) // 3)
    bad = list(warc.salvage(gzip.compress(plain[:at] + b"P" + plain[at + 1 :])))
    assert [k for k, *_ in bad].count("record") == len(whole) - 1 and [k for k, *_ in bad].count("gap") == 1
    # a cut member keeps its first records, the rest is a gap, and the next member is found
    found = list(warc.salvage(data[: len(data) // 2] + gzip.compress(plain)))
    n = [k for k, *_ in found].count("record")
    assert len(whole) <= n < 2 * len(whole) and [k for k, *_ in found].count("gap") == 1
    assert sum(length for k, _, length, _, _ in found if k == "gap") == len(data) // 2


def test_suffixes_equal_all_windows(spark, texts):
    got, ids = by_id(queries.op10(spark, SF_DIR)), sorted(texts)
    want = dict(zip(ids, brute.removed([texts[i] for i in ids], 200)))
    assert {i: (g["n_bytes"], g["n_removed"], g["n_spans"], g["kept_sha256"]) for i, g in got.items()} == want


def test_suffixes_on_random_and_odd_texts(spark, rnd):
    words = ["".join(rnd.choice("ab é") for _ in range(rnd.randint(5, 60))) for _ in range(40)]
    texts = ["".join(rnd.choices(words, k=rnd.randint(0, 12))) for _ in range(80)] + ODD[:9] + ["x" * 700] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(suffixes.remove_repeats(docs, length=40, gram=16))
    assert [tuple(got[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for i in range(len(texts))] == brute.removed(texts, 40)


def test_odd_rows_and_empty_tables(spark, odd):
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    for run in (units.drop_repeated_units, site_lines.drop_boilerplate, suffixes.remove_repeats, simhash.simhash_components, shards.byte_shards, lambda d: decontaminate.find_leaks(d, items)):
        assert run(odd).count() == odd.count()
        assert run(odd.limit(0)).count() == 0


def test_stages_feed_each_other(spark):
    import corpus_pipeline

    assert len(corpus_pipeline.STAGES) == 5
    ids = {r[0] for r in corpus_pipeline.run(spark, SF_DIR).select("doc_id").distinct().collect()}
    assert ids and ids <= {r[0] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id").collect()}
