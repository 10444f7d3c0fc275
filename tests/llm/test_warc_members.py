"""Archives with one gzip member per record."""

import gzip
import hashlib
import os

from odd import odd_docs
from pyspark.sql import functions as F

from barloom.llm import queries, warc


def written(spark, path, **how):
    pages = spark.createDataFrame([(i, "u", f"page {i} " + hashlib.sha256(str(i).encode()).hexdigest() * 40) for i in range(40)] + [(40, "u", "é twice"), (41, None, "é twice")],
                                  "page_id long, url string, html string")
    warc.write_archives(pages.coalesce(1), path, file_bytes=1 << 30, **how)
    files = sorted(f for f in os.listdir(path) if f.startswith("part-"))
    return [open(f"{path}/{f}", "rb").read() for f in files]


def kinds(data):
    return [k for k, *_ in warc.salvage(data)]


def test_damage_costs_one_record(spark, tmp_path, monkeypatch):
    # the archives as the query writes them
    how = {}
    monkeypatch.setattr(warc, "write_archives", lambda pages, path, least=0, **more: how.update(more) or spark.range(0).write.parquet(path))
    queries.op9(spark, "/root/testdata/sf0.001")
    monkeypatch.undo()
    parts = written(spark, str(tmp_path / "w"), **how)
    assert sum(kinds(p).count("record") for p in parts) == 42 and not any("gap" in kinds(p) for p in parts)
    plain = b"".join(gzip.decompress(p) for p in parts)
    assert plain.count(b"WARC-Type: revisit") == 1 and "é twice".encode() in plain
    data = max(parts, key=len)
    n = kinds(data).count("record")
    assert n > 2
    offsets = [a for _, a, *_ in warc.salvage(data)]
    for at in (offsets[1] + 40, len(data) // 3, len(data) // 2):
        bad = data[:at] + bytes([data[at] ^ 255]) + data[at + 1 :]
        assert kinds(bad).count("record") >= n - 1 and "gap" in kinds(bad)


def test_large_records_end_their_members():
    record = b"x" * ((1 << 24) + 5)
    assert gzip.decompress(warc.member(record) + b"\0") == record + b"\r\n\r\n"


def test_files_of_any_name_are_read(spark, tmp_path):
    os.makedirs(tmp_path / "in" / "deep")
    data = b"".join(written(spark, str(tmp_path / "w"), compression="records"))
    (tmp_path / "in" / "deep" / "crawl-00000.warc.gz").write_bytes(data)
    (tmp_path / "in" / "other.warc").write_bytes(data)
    rows = warc.read_archives(spark, str(tmp_path / "in")).where("kind = 'record'")
    assert rows.count() == 84
    assert warc.read_archives(spark, str(tmp_path / "in"), pattern="*.gz").where("kind = 'record'").count() == 42


def test_every_cut_of_a_record_leaves_the_next_one_whole(spark, tmp_path):
    plain = b"".join(gzip.decompress(p) for p in written(spark, str(tmp_path / "w"), compression="records"))
    whole = [(at, n, fields, block) for kind, at, n, fields, block in warc.salvage(plain) if kind == "record"]
    revisit = next(r for r in whole if r[2]["warc-type"] == "revisit")
    response = next(r for r in whole if r[2]["warc-type"] == "response")
    for first, second in ((revisit, response), (response, revisit)):
        cut_off, kept = (plain[r[0] : r[0] + r[1]] for r in (first, second))
        for at in range(1, len(cut_off)):
            rows = list(warc.salvage(cut_off[:at] + kept))
            assert [(k, a, n) for k, a, n, _, _ in rows] == [("gap", 0, at), ("record", at, len(kept))], at
            assert rows[1][3] == second[2] and rows[1][4] == second[3]


def test_headers_that_no_writer_makes_are_gaps():
    good = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <a>\r\nContent-Length: 2\r\n%s\r\nhi\r\n\r\n"
    assert kinds(good % b"WARC-Concurrent-To: <b>\r\nWARC-Concurrent-To: <c>\r\n") == ["record"]
    for line in (b"WARC-Type: response\r\n", b"A: x\rB: y\r\n", b"A: x\nB: y\r\n", b"no colon\r\n"):
        assert kinds(good % line) == ["gap"]


def test_odd_pages_come_back(spark, tmp_path):
    pages = odd_docs(spark).selectExpr("doc_id AS page_id", "source AS url", "text AS html", "fp AS id", "fp AS sha1", "score AS size", "fp AS first")
    want = [(r["page_id"], len((r["html"] or "").encode())) for r in pages.collect()]
    for how in ("none", "gzip", "records"):
        warc.write_archives(pages, str(tmp_path / how), compression=how)
        rows = warc.read_archives(spark, str(tmp_path / how))
        got = rows.select(warc.page_of(F.col("record_id")), "payload_bytes").collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and rows.where("kind = 'gap'").count() == 0
        warc.write_archives(pages.limit(0), str(tmp_path / f"{how}-empty"), compression=how)
        assert warc.read_archives(spark, str(tmp_path / f"{how}-empty")).count() == 0
