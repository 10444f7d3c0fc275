"""Exact removal of repeated byte strings by sorted suffixes.

A byte goes if a ``length``-byte string that covers it also starts anywhere
else.  Sorting all suffixes would move every position many times over, so only
those are sorted that can meet an equal string:

1. Every ``length``-byte window has an anchor, the leftmost of the least hashed
   ``gram``-byte strings inside it.  Equal windows have equal anchors in equal
   places.  Neighbouring windows with one anchor form a run; a run is shuffled
   as the hashes of its anchor and of its bytes, not as text.
2. Runs that are equal as a whole are repeated as a whole.  Runs whose anchor
   no other run has are not repeated.  What is left meets another run at its
   anchor but differs from all of them somewhere.
3. Of these runs the suffix from the anchor and the reversed prefix before it
   are taken.  Two equal windows share at least half of ``length`` on one of the
   two sides, so suffixes and prefixes are range-partitioned by sampled
   splitters on the leading half, and every bucket is sorted by multikey
   quicksort.  A splitter is a whole leading half, so that no group of equal
   ones lies across a boundary and nothing is left to compare there.
4. Inside a group runs are laid anchor on anchor; how far two agree to the left
   and to the right gives their equal windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.llm.shared import long_id, row_key, stored, utf8

#: Windows of a text that are looked at together; longer texts are cut into such
#: stretches, which only ends runs earlier.
STRETCH = 1 << 22
#: Members of a group up to which all are laid on each other at once.
PAIRWISE = 256
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def __call__(self, n: int):
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 13)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                values = np.full(size, base, dtype=np.uint64)
                values[0] = 1
                setattr(self, name, np.cumprod(values, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def _gram_order(data: np.ndarray, gram: int) -> np.ndarray:
    """A pseudo-random order of the ``gram``-byte strings: 40 hash bits, then the place."""
    n = len(data) - gram + 1
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data + np.uint64(1)) * up, dtype=np.uint64, out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[:n]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(n, dtype=np.uint64)


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchor_runs(text: bytes, length: int, gram: int):
    """``(first window, bytes, anchor)`` of every run of windows with one anchor."""
    for base in range(0, len(text) - length + 1, STRETCH):
        part = np.frombuffer(text, dtype=np.uint8, count=min(len(text) - base, STRETCH + length - 1), offset=base)
        least = _window_min(_gram_order(part.astype(np.uint64), gram), length - gram + 1)
        anchor = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        ends = np.flatnonzero(np.diff(anchor)) + 1
        starts = np.concatenate([[0], ends])
        ends = np.concatenate([ends, [len(anchor)]])
        for s, e, a in zip(starts.tolist(), ends.tolist(), anchor[starts].tolist()):
            yield base + s, e - s + length - 1, base + a


def _runs(docs: DataFrame, doc_id: str, text: str, length: int, gram: int) -> DataFrame:
    """``(k1, k2, start, size, at, h, hh, again)`` of every run of windows with one anchor."""
    ident, body = long_id(docs, doc_id), docs[f"`{text}`"].cast("string")
    rows = docs.select(body.alias("text"), *row_key(ident, body)).where(F.octet_length("text") >= length)
    names = ["k1", "k2", "start", "size", "at", "h", "hh", "again"]
    digest = xxhash.xxh64_intdigest

    def settled(cols):
        """The runs of some texts; equal ones among them need no other to meet.

        One of these, marked 1, goes on to meet the rest of the table, the
        others, marked 2, travel under keys of their own, so that a passage
        that many texts share is no hot key.
        """
        k1, start = np.array(cols[0], dtype=np.int64), np.array(cols[2], dtype=np.int64)
        h, hh = np.array(cols[5], dtype=np.uint64).view(np.int64), np.array(cols[6], dtype=np.uint64).view(np.int64)
        order = np.lexsort((hh, h))
        same = (h[order][1:] == h[order][:-1]) & (hh[order][1:] == hh[order][:-1])
        again = np.zeros(len(h), dtype=np.int8)
        again[order[:-1]] |= same
        again[order[1:][same]] = 2
        h = np.where(again == 2, k1 ^ (start * np.int64(0x9E3779B97F4A7C1)), h)
        arrays = [pa.array(c, k) for c, k in zip(cols[:5], (pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int16()))]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(h), pa.array(hh), pa.array(again)], names=names)

    def run(batches):
        for batch in batches:
            cols = [[] for _ in range(7)]
            for k1, k2, data in zip(batch.column("__k1").to_pylist(), batch.column("__k2").to_pylist(), utf8(batch.column("text"))):
                for s, n, a in anchor_runs(data, length, gram):
                    for c, v in zip(cols, (k1, k2, s, n, a - s, digest(data[a : a + gram]), digest(data[s : s + n], 1))):
                        c.append(v)
                if len(cols[0]) >= 200_000:
                    yield settled(cols)
                    cols = [[] for _ in range(7)]
            if cols[0]:
                yield settled(cols)

    return rows.mapInArrow(run, "k1 bigint, k2 bigint, start int, size smallint, at smallint, h bigint, hh bigint, again tinyint")


def multikey_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of ``words`` and the starts of groups of equal rows.

    Multikey quicksort, all partitions of a level at once: rows are split by
    one 8-byte token, and only those still tied go on with the next.
    """
    n, width = words.shape
    order, group = np.arange(n), np.zeros(n, dtype=np.int64)
    tied = np.arange(n)
    for w in range(width):
        token = words[order[tied], w]
        by = np.lexsort((token, group[tied]))
        order[tied], token = order[tied][by], token[by]
        g = group[tied]
        fresh = np.concatenate([[True], (token[1:] != token[:-1]) | (g[1:] != g[:-1])]) if len(tied) else np.zeros(0, dtype=bool)
        group[tied] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(tied)), 0))] if len(tied) else g
        sizes = np.bincount(group, minlength=n)
        tied = np.flatnonzero(sizes[group] > 1)
        if not len(tied):
            break
    return order, np.flatnonzero(group == np.arange(n))


def _agreement(rows: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Leading columns in which each of ``rows`` agrees with ``own``."""
    same = rows == own
    first = same.argmin(axis=1)
    return np.where(same[np.arange(len(rows)), first], rows.shape[1], first)


def equal_windows(before: np.ndarray, after: np.ndarray, left: np.ndarray, right: np.ndarray, need: np.ndarray, length: int) -> list[np.ndarray]:
    """For every needed run, which windows ``d`` bytes before its anchor another run has too.

    ``before`` holds the bytes before the anchors, nearest first, ``after`` those
    from the anchor on; ``left`` and ``right`` how many of them belong to the run.
    """
    g, out = len(left), []
    if g <= PAIRWISE:
        for i in np.flatnonzero(need):
            lo = length - np.minimum(np.minimum(_agreement(after, after[i]), right), right[i])
            hi = np.minimum(np.minimum(_agreement(before, before[i]), left), left[i])
            ok = lo <= hi
            ok[i] = False
            steps = np.zeros(length + 2, dtype=np.int64)
            np.add.at(steps, np.maximum(lo[ok], 0), 1)
            np.add.at(steps, hi[ok] + 1, -1)
            out.append(np.flatnonzero(np.cumsum(steps) > 0))
        return out
    hits: dict[int, list[int]] = {int(i): [] for i in np.flatnonzero(need)}
    whole = np.ascontiguousarray(np.concatenate([before[:, ::-1], after], axis=1))
    middle = before.shape[1]
    for d in range(before.shape[1] + 1):
        have = np.flatnonzero((left >= d) & (right >= length - d))
        if len(have) > 1:
            strings = np.ascontiguousarray(whole[have, middle - d : middle - d + length]).view(f"V{length}").ravel()
            _, inverse, counts = np.unique(strings, return_inverse=True, return_counts=True)
            for i in have[(counts[inverse] > 1) & need[have]].tolist():
                hits[i].append(d)
    return [np.array(hits[int(i)], dtype=np.int64) for i in np.flatnonzero(need)]


def _compare(length: int, gram: int):
    """Map over one bucket: repeated spans of its needed runs."""
    half, reach = length // 2, length - gram
    words = -(-half // 8)

    def run(batches):
        table = [b for b in batches if b.num_rows]
        if not table:
            return
        t = pa.Table.from_batches(table)
        keys = t.column("key").to_pylist()
        packed = np.zeros((len(keys), 8 * words + 8), dtype=np.uint8)
        packed[:, : half] = np.frombuffer(b"".join(keys), dtype=np.uint8).reshape(len(keys), half)
        packed[:, -1] = t.column("side").to_numpy()
        order, starts = multikey_order(packed.view(">u8").astype(np.uint64))
        need = t.column("need").to_numpy().astype(bool)
        left, right = (t.column(c).to_numpy().astype(np.int64) for c in ("left", "right"))
        spans, data = t.column("start").to_numpy(), t.column("bytes").to_pylist()
        k1, k2 = t.column("k1").to_numpy(), t.column("k2").to_numpy()
        out: list[tuple[int, int, int, int]] = []
        for a, b in zip(starts, np.append(starts[1:], len(order))):
            own = order[a:b]
            if b - a < 2 or not need[own].any():
                continue
            before, after = np.zeros((b - a, reach), dtype=np.uint8), np.zeros((b - a, length), dtype=np.uint8)
            for row, i in enumerate(own):
                bytes_ = np.frombuffer(data[i], dtype=np.uint8)
                before[row, : left[i]] = bytes_[: left[i]][::-1]
                after[row, : right[i]] = bytes_[left[i] :]
            found = equal_windows(before, after, left[own], right[own], need[own], length)
            for i, ds in zip(own[need[own]], found):
                if len(ds):
                    cuts = np.flatnonzero(np.diff(ds) > 1)
                    anchor = int(spans[i] + left[i])
                    for lo, hi in zip(ds[np.concatenate([[0], cuts + 1])], ds[np.concatenate([cuts, [len(ds) - 1]])]):
                        out.append((int(k1[i]), int(k2[i]), anchor - int(hi), int(hi - lo) + length))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["k1", "k2", "start", "size"])

    return run


def _sides(length: int):
    """Map over texts with their undecided runs: both sides of every run, by leading half."""
    half = length // 2
    names = ["side", "key", "k1", "k2", "start", "left", "right", "need", "bytes"]
    kinds = (pa.int8(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.bool_(), pa.binary())

    def run(batches):
        for batch in batches:
            out = []
            for k1, k2, data, runs in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), utf8(batch.column("text")), batch.column("runs").to_pylist()):
                for r in runs:
                    s, n, left = r["start"], r["size"], r["at"]
                    bytes_, right = data[s : s + n], n - left
                    if right >= half:
                        out.append((0, bytes_[left : left + half], k1, k2, s, left, right, r["need"], bytes_))
                    if left >= half:
                        out.append((1, bytes_[left - half : left][::-1], k1, k2, s, left, right, r["need"], bytes_))
                if len(out) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return run


def repeated_spans(docs: DataFrame, *, length: int = 200, gram: int = 64, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(k1, k2, spans)``: repeated byte spans, overlapping ones not joined, by ``row_key`` of the row."""
    runs = _runs(docs, doc_id, text, length, gram)
    anchor, equal = W.partitionBy("h"), W.partitionBy("h", "hh")
    told = runs.withColumns({"n": F.count("*").over(anchor), "most": F.max("again").over(equal), "m": F.count("*").over(equal),
                             "nth": F.row_number().over(equal.orderBy("again", "k1", "k2", "start"))})
    told = told.withColumn("whole", (F.col("m") > 1) | (F.col("most") > 0))
    told = told.withColumn("open", F.max(~F.col("whole")).over(anchor)).where((F.col("n") > 1) | F.col("whole"))
    told = stored(told.select("k1", "k2", "start", "size", "at", "whole", ((F.col("n") > F.col("m")) & F.col("open") & (F.col("nth") == 1)).alias("meets")), "runs")
    undecided = told.where("meets").groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "size", "at", (~F.col("whole")).alias("need"))).alias("runs"))
    ident, body = long_id(docs, doc_id), docs[f"`{text}`"].cast("string")
    texts = docs.select(body.alias("text"), *[c.alias(n) for c, n in zip(row_key(ident, body), ("k1", "k2"))]).where(F.octet_length("text") >= length)
    sides = texts.join(undecided, ["k1", "k2"]).select("k1", "k2", "text", "runs").mapInArrow(
        _sides(length), "side tinyint, key binary, k1 bigint, k2 bigint, start int, left smallint, right smallint, need boolean, bytes binary")
    parts = stored(sides.dropDuplicates(["side", "k1", "k2", "start"]), "sides")
    partial = parts.repartitionByRange("side", "key").mapInArrow(_compare(length, gram), "k1 bigint, k2 bigint, start int, size int")
    spans = told.where("whole").select("k1", "k2", "start", F.col("size").cast("int").alias("size")).union(partial)
    return spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "size")).alias("spans"))


def joined_spans(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal spans ``(start, end)``; touching ones are one."""
    out: list[list[int]] = []
    for s, e in sorted((r["start"], r["start"] + r["size"]) for r in spans or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def remove_repeats(docs: DataFrame, *, length: int = 200, gram: int = 64, doc_id: str = "doc_id", text: str = "text", kept: bool = True) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed_spans[, kept_bytes])`` per row.

    Texts are their UTF-8 bytes, a null text none.  Every occurrence of a
    repeated string goes, the first included, and strings are judged on the
    input.  Rows that repeat are places of their own: all of them go, down to
    what is shorter than ``length``.  What stays may cut a character, so it is
    binary.  Null ids stay null; other columns are left out; an empty table
    gives an empty result.
    """
    if not 0 < gram <= length // 2 or length > 16_000:
        raise ValueError("needs 0 < gram <= length / 2 and length <= 16000")
    found = repeated_spans(docs, length=length, gram=gram, doc_id=doc_id, text=text)
    ident, body = long_id(docs, doc_id), docs[f"`{text}`"].cast("string")
    rows = docs.select(ident.alias("doc_id"), body.alias("text"), *[c.alias(n) for c, n in zip(row_key(ident, body), ("k1", "k2"))])
    rows = rows.join(found, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed_spans"] + ["kept_bytes"] * kept

    def run(batches):
        for batch in batches:
            out = []
            for doc, data, spans in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), batch.column("spans").to_pylist()):
                spans = joined_spans(spans)
                bounds = [0, *(x for s in spans for x in s), len(data)]
                rest = b"".join(data[a:b] for a, b in zip(bounds[::2], bounds[1::2]))
                row = (doc, len(data), len(data) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), [{"start": a, "end": b} for a, b in spans])
                out.append((*row, rest) if kept else row)
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, removed_spans array<struct<start: bigint, end: bigint>>" + ", kept_bytes binary" * kept)
