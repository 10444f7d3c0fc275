"""Benchmark passages in documents: SimHash windows, multi-index blocks, exact check.

Every benchmark item has a fingerprint over its word shingles.  A document is
looked through with windows of the items' own sizes in words.  Windows that
share no shingle with any item of that size cannot be similar and are passed
over; every other window is fingerprinted and looked up.  The fingerprint's
bits are cut into ``BLOCKS`` blocks; within the radius at least one block
differs in one bit at most, so the tables of all blocks together give every
item within the radius.  Those are held against the full distance and then
against the exact weighted similarity of their shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.shared import BoundedCache, long_id, utf8

#: Bytes of a fingerprint; each byte is one block of the index.
BLOCKS = 32
#: Largest distance: under two differing bits per block on average, so that one
#: block has at most one.  Shingles of similarity 0.8 differ in 38 +- 6 of 256 bits.
RADIUS = 2 * BLOCKS - 1
#: Items whose index travels with the tasks at once; larger benchmarks take
#: several passes inside one job.
ITEMS_PER_PASS = 4096
_PLAIN = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))
_NEAR = np.array([[bin(a ^ b).count("1") <= 1 for b in range(256)] for a in range(256)])
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)

LEAK = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start_word", T.LongType()), T.StructField("n_words", T.LongType()),
                     T.StructField("similarity", T.DoubleType()), T.StructField("distance", T.IntegerType())])


def plain_words(text: bytes) -> list[bytes]:
    """Lower-cased words; ASCII punctuation and white space part them."""
    return text.decode("utf-8", "replace").lower().encode().translate(_PLAIN).split()


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


_known = BoundedCache(_hash)


def word_hashes(text: bytes) -> np.ndarray:
    known = _known
    return np.array([known[w] for w in plain_words(text)], dtype=np.uint64)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        h = (h ^ words[i : i + n]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h


def _bits(shingles: np.ndarray) -> np.ndarray:
    """256 bits of every shingle, as rows of 0 and 1."""
    wide = shingles[:, None] * _MIX
    wide ^= wide >> np.uint64(29)
    wide *= np.uint64(0xBF58476D1CE4E5B9)
    wide ^= wide >> np.uint64(32)
    return np.unpackbits(wide.view(np.uint8), axis=1)


def window_fingerprints(shingles: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of ``size`` shingles from every start, as rows of bytes."""
    low, high = int(starts[0]), int(starts[-1]) + size
    sums = np.zeros((high - low + 1, 8 * BLOCKS), dtype=np.int32)
    np.cumsum(_bits(shingles[low:high]), axis=0, dtype=np.int32, out=sums[1:])
    at = starts - low
    return np.packbits(2 * (sums[at + size] - sums[at]) > size, axis=1)


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Shared weight over joint weight, a shingle weighing as often as it occurs."""
    ka, na = np.unique(a, return_counts=True)
    kb, nb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    shared = int(np.minimum(na[ia], nb[ib]).sum())
    return shared / (len(a) + len(b) - shared)


class Index:
    """One pass' items: their shingles, fingerprints and block tables, by size."""

    def __init__(self, items: list[tuple[int, bytes]], shingle: int):
        self.sizes: dict[tuple[int, int], dict] = {}
        by_size: dict[tuple[int, int], list] = {}
        for item, text in sorted(items):
            words = word_hashes(text)
            if len(words):
                width = min(shingle, len(words))
                by_size.setdefault((len(words), width), []).append((item, shingle_hashes(words, width)))
        for size, held in sorted(by_size.items()):
            prints = np.concatenate([window_fingerprints(s, np.array([0]), len(s)) for _, s in held])
            self.sizes[size] = {
                "items": [i for i, _ in held], "shingles": [s for _, s in held], "prints": prints,
                # near[block, value]: which items have a block within one bit of value, packed
                "near": np.stack([np.packbits(_NEAR[:, prints[:, b]], axis=1) for b in range(BLOCKS)]),
            }
        self.widths = {}
        for width in {w for _, w in self.sizes}:
            grams = np.unique(np.concatenate([s for (_, w), t in self.sizes.items() if w == width for s in t["shingles"]]))
            owners = [np.unique(np.concatenate(t["shingles"])) for (_, w), t in self.sizes.items() if w == width]
            spot = np.zeros(1 << 16, dtype=bool)
            spot[(grams & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.widths[width] = (grams, spot, [(size, o) for (size, w), o in zip([k for k in self.sizes if k[1] == width], owners)])

    def leaks(self, text: bytes, least: float, radius: int) -> list[tuple[int, int, int, float, int]]:
        """``(item, first word, words, similarity, distance)`` of the most similar window per item."""
        words, best = word_hashes(text), {}
        for width, (grams, spot, owners) in self.widths.items():
            shingles = shingle_hashes(words, width)
            maybe = np.flatnonzero(spot[(shingles & np.uint64(0xFFFF)).astype(np.int64)])
            if len(maybe):
                at = np.minimum(np.searchsorted(grams, shingles[maybe]), len(grams) - 1)
                maybe = maybe[grams[at] == shingles[maybe]]
            if not len(maybe):
                continue
            for n, own in owners:
                at = np.minimum(np.searchsorted(own, shingles[maybe]), len(own) - 1)
                hits = maybe[own[at] == shingles[maybe]]
                if len(hits):
                    self._windows(words, shingles, hits, n, width, least, radius, best)
        return [(item, start, n, s, d) for item, (s, start, n, d) in sorted(best.items())]

    def _windows(self, words, shingles, hits, n, width, least, radius, best):
        n_window = min(n, len(words))
        size, last = n_window - width + 1, len(words) - n_window
        # all windows that hold a hit
        cover = np.zeros(last + 2, dtype=np.int64)
        np.add.at(cover, np.clip(hits - size + 1, 0, last), 1)
        np.add.at(cover, np.minimum(hits, last) + 1, -1)
        starts = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
        t = self.sizes[n, width]
        cuts = np.flatnonzero(np.diff(starts) > size) + 1
        for part in np.split(starts, cuts):
            for i in range(0, len(part), 4096):
                some = part[i : i + 4096]
                prints = window_fingerprints(shingles, some, size)
                found = np.zeros((len(some), t["near"].shape[2]), dtype=np.uint8)
                for b in range(BLOCKS):
                    found |= t["near"][b][prints[:, b]]
                at, item = np.nonzero(np.unpackbits(found, axis=1, count=len(t["items"])))
                distance = np.bitwise_count(prints[at] ^ t["prints"][item]).sum(axis=1)
                for k in np.flatnonzero(distance <= radius):
                    start, j = int(some[at[k]]), int(item[k])
                    s = weighted_similarity(shingles[start : start + size], t["shingles"][j])
                    if s >= least:
                        key, value = t["items"][j], (s, start, n_window, int(distance[k]))
                        if key not in best or (value[0], -value[1]) > (best[key][0], -best[key][1]):
                            best[key] = value


def find_leaks(docs: DataFrame, items: DataFrame, *, shingle: int = 5, least: float = 0.8, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text",
               item_id: str = "item_id", item_text: str = "text", items_per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """``row, doc_id, leaks`` per row of ``docs``; ``row`` holds its columns.

    ``leaks`` has, per item that some window matches, ``(item_id, start_word,
    n_words, similarity, distance)`` of its most similar window, the first of
    equals.  A window has the item's number of words, or all words of a shorter
    document; items of fewer than ``shingle`` words are one shingle.  Similarity
    is that of shingles with repeats.

    Null and empty texts have no leak and leak into nothing, likewise items
    without an id; items that repeat an id count as one if their texts are
    equal.  Repeated rows and null ids stay.  Empty tables give no leaks.
    """
    if radius > RADIUS:
        raise ValueError(f"the blocks guarantee a radius of at most {RADIUS}")
    wanted = items.select(long_id(items, item_id).alias("item"), items[f"`{item_text}`"].cast("string").alias("text")).where("item is not null and text is not null").distinct()
    passes = max(1, -(-wanted.count() // items_per_pass))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), long_id(docs, doc_id).alias("doc_id"), docs[f"`{text}`"].cast("string").alias("text"))
    rows = rows.withColumn("leaks", F.array().cast(T.ArrayType(LEAK)))
    for number in range(passes):
        # about items_per_pass items of the query set, whatever the documents hold
        part = wanted.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == number).collect()
        index = docs.sparkSession.sparkContext.broadcast(Index([(r["item"], r["text"].encode()) for r in part], shingle))
        rows = rows.mapInArrow(_look(index, least, radius), rows.schema)
    return rows.drop("text")


def _look(index, least: float, radius: int):
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("similarity", pa.float64()), ("distance", pa.int32())]))

    def run(batches):
        names = [f.name for f in LEAK.fields]
        for batch in batches:
            found = [[*old, *(dict(zip(names, x)) for x in index.value.leaks(data, least, radius))] for data, old in zip(utf8(batch.column("text")), batch.column("leaks").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("text"), pa.array(found, kind)], names=["row", "doc_id", "text", "leaks"])

    return run
