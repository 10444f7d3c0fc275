"""Packing documents into sequences by a configuration linear program.

Only the histogram of piece lengths, at most one count per length up to the
capacity, is solved on the driver; pieces are never gathered.  A configuration
is a multiset of lengths that fits one sequence.  The covering program over
configurations is solved by multiplicative weights: a knapsack dynamic program
prices, for every length, the best configuration that holds it; lengths that a
phase covers too often become cheaper, the others dearer.  The fractional
counts are rounded down, full configurations once up, and the program is solved
again for what is left while that places much.  The rest is rounded by pricing
in whole numbers: a knapsack program bounded by the supply gives the longest
piece its fullest filling, as often as the supply allows.  The n-th piece of a
length finds its sequence and offset by arithmetic from its number alone.
"""

from __future__ import annotations

import functools
import math
import os
import re
import zlib
from array import array
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.llm.shared import long_id, stored, utf8

#: Phases of multiplicative weights and their rate.
PHASES, RATE = 32, 0.3
#: How often the program is solved at most, and the share of the pieces that a
#: solution has to place for another one.
AGAIN, AGAIN_SHARE = 8, 0.25


#: Words whose ids a worker keeps: some 100 MB and as much again for those before them.
WORDS = 600_000
# fixed values: the pre-tokenizer's pattern on lower-case ASCII without white space
_PARTS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


class WordEncoder:
    """Token ids of a text as little-endian 32-bit words, by its white-space words.

    The pre-tokenizer never joins what ASCII white space parts and drops the
    white space, so the ids of a text are those of its words.  It cuts ASCII
    words by a plain pattern once they are lower case, so their ids are those of
    their parts, of which there are fewer.  Words in other scripts, and those
    that may hold a special string, are left to the library whole.
    """

    def __init__(self, path: str, limit: int = WORDS):
        # a pool of threads in every worker would only wait for the others' cores
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.known, self.older, self.parts = Tokenizer.from_file(path), limit, {}, {}, {}

    def encoded(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def encoded_parts(self, parts: list[bytes]) -> list[bytes]:
        """Ids of parts that the pre-tokenizer leaves whole, by one text of all of them."""
        e = self.tokenizer.encode(b" ".join(parts).decode("ascii"), add_special_tokens=False)
        ids, owner = np.array(e.ids, dtype="<u4"), np.array(e.word_ids)
        cuts = np.flatnonzero(np.diff(owner)) + 1
        if len(cuts) + 1 != len(parts):
            return self.encoded(parts)
        data, ends = ids.tobytes(), [0, *(4 * cuts).tolist(), 4 * len(ids)]
        return [data[i:j] for i, j in zip(ends, ends[1:])]

    def learn(self, words: set[bytes]) -> None:
        if len(self.known) + len(words) > self.limit:
            self.known, self.older = {}, self.known
        if len(self.parts) > self.limit:
            self.parts = {}
        older, whole, cut, fresh = self.older, [], [], {}
        for w in words:
            if w in older:
                self.known[w] = older[w]
            elif not w.isascii() or b"<|" in w:
                whole.append(w)
            else:
                parts = _PARTS.findall(w.lower())
                cut.append((w, parts))
                for p in parts:
                    if p not in self.parts:
                        fresh[p] = None
        for todo, encode, into, step in ((whole, self.encoded, self.known, 20_000), (list(fresh), self.encoded_parts, self.parts, 2_000)):
            for i in range(0, len(todo), step):
                into.update(zip(todo[i : i + step], encode(todo[i : i + step])))
        for w, parts in cut:
            self.known[w] = b"".join([self.parts[p] for p in parts])

    def __call__(self, text: bytes) -> bytes:
        words = text.split()
        new = set(words).difference(self.known)
        if new:
            self.learn(new)
        try:
            return b"".join([self.known[w] for w in words])
        except KeyError:
            # the text made the words known before it the older ones
            self.learn(set(words))
            return b"".join([self.known[w] for w in words])


@functools.lru_cache(maxsize=2)
def _encoder(path: str, words: int) -> WordEncoder:
    return WordEncoder(path, words)


def token_pieces(docs: DataFrame, *, vocabulary: str, capacity: int = 4096, end: int = 1, doc_id: str = "doc_id", text: str = "text", ids: bool = False,
                 words: int = WORDS) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, __part, __nth[, ids])``: documents cut at ``capacity`` tokens.

    ``__nth`` numbers the pieces of a length within the task ``__part``.
    """
    rows = docs.select(long_id(docs, doc_id).alias("doc_id"), docs[f"`{text}`"].cast("string").alias("text"))
    tail = array("I", [end]).tobytes()

    def run(batches):
        encode, part, seen = _encoder(vocabulary, words), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            out, held = [[], [], [], [], [], []], []
            for doc, raw in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text"))):
                data = encode(raw) + tail
                for number, at in enumerate(range(0, len(data), 4 * capacity)):
                    cut = data[at : at + 4 * capacity]
                    n = len(cut) // 4
                    for column, value in zip(out, (doc, number, at // 4, n, zlib.crc32(cut), seen[n])):
                        column.append(value)
                    seen[n] += 1
                    if ids:
                        held.append(np.frombuffer(cut, dtype="<u4").astype(np.int32))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(out, kinds)] + [pa.array([part] * len(out[0]), pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "__nth", "__part"]
            if ids:
                arrays.append(pa.array(held, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, __nth bigint, __part int" + ", ids array<int>" * ids)


def _price(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: best value of every room, and the length taken last (0: none)."""
    best, taken = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    n = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room], taken[room] = best[room - 1], 0
        if n[room]:
            gain = values[: n[room]] + best[room - lengths[: n[room]]]
            k = int(np.argmax(gain))
            if gain[k] > best[room]:
                best[room], taken[room] = gain[k], lengths[k]
    return best, taken


def fractional(demand: dict[int, int], capacity: int, phases: int = PHASES) -> dict[tuple[int, ...], float]:
    """Configurations and fractional counts that cover ``demand``."""
    lengths = np.array(sorted(demand), dtype=np.int64)
    need = np.array([demand[int(n)] for n in lengths], dtype=float)
    place = {int(n): i for i, n in enumerate(lengths)}
    weight, counts, shares = lengths / capacity, defaultdict(float), (need / phases).tolist()
    for _ in range(phases):
        taken = _price(weight, lengths, capacity)[1].tolist()
        covered = [0.0] * len(place)
        for i, n in enumerate(place):
            share = shares[i] - covered[i]
            if share <= 0:
                continue
            config, room = [n], capacity - n
            while room > 0:
                t = taken[room]
                if t:
                    config.append(t)
                    room -= t
                else:
                    room -= 1
            times = Counter(config)
            times_of = share / times[n]
            for m, k in times.items():
                covered[place[m]] += k * times_of
            counts[tuple(sorted(config, reverse=True))] += times_of
        weight = weight * np.exp(-RATE * np.clip(np.array(covered) * phases / need - 1, -1, 4))
        weight = np.maximum(weight / np.max(weight * capacity / lengths), lengths / capacity * 1e-3)
    return counts


def _sums(below: int, length: int, supply: int, capacity: int) -> int:
    """Bit set of the sums of ``below`` with up to ``supply`` more pieces of a length."""
    count, step, full = min(supply, capacity // length), 1, (1 << (capacity + 1)) - 1
    while count > 0:
        step = min(step, count)
        below |= (below << (length * step)) & full
        count -= step
        step *= 2
    return below


def _priced(rest: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Configurations for the supply that is left, by a knapsack program bounded by it.

    Each holds the longest piece and the fullest filling beside it, of long
    pieces before short ones, and is used as often as the supply allows.  Every
    one uses up a length or leaves less of it than a sequence could hold, so
    their number depends on the capacity alone.
    """
    rest, out = {n: k for n, k in rest.items() if k > 0}, []
    lengths, sums = sorted(rest), [1]  # sums[i]: those of lengths[:i]
    while lengths:
        for n in lengths[len(sums) - 1 :]:
            sums.append(_sums(sums[-1], n, rest[n], capacity))
        longest = lengths[-1]
        beside = _sums(sums[len(lengths) - 1], longest, rest[longest] - 1, capacity - longest)
        room = (beside & ((1 << (capacity - longest + 1)) - 1)).bit_length() - 1
        times = Counter({longest: 1})
        for n, below in zip(reversed(lengths), reversed(sums[: len(lengths)])):
            if not room:
                break
            k = min(rest[n] - (n == longest), room // n)
            while not below >> (room - k * n) & 1:
                k -= 1
            if k:
                times[n] += k
                room -= k * n
        copies = min(rest[n] // k for n, k in times.items())
        out.append((tuple(sorted(times.elements(), reverse=True)), copies))
        for n, k in times.items():
            rest[n] -= k * copies
        # the sums of lengths below the first whose supply now counts stay
        scarce = [n for n in times if rest[n] < capacity // n]
        del sums[bisect_left(lengths, min(scarce)) + 1 :]
        lengths = [n for n in lengths if rest[n]]
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Configurations and how many sequences take each; every piece is in exactly one."""
    rest = {n: k for n, k in histogram.items() if 0 < n < capacity and k > 0}
    out = [((capacity,), histogram[capacity])] if histogram.get(capacity) else []

    def take(ranked, slack: int, up: bool) -> int:
        taken = 0
        for config, x in ranked:
            times = Counter(config)
            most = min(rest.get(n, 0) // k for n, k in times.items())
            n = min(most, 1 if up else math.floor(x + 1e-9))
            if n and capacity - sum(config) <= slack:
                out.append((config, n))
                taken += n * len(config)
                for m, k in times.items():
                    rest[m] -= k * n
        return taken

    for _ in range(AGAIN):
        left = sum(rest.values())
        if not left:
            break
        counts = fractional({n: k for n, k in rest.items() if k}, capacity)
        ranked = sorted(counts.items(), key=lambda c: (capacity - sum(c[0]), -c[1], c[0]))
        taken = take(ranked, capacity // 512, False)
        take(ranked, 0, True)
        if taken < left * AGAIN_SHARE:
            break
    return out + _priced(rest, capacity)


def _table(configs: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first piece number, pieces per sequence, first sequence, offset), sorted."""
    rows, numbers, sequence = [], defaultdict(int), 0
    for config, n in configs:
        at = 0
        for m, k in sorted(Counter(config).items(), reverse=True):
            rows.append((m, numbers[m], k, sequence, at))
            numbers[m] += k * n
            at += m * k
        sequence += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, *, vocabulary: str, capacity: int = 4096, end: int = 1, doc_id: str = "doc_id", text: str = "text", ids: bool = False,
         words: int = WORDS) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids])`` per piece.

    A document is the ids of its text and the ``end`` id; those longer than
    ``capacity`` are cut into pieces of it.  A null text is an empty one: its
    piece is the end id alone.  Repeated rows and null ids are packed like any
    other; other columns are left out.  ``ids=True`` adds the tokens.  A worker
    keeps the ids of up to twice ``words`` words.  An empty table gives an empty
    result.
    """
    pieces = stored(token_pieces(docs, vocabulary=vocabulary, capacity=capacity, end=end, doc_id=doc_id, text=text, ids=ids, words=words), "pieces")
    counts = pieces.groupBy("length", "__part").agg(F.count("*").alias("n"))
    # at most one row per length: bounded by the capacity
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = _table(plan(histogram, capacity))
    shared = docs.sparkSession.sparkContext.broadcast(table)
    before = W.partitionBy("length").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("length", "__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    numbered = pieces.join(bases, ["length", "__part"]).withColumn("__n", F.col("__base") + F.col("__nth"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids
    numbered = numbered.select(*names, "__n")

    def place(batches):
        t = shared.value
        keys = t[:, 0] << 44 | t[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            n = batch.column("__n").to_numpy(zero_copy_only=False)
            row = t[np.searchsorted(keys, length << 44 | n, side="right") - 1]
            nth = n - row[:, 1]
            sequence, offset = row[:, 3] + nth // row[:, 2], row[:, 4] + nth % row[:, 2] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * ids + ", sequence_id bigint, offset bigint"
    return numbered.mapInArrow(place, schema)
