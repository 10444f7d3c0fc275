"""SimHash near-duplicates with pigeonring candidate filtering.

A document's fingerprint has 64 bits, each the majority of that bit over the
hashes of its word shingles.  Documents whose fingerprints differ in at most
``radius`` bits are linked.

The bits are cut into ``segments`` on a ring.  If two fingerprints differ in
at most r bits, some start on the ring sees, for every chain length l, at most
floor(l r / m) differences in the next l of the m segments.  The chains with a
budget of 0 or 1 make the index: the first segments must be equal, and of the
rest of the longest chain with budget 1 all but one.  Fingerprints that share
such a key are held against the budgets of all longer chains, and only the
survivors against the full distance.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.components import components
from barloom.llm.shared import long_id, map_batches, row_key, stored, utf8

#: Fingerprints of one key that are compared in one task; larger keys are cut
#: into blocks of about this size and every pair of blocks is a task of its own.
BLOCK = 4096
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SEED = 42
_CHUNK = 1 << 16


def _majority(hashes: list[int]) -> int:
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _CHUNK):
        part = np.array(hashes[i : i + _CHUNK], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: bytes, shingle: int, distinct: bool) -> int:
    """Signed 64-bit SimHash; a text with no word has 0."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    n = min(shingle, len(words))
    grams = [joined[a : b - 1] for a, b in zip(ends, ends[n:])]
    if distinct:
        grams = sorted(set(grams))
    h = xxhash.xxh64_intdigest
    return _majority([h(g, _SEED) for g in grams])


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, distinct: bool = False) -> DataFrame:
    """``(doc_id, __k1, __k2, fp)`` per row; a null text counts as empty."""
    ident, body = long_id(docs, doc_id), docs[f"`{text}`"]
    rows = docs.select(ident.alias("doc_id"), body.alias("text"), *row_key(ident, body))

    def one(batch):
        fps = [fingerprint(t, shingle, distinct) for t in utf8(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("__k1"), batch.column("__k2"), pa.array(fps, pa.int64())],
                                         names=["doc_id", "__k1", "__k2", "fp"])

    return map_batches(rows, one, "doc_id bigint, __k1 bigint, __k2 bigint, fp bigint")


class Ring:
    """Segments, chain budgets and index keys for a radius."""

    def __init__(self, radius: int, segments: int):
        if not 0 < radius < segments <= 64:
            raise ValueError("needs 0 < radius < segments <= 64")
        cuts = [64 * i // segments for i in range(segments + 1)]
        self.parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
        self.budget = [(n * radius) // segments for n in range(segments + 1)]
        zero = max(n for n in range(segments + 1) if self.budget[n] == 0)
        one = max(n for n in range(segments + 1) if self.budget[n] <= 1)
        #: (start, bits that must be equal) of every key
        self.keys = []
        for s in range(segments):
            chain = [self.parts[(s + i) % segments] for i in range(one)]
            for left_out in range(zero, one):
                self.keys.append((s, sum(p for i, p in enumerate(chain) if i != left_out)))
        #: bits of the first n segments from every start
        self.chains = [[sum(self.parts[(s + i) % segments] for i in range(n)) for n in range(1, segments + 1)] for s in range(segments)]

    def near(self, x: np.ndarray, start: int) -> np.ndarray:
        """Which differences ``x`` keep every chain budget from ``start``, the last being the radius."""
        alive = np.arange(len(x))
        for bits, most in zip(self.chains[start], self.budget[1:]):
            if not len(alive):
                break
            alive = alive[np.bitwise_count(x[alive] & np.uint64(bits)) <= most]
        return alive


def _spread(ring: Ring, start: int, left: np.ndarray, right: np.ndarray | None) -> list[tuple[int, int]]:
    """Links of a spanning forest: within ``left``, or between ``left`` and ``right``.

    A found fingerprint is never compared again from its own side, so a dense
    group costs little and gives one link per member, not one per pair.
    """
    out = []
    if right is None:
        rest = left
        while len(rest) > 1:
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                p = queue.pop()
                hit = ring.near(rest ^ p, start)
                if len(hit):
                    found = rest[hit]
                    out += [(int(p), int(q)) for q in found]
                    queue += list(found)
                    rest = np.delete(rest, hit)
        return out
    rests = [left, right]
    while len(rests[0]) and len(rests[1]):
        queue, rests[0] = [(0, rests[0][0])], rests[0][1:]
        while queue:
            side, p = queue.pop()
            hit = ring.near(rests[1 - side] ^ p, start)
            if len(hit):
                found = rests[1 - side][hit]
                out += [(int(p), int(q)) for q in found]
                queue += [(1 - side, q) for q in found]
                rests[1 - side] = np.delete(rests[1 - side], hit)
    return out


def _links(ring: Ring):
    """Map over rows sorted by (kid, key, left, right): links of each run."""

    def run(batches):
        names = ["kid", "key", "left", "right", "block", "fp"]
        held: list[np.ndarray] = []

        def flush(cols):
            kid, _, left, right, block, fp = cols
            pair = left[0] != right[0]
            f = fp.view(np.uint64)
            start = ring.keys[int(kid[0])][0]
            if not pair:
                return _spread(ring, start, f, None)
            return _spread(ring, start, f[block == left[0]], f[block == right[0]])

        def batch_of(found):
            a = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])

        for batch in batches:
            cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
            if held:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            n = len(cols[0])
            if not n:
                continue
            cut = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0) | (np.diff(cols[3]) != 0)) + 1
            bounds = np.concatenate([[0], cut])
            out = []
            for a, b in zip(bounds[:-1], bounds[1:]):
                out += flush([c[a:b] for c in cols])
            held = [c[bounds[-1] :] for c in cols]
            if out:
                yield batch_of(out)
        if held:
            out = flush(held)
            if out:
                yield batch_of(out)

    return run


def links(values: DataFrame, *, radius: int = 3, segments: int = 8, block: int = BLOCK) -> DataFrame:
    """``(a, b)`` links that connect all distinct fingerprints within ``radius``.

    ``values`` has one row per distinct ``fp``.  Of the links inside a key only
    a spanning forest is returned: components are those of all links.
    """
    ring = Ring(radius, segments)

    def signed(bits):
        return bits - (1 << 64) if bits >= 1 << 63 else bits

    keyed = values.select("fp", F.posexplode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(bits)).cast("bigint"))) for i, (_, bits) in enumerate(ring.keys)])).alias("kid", "key"))
    sizes = keyed.groupBy("kid", "key").agg(F.count("*").alias("n")).where("n > 1")
    full = keyed.join(sizes, ["kid", "key"]).withColumn("blocks", F.ceil(F.col("n") / F.lit(block)).cast("int"))
    full = full.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "fp"), F.col("blocks")).cast("int"))
    dealt = full.select("kid", "key", "block", "fp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("kid", "key", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "fp")
    dealt = dealt.repartition("kid", "key", "left", "right").sortWithinPartitions("kid", "key", "left", "right", "fp")
    return dealt.mapInArrow(_links(ring), "a bigint, b bigint")


def groups(fps: DataFrame, *, radius: int = 3, segments: int = 8) -> DataFrame:
    """``(fp, component_id)``: the least doc_id reachable over links, for every fingerprint.

    ``fps`` has ``doc_id, fp`` per row.  Null ids never name a component unless
    it has no other.
    """
    values = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "fps")
    reach = components(links(values.select("fp"), radius=radius, segments=segments))
    rooted = values.join(reach.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id")


def simhash_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, distinct: bool = False,
                       radius: int = 3, segments: int = 8) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` per row of ``docs``.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased;
    shingles are hashed by XXH64 with seed 42.  Texts shorter than a shingle
    give one shingle, texts without words the zero fingerprint, which is linked
    like any other.  A null text is an empty one; a null id stays null and
    names a component only if it has no other id.  Repeated rows stay.  Columns
    other than id and text are left out.  An empty table gives an empty result.
    """
    fps = stored(fingerprints(docs, doc_id=doc_id, text=text, shingle=shingle, distinct=distinct).select("doc_id", "fp"), "fps")
    named = groups(fps, radius=radius, segments=segments)
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, distinct: bool = False,
             radius: int = 3, segments: int = 8) -> DataFrame:
    """The rows of ``docs`` that stay: of every component that with the least id.

    Rows without an id come last; ties between rows of one id go to the least
    hash of the text, and of identical rows one stays.  All columns are kept.
    """
    fps = stored(fingerprints(docs, doc_id=doc_id, text=text, shingle=shingle, distinct=distinct), "fps")
    values = stored(fps.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__k1", "__k2")).alias("first")), "fps")
    reach = components(links(values.select("fp"), radius=radius, segments=segments))
    rooted = values.join(reach.withColumnRenamed("node", "fp"), "fp", "left").select("first", F.coalesce("root", "fp").alias("root"))
    return rows_of(docs, rooted, doc_id=doc_id, text=text)


def rows_of(docs: DataFrame, rooted: DataFrame, *, doc_id: str, text: str) -> DataFrame:
    """The rows of ``docs`` with the least ``first`` of every ``root``; of identical rows one."""
    winners = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.__k1", "first.__k2").distinct()
    ident, body = long_id(docs, doc_id), docs[f"`{text}`"]
    kept = docs.select("*", *row_key(ident, body)).join(winners, ["__k1", "__k2"], "left_semi")
    return kept.dropDuplicates(["__k1", "__k2"]).select(*[f"`{c}`" for c in docs.columns])
