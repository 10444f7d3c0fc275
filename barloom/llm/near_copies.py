"""One row of every group of near copies, by exact similarity of word shingles.

Two texts are near copies if their sets of ``shingle``-word shingles have a
Jaccard similarity of at least ``least``.  Candidates come from two indexes:
the pigeonring over SimHash fingerprints of the distinct words, and bands of
min-hash values of the shingles, which reach the similarities that are too many
bits away for the first.  Candidates only say which texts have to be held
against each other: every link is confirmed on the shingle sets before the
components of near copies are formed.

Members of one index key are linked to the least of them, so a key of many
texts costs one link each.  The shingle sets travel once per component of
candidates and pair of its blocks, and only of texts that have a candidate.
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
from barloom.llm.simhash import fingerprint, links, rows_of

#: Bands of min-hash values and values of a band: of pairs with a similarity of
#: 0.8 one of 1,500 meets in no band.
BANDS, VALUES = 24, 6
#: Shingles of the texts that are compared in one task; larger components are
#: cut into blocks of about this many and every pair of blocks is a task.
SHINGLES = 1 << 18
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SEED = 42
_CHUNK = 1 << 12
_MIX = np.random.default_rng(_SEED).integers(0, 1 << 63, size=(2, BANDS * VALUES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Sorted hashes of the shingles; a text shorter than a shingle is one."""
    words = text.translate(_LOWER).split()
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    n = max(min(shingle, len(words)), 1)
    grams = {joined[a : b - 1] for a, b in zip(ends, ends[n:])} or {b""}
    h = xxhash.xxh64_intdigest
    return np.unique(np.array([h(g, _SEED) for g in grams], dtype=np.uint64))


def band_keys(grams: np.ndarray) -> list[int]:
    """A signed 64-bit key of every band."""
    least = np.full(BANDS * VALUES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(grams), _CHUNK):
        np.minimum(least, ((grams[i : i + _CHUNK, None] ^ _MIX[0]) * _MIX[1]).min(axis=0), out=least)
    data, step = least.tobytes(), 8 * VALUES
    keys = b"".join(xxhash.xxh64_digest(data[i : i + step], i) for i in range(0, len(data), step))
    return np.frombuffer(keys, dtype="<i8").tolist()


def _facts(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """``(doc_id, __k1, __k2, sid, fp, n, bands)`` per row; equal sets have equal ``sid``."""
    ident, body = long_id(docs, doc_id), docs[f"`{text}`"]
    rows = docs.select(ident.alias("doc_id"), body.alias("text"), *row_key(ident, body))

    def one(batch):
        cols = [[], [], [], []]
        for data in utf8(batch.column("text")):
            grams = shingle_set(data, shingle)
            sid = int.from_bytes(xxhash.xxh64_digest(grams.tobytes()), "big", signed=True)
            for c, v in zip(cols, (sid, fingerprint(data, 1, True), len(grams), band_keys(grams))):
                c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "__k1", "__k2")), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                                         names=["doc_id", "__k1", "__k2", "sid", "fp", "n", "bands"])

    return map_batches(rows, one, "doc_id bigint, __k1 bigint, __k2 bigint, sid bigint, fp bigint, n bigint, bands array<bigint>")


def candidate_links(values: DataFrame, *, radius: int = 3, segments: int = 8) -> DataFrame:
    """``(a, b)`` links of sets that share a band or have fingerprints within ``radius``.

    ``values`` has one row ``(sid, fp, bands)`` per set.  The keys of this ring
    have 32 bits; those of wider radii have fewer, and the sets that meet in
    them by chance would grow with the square of the corpus.
    """
    keys = values.select("sid", F.posexplode(F.concat("bands", F.array("fp"))).alias("kid", "key"))
    first = keys.groupBy("kid", "key").agg(F.min("sid").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = keys.join(first, ["kid", "key"]).select("a", F.col("sid").alias("b"))
    prints = stored(values.groupBy("fp").agg(F.min("sid").alias("sid")), "prints")
    ringed = links(prints.select("fp"), radius=radius, segments=segments).distinct()
    for side in ("a", "b"):
        ringed = ringed.join(prints.select(F.col("fp").alias(side), F.col("sid").alias("__sid")), side).withColumn(side, F.col("__sid")).drop("__sid")
    return met.where("a <> b").union(ringed.select("a", "b"))


def confirmed(sets: list[np.ndarray], sides: np.ndarray | None, least: float) -> list[tuple[int, int]]:
    """Links of a spanning forest of the sets within ``least``: of all, or between the two sides.

    As in ``simhash._spread`` a found set is not looked for again.
    """
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    mark = np.zeros(int(flat.max()) + 1, dtype=bool)
    alive, out = np.ones(len(sets), dtype=bool), []
    for seed in range(len(sets)):
        if not alive[seed]:
            continue
        alive[seed], queue = False, [seed]
        while queue:
            p = queue.pop()
            near = alive & (sizes >= least * sizes[p] - 1) & (sizes * least - 1 <= sizes[p])
            if sides is not None:
                near &= sides != sides[p]
            where = np.flatnonzero(near)
            if not len(where):
                continue
            own = flat[starts[p] : ends[p]]
            mark[own] = True
            if 4 * len(where) < len(sets):
                shared = np.array([np.count_nonzero(mark[flat[starts[i] : ends[i]]]) for i in where])
            else:
                shared = np.add.reduceat(mark[flat], starts, dtype=np.int64)[where]
            mark[own] = False
            # a quotient of integers and the decimal literal round alike
            found = where[shared / (sizes[where] + sizes[p] - shared) >= least]
            alive[found] = False
            out += [(p, int(q)) for q in found]
            queue += found.tolist()
    return out


def _confirm(least: float):
    """Map over rows sorted by (root, left, right): confirmed links of each run."""
    names = ["root", "left", "right", "block", "sid", "grams"]

    def flush(rows):
        sets = [np.frombuffer(g, dtype="<u8") for g in rows["grams"]]
        blocks = np.array(rows["block"])
        sides = None if rows["left"][0] == rows["right"][0] else blocks == rows["left"][0]
        return [(rows["sid"][i], rows["sid"][j]) for i, j in confirmed(sets, sides, least)]

    def run(batches):
        held = {n: [] for n in names}
        for batch in batches:
            out = []
            for row in zip(*(batch.column(n).to_pylist() for n in names)):
                if held["root"] and row[:3] != tuple(held[n][0] for n in names[:3]):
                    out += flush(held)
                    held = {n: [] for n in names}
                for n, v in zip(names, row):
                    held[n].append(v)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])
        out = flush(held) if held["root"] else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

    return run


def confirmed_links(docs: DataFrame, values: DataFrame, candidates: DataFrame, *, shingle: int, least: float, doc_id: str = "doc_id", text: str = "text",
                    shingles: int = SHINGLES) -> DataFrame:
    """``(a, b)`` links that connect all sets of one candidate component that reach ``least``."""
    members = candidates.withColumnRenamed("node", "sid").join(values.select("sid", "n", "first"), "sid")
    members = stored(members.select("sid", "root", "n", F.col("first.__k1").alias("__k1"), F.col("first.__k2").alias("__k2")), "members")
    sizes = members.groupBy("root").agg(F.ceil(F.sum("n") / F.lit(shingles)).cast("int").alias("blocks"))
    dealt = members.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "sid"), F.col("blocks")).cast("int"))
    ident, body = long_id(docs, doc_id), docs[f"`{text}`"].cast("string")
    # of rows that repeat an id and its text one is enough
    texts = docs.select(body.alias("text"), *row_key(ident, docs[f"`{text}`"])).join(dealt, ["__k1", "__k2"]).select("root", "blocks", "block", "sid", "text").dropDuplicates(["sid"])

    def one(batch):
        grams = [shingle_set(t, shingle).astype("<u8").tobytes() for t in utf8(batch.column("text"))]
        kept = ["root", "blocks", "block", "sid"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(grams, pa.binary())], names=[*kept, "grams"])

    sets = map_batches(texts, one, "root bigint, blocks int, block int, sid bigint, grams binary")
    dealt = sets.select("root", "block", "sid", "grams", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("root", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "sid", "grams")
    dealt = dealt.repartition("root", "left", "right").sortWithinPartitions("root", "left", "right", "sid")
    return dealt.mapInArrow(_confirm(least), "a bigint, b bigint")


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay: of every component of near copies that with the least id.

    Words are those of ``simhash_components``.  Texts shorter than a shingle are
    one shingle, texts without words are copies of each other, a null text is an
    empty one.  Rows without an id come last; ties between rows of one id go to
    the least hash of the text, and of identical rows one stays.  All columns
    are kept.
    """
    facts = stored(_facts(docs, doc_id, text, shingle), "sets")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__k1", "__k2")
    values = stored(facts.groupBy("sid").agg(F.min(place).alias("first"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("bands").alias("bands")), "values")
    candidates = components(candidate_links(values))
    reach = components(confirmed_links(docs, values, candidates, shingle=shingle, least=least, doc_id=doc_id, text=text))
    rooted = values.join(reach.withColumnRenamed("node", "sid"), "sid", "left").select("first", F.coalesce("root", "sid").alias("root"))
    return rows_of(docs, rooted, doc_id=doc_id, text=text)
