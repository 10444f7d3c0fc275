"""Merkle manifest of a table: a hash tree per group of rows, one root above all.

Leaves stand in their order in aligned blocks of ``FANOUT ** LEVELS``, so that a
block is a whole subtree.  Every block hashes its own subtree; then the blocks
exchange roots as in a butterfly.  In a round, the blocks of up to ``FANOUT``
neighbouring subtrees form a group: a block takes the root of each of them from
the block that has its own place there, and hashes the parent itself, as all
others of the group do.  After the last round every block has the root and all
upper siblings of its leaves, and no pass down the tree is needed.  If a subtree
has fewer blocks than its neighbours, its blocks serve several places each.
The trees of the groups are joined by further rounds of the same kind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.llm.shared import long_id, stored

FANOUT = 8
#: Levels of a block's own subtree: 4,096 leaves, under a megabyte in a task.
LEVELS = 4
#: Blocks that one copy of a sender serves; a sender with more takers is repeated.
TAKERS = 4096
_PATH = "array<struct<pos:int,nodes:array<string>>>"


def digest(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def levels(leaves: list[str], up: int | None) -> list[list[str]]:
    """The levels of a tree over ``leaves``: ``up`` of them above the leaves, or all up to the root."""
    found = [leaves]
    while len(found) <= up if up is not None else len(found[-1]) > 1:
        below = found[-1]
        found.append([digest(below[i : i + FANOUT]) for i in range(0, len(below), FANOUT)])
    return found


def steps(tree: list[list[str]], at: int) -> Iterator[tuple[int, list[str]]]:
    """From a leaf upwards: its position in the run and the run."""
    for level in tree[:-1]:
        first = at - at % FANOUT
        yield at - first, level[first : first + FANOUT]
        at //= FANOUT


def fold(leaf: str, path: list[tuple[int, list[str]]]) -> str:
    """The root that follows from a leaf and the runs on its way."""
    for pos, run in path:
        leaf = digest([*run[:pos], leaf, *run[pos + 1 :]])
    return leaf


def siblings(path: list[tuple[int, list[str]]]) -> list[str]:
    return [node for pos, run in path for node in run[:pos] + run[pos + 1 :]]


def leaf_of(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each its byte length and value, or ``-`` for null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add ``number`` from 0 in the order of ``order``, over range partitions and their counts."""
    placed = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__row", F.monotonically_increasing_id()), name)
    part, nth = F.shiftright("__row", 33), F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    # one row per partition
    starts = counts.select("__part", F.coalesce(F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    return placed.join(F.broadcast(starts), part == F.col("__part")).withColumn("number", F.col("__start") + nth).drop("__row", "__part", "__start")


def _by_block(rows: DataFrame, one: Callable[[list[dict]], pa.RecordBatch], schema: str) -> DataFrame:
    """Map over the rows of every block, in their order."""

    def run(batches):
        each = (row for batch in batches for row in batch.to_pylist())
        for _, block in groupby(each, key=lambda row: (row["tree"], row["block"])):
            yield one(list(block))

    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "rank").mapInArrow(run, schema)


def _own_tree(leaves: list[dict], height: int) -> list[list[str]]:
    return levels([r["leaf"].hex() for r in leaves], height if leaves[0]["blocks"] > 1 else None)


def _root(height: int):
    kinds = pa.schema([("tree", pa.int64()), ("block", pa.int64()), ("root", pa.string())])

    def one(leaves: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"tree": leaves[0]["tree"], "block": leaves[0]["block"], "root": _own_tree(leaves, height)[-1][0]}], kinds)

    return one


def exchange(state: DataFrame) -> DataFrame:
    """One round for the trees that have more than one subtree.

    ``state`` has a row per block: ``tree, block`` name it; ``top`` the tree it
    is in, ``unit`` its subtree there, ``at`` its place among the blocks of the
    subtree, ``root`` the subtree's root and ``path`` the runs above the block.
    """
    sizes = state.groupBy("top", "unit").agg(F.count("*").alias("size"))
    runs = sizes.groupBy("top", F.floor(F.col("unit") / FANOUT).alias("run")).agg(F.sort_array(F.collect_list(F.struct("unit", "size"))).alias("peers"))
    several = sizes.groupBy("top").agg(F.count("*").alias("units")).where("units > 1").select("top")
    runs = stored(runs.join(several, "top").withColumn("most", F.array_max("peers.size")), "runs")
    pos = F.pmod("unit", F.lit(FANOUT)).cast("int")
    known = state.withColumn("run", F.floor(F.col("unit") / FANOUT)).join(runs, ["top", "run"], "left").withColumn("pos", pos)
    takes = known.where("peers is not null").select("tree", "block", "top", "at", F.explode("peers").alias("peer")).select(
        "tree", "block", "top", F.col("peer.unit").alias("unit"), F.pmod("at", "peer.size").alias("at"), F.floor(F.col("at") / F.col("peer.size") / TAKERS).alias("copy"))
    own = F.get(F.col("peers"), F.col("pos"))["size"]
    gives = known.where("peers is not null").select("top", "unit", "at", "root", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("most") - 1) / own / TAKERS))).alias("copy"))
    got = takes.join(gives, ["top", "unit", "at", "copy"]).groupBy("tree", "block").agg(F.sort_array(F.collect_list(F.struct("unit", "root")))["root"].alias("nodes"))
    before = F.aggregate(F.slice("peers", F.lit(1), F.col("pos")), F.lit(0).cast("bigint"), lambda s, p: s + p["size"])
    moved = known.join(got, ["tree", "block"], "left")
    met = F.col("nodes").isNotNull()
    return moved.select("tree", "block", "subroot", "top", F.when(met, F.col("run")).otherwise(F.col("unit")).alias("unit"),
                        F.when(met, F.col("at") + before).otherwise(F.col("at")).alias("at"),
                        F.when(met, F.sha2(F.concat_ws("", "nodes"), 256)).otherwise(F.col("root")).alias("root"),
                        F.when(met, F.concat("path", F.array(F.struct("pos", "nodes")))).otherwise(F.col("path")).cast(_PATH).alias("path"))


def _rounds(state: DataFrame) -> DataFrame:
    state = stored(state, "blocks")
    while (state.agg(F.max("unit")).first()[0] or 0) > 0:
        state = stored(exchange(state), "blocks")
    return state


def _proofs(height: int, proofs: bool):
    kinds = [("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string())]
    if proofs:
        kinds.append(("proof", pa.list_(pa.struct([("pos", pa.int32()), ("nodes", pa.list_(pa.string()))]))))

    def one(rows: list[dict]) -> pa.RecordBatch:
        above, leaves = rows[0], rows[1:]
        upper = [(s["pos"], s["nodes"]) for s in above["path"]]
        tail, tree, out = "".join(siblings(upper)), _own_tree(leaves, height), []
        for at, row in enumerate(leaves):
            lower = list(steps(tree, at))
            told = row["claimed"] or row["leaf"]
            out.append({"doc_id": row["doc_id"], "leaf": tree[0][at], "subroot": above["subroot"], "root": above["root"],
                        "proof_sha256": digest([*siblings(lower), tail]), "folded_root": fold(told.hex(), lower + upper)})
            if proofs:
                out[-1]["proof"] = [{"pos": p, "nodes": run[:p] + run[p + 1 :]} for p, run in lower + upper]
        return pa.RecordBatch.from_pylist(out, pa.schema(kinds))

    return one


def manifest(docs: DataFrame, *, fields: list[str], group: str = "lang", doc_id: str = "doc_id", claimed: dict[str, Column] | None = None,
             when: Column | None = None, proofs: bool = False, height: int = LEVELS) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified[, proof])`` per row.

    A leaf hashes ``fields``.  The leaves of a ``group`` value stand by id (null
    first), repeated ids by leaf, repeated rows in any order, which changes
    nothing; runs of eight are hashed until one node is left, the subroot, and
    the subroots in the order of the values (null first) likewise to the root.
    ``proof_sha256`` hashes the siblings on the way from the leaf to the root.

    Blocks have up to ``8 ** height`` leaves.

    ``claimed`` gives other contents of fields, as a copy of the table may have
    them, ``when`` the rows to which they apply: ``folded_root`` is the root
    that follows from such a leaf and the true siblings, ``verified`` whether it
    is the root.  ``proof`` lists each level's position and siblings.

    Null fields have a leaf of their own, distinct from empty ones; long texts
    are only hashed; columns other than fields, group and id are left out.  An
    empty table gives an empty result.
    """
    true = [docs[f"`{f}`"] for f in fields]
    other = leaf_of([(claimed or {}).get(f, c) for f, c in zip(fields, true)])
    told = F.when(F.lit(bool(claimed)) & (when if when is not None else F.lit(True)), F.unhex(other))
    leaves = stored(docs.select(long_id(docs, doc_id).alias("doc_id"), docs[f"`{group}`"].alias("value"), F.unhex(leaf_of(true)).alias("leaf"), told.alias("claimed"),
                                F.xxhash64(F.monotonically_increasing_id()).alias("tie")), "leaves")
    ranked = numbered(leaves, ["value", "doc_id", "leaf", "tie"], "ranked").drop("tie")
    values = numbered(ranked.groupBy("value").agg(F.min("number").alias("first"), F.count("*").alias("rows")), ["value"], "values")
    values = stored(values.select(F.col("value").alias("__value"), "first", "rows", F.col("number").alias("tree")), "trees")
    size = FANOUT**height
    rank = F.col("number") - F.col("first")
    placed = ranked.join(values, ranked["value"].eqNullSafe(values["__value"])).select(
        "tree", F.floor(rank / size).alias("block"), rank.alias("rank"), "doc_id", "leaf", "claimed", F.ceil(F.col("rows") / size).alias("blocks"))
    placed = stored(placed, "placed")
    roots = _by_block(placed.select("tree", "block", "rank", "leaf", "blocks"), _root(height), "tree bigint, block bigint, root string")
    start = roots.select("tree", "block", F.lit(None).cast("string").alias("subroot"), F.col("tree").alias("top"), F.col("block").alias("unit"), F.lit(0).cast("bigint").alias("at"),
                         "root", F.array().cast(_PATH).alias("path"))
    inside = _rounds(start)
    above = _rounds(inside.withColumns({"subroot": F.col("root"), "top": F.lit(0).cast("bigint"), "unit": F.col("tree"), "at": F.col("block")}))
    both = placed.unionByName(above.select("tree", "block", "subroot", "root", "path", F.lit(-1).cast("bigint").alias("rank")), allowMissingColumns=True)
    schema = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string" + f", proof {_PATH}" * proofs
    found = _by_block(both, _proofs(height, proofs), schema)
    return found.select("*", (F.col("folded_root") == F.col("root")).alias("verified"))
