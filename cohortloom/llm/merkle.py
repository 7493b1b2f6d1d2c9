"""Merkle manifest of a table: digests, proofs and folding from kept hash states.

A leaf is the SHA-256 of a row. The leaves of a group, in the order of their keys, form a tree: while more than one node is
left, every ``fanout`` consecutive nodes (the last run may be shorter) become the hash of their digests. What remains is the
group's subroot, and the subroots, in the order of the groups, form the tree above.

A parent hashes its children one after another and keeps a copy of the hash state before each child slot. Folding a changed
leaf goes up its path: the state kept before its slot is taken up again with the new digest and the siblings to the right
only; what lies to the left is never hashed again.

Trees are worked on in aligned pieces of about ``PIECE`` nodes, several levels at a time: a first pass from the leaves up
leaves one node per piece, a second one from the root down hands every piece the path above it. A task holds one piece, its
states and one path, whatever the size of the table.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.llm.components import settled

#: Nodes of a piece of a tree, at most (at least one run).
PIECE = 1_024
#: Bits of ``monotonically_increasing_id`` that count the rows of a partition.
ROW_BITS = 33

_PATH = "array<struct<before:string,after:string>>"
_PATH_ARROW = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the fields of a row."""
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


class Tree:
    """An aligned piece of a tree: the digests of each level, and the hash states before each child slot."""

    def __init__(self, digests: Sequence[bytes], fanout: int, levels: int):
        self.fanout = fanout
        self.rows, self.states = [list(digests)], []
        for _ in range(levels):
            parents, held = [], []
            for at in range(0, len(self.rows[-1]), fanout):
                state = hashlib.sha256()
                for digest in self.rows[-1][at : at + fanout]:
                    held.append(state.copy())
                    state.update(digest)
                parents.append(state.hexdigest().encode())
            self.states.append(held)
            self.rows.append(parents)

    def siblings(self, place: int) -> list[tuple[bytes, bytes]]:
        """The digests before and after the node in its run, level by level."""
        out = []
        for row in self.rows[:-1]:
            first = place - place % self.fanout
            out.append((b"".join(row[first:place]), b"".join(row[place + 1 : first + self.fanout])))
            place //= self.fanout
        return out

    def fold(self, place: int, digest: bytes) -> bytes:
        """The piece's top digest if the node at ``place`` had this digest."""
        for row, held in zip(self.rows, self.states):
            end = place - place % self.fanout + self.fanout
            digest = resumed(held[place], digest, row[place + 1 : end])
            place //= self.fanout
        return digest


def resumed(state, digest: bytes, right: Iterable[bytes]) -> bytes:
    """The parent's digest from the state before a child slot, the child's digest and the siblings to its right."""
    state = state.copy()
    state.update(digest)
    for sibling in right:
        state.update(sibling)
    return state.hexdigest().encode()


class Path:
    """The levels above a piece: the states before its slots are made once and taken up for every node of the piece."""

    def __init__(self, levels: Iterable[dict]):
        self.levels = [(hashlib.sha256(level["before"].encode()), level["after"].encode()) for level in levels]

    def fold(self, digest: bytes) -> bytes:
        for state, after in self.levels:
            digest = resumed(state, digest, (after,))
        return digest


def levels_of(nodes: int, fanout: int, most: int) -> int:
    """Levels until one node is left, ``most`` at most."""
    n = 0
    while nodes > 1 and n < most:
        nodes, n = -(-nodes // fanout), n + 1
    return n


def _stage_levels(fanout: int) -> int:
    n = 1
    while fanout ** (n + 1) <= PIECE:
        n += 1
    return n


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by("pos")


def _tops(fanout: int, levels: int) -> Callable[[pa.Table], pa.Table]:
    def top(table: pa.Table) -> pa.Table:
        table = _sorted(table)
        total = table["total"][0].as_py()
        tree = Tree([d.encode() for d in table["digest"].to_pylist()], fanout, levels_of(total, fanout, levels))
        return table.slice(0, 1).select(["tree", "piece"]).append_column("digest", pa.array([tree.rows[-1][0].decode()]))

    return top


def _split(table: pa.Table) -> tuple[pa.Table, dict]:
    """The nodes of a piece in order, and the row that brought its path (place -1)."""
    table = _sorted(table)
    return table.slice(1), table.select(["above", "subroot", "root"]).slice(0, 1).to_pylist()[0]


def _paths(fanout: int, levels: int) -> Callable[[pa.Table], pa.Table]:
    def down(table: pa.Table) -> pa.Table:
        nodes, top = _split(table)
        tree = Tree([d.encode() for d in nodes["digest"].to_pylist()], fanout, levels_of(nodes["total"][0].as_py(), fanout, levels))
        above = [_path(tree.siblings(i)) + top["above"] for i in range(nodes.num_rows)]
        return pa.table({"tree": nodes["tree"], "pos": nodes["pos"], "above": pa.array(above, _PATH_ARROW), **_repeated(top, len(above))})

    return down


def _repeated(top: dict, n: int) -> dict[str, pa.Array]:
    return {name: pa.array([top[name]] * n, pa.string()) for name in ("subroot", "root")}


def _path(siblings: list[tuple[bytes, bytes]]) -> list[dict]:
    return [{"before": b.decode(), "after": a.decode()} for b, a in siblings]


def _folded(fanout: int, levels: int) -> Callable[[pa.Table], pa.Table]:
    def down(table: pa.Table) -> pa.Table:
        nodes, top = _split(table)
        tree = Tree([d.encode() for d in nodes["digest"].to_pylist()], fanout, levels_of(nodes["total"][0].as_py(), fanout, levels))
        path = Path(top["above"])
        claims = nodes["claim"].to_pylist()
        above = [_path(tree.siblings(i)) + top["above"] for i in range(nodes.num_rows)]
        folded = [path.fold(tree.fold(i, c.encode())).decode() for i, c in enumerate(claims)]
        return pa.table({"key": nodes["key"], "tree": nodes["tree"], "leaf": nodes["digest"], "claim": nodes["claim"], **_repeated(top, len(claims)), "proof": pa.array(above, _PATH_ARROW), "folded_root": pa.array(folded, pa.string())})

    return down


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with pos, the place (from 0) in the tree's order, and total, the tree's number of rows; nulls come first.

    Rows are dealt by ranges of (tree, order) and numbered in their range; one row per range and tree carries the numbers
    across. ``rows`` must be settled: equal rows are told apart by where they are stored.
    """
    by = [F.asc_nulls_first(c) for c in ["tree", *order]] + [F.asc("_tie")]
    tied = settled(rows.withColumn("_tie", F.monotonically_increasing_id()))
    ranged = tied.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie").withColumn("_row", F.monotonically_increasing_id())
    ranged = settled(ranged.withColumn("_range", F.shiftright("_row", ROW_BITS)))
    counts = ranged.groupBy("tree", "_range").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("tree")
    earlier = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("tree").alias("_tree"),
        F.col("_range").alias("_of"),
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(whole).alias("total"),
    )
    same = ranged["tree"].eqNullSafe(starts["_tree"]) & (ranged["_range"] == starts["_of"])
    return ranged.join(starts, same).withColumn("pos", F.col("_row") + F.col("_shift")).drop("_row", "_range", "_tree", "_of", "_shift")


def _stages(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """The nodes (tree, pos, total, digest) of each stage, up to the one in which every tree has a single node left."""
    levels = _stage_levels(fanout)
    size = fanout**levels
    group = nodes.schema["tree"].dataType.simpleString()
    out = [nodes]
    while (out[-1].agg(F.max("total")).first()[0] or 0) > 1:
        pieces = out[-1].select("tree", "pos", "total", "digest", _piece(size).alias("piece"))
        tops = pieces.groupBy("tree", "piece").applyInArrow(_tops(fanout, levels), f"tree {group}, piece long, digest string")
        totals = out[-1].where(F.col("pos") % size == 0).select(F.col("tree").alias("_tree"), _piece(size).alias("_pos"), F.expr(f"(total + {size - 1}) div {size}").alias("total"))
        same = tops["tree"].eqNullSafe(totals["_tree"]) & (tops["piece"] == totals["_pos"])
        out.append(settled(tops.join(totals, same).select("tree", F.col("piece").alias("pos"), "total", "digest")))
    return out


def _piece(size: int) -> Column:
    return F.expr(f"pos div {size}")


def _with_path(nodes: DataFrame, paths: DataFrame, size: int) -> DataFrame:
    """Nodes and, at place -1 of each piece, the path of the piece (stored under the piece's number)."""
    marked = paths.select("tree", F.col("pos").alias("piece"), F.lit(-1).cast("long").alias("pos"), "above", "subroot", "root")
    return nodes.withColumn("piece", _piece(size)).unionByName(marked, allowMissingColumns=True)


def _paths_down(stages: list[DataFrame], top: DataFrame, fanout: int) -> DataFrame:
    """Paths of the pieces of the first stage, from those of the trees' tops (tree, pos, above, subroot, root)."""
    levels = _stage_levels(fanout)
    group = top.schema["tree"].dataType.simpleString()
    for nodes in reversed(stages[1:-1]):
        pieces = _with_path(nodes, top, fanout**levels)
        top = settled(pieces.groupBy("tree", "piece").applyInArrow(_paths(fanout, levels), f"tree {group}, pos long, above {_PATH}, subroot string, root string"))
    return top


def manifest(leaves: DataFrame, key: str = "doc_id", group: str = "lang", leaf: str = "leaf", claim: str | None = None, fanout: int = 2) -> DataFrame:
    """One row per leaf: key, group, leaf, claim, subroot, root, proof, folded_root.

    ``leaves`` holds a key, a group and the leaf digest (hex text), and possibly the digest that somebody claims for the row
    (``claim``; the leaf itself without one). proof lists the siblings (before, after) from the leaf's run to the root;
    folded_root is the root that follows from the claim and the proof. Nulls in key and group are values that come first;
    equal keys follow the order of their digests, and repeated rows are leaves of their own. Other columns are ignored, so
    names can't clash. An empty table has no rows. A single leaf is its subroot; a single group's subroot is the root.
    """
    if fanout < 2:
        raise ValueError("a run needs at least two nodes")
    rows = leaves.select(F.col(key).alias("key"), F.col(group).alias("tree"), F.col(leaf).alias("digest"), F.col(claim or leaf).alias("claim"))
    nodes = settled(_placed(rows, ["key", "digest"]))
    stages = _stages(nodes, fanout)
    subroots = stages[-1].where("pos = 0").select(F.lit(0).alias("tree"), F.col("tree").alias("of"), "digest")
    groups = settled(_placed(subroots, ["of"]))
    group_stages = _stages(groups.select("tree", "pos", "total", "digest"), fanout)
    root = group_stages[-1].select("tree", "pos", F.expr(f"cast(array() AS {_PATH})").alias("above"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    size = fanout ** _stage_levels(fanout)
    group_paths = _paths_down(group_stages, root, fanout)
    pieces = _with_path(groups.select("tree", "pos", "total", "digest"), group_paths, size)
    each = pieces.groupBy("tree", "piece").applyInArrow(_paths(fanout, _stage_levels(fanout)), f"tree int, pos long, above {_PATH}, subroot string, root string")
    tops = groups.join(each.select("pos", "above", "root"), "pos").select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("pos"), "above", F.col("digest").alias("subroot"), "root")
    paths = _paths_down(stages, settled(tops), fanout)
    found = _with_path(nodes, paths, size).groupBy("tree", "piece").applyInArrow(_folded(fanout, _stage_levels(fanout)), _found_schema(rows))
    return found.withColumnsRenamed({"key": key, "tree": group})


def _found_schema(rows: DataFrame) -> T.StructType:
    text = [T.StructField(name, T.StringType()) for name in ("leaf", "claim", "subroot", "root")]
    path = T.ArrayType(T.StructType([T.StructField("before", T.StringType()), T.StructField("after", T.StringType())]))
    return T.StructType([rows.schema["key"], rows.schema["tree"], *text, T.StructField("proof", path), T.StructField("folded_root", T.StringType())])


def proof_text(proof: str = "proof") -> Column:
    """The siblings of a proof one after another, level by level, from left to right."""
    return F.array_join(F.transform(proof, lambda level: F.concat(level["before"], level["after"])), "")
