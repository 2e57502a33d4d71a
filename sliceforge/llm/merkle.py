"""Merkle manifest of a table, its subtrees stored in van Emde Boas order.

A row's leaf is the SHA-256 of its fields.  Per group (source) the leaves are in
order; three consecutive nodes become their hash, level by level, until one is
left, the subroot.  The subroots, in order of their groups, give the root alike.

On Spark, leaf ``i`` of a group is in the aligned subtree ``i div 3^HEIGHT``.
A round hashes every such subtree in a task of its own and stores its nodes as
one array; the subtrees' roots are the leaves of the next round, until each
group has one node.  The nodes of a subtree of L levels are laid out
recursively: the upper L div 2 levels, then the subtrees below them one after
another, each laid out likewise.  The place of a node follows by arithmetic
(``veb_places``), in construction as in the retrieval of siblings, and a path
from leaf to root touches few blocks of memory whatever their size.

Proofs go down the rounds: a subtree's path to the root is joined to its
leaves, whose siblings inside it come from its array.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize

FAN = 3
#: Levels of hashing in a stored subtree: 3^6 = 729 leaves, 35 kB.
HEIGHT = 6
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def field_bytes(column: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_hash(columns: list[Column]) -> Column:
    """The leaf of a row: lowercase hex SHA-256 of its fields, one after another."""
    return F.sha2(F.concat(*map(field_bytes, columns)), 256)


def nodes_in(levels: int) -> int:
    """Nodes of a full subtree of ``levels`` levels."""
    return (FAN**levels - 1) // (FAN - 1)


def veb_places(depth: int, index: np.ndarray, levels: int) -> np.ndarray:
    """Places of the nodes ``index`` at ``depth`` (0: the root) of a subtree of
    ``levels`` levels."""
    base = np.zeros(len(index), dtype=np.int64)
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        # In which of the subtrees below, and where that one begins.
        lower = levels - upper
        below = FAN ** (depth - upper)
        base = base + nodes_in(upper) + (index // below) * nodes_in(lower)
        index, depth, levels = index % below, depth - upper, lower
    return base


def levels_for(n: int) -> int:
    """Rounds of hashing until one of ``n`` nodes is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def build_subtree(leaves: list[str], height: int) -> np.ndarray:
    """All nodes (32 bytes each) above ``leaves``, in van Emde Boas order."""
    store = np.zeros((nodes_in(height + 1), 32), dtype=np.uint8)
    level = leaves
    for depth in range(height, -1, -1):
        places = veb_places(depth, np.arange(len(level)), height + 1)
        store[places] = np.frombuffer(bytes.fromhex("".join(level)), dtype=np.uint8).reshape(-1, 32)
        if depth:
            level = [hashlib.sha256("".join(level[i : i + FAN]).encode()).hexdigest() for i in range(0, len(level), FAN)]
    return store


def sibling_paths(store: np.ndarray, n: int, height: int) -> tuple[list[list[str]], list[list[str]]]:
    """For each of the ``n`` leaves, from the lowest level up: what stands before
    and behind its path's node in the run (hex digests, one after another)."""
    before: list[list[str]] = [[] for _ in range(n)]
    behind: list[list[str]] = [[] for _ in range(n)]
    count, width = n, 1
    for depth in range(height, 0, -1):
        text = store[veb_places(depth, np.arange(count), height + 1)].tobytes().hex()
        for run in range(0, count, FAN):
            last = min(run + FAN, count)
            for i in range(run, last):
                a, b = text[64 * run : 64 * i], text[64 * (i + 1) : 64 * last]
                for leaf in range(i * width, min((i + 1) * width, n)):
                    before[leaf].append(a)
                    behind[leaf].append(b)
        count, width = -(-count // FAN), width * FAN
    return before, behind


# --------------------------------------------------------------------------


def number_in_groups(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` (written already) with ``idx``, the place in its group by
    ``order`` (from 0); and the groups' sizes (group, total).

    Rows are sorted by range and written with their place in the range; what lies
    before a range follows from one small row per group and range.  Equal rows are
    told apart by their place in ``rows``, so a group of copies spreads.
    """
    named = rows.withColumn("__row", F.monotonically_increasing_id())
    keys = [F.col(group).asc(), *[F.col(c).asc_nulls_first() for c in order], F.col("__row").asc()]
    ranged = named.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = ranged.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    ranged = materialize(ranged, "merkle-order")
    parts = ranged.groupBy(group, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    parts = materialize(parts, "merkle-ranges")
    earlier = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    sizes = parts.groupBy(group).agg(F.sum("__n").alias("total"))
    numbered = ranged.join(parts.select(group, "__part", "__first", "__before"), [group, "__part"])
    numbered = numbered.withColumn("idx", F.col("__at") - F.col("__first") + F.col("__before"))
    return numbered.drop("__row", "__part", "__at", "__first", "__before"), sizes


@dataclass
class Tree:
    """A built tree: numbered leaves, per round the stored subtrees (grp, block,
    total, n, nodes, top), and each group's root (grp, root)."""

    leaves: DataFrame
    rounds: list[DataFrame]
    roots: DataFrame
    height: int


def _hash_round(leaves: DataFrame, height: int) -> DataFrame:
    """One round: (grp, idx, total, node) to its subtrees."""
    size = FAN**height

    def subtree(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        grp, block = (k.as_py() for k in key)
        total = table.column("total")[0].as_py()
        order = np.argsort(table.column("idx").to_numpy())
        nodes = table.column("node").take(pa.array(order)).to_pylist()
        # A group of one subtree ends where one node is left.
        h = height if total > size else levels_for(total)
        store = build_subtree(nodes, h)
        return pa.table(
            {
                "grp": pa.array([grp], pa.string()),
                "block": pa.array([block], pa.int64()),
                "total": pa.array([total], pa.int64()),
                "n": pa.array([len(nodes)], pa.int32()),
                "nodes": pa.array([store.tobytes()], pa.binary()),
                "top": pa.array([store[0].tobytes().hex()], pa.string()),
            }
        )

    rows = leaves.select("grp", "idx", "total", "node", F.floor(F.col("idx") / size).alias("block"))
    return rows.groupBy("grp", "block").applyInArrow(
        subtree, "grp string, block long, total long, n int, nodes binary, top string"
    )


def build_tree(rows: DataFrame, order: list[str], height: int = HEIGHT) -> Tree:
    """Trees over ``rows`` (grp string not null, node, ...), one per group, leaves
    by ``order``.  Rounds shrink the nodes by 3^height."""
    numbered, sizes = number_in_groups(rows, "grp", order)
    leaves = materialize(numbered.join(sizes, "grp"), "merkle-leaves")
    rounds = []
    level, size = leaves, FAN**height
    while True:
        made = materialize(_hash_round(level, height), "merkle-subtrees")
        rounds.append(made)
        # Groups of more than one subtree go on.
        level = made.where(F.col("total") > size).select(
            "grp", F.col("block").alias("idx"), F.ceil(F.col("total") / size).alias("total"), F.col("top").alias("node")
        )
        if level.isEmpty():
            break
    roots = None
    for made in rounds:
        done = made.where(F.col("total") <= size).select("grp", F.col("top").alias("root"))
        roots = done if roots is None else roots.unionByName(done)
    return Tree(leaves, rounds, roots, height)


PATH = "label string, before array<string>, behind array<string>"


def paths_of(tree: Tree, above: DataFrame, payload: list[str]) -> DataFrame:
    """(grp, payload..., label, before, behind): each leaf's path to the root.

    ``above`` (grp, label, up_before, up_behind) continues the paths of a group's
    root and labels its leaves.  From the last round down, each subtree's path is
    joined to its nodes.
    """
    height = tree.height
    size = FAN**height

    def walk(children: DataFrame, subtrees: DataFrame, keep: list[str]) -> DataFrame:
        types = ", ".join(f"`{c}` {children.schema[c].dataType.simpleString()}" for c in keep)

        def siblings(left: pa.Table, right: pa.Table) -> pa.Table:
            row = right.slice(0, 1).to_pylist()[0] if right.num_rows else None
            kept = left.select(keep)
            if row is None or not left.num_rows:
                none = pa.array([], pa.list_(pa.string()))
                kept = kept.slice(0, 0).append_column("label", pa.array([], pa.string()))
                return kept.append_column("before", none).append_column("behind", none)
            h = height if row["total"] > size else levels_for(row["total"])
            store = np.frombuffer(row["nodes"], dtype=np.uint8).reshape(-1, 32)
            before, behind = sibling_paths(store, row["n"], h)
            at = (left.column("idx").to_numpy() % size).tolist()
            up_before, up_behind = row["up_before"], row["up_behind"]
            kept = kept.append_column("label", pa.array([row["label"]] * len(at), pa.string()))
            return kept.append_column(
                "before", pa.array([before[i] + up_before for i in at], pa.list_(pa.string()))
            ).append_column("behind", pa.array([behind[i] + up_behind for i in at], pa.list_(pa.string())))

        left = children.withColumn("__block", F.floor(F.col("idx") / size)).groupBy("grp", "__block")
        return left.cogroup(subtrees.groupBy("top_grp", "block")).applyInArrow(siblings, f"{types}, {PATH}")

    path = None  # of the subtrees of the round above: grp, idx, label, before, behind
    cols = [F.col("grp").alias("top_grp"), "block", "total", "n", "nodes", "label", "up_before", "up_behind"]
    for i, made in enumerate(reversed(tree.rounds)):
        ended = made.where(F.col("total") <= size).join(above, "grp")
        subtrees = ended.select(*cols)
        if path is not None:
            inner = made.where(F.col("total") > size).join(
                path.select("grp", F.col("idx").alias("block"), "label", F.col("before").alias("up_before"), F.col("behind").alias("up_behind")),
                ["grp", "block"],
            )
            subtrees = subtrees.unionByName(inner.select(*cols))
        if i == len(tree.rounds) - 1:
            return walk(tree.leaves, subtrees, ["grp", *payload])
        below = tree.rounds[len(tree.rounds) - 2 - i]
        children = below.where(F.col("total") > size).select("grp", F.col("block").alias("idx"))
        path = materialize(walk(children, subtrees, ["grp", "idx"]), "merkle-paths")
    raise AssertionError("a tree has a round")


def fold(leaf: Column, before: Column, behind: Column) -> Column:
    """The root that a leaf and its path give."""
    steps = F.arrays_zip(before.alias("a"), behind.alias("b"))
    return F.aggregate(steps, leaf, lambda node, s: F.sha2(F.concat(s["a"], node, s["b"]), 256))


def proof_hash(before: Column, behind: Column) -> Column:
    """SHA-256 of a path's siblings, one after another."""
    return F.sha2(F.array_join(F.zip_with(before, behind, lambda a, b: F.concat(a, b)), ""), 256)


def merkle_manifest(
    df: DataFrame,
    id_col: str = "doc_id",
    group_col: str = "source",
    columns: list[str] | None = None,
    presented: Callable[[Column, str], Column] | None = None,
    height: int = HEIGHT,
) -> DataFrame:
    """One row per row of ``df``: doc_id, leaf, subroot, root, before, behind,
    presented (the leaf to be verified).

    ``presented(column, name)`` gives a column of the rows that are held against the
    manifest; without it they are the rows themselves.  Defined cases: a null
    group is one of its own and comes first; null ids come first in their group;
    rows of one id are in the order of their leaves, equal rows in any order; texts
    are hashed whole; a group of one row has its leaf as subroot, a table of one
    group its subroot as root; an empty table gives no rows; other columns are
    ignored.  A group that holds a third of all rows is spread: no task sees more
    than a range of it or a subtree.
    """
    spark = df.sparkSession
    names = columns or COLUMNS
    cols = [F.col(c) for c in names]
    leaf = leaf_hash(cols)
    shown = leaf if presented is None else leaf_hash([presented(c, n) for c, n in zip(cols, names, strict=True)])
    rows = df.select(
        F.coalesce(F.concat(F.lit("s"), F.col(group_col).cast("string")), F.lit("n")).alias("grp"),
        F.col(id_col).alias("id"),
        leaf.alias("node"),
        shown.alias("shown"),
    )
    rows = materialize(rows.withColumn("shown", F.when(F.col("shown") != F.col("node"), F.col("shown"))), "merkle-rows")
    tree = build_tree(rows, ["id", "node"], height)
    # The subroots are the leaves of one more tree.
    subroots = materialize(
        tree.roots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("root").alias("node")), "merkle-subroots"
    )
    if subroots.isEmpty():
        return rows.select(
            F.col("id").alias("doc_id"), F.col("node").alias("leaf"), F.col("node").alias("subroot"), F.col("node").alias("root"),
            F.array().cast("array<string>").alias("before"), F.array().cast("array<string>").alias("behind"),
            F.col("node").alias("presented"),
        )
    top = build_tree(subroots, ["name"], height)
    root = top.roots.first()["root"]  # one row
    nothing = F.array().cast("array<string>")
    origin = spark.range(1).select(
        F.lit("").alias("grp"), F.lit("").alias("label"), nothing.alias("up_before"), nothing.alias("up_behind")
    )
    above = paths_of(top, origin, ["name", "node"])
    above = materialize(
        above.select(F.col("name").alias("grp"), F.col("node").alias("label"), F.col("before").alias("up_before"), F.col("behind").alias("up_behind")),
        "merkle-group-paths",
    )
    found = paths_of(tree, above, ["id", "node", "shown"])
    return found.select(
        F.col("id").alias("doc_id"),
        F.col("node").alias("leaf"),
        F.col("label").alias("subroot"),
        F.lit(root).alias("root"),
        "before",
        "behind",
        F.coalesce("shown", "node").alias("presented"),
    )


def verification_digests(manifest: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    folded = manifest.withColumn("folded_root", fold(F.col("presented"), F.col("before"), F.col("behind")))
    return folded.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        proof_hash(F.col("before"), F.col("behind")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def without_line_ends(id_col: str = "doc_id", text_col: str = "text") -> Callable[[Column, str], Column]:
    """A tampering: where 2 divides the CRC-32 of the decimal id, the text has lost
    its line ends (nulls stay)."""

    def shown(column: Column, name: str) -> Column:
        if name != text_col:
            return column
        chosen = F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0
        return F.when(chosen, F.translate(column, "\n", "")).otherwise(column)

    return shown
