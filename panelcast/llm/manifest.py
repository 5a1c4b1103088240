"""Merkle manifest of a corpus as a persistent tree, with a version per changed row.

Every row is a leaf. The rows of a source, in order of doc_id, form a tree whose runs of
``ARITY`` consecutive nodes hash to their parent until one node, the subroot, is left; the
subroots, in order of source, form the tree of the root in the same way.

A tree is cut into aligned blocks of ``BLOCK = ARITY**HEIGHT`` leaves. A task holds the
nodes of one block and never more. Inside, :class:`PersistentTree` only adds nodes: a
version with another leaf has new nodes for this leaf and its ancestors, and shares all
others with the first version. The roots of blocks are the leaves of the next round, so
each round divides a tree by ``BLOCK``; the rounds run on Spark until every tree has one
node. What a version needs above its block is the path from the block to the root, the
same for the whole block; it reaches the block's rows by a cogroup on (source, block), and
the versions go on from there. So a source with any share of the rows is spread evenly, as
all groups have at most ``BLOCK`` rows.

Positions come from a range partitioning by (source, doc_id, leaf, row), whose keys are all
different, and sums over one row per source and partition. Texts are read once, for the
digests, and are not shuffled. Nothing is broadcast by hint and nothing reaches the driver
but two counts (rows of the largest tree, number of sources).

Defined cases: a null field is ``-``; a null source is a source of its own, before all
others; rows with a null doc_id come first in their source and are never marked as changed;
rows with the same source and doc_id are in order of their leaves (equal leaves are
interchangeable); empty texts are ``0:``; texts of any length are hashed whole; an empty table
gives an empty result; a tree with one leaf has this leaf as its root and no siblings; other
columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.session import materialize

ARITY = 3
#: Levels inside a block, and its leaves (2,187).
HEIGHT = 7
BLOCK = ARITY**HEIGHT

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
TREE = ["known", "name"]
PATH = "array<struct<left: string, right: string>>"


def digest(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    count = 0
    while n > 1:
        n, count = -(-n // ARITY), count + 1
    return count


class PersistentTree:
    """Nodes are numbered and only ever added; a version is the number of its root."""

    def __init__(self, leaves: list[str], height: int) -> None:
        self.digests: list[str] = []
        self.children: list[tuple[int, ...]] = []
        row = [self.add(leaf, ()) for leaf in leaves]
        self.rows = [row]
        for _ in range(height):
            row = [self.parent(row[i : i + ARITY]) for i in range(0, len(row), ARITY)]
            self.rows.append(row)
        self.root = row[0]

    def add(self, own: str, children: tuple[int, ...]) -> int:
        self.digests.append(own)
        self.children.append(children)
        return len(self.digests) - 1

    def parent(self, children: list[int]) -> int:
        return self.add(digest([self.digests[c] for c in children]), tuple(children))

    def version(self, place: int, leaf: str) -> list[int]:
        """Replaces one leaf: the added nodes, from the leaf to the version's root.
        Everything beside this path is shared."""
        copied = [self.add(leaf, ())]
        for row in self.rows[:-1]:
            first = place - place % ARITY
            run = row[first : first + ARITY]
            run[place - first] = copied[-1]
            copied.append(self.parent(run))
            place //= ARITY
        return copied

    def siblings(self, place: int) -> list[tuple[str, str]]:
        """Digests left and right of the path, level by level."""
        path = []
        for row in self.rows[:-1]:
            first = place - place % ARITY
            run = [self.digests[node] for node in row[first : first + ARITY]]
            path.append(("".join(run[: place - first]), "".join(run[place - first + 1 :])))
            place //= ARITY
        return path


def fold(leaf: str, path: list[tuple[str, str]]) -> list[str]:
    """The nodes above a leaf, recomputed from the siblings on its path."""
    out = [leaf]
    for left, right in path:
        out.append(digest([left, out[-1], right]))
    return out


def field(column: Column) -> Column:
    text = column.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(text: Column) -> Column:
    return F.sha2(F.concat(*[field(text if c == "text" else F.col(c)) for c in FIELDS]), 256)


def without_line_feeds(text: Column) -> Column:
    return F.translate(text, "\n", "")


def marked(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 2 == 0, F.lit(False))


def hashed_rows(docs: DataFrame, change=without_line_feeds, where=marked) -> DataFrame:
    """doc_id, the source as (known, name), leaf, and other: the leaf after ``change`` of
    the text, null for rows not marked."""
    other = F.when(where(F.col("doc_id")), leaf_digest(change(F.col("text").cast("string"))))
    return docs.select(
        "doc_id",
        F.col("source").isNotNull().cast("int").alias("known"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("name"),
        leaf_digest(F.col("text")).alias("leaf"),
        other.alias("other"),
    )


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, their place in the tree they belong to in the given order,
    and ``n``, the rows of this tree."""
    own = rows.columns
    tied = materialize(rows).withColumn("tie", F.monotonically_increasing_id())
    by = [F.asc_nulls_first(c) for c in [*TREE, *order, "tie"]]
    ordered = tied.repartitionByRange(*by).sortWithinPartitions(*by).drop("tie")
    ordered = materialize(ordered.withColumn("at", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("part", F.shiftright("at", 33))
    runs = ordered.groupBy(*TREE, "part").agg(F.min("at").alias("begin"), F.count("*").alias("size"))
    tree = Window.partitionBy(*TREE)
    before = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        *TREE,
        "part",
        (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("begin")).alias("shift"),
        F.sum("size").over(tree).alias("n"),
    )
    joined = ordered.join(runs, [*TREE, "part"])
    return joined.select(*own, (F.col("at") + F.col("shift")).alias("pos"), "n")


def block_of(pos: str = "pos") -> Column:
    return F.expr(f"{pos} DIV {BLOCK}")


def tree_of(table: pa.Table) -> tuple[list[int], PersistentTree]:
    """The block's persistent tree, and which row of the table each leaf is."""
    pos = table.column("pos").to_pylist()
    order = sorted(range(len(pos)), key=pos.__getitem__)
    digests = table.column("leaf").to_pylist()
    height = min(HEIGHT, levels(table.column("n")[0].as_py()))
    return order, PersistentTree([digests[i] for i in order], height)


def block_roots(table: pa.Table) -> pa.Table:
    _, tree = tree_of(table)
    first = table.slice(0, 1)
    return pa.Table.from_arrays(
        [*[first.column(c) for c in TREE], first.column("block"), pa.array([tree.digests[tree.root]])],
        names=[*TREE, "pos", "leaf"],
    )


def block_paths(table: pa.Table) -> pa.Table:
    """Every node of the block with its path to the block's root."""
    order, tree = tree_of(table)
    rows = table.take(order)
    paths = [[{"left": a, "right": b} for a, b in tree.siblings(i)] for i in range(len(order))]
    kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
    top = pa.array([tree.digests[tree.root]] * len(order))
    return pa.Table.from_arrays(
        [*[rows.column(c) for c in TREE], rows.column("pos"), pa.array(paths, kind), top],
        names=[*TREE, "pos", "path", "top"],
    )


def in_blocks(nodes: DataFrame, work, schema: str) -> DataFrame:
    return nodes.withColumn("block", block_of()).groupBy(*TREE, "block").applyInArrow(work, schema)


def climb(nodes: DataFrame) -> DataFrame:
    """(known, name, pos, path, top): for every node of every tree its path to the tree's
    root, and this root. ``nodes``: known, name, pos, n, leaf."""
    rounds = []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        paths = materialize(in_blocks(nodes, block_paths, f"known int, name string, pos long, path {PATH}, top string"))
        rounds.append(paths)
        if most <= BLOCK:
            break
        sizes = nodes.select(*TREE, F.ceil(F.col("n") / BLOCK).cast("long").alias("n")).distinct()
        tops = paths.select(*TREE, block_of().alias("pos"), F.col("top").alias("leaf")).distinct()
        nodes, most = tops.join(sizes, TREE), -(-most // BLOCK)
    above = rounds.pop()
    while rounds:
        below = rounds.pop().withColumn("block", block_of()).drop("top")
        above = above.select(*TREE, F.col("pos").alias("block"), F.col("path").alias("further"), "top")
        joined = below.join(above, [*TREE, "block"])
        above = joined.select(*TREE, "pos", F.concat("path", "further").alias("path"), "top")
    return above


def upper_paths(rows: DataFrame) -> DataFrame:
    """(known, name, block, path, subroot, root) of every block of the rows' trees."""
    roots = in_blocks(rows.select(*TREE, "pos", "n", "leaf"), block_roots, "known int, name string, pos long, leaf string")
    sizes = rows.select(*TREE, F.ceil(F.col("n") / BLOCK).cast("long").alias("n")).distinct()
    inside = materialize(climb(materialize(roots.join(sizes, TREE))))
    # the tree of the root has the subroots as its leaves
    subroots = inside.where("pos = 0").select(
        F.lit(1).alias("known"), F.lit("").alias("name"), F.col("known").alias("first"), F.col("name").alias("second"),
        F.col("top").alias("leaf"),
    )
    subroots = materialize(placed(subroots, ["first", "second"]))
    whole = climb(subroots.select(*TREE, "pos", "n", "leaf")).select("pos", F.col("path").alias("further"), "top")
    whole = subroots.join(whole, "pos").select(
        F.col("first").alias("known"), F.col("second").alias("name"), "further", F.col("top").alias("root")
    )
    return inside.join(whole, TREE).select(
        *TREE,
        F.col("pos").alias("block"),
        F.concat("path", "further").alias("path"),
        F.col("top").alias("subroot"),
        "root",
    )


def prover(nodes: bool):
    def prove(rows: pa.Table, upper: pa.Table) -> pa.Table:
        """The versions of one block, carried on to the root."""
        order, tree = tree_of(rows)
        rows = rows.take(order)
        further = [(x["left"], x["right"]) for x in upper.column("path")[0].as_py()]
        subroot, root = (upper.column(c)[0].as_py() for c in ("subroot", "root"))
        leaves, others = rows.column("leaf").to_pylist(), rows.column("other").to_pylist()
        proofs, folded, copies = [], [], []
        rest = "".join(a + b for a, b in further)
        for place, (leaf, other) in enumerate(zip(leaves, others, strict=True)):
            path = tree.siblings(place)
            proofs.append(digest([*(a + b for a, b in path), rest]))
            if other is None or other == leaf:
                below = fold(leaf, path)
            else:
                below = [tree.digests[node] for node in tree.version(place, other)]
            above = fold(below[-1], further)
            folded.append(above[-1])
            copies.append(below + above[1:] if nodes and other is not None else None)
        n = len(order)
        columns = [
            rows.column("doc_id"), rows.column("leaf"), pa.array([subroot] * n), pa.array([root] * n),
            pa.array(proofs), pa.array(folded), pa.array([x == root for x in folded]),
        ]
        names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        if nodes:
            columns += [rows.column("known"), rows.column("name"), rows.column("pos"), pa.array(copies, pa.list_(pa.string()))]
            names += ["known", "name", "pos", "version"]
        return pa.Table.from_arrays(columns, names=names)

    return prove


def manifest(docs: DataFrame, change=without_line_feeds, where=marked, nodes: bool = False) -> DataFrame:
    """For every row its leaf, the roots it is under, the digest of its siblings, and the
    root of its version: the one in which ``change`` was made to its text if ``where`` marks
    it, and nothing else was.

    With ``nodes`` also its tree (known, name), its place there, and for marked rows the
    nodes of the version that are not shared, from the leaf to the root.
    """
    rows = materialize(placed(hashed_rows(docs, change, where), ["doc_id", "leaf"]))
    keys = [*TREE, "block"]
    upper = upper_paths(rows)
    strings = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    kinds = [(c, T.StringType()) for c in strings] + [("verified", T.BooleanType())]
    if nodes:
        kinds += [("known", T.IntegerType()), ("name", T.StringType()), ("pos", T.LongType()), ("version", T.ArrayType(T.StringType()))]
    schema = T.StructType([docs.select("doc_id").schema[0], *[T.StructField(c, kind) for c, kind in kinds]])
    own = rows.withColumn("block", block_of()).groupBy(*keys)
    return own.cogroup(upper.groupBy(*keys)).applyInArrow(prover(nodes), schema)
