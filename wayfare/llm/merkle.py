"""Merkle manifest of a dataset: a root for all rows and a proof for each.

Every row is a leaf, and the leaves of a group stand in a fixed order. A
leaf's rank there, written in digits of base 8, says under which nodes it
lies. Inside a block of 512 leaves the digits are grouped away one after the
other: rows that agree on all digits but the last become one row, whose struct
nests theirs, three times, until a block is one row with its whole subtree.
The blocks' hashes are the leaves of the next, 512 times smaller tree, and the
groups' roots, in order, those of the last one. On the way back the leaves of a
block are nested once more, now with what lies above it (a row more in their
union, no join), a transform over the nested structs puts the siblings of every
leaf together, and explode emits the leaves with their proofs.

Exchanges carry ids and digests only, never texts; no group of rows is larger
than a block, so a hot group is spread over as many tasks as it has blocks.
Tables that are written and read again have a row per leaf or per block's
hash: a reader takes some thousand rows at once, and a nested block with its
proofs has most of a megabyte.

Defined results: a null field counts as ``-``, everything else by its bytes,
so an empty text differs from a null one; null groups and null ids come first;
rows of one id stand in the order of their digests, repeated rows are leaves
of their own; whole texts are hashed, however long; an empty table gives no
rows; other columns never take part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.operators.ordering import global_index, rank_in_group
from wayfare.session import cut_through

from .common import stage

DIGIT = 3            # bits of a digit: up to 8 nodes have one parent
DIGITS = 3           # digits grouped away inside a block
KEYS = ["_w_group", "_w_block"]
PATH = "array<struct<left:string,right:string>>"


def leaf_hash(fields: list[Column]) -> Column:
    """Digest of a row's fields, each as ``bytes:value`` or ``-`` if null."""
    parts = []
    for field in fields:
        text = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _parent(kids: str, only: Column) -> Column:
    """Digest of a run of nodes; the only node that is left stays itself."""
    digests = F.array_join(F.col(kids)["hash"], "")
    return F.when(only & (F.size(kids) == 1), F.col(kids)[0]["hash"]).otherwise(F.sha2(digests, 256))


def _beside(kids: Column, at: Column, only: Column) -> Column:
    """The siblings of the node at ``at``, left and right, as one text each;
    null where the node has no parent."""
    left = F.array_join(F.slice(kids["hash"], F.lit(1), at), "")
    right = F.array_join(F.slice(kids["hash"], at + F.lit(2), F.size(kids)), "")
    return F.when(~(only & (F.size(kids) == 1)), F.struct(left.alias("left"), right.alias("right")))


def _blocks(nodes: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """One row per group and block: its ``_w_hash``; with the table of what
    lies ``above`` the blocks, that (``_w_up``) and the block's ``_w_leaves``
    instead, each with the siblings on the way up to the block. Nodes have a
    group, a 0-based rank, a hash and a struct that they carry along."""
    digit = lambda k: F.shiftright("_w_rank", DIGIT * k).bitwiseAND(F.lit((1 << DIGIT) - 1)).cast("int")
    node = [digit(0).alias("digit"), F.col("_w_hash").alias("hash"), *([F.col("_w_load").alias("load")] if above is not None else [])]
    rows = nodes.select("_w_group", F.shiftright("_w_rank", DIGIT * DIGITS).alias("_w_block"), digit(2).alias("_w_d2"),
                        digit(1).alias("_w_d1"), F.struct(*node).alias("_w_node"))
    if above is not None:
        rows = rows.unionByName(above.select(*KEYS, "_w_up"), allowMissingColumns=True)
    rows = rows.repartition(*KEYS)  # the one exchange: the three steps stay in their partition
    up = [F.first("_w_up", ignorenulls=True).alias("_w_up")] if above is not None else []
    first = F.col("_w_block") == 0
    for level, name in enumerate(("_w_d1", "_w_d2", None)):
        keys = [*KEYS, "_w_d2", "_w_d1"][:4 - level]
        rows = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("_w_node")).alias("_w_kids"), *up)
        if above is not None and not name:
            break
        # a run of one node is all that remains if nothing can stand after it
        only = first
        for k in keys[2:]:
            only = only & (F.col(k) == 0)
        hashed = rows.withColumn("_w_hash", _parent("_w_kids", only))
        if not name:
            return hashed.select(*KEYS, "_w_hash")
        node = F.struct(F.col(name).alias("digit"), F.col("_w_hash").alias("hash"), *([F.col("_w_kids").alias("kids")] if above is not None else []))
        # the row from above has no kids
        rows = hashed.select(*keys[:-1], F.when(F.size("_w_kids") > 0, node).alias("_w_node"), *(["_w_up"] if above is not None else []))

    kids = F.col("_w_kids")

    def leaf(n2: Column, i: Column, n1: Column, j: Column, node: Column, k: Column) -> Column:
        low = first & (n2["digit"] == 0)
        path = F.array(_beside(n1["kids"], k, low & (n1["digit"] == 0)), _beside(n2["kids"], j, low), _beside(kids, i, first))
        return F.struct(node["load"].alias("load"), node["hash"].alias("hash"), F.array_compact(path).cast(PATH).alias("path"))

    leaves = F.flatten(F.transform(kids, lambda n2, i: F.flatten(F.transform(
        n2["kids"], lambda n1, j: F.transform(n1["kids"], lambda node, k: leaf(n2, i, n1, j, node, k))))))
    return rows.select(*KEYS, "_w_up", leaves.alias("_w_leaves"))


def _climb(nodes: DataFrame, crown: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """For each node its group, its hash, what it carries, the ``path`` of
    siblings up to the root, and the roots ``sub`` of its group and ``root``
    of all. ``crown`` says what lies above the groups' roots. Nodes are read
    twice."""
    blocks = stage(_blocks(nodes))
    last = blocks.agg(F.max("_w_block")).first()[0]
    if last:
        upper = blocks.select("_w_group", F.col("_w_block").alias("_w_rank"), "_w_hash", F.struct("_w_block").alias("_w_load"))
        above = _climb(upper, crown).select("_w_group", "_w_load._w_block", F.struct("path", "sub", "root").alias("_w_up"))
    elif crown:
        above = crown(blocks)
    else:
        whole = F.struct(F.array().cast(PATH).alias("path"), F.col("_w_hash").alias("sub"), F.col("_w_hash").alias("root"))
        above = blocks.select(*KEYS, whole.alias("_w_up"))
    return _blocks(nodes, above).select("_w_group", "_w_up", F.explode("_w_leaves").alias("_w_leaf")).select(
        "_w_group", F.col("_w_leaf.load").alias("_w_load"), F.col("_w_leaf.hash").alias("_w_hash"),
        F.concat("_w_leaf.path", "_w_up.path").alias("path"), F.col("_w_up.sub").alias("sub"), F.col("_w_up.root").alias("root"))


def _over_groups(blocks: DataFrame) -> DataFrame:
    """The tree over the groups' roots, ordered by group, nulls first."""
    tops = blocks.select("_w_group", "_w_hash")
    nodes = stage(global_index(tops, ["_w_group"], "_w_rank").select(
        F.lit(0).alias("_w_all"), "_w_rank", "_w_hash", F.struct("_w_group").alias("_w_load")))
    done = _climb(nodes.withColumnRenamed("_w_all", "_w_group"))
    up = F.struct("path", F.col("_w_hash").alias("sub"), "root")
    return done.select(F.col("_w_load._w_group").alias("_w_group"), F.lit(0).cast("long").alias("_w_block"), up.alias("_w_up"))


def manifest(df: DataFrame, leaf: Column, id_col: str = "doc_id", group_col: str = "lang",
             carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``df``: id, group, ``leaf`` (its digest), the
    ``path`` of siblings (left and right, level by level), ``subroot`` of the
    group, ``root`` of all, and the columns of ``carry``."""
    carry = carry or {}
    named = [F.col(f"`{id_col}`").alias("_w_id"), F.col(f"`{group_col}`").alias("_w_group"), leaf.alias("_w_hash")]

    def ranked() -> DataFrame:
        leaves = stage(df.select(*named, *[c.alias(f"_w_c{k}") for k, c in enumerate(carry.values())])
                       .withColumn("_w_row", F.monotonically_increasing_id()))
        load = F.struct("_w_id", *[f"_w_c{k}" for k in range(len(carry))])
        return rank_in_group(leaves, ["_w_group"], ["_w_id", "_w_hash", "_w_row"], "_w_place").select(
            "_w_group", (F.col("_w_place") - 1).cast("long").alias("_w_rank"), "_w_hash", load.alias("_w_load"))

    return _climb(cut_through(df.sparkSession, ranked), _over_groups).select(
        F.col("_w_load._w_id").alias(id_col), F.col("_w_group").alias(group_col), F.col("_w_hash").alias("leaf"),
        "path", F.col("sub").alias("subroot"), "root",
        *[F.col(f"_w_load._w_c{k}").alias(name) for k, name in enumerate(carry)])


def siblings(path: Column) -> Column:
    """All siblings of a path in order, as one text."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda node, p: F.sha2(F.concat(p["left"], node, p["right"]), 256))
