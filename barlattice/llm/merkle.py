"""A Merkle manifest of a table, with the proof of every row by pointer jumping.

Every row is a leaf; the leaves of a language in order of id form a tree of runs of two, and the
roots of the languages form one more. Trees are built in blocks of ``2**BLOCK`` neighbours: all nodes
of a block are hashed in one row, and the tops of the blocks are the leaves of the next pass, so a
table of n rows takes log(n) / ``BLOCK`` passes.

Proofs come from nodes that hold the siblings on the way to an ancestor. At first that is the parent;
a round joins every node with the node it points to and puts the two segments one after the other,
which doubles the distance, until the leaves point to the root. A round keeps only the nodes that the
next one can reach, so the nodes above the leaves shrink to the square root, and again.

A segment has 33 bytes a level: the side of the sibling (0 for a run of one) and its digest.

Defined cases: a null value is '-' in the leaf; null ids come first within their language, equal ids
are ordered by their leaf; the null language comes first; an empty table gives an empty result, and
one row is its own root with an empty proof; long texts are hashed whole; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlattice.llm.common import settled, with_group_values, written
from barlattice.llm.places import with_places

#: Levels of a block, and the most nodes of a round that are broadcast (at most 33 bytes a level each).
BLOCK, SMALL = 10, 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """UTF-8 byte count, colon, value; '-' for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, values)), 256)


def depth_of(n: Column) -> Column:
    """Levels between the leaves of a tree of ``n`` and its root."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(F.lit(0))


def _parents(level: Column) -> Column:
    """Digests of the runs of two of an array of digests; the last run may have one."""
    return F.transform(F.sequence(F.lit(1), F.size(level), F.lit(2)), lambda i: F.sha2(
        F.concat(F.element_at(level, i), F.coalesce(F.try_element_at(level, i + 1), F.lit(""))), 256))


def _entry(level: Column, at: Column) -> Column:
    """Side and digest of the sibling of the node at ``at`` (from 0) of a level."""
    left = F.concat(F.lit("01"), F.try_element_at(level, at))
    right = F.concat(F.lit("02"), F.try_element_at(level, at + 2))
    return F.unhex(F.when(at % 2 == 1, left).otherwise(F.coalesce(right, F.lit("00" * 33))))


def _blocks(rows: DataFrame) -> DataFrame:
    """Hash blocks of ``2**BLOCK`` neighbours of (tree, idx, digest, base, depth, load) up to their tops."""
    held = rows.groupBy("tree", "base", "depth", F.shiftright("idx", BLOCK).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("idx", "digest", "load"))).alias("items"))
    steps = F.least(F.lit(BLOCK), F.col("depth") - F.col("base"))
    first = F.array(F.transform("items", lambda x: x["digest"]))
    levels = F.when(steps > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), first, lambda held, k: F.concat(
        held, F.array(_parents(F.element_at(held, -1)))))).otherwise(first)
    return written(held.select("tree", "base", "depth", "block", "items", levels.alias("levels")))


def build(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trees over (tree, idx from 0, digest, n, load): leaves, inner nodes and roots.

    Leaves and nodes have (tree, level, idx, depth, to, segment): the segment leads to level ``to``.
    """
    rows = rows.select("tree", "idx", "digest", F.lit(0).alias("base"), depth_of(F.col("n")).alias("depth"), "load")
    leaves, inner, roots = None, [], []
    while True:
        blocks = _blocks(rows)
        top = F.size("levels") - 1
        if leaves is None:
            first = F.element_at("levels", 1)
            leaf = F.explode(F.transform("items", lambda x, i: F.struct(
                x.alias("item"), F.when(F.col("depth") > 0, _entry(first, i)).otherwise(F.unhex(F.lit(""))).alias("segment")))).alias("x")
            leaves = blocks.select("tree", "depth", leaf).select(
                "tree", F.lit(0).alias("level"), "x.item.idx", "depth", F.least(F.lit(1), F.col("depth")).alias("to"),
                "x.item.digest", "x.item.load", "x.segment")
        below = F.flatten(F.transform(F.slice("levels", F.lit(1), top), lambda level, k: F.transform(level, lambda _, i: F.struct(
            k.alias("k"), i.alias("at"), _entry(level, i).alias("segment")))))
        each = blocks.select("tree", "base", "depth", "block", F.explode(below).alias("x")).select("tree", "base", "depth", "block", "x.*")
        level = F.col("base") + F.col("k")
        inner.append(each.filter(level > 0).select(
            "tree", level.alias("level"), (F.col("block") * F.expr(f"shiftleft(1L, {BLOCK} - k)") + F.col("at")).alias("idx"),
            "depth", (level + 1).alias("to"), "segment"))
        tops = blocks.select("tree", F.col("block").alias("idx"), F.element_at(F.element_at("levels", -1), 1).alias("digest"),
                             (F.col("base") + top).alias("base"), "depth", F.lit(None).cast(rows.schema["load"].dataType).alias("load"))
        roots.append(tops.filter("base = depth").select("tree", "digest"))
        rows = tops.filter("base < depth")
        if rows.isEmpty():
            break
    nodes, ends = inner[0], roots[0]
    for more, end in zip(inner[1:], roots[1:]):
        nodes, ends = nodes.unionByName(more), ends.unionByName(end)
    return leaves, nodes, ends


def _jumped(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows whose segments go on with those of the nodes they point to; rows at the root stay."""
    names = rows.columns
    up = F.expr("shiftright(idx, to - level)")
    rows = rows.withColumn("__up", up)
    met = rows.join(targets, (rows["tree"] == targets["__tree"]) & (rows["to"] == targets["__level"]) & (rows["__up"] == targets["__idx"]), "left")
    return met.withColumn("segment", F.concat("segment", F.coalesce("__segment", F.unhex(F.lit(""))))).withColumn(
        "to", F.coalesce("__to", "to")).select(*names)


def paths(leaves: DataFrame, nodes: DataFrame, deepest: int) -> DataFrame:
    """The leaves with segments that lead to the root of their tree."""
    reach = 1
    nodes = settled(nodes)
    while reach < deepest:
        targets = nodes.filter(F.col("level") % (2 * reach) == reach).select(
            F.col("tree").alias("__tree"), F.col("level").alias("__level"), F.col("idx").alias("__idx"),
            F.col("segment").alias("__segment"), F.col("to").alias("__to"))
        if targets.limit(SMALL + 1).count() <= SMALL:
            targets = F.broadcast(targets)
        leaves = _jumped(leaves, targets)
        nodes = settled(_jumped(nodes.filter(F.col("level") % (2 * reach) == 0), targets))
        reach *= 2
    return leaves


def proof(segment: Column) -> Column:
    """array<struct<side, digest>> of a segment: '<' for a sibling on the left, '>' on the right, '' for none."""
    side = lambda i: F.hex(F.substring(segment, i * 33 + 1, F.lit(1)))
    steps = F.sequence(F.lit(0), F.greatest(F.octet_length(segment) / 33 - 1, F.lit(0)).cast("int"))
    found = F.transform(steps, lambda i: F.struct(
        F.when(side(i) == "01", "<").when(side(i) == "02", ">").otherwise("").alias("side"),
        F.lower(F.hex(F.substring(segment, i * 33 + 2, F.lit(32)))).alias("digest")))
    return F.when(F.octet_length(segment) > 0, found).otherwise(F.array().cast("array<struct<side:string,digest:string>>"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a proof give."""
    return F.aggregate(path, leaf, lambda h, x: F.sha2(
        F.when(x["side"] == "<", F.concat(x["digest"], h)).when(x["side"] == ">", F.concat(h, x["digest"])).otherwise(h), 256))


def siblings_sha256(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(F.filter(path, lambda x: x["side"] != ""), lambda x: x["digest"]), ""), 256)


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, row_id: str = "doc_id", group: str = "lang",
             carry: Column | None = None) -> DataFrame:
    """Per row: its id, leaf, subroot, root and proof, and ``carry`` (a column of strings over ``docs``)."""
    tree = F.coalesce(F.concat(F.lit("0"), F.col(group).cast("string")), F.lit(""))
    rows = docs.select(tree.alias("tree"), F.col(row_id).alias("id"), leaf_digest([F.col(f) for f in fields]).alias("digest"),
                       (carry if carry is not None else F.lit(None)).cast("string").alias("carry"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows)
    placed = with_places(rows, [F.col("id").asc_nulls_first(), F.col("digest").asc(), F.col("row").asc()], group="tree")
    sizes = settled(rows.groupBy("tree").agg(F.count(F.lit(1)).alias("n")))
    total, largest, trees = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), F.count(F.lit(1))).first()
    leafs = with_group_values(placed, sizes, "tree", "n", total).select(
        "tree", (F.col("place") - 1).alias("idx"), "digest", "n", F.struct("id", "carry").alias("load"))
    leaves, nodes, subroots = build(leafs)
    leaves = paths(leaves, nodes, (int(largest) - 1).bit_length() if largest else 0)
    # the tree over the roots, in order of their group
    tops = with_places(subroots, [F.col("tree").asc()]).select(
        F.lit("").alias("tree"), (F.col("place") - 1).alias("idx"), "digest", F.lit(trees).cast("long").alias("n"),
        F.struct(F.col("tree").alias("of"), F.col("digest").alias("subroot")).alias("load"))
    upper, above, root = build(tops)
    upper = paths(upper, above, (int(trees) - 1).bit_length() if trees else 0)
    last = root.select("digest").first()
    upper = settled(upper.select(F.col("load.of").alias("tree"), F.col("load.subroot").alias("subroot"), F.col("segment").alias("upper"))
                    .join(sizes, "tree"))
    whole = with_group_values(leaves.select("tree", "load", "digest", "segment"), upper, "tree", "n", total)
    return whole.select(F.col("load.id").alias(row_id), F.col("digest").alias("leaf"), "subroot",
                        F.lit(last["digest"] if last else None).cast("string").alias("root"),
                        proof(F.concat("segment", "upper")).alias("proof"), F.col("load.carry").alias("carry"))


def tampered_leaf(fields: Sequence[str] = FIELDS, row_id: str = "doc_id", count: str = "n_chars") -> Column:
    """For a check of the proofs: the leaf after 1 was added to ``count``, of the rows whose id's CRC-32 is a multiple of 7."""
    changed = leaf_digest([F.col(f) + F.lit(1).cast("long") if f == count else F.col(f) for f in fields])
    return F.when(F.crc32(F.col(row_id).cast("string").cast("binary")) % 7 == 0, changed)
