"""A Merkle manifest of a dataset: a tree of hashes for each source, and one over the sources' subroots, with a proof for every row.

Leaves are sorted by source and key and dealt out in blocks. A block holds a sparse forest: nodes by tree, level and index whose
siblings are not all there. As each tree's number of leaves is known, so is every run of siblings, and where one is complete it becomes its
parent; putting two forests together so is associative. Blocks are merged in rounds, :data:`FAN` at a time; of a block only its open nodes
travel, a few for each level at both of its ends, and a tree that lies within a block leaves it as a subroot. The way back hands every open
node the path from it to the root, through the same rounds, so that each block can give its leaves theirs. No task holds a tree, the driver
only the root.

A path is an array of steps from the leaf to the root. A step is the node's place in its run, one digit, and its siblings' digests, left to right.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from functools import partial, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import drop, saved

#: Nodes of a run; at most nine.
ARITY = 3
#: Leaves of a block at most, on average, and blocks or merged blocks that a round merges.
BLOCK_ROWS, FAN = 1 << 14, 64
#: Hex digits of a digest.
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_NODE = "block long, tree string, total long, level int, index long, digest string, done boolean"
_SIDE = "block long, tree string, total long, level int, index long, digest string, path string"


def digest(*values: Column) -> Column:
    """SHA-256, in hex, of values: each ``-`` if null, else its length in bytes, a colon, and itself."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def proof(path: Column) -> Column:
    """SHA-256, in hex, of all siblings on a path."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.substring(s, 2, ARITY * HEX)), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of its path."""

    def up(node: Column, step: Column) -> Column:
        left = F.substring(step, 1, 1).cast("int") * HEX
        return F.sha2(F.concat(step.substr(F.lit(2), left), node, step.substr(left + 2, F.lit(ARITY * HEX))), 256)

    return F.aggregate(path, leaf, up)


# What is done within a task, with the nodes of one tree.


def _hash(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Forest(NamedTuple):
    """The nodes of one tree that a task knows: by level, those given and those made of complete runs; which of them are open, and the root if it is there."""

    levels: list[dict[int, str]]
    widths: list[int]
    open_: list[tuple[int, int]]
    root: str | None


def run(index: int, width: int) -> range:
    first = index - index % ARITY
    return range(first, min(first + ARITY, width))


def grown(given: dict[int, dict[int, str]], total: int) -> Forest:
    """Every complete run of siblings becomes its parent, level by level."""
    levels, widths, open_, made, last = [], [], [], {}, max(given)
    width = total
    while True:
        here = given.get(len(levels), {}) | made
        levels.append(here)
        widths.append(width)
        if width == 1:
            return Forest(levels, widths, open_, here.get(0))
        made = {}
        for index in here:
            siblings = run(index, width)
            if all(i in here for i in siblings):
                if index == siblings[0]:
                    made[index // ARITY] = _hash(here[i] for i in siblings)
            else:
                open_.append((len(levels) - 1, index))
        if not made and len(levels) > last:
            return Forest(levels, widths, open_, None)
        width = -(-width // ARITY)


def paths(forest: Forest, known: dict[tuple[int, int], str]) -> list[dict[int, str]]:
    """By level, the path of every node to the root of all: of open ones and of the tree's root it is ``known``. Steps are joined by spaces."""
    out: list[dict[int, str]] = [{} for _ in forest.levels]
    for level in range(len(forest.levels) - 1, -1, -1):
        here, width = forest.levels[level], forest.widths[level]
        for index in here:
            if (level, index) in known:
                out[level][index] = known[level, index]
            elif width > 1:
                others = "".join(here[i] for i in run(index, width) if i != index)
                above = out[level + 1][index // ARITY]
                out[level][index] = f"{index % ARITY}{others} {above}" if above else f"{index % ARITY}{others}"
    return out


def _trees(rows: pa.Table) -> tuple[dict[str | None, dict[int, dict[int, str]]], dict[str | None, int]]:
    """Nodes by tree and level, and the trees' numbers of leaves."""
    trees, totals = {}, {}
    for r in rows.select(["tree", "total", "level", "index", "digest"]).to_pylist():
        trees.setdefault(r["tree"], {}).setdefault(r["level"], {})[r["index"]] = r["digest"]
        totals[r["tree"]] = r["total"]
    return trees, totals


def _nodes(block: int, forests: dict[str | None, tuple[Forest, int]]) -> pa.Table:
    rows = []
    for tree, (forest, total) in forests.items():
        if forest.root is not None:
            rows.append((block, tree, total, len(forest.levels) - 1, 0, forest.root, True))
        rows += [(block, tree, total, level, index, forest.levels[level][index], False) for level, index in forest.open_]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_())
    names = ("block", "tree", "total", "level", "index", "digest", "done")
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})


def _merge(key: tuple, rows: pa.Table) -> pa.Table:
    trees, totals = _trees(rows)
    return _nodes(key[0].as_py(), {t: (grown(levels, totals[t]), totals[t]) for t, levels in trees.items()})


def _in_block(leaves: pa.Table, sides: pa.Table) -> tuple[np.ndarray, list[tuple[str | None, int, int, dict]]]:
    """The order of a block's leaves, and for each of its trees where its leaves begin and end in that order and the tree's row of spans."""
    order = np.argsort(leaves.column("place").to_numpy(), kind="stable")
    spans = {r["tree"]: r for r in sides.to_pylist() if r["level"] == -1}
    out, names = [], leaves.column("tree").take(pa.array(order)).to_pylist()
    at = 0
    while at < len(names):
        end = at + 1
        while end < len(names) and names[end] == names[at]:
            end += 1
        out.append((names[at], at, end, spans[names[at]]))
        at = end
    return order, out


def _resolve(key: tuple, leaves: pa.Table, sides: pa.Table) -> pa.Table:
    """The forest of a block of leaves."""
    order, trees = _in_block(leaves, sides)
    digests = leaves.column("leaf").take(pa.array(order)).to_pylist()
    forests = {}
    for tree, at, end, span in trees:
        given = dict(enumerate(digests[at:end], span["index"]))
        forests[tree] = (grown({0: given}, span["total"]), span["total"])
    return _nodes(key[0].as_py(), forests)


def _known(sides: pa.Table) -> dict[str | None, dict[tuple[int, int], str]]:
    out: dict = {}
    for r in sides.to_pylist():
        if r["level"] >= 0:
            out.setdefault(r["tree"], {})[r["level"], r["index"]] = r["path"]
    return out


def _hand_down(key: tuple, nodes: pa.Table, sides: pa.Table) -> pa.Table:
    """The paths of the open nodes that were merged, from those of what they became."""
    trees, totals = _trees(nodes)
    known = _known(sides)
    found = {t: paths(grown(levels, totals[t]), known[t]) for t, levels in trees.items()}
    path = [found[t][level][index] for t, level, index in zip(*(nodes.column(c).to_pylist() for c in ("tree", "level", "index")), strict=True)]
    return pa.table({**{c: nodes.column(c) for c in ("block", "tree", "total", "level", "index", "digest")}, "path": pa.array(path, pa.string())})


def _hand_out(key: tuple, leaves: pa.Table, sides: pa.Table, names: list[str]) -> pa.Table:
    """Each leaf of a block with its index, its subroot and its path."""
    order, trees = _in_block(leaves, sides)
    digests = leaves.column("leaf").take(pa.array(order)).to_pylist()
    known, index, subroot, path = _known(sides), [], [], []
    for tree, at, end, span in trees:
        given = dict(enumerate(digests[at:end], span["index"]))
        index += given
        subroot += [span["digest"]] * (end - at)
        found = paths(grown({0: given}, span["total"]), known[tree])[0]
        path += [found[i] for i in given]
    ordered = leaves.take(pa.array(order))
    return pa.table({**{n: ordered.column(n) for n in names}, "index": pa.array(index, pa.int64()), "subroot": pa.array(subroot, pa.string()), "path": pa.array(path, pa.string())})


# The rounds.


class Grown(NamedTuple):
    """Leaves in their blocks, their blocks' spans, the open nodes that each round left, and each tree's root by the round that made it."""

    leaves: DataFrame
    spans: DataFrame
    opens: list[DataFrame]
    roots: list[DataFrame]


def placed(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` (tree, leaf and others) sorted by tree and ``order``, nulls first, in blocks of about equal size; repeated keys follow their leaf.
    With place, which ascends in that order within each block, and block."""
    spark = leaves.sparkSession
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-leaves.count() // BLOCK_ROWS))
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order, "leaf", "__row")]
    ranged = leaves.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(blocks, *keys).sortWithinPartitions(*keys)
    return saved(ranged.drop("__row").withColumn("place", F.monotonically_increasing_id()).withColumn("block", F.shiftright("place", 33)), "leaves")


def up(leaves: DataFrame) -> Grown:
    """Forests of blocks, merged until every tree has its root."""
    counted = leaves.groupBy("block", "tree").agg(F.count("*").alias("n"))
    tree = Window.partitionBy("tree")
    before = F.sum("n").over(tree.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    spans = counted.select("block", "tree", F.sum("n").over(tree).alias("total"), F.lit(-1).alias("level"), F.coalesce(before, F.lit(0)).alias("index"))
    spans = saved(spans.select("*", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("string").alias("path")), "spans")
    made = saved(leaves.select("block", "place", "tree", "leaf").groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(_resolve, _NODE), "nodes")
    opens, roots = [made.where("not done")], [made.where("done")]
    while not opens[-1].isEmpty():
        merged = opens[-1].groupBy(F.expr(f"block div {FAN}").alias("__into")).applyInArrow(_merge, _NODE)
        made = saved(merged, "nodes")
        opens.append(made.where("not done"))
        roots.append(made.where("done"))
    return Grown(leaves, spans, opens, roots)


def down(tree: Grown, base: DataFrame) -> DataFrame:
    """The rows of ``tree.leaves`` with index, subroot and path; ``base`` has the path of every tree's root (tree, path)."""
    same = lambda a, b: a.join(b.withColumnRenamed("tree", "__tree"), F.col("tree").eqNullSafe(F.col("__tree"))).drop("__tree")
    side = [f.split()[0] for f in _SIDE.split(", ")]
    known = None
    for opens, roots in zip(reversed([None, *tree.opens[:-1]]), reversed(tree.roots), strict=True):
        ends = same(roots, base).select(*side)
        known = ends if known is None else ends.unionByName(known)
        if opens is not None:
            handed = opens.groupBy(F.expr(f"block div {FAN}").alias("__into")).cogroup(known.groupBy("block")).applyInArrow(_hand_down, _SIDE)
            known = saved(handed, "paths")
    subroots = reduce(DataFrame.unionByName, tree.roots).select("tree", F.col("digest").alias("__digest"))
    spans = same(tree.spans.drop("digest"), subroots).withColumnRenamed("__digest", "digest").select(*side)
    names = tree.leaves.columns
    kinds = {f.name: f.dataType.simpleString() for f in tree.leaves.schema.fields}
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", index long, subroot string, path string"
    handed = tree.leaves.groupBy("block").cogroup(spans.unionByName(known).groupBy("block")).applyInArrow(partial(_hand_out, names=names), schema)
    return handed.withColumn("path", F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split("path", " ")))


def manifest(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` (tree, leaf and others) with index (among the tree's leaves, by ``order``), subroot, root and path.

    Trees come in the order of their names, the null first, bytewise. Rows whose ``order`` is the same follow their leaf, repeated rows stand one
    after the other, each a leaf of its own; null keys come first. A tree of one leaf is that leaf; an empty table stays empty.
    Columns named place, block, index, subroot, root or path must not be there yet.
    """
    sources = up(placed(leaves, order))
    subroots = reduce(DataFrame.unionByName, sources.roots).select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("digest").alias("leaf"))
    listed = saved(subroots, "subroots")
    top = up(placed(listed, ["name"]))
    drop(listed)
    found = [r.first() for r in top.roots]
    root = next((r.digest for r in found if r), None)
    base = saved(down(top, leaves.sparkSession.range(1).select(F.lit("").alias("tree"), F.lit("").alias("path"))).select(F.col("name").alias("tree"), F.array_join("path", " ").alias("path")), "base")
    return down(sources, base).drop("place", "block").withColumn("root", F.lit(root).cast("string"))


def tampered(doc_id: Column, text: Column) -> Column:
    """The text without its line ends where the crc32 of the decimal id is even, else the text."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def leaves(docs: DataFrame) -> DataFrame:
    """A leaf for each document: tree (its source), doc_id, leaf, and shown, the leaf of what it is after tampering. Texts go no further than this pass."""
    fields = [F.col(c) for c in FIELDS]
    changed = tampered(F.col("doc_id"), F.col("text"))
    return docs.select(F.col("source").alias("tree"), "doc_id", digest(*fields).alias("leaf"), F.when(~changed.eqNullSafe(F.col("text")), digest(*fields[:-1], changed)).alias("shown")).withColumn("shown", F.coalesce("shown", "leaf"))


def verified(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 (of the siblings on the way to the root), folded_root (what the leaf after tampering gives with
    those siblings) and verified (whether that is the root), a row for each row of ``docs``; see :func:`manifest` for nulls, ties and repeated rows."""
    hashed = saved(leaves(docs), "digests")
    made = manifest(hashed, ["doc_id"])
    drop(hashed)
    out = made.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded(F.col("shown"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
