"""Merkle manifest of a dataset: a tree of digests for each language, one root over all, and a proof for each row.

A row's leaf is the digest of its fields. In each language leaves ascend by ``doc_id`` and every run of ``ARITY`` siblings
becomes the digest of its members, level by level; the languages' roots, in order, become the root in the same way.

The trees are built as a monoid of sparse forests: a forest maps (tree, level, index) to a digest, and merging two of them
is their union, closed by hashing every sibling run that is now complete. How many members a run has is known from the
number of leaves, so merging is associative and commutative, and any partition may hold any fragment. Leaves are numbered
by a range partitioning; ``ARITY ** height`` neighbours lie in one block, whose own tree is built where the block lies, so a
partition's unresolved nodes are its blocks' tops. ``treeReduce`` merges these. What reaches the driver, and goes back to
the tasks for the proofs, is the part of the trees above the blocks: ``height`` grows with the input so that there are at
most ``BLOCKS`` blocks for each shuffle partition and one for each language, whatever the number of rows.

Defined cases: a null field is ``-``; rows without doc_id come first, rows of one doc_id in the order of their leaves; a null
language comes first; a language with one row has that leaf as its root, and so has a table with one language; an empty table
gives an empty result; columns besides the five fields are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from sparkwell.llm.common import materialize, partitions, small_batches
from sparkwell.llm.line_dedup import LOWER, UPPER

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 8
#: Blocks for each shuffle partition: bounds what the driver and each task hold of the trees.
BLOCKS = 16
#: The tree over the languages' roots; languages are numbered from 0.
TOP = -1
#: Rows with their proofs that a task hands out at once.
ROWS_OUT = 1000

Forest = dict[tuple[int, int, int], str]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(value: Column) -> Column:
    """``-``, or the bytes of a value after their number and a colon."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(**replaced: Column) -> Column:
    return F.sha2(F.concat(*[encoded(replaced.get(f, F.col(f))) for f in FIELDS]).cast("binary"), 256)


def lowered(text: Column) -> Column:
    """A-Z lower-cased, other letters as they are."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def level_sizes(leaves: int) -> list[int]:
    """Nodes of each level, leaves first, down to one."""
    sizes = [leaves]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // ARITY))
    return sizes


class Trees:
    """The known shape of all trees: how many leaves each language has."""

    def __init__(self, leaves: dict[int, int]):
        self.sizes = {k: level_sizes(n) for k, n in leaves.items()} | {TOP: level_sizes(len(leaves))}

    def run(self, tree: int, level: int, index: int) -> range:
        """The indices of a node's sibling run, its own included."""
        first = index // ARITY * ARITY
        return range(first, min(first + ARITY, self.sizes[tree][level]))

    def root(self, tree: int) -> tuple[int, int, int]:
        return tree, len(self.sizes[tree]) - 1, 0

    def levels(self, tree: int, height: int) -> int:
        """How many levels above the leaves a block has."""
        return min(height, len(self.sizes[tree]) - 1)

    def is_root(self, tree: int, level: int) -> bool:
        return level == len(self.sizes[tree]) - 1

    def merge(self, a: Forest, b: Forest) -> Forest:
        """The union of two forests, closed: every complete sibling run has its parent, every language's root is a leaf of the top."""
        forest = a | b
        fresh = list(b if len(b) < len(a) else a) if a and b else list(forest)
        while fresh:
            tree, level, index = fresh.pop()
            if self.is_root(tree, level):
                up, value = (TOP, 0, tree), forest[tree, level, index]
                if tree == TOP:
                    continue
            else:
                members = [forest.get((tree, level, i)) for i in self.run(tree, level, index)]
                if None in members:
                    continue
                up, value = (tree, level + 1, index // ARITY), digest("".join(members))
            if up not in forest:
                forest[up] = value
                fresh.append(up)
        return forest

    def siblings(self, forest: Forest, tree: int, level: int, index: int) -> list[tuple[str, str]]:
        """(what stands before, what stands after) a node in its run, and so on up to the root."""
        path = []
        while not self.is_root(tree, level) or tree != TOP:
            if self.is_root(tree, level):
                tree, level, index = TOP, 0, tree
                continue
            run = self.run(tree, level, index)
            path.append(("".join(forest[tree, level, i] for i in run if i < index), "".join(forest[tree, level, i] for i in run if i > index)))
            level, index = level + 1, index // ARITY
        return path


def fold(value: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    return reduce(lambda node, around: digest(around[0] + node + around[1]), path, value)


def numbered(docs: DataFrame, tampered: Column) -> DataFrame:
    """(part, run, pos, lang, doc_id, leaf, changed): digests of all rows, ranged by language and doc_id. ``run`` numbers the
    languages of a range, ``pos`` the rows of a language in it."""
    leaves = docs.select(*FIELDS).select(F.col("lang").cast("string").alias("lang"), "doc_id", leaf().alias("leaf"), F.when(tampered, leaf(text=lowered(F.col("text")))).alias("changed"))
    keys = ("lang", "doc_id", "leaf")
    ranged = leaves.repartitionByRange(partitions(docs.sparkSession), *keys).sortWithinPartitions(*keys)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, run, at = TaskContext.get().partitionId(), None, -1, 0
        for batch in batches:
            runs, places = [], []
            for name in batch.column("lang").to_pylist():
                if run < 0 or name != last:
                    run, at, last = run + 1, 0, name
                runs.append(run)
                places.append(at)
                at += 1
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(runs), pa.int32()), pa.array(runs, pa.int32()), pa.array(places, pa.int64()), *batch.columns], ["part", "run", "pos", *batch.schema.names])

    return ranged.mapInArrow(number, StructType([StructField("part", IntegerType()), StructField("run", IntegerType()), StructField("pos", LongType()), *leaves.schema.fields]))


def block_levels(leaves: list[str], levels: int) -> list[list[str]]:
    """The digests of a block's lowest levels, leaves first."""
    out = [leaves]
    for _ in range(levels):
        out.append([digest("".join(out[-1][i : i + ARITY])) for i in range(0, len(out[-1]), ARITY)])
    return out


def _blocks(leaves: DataFrame, starts: DataFrame, height: int) -> DataFrame:
    """(tree, block, lang, ids, leaves, changed): a row for each block of at most ``ARITY ** height`` neighbours, in order."""
    placed = leaves.join(starts, ["part", "run"]).withColumn("at", F.col("start") + F.col("pos"))
    rows = F.sort_array(F.collect_list(F.struct("at", "doc_id", "leaf", "changed")))
    grouped = placed.groupBy("tree", F.expr(f"at div {ARITY**height}").alias("block")).agg(F.first("lang").alias("lang"), rows.alias("rows"))
    return grouped.select("tree", "block", "lang", F.col("rows.doc_id").alias("ids"), F.col("rows.leaf").alias("leaves"), F.col("rows.changed").alias("changed"))


def _forest(blocks: DataFrame, trees: Trees, height: int) -> Forest:
    """All nodes from the blocks' tops to the root, merged as a tree of partitions."""

    def fragment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for tree, block, leaves in zip(*(batch.column(c).to_pylist() for c in ("tree", "block", "leaves"))):
                levels = trees.levels(tree, height)
                out.append((tree, levels, block, block_levels(leaves, levels)[-1][0]))
            yield pa.RecordBatch.from_pydict(dict(zip(("tree", "level", "index", "digest"), map(list, zip(*out)))) if out else {"tree": [], "level": [], "index": [], "digest": []}, pa.schema([("tree", pa.int32()), ("level", pa.int32()), ("index", pa.int64()), ("digest", pa.string())]))

    tops = blocks.select("tree", "block", "leaves").mapInArrow(fragment, "tree int, level int, index long, digest string")
    fragments = tops.rdd.mapPartitions(lambda rows: [trees.merge({(r[0], r[1], r[2]): r[3] for r in rows}, {})])
    return fragments.treeReduce(trees.merge)


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, lang, leaf, subroot, root, proof, folded_root, verified), one row per input row.

    ``proof``: for each level up to the root the digests before and after the node in its run, each as one string.
    ``tampered``: a condition on the rows whose text is changed after the manifest was made (its A-Z lower-cased);
    ``folded_root`` is what such a row, or else the row as it was, and its proof give, ``verified`` whether that is the root.
    """
    spark = docs.sparkSession
    small_batches(spark)
    leaves = materialize(numbered(docs, F.lit(False) if tampered is None else tampered), "merkle-leaves")
    # A row for each range and language in it; their number does not grow with the rows.
    runs = leaves.groupBy("part", "run").agg(F.first("lang").alias("lang"), F.count("*").alias("rows")).sort("part", "run").collect()
    names = sorted({r["lang"] for r in runs}, key=lambda x: (x is not None, (x or "").encode()))
    number, sizes, starts = {name: i for i, name in enumerate(names)}, dict.fromkeys(range(len(names)), 0), []
    for part, run, lang, rows in runs:
        starts.append((part, run, number[lang], sizes[number[lang]]))
        sizes[number[lang]] += rows
    trees, height = Trees(sizes), 1
    while sum(sizes.values()) > BLOCKS * partitions(spark) * ARITY**height:
        height += 1
    blocks = materialize(_blocks(leaves, spark.createDataFrame(starts, "part int, run int, tree int, start long"), height), "merkle-blocks")
    above = spark.sparkContext.broadcast(_forest(blocks, trees, height) if starts else {})
    pair = pa.struct([("before", pa.string()), ("after", pa.string())])
    fields = [pa.field("lang", pa.string()), pa.field("leaf", pa.string()), pa.field("subroot", pa.string()), pa.field("root", pa.string()), pa.field("proof", pa.list_(pair)), pa.field("folded_root", pa.string()), pa.field("verified", pa.bool_())]

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = above.value
        root = forest.get(trees.root(TOP))
        for batch in batches:
            schema = pa.schema([pa.field("doc_id", batch.schema.field("ids").type.value_type), *fields])
            for tree, block, lang, ids, own, changed in zip(*(batch.column(c).to_pylist() for c in ("tree", "block", "lang", "ids", "leaves", "changed"))):
                levels = block_levels(own, trees.levels(tree, height))
                upper = trees.siblings(forest, tree, len(levels) - 1, block)
                subroot, rows = forest[trees.root(tree)], []
                for i, (doc_id, leaf_, other) in enumerate(zip(ids, own, changed)):
                    path, at = [], i
                    for level in levels[:-1]:
                        first = at // ARITY * ARITY
                        path.append(("".join(level[first:at]), "".join(level[at + 1 : first + ARITY])))
                        at //= ARITY
                    folded = fold(other or leaf_, path + upper)
                    rows.append((doc_id, lang, leaf_, subroot, root, [{"before": a, "after": b} for a, b in path + upper], folded, folded == root))
                    if len(rows) == ROWS_OUT or i + 1 == len(ids):
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows = []

    kind = docs.schema["doc_id"].dataType.simpleString()
    return blocks.mapInArrow(prove, f"doc_id {kind}, lang string, leaf string, subroot string, root string, proof array<struct<before:string,after:string>>, folded_root string, verified boolean")


def proof_digest(proof: Column) -> Column:
    """The digest of a proof's digests, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda p: F.concat(p["before"], p["after"])), "").cast("binary"), 256)
