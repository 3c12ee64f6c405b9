"""A Merkle manifest of a dataset as a persistent tree: proofs of all rows, and a version of the tree for every altered row.

A row's leaf is the SHA-256 of its columns, each as ``-`` for null or else its UTF-8 byte count, a colon and its value. The leaves of a source
by rising doc_id make a tree: while several nodes remain, every 16 consecutive ones become the hash of their joined hexadecimal digests.
What remains of the sources, in their order, makes the tree on top in the same way.

* **Aligned blocks.** 16**3 consecutive nodes are a block, the unit of work: a task reduces it by three levels, and the blocks' roots are the
  nodes of the next layer, again in blocks. A layer is one shuffle of a 4 096th of the rows of the layer below. A source of any size is cut
  into blocks, and the sources' own roots are numbered and cut in the same way.
* **Places.** Leaves are sorted into ranges; a leaf's place in its source is its place in its range plus the source's leaves in the ranges
  before, of which there is one count per range and source.
* **Proofs** go down the layers: a block learns the siblings above its root and hands to each of its nodes those and the siblings within.
  A block's leaves meet one such row, in a stream sorted by place; a task holds one block.
* **Versions.** An altered leaf copies the nodes on its path and shares all others with the original tree: its ancestors within the leaf block
  are copied where the block is, and the version goes on as a row that meets the siblings above its block and copies the
  upper ancestors there. ``copied`` holds a version's own digests, from leaf to root. Versions of one block meet one row of siblings, so a source
  that holds most versions spreads over its blocks. A row that is not altered has the original version.
* **Folds.** Every row's root is recomputed where its block is, from the altered leaf or else its own and the original siblings within and above the
  block. It is never taken over from the tree, so a damaged digest or path shows up in rows that nobody altered, too.

Defined cases: null columns are ``-``; a null source is a source of its own and comes first; a null doc_id comes first in its source and is never altered by
the query; equal doc_ids are ordered by their leaves; repeated rows are leaves of their own; an empty table gives no rows; other columns are
ignored. Cells of ``columns`` can be of any type that casts to string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.shared import materialise

ARITY = 16
LEVELS = 3
BLOCK = ARITY**LEVELS
_HEX = 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<l:string,r:string>>"
_PATH_ARROW = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(columns: list[Column]) -> Column:
    def entry(c: Column) -> Column:
        value = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.sha2(F.concat(*[entry(c) for c in columns]).cast("binary"), 256)


def leaf_rows(docs: DataFrame, altered: dict[str, Column], where: Column) -> DataFrame:
    """tree (the source), doc_id, digest and, ``where`` a row is altered, its digest with the columns of ``altered`` in place."""
    plain = [F.col(c) for c in COLUMNS]
    other = leaf_digest([altered.get(c, F.col(c)) for c in COLUMNS])
    return docs.select(
        F.col("source").alias("tree"), "doc_id", leaf_digest(plain).alias("digest"), F.when(F.coalesce(where, F.lit(False)), other).alias("altered")
    )


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` (from 0, by ``order`` in each tree) and ``total`` (the tree's rows). ``order`` begins with the tree."""
    # the last key lets equal rows fall into different ranges
    keys = [*order, "tie"]
    ranged = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    ranked = materialise(ranged.withColumn("mid", F.monotonically_increasing_id()), "manifest-sorted")
    ranked = ranked.withColumn("range", F.shiftright("mid", 33))
    tree = order[0]
    before = Window.partitionBy(tree).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranked.groupBy(tree, "range").agg(F.min("mid").alias("first"), F.count(F.lit(1)).alias("n"))
    shifts = counts.select(
        F.col(tree).alias("at_tree"), F.col("range").alias("at_range"),
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(Window.partitionBy(tree)).alias("total"),
    )
    same = F.col(tree).eqNullSafe(F.col("at_tree")) & (F.col("range") == F.col("at_range"))
    joined = ranked.join(materialise(shifts, "manifest-shifts"), same)
    return joined.select(*rows.columns, (F.col("mid") + F.col("shift")).alias("pos"), "total")


def levels_of(total: int) -> int:
    """Levels that a block of a tree with ``total`` nodes is reduced by."""
    n, levels = total, 0
    while n > 1 and levels < LEVELS:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def block_levels(digests: list[str], total: int) -> list[list[str]]:
    """The nodes of a block, level by level."""
    out = [digests]
    for _ in range(levels_of(total)):
        below = out[-1]
        out.append([_hash("".join(below[i : i + ARITY])) for i in range(0, len(below), ARITY)])
    return out


def siblings(level: list[str], i: int) -> tuple[str, str]:
    """What stands left and right of node ``i`` in its run."""
    start = i - i % ARITY
    return "".join(level[start:i]), "".join(level[i + 1 : start + ARITY])


def folded(node: str, path: list[dict]) -> str:
    """The root that a node gives with the siblings ``path`` above it."""
    for step in path:
        node = _hash(step["l"] + node + step["r"])
    return node


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """((tree, block), its rows) of batches sorted by tree and block; at most one block is held."""
    key, rows = None, []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for row in zip(*columns):
            if rows and row[:2] != key:
                yield key, rows
                rows = []
            key = row[:2]
            rows.append(row)
    if rows:
        yield key, rows


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """tree, block, pos, total, digest -> tree, pos, total, digest of the block's root."""

    def roots():
        for (tree, block), rows in _blocks(batches):
            total = rows[0][3]
            yield tree, block, -(-total // BLOCK), block_levels([r[4] for r in rows], total)[-1][0]

    yield from _in_batches(roots(), pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("total", pa.int64()), ("digest", pa.string())]))


def _descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """tree, block, pos, total, digest, path (on a block's first row, which has no node) -> tree, pos, path of every node."""

    def paths():
        for (tree, _), (head, *rows) in _blocks(batches):
            levels = block_levels([r[4] for r in rows], rows[0][3])
            for i, row in enumerate(rows):
                inner = [siblings(level, i // ARITY**k) for k, level in enumerate(levels[:-1])]
                yield tree, row[2], [*({"l": a, "r": b} for a, b in inner), *head[5]]

    yield from _in_batches(paths(), pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("path", _PATH_ARROW)]), 256)


def _prover(ids: pa.DataType):
    """As ``_descend`` over leaves, with doc_id and altered: proofs, every row's folded root, and the copied nodes within the block."""
    schema = pa.schema([
        ("tree", pa.string()), ("block", pa.int64()), ("doc_id", ids), ("leaf", pa.string()), ("proof_sha256", pa.string()),
        ("folded_root", pa.string()), ("copied", pa.list_(pa.string())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_out():
            for (tree, block), (head, *rows) in _blocks(batches):
                levels = block_levels([r[4] for r in rows], rows[0][3])
                above = ["".join(x["l"] + x["r"] for x in head[5])]
                for k in range(len(levels) - 2, 0, -1):
                    above = ["".join(siblings(levels[k], i)) + above[i // ARITY] for i in range(len(levels[k]))]
                inner = len(levels) > 1
                for i, row in enumerate(rows):
                    proof = _hash("".join(siblings(levels[0], i)) + above[i // ARITY]) if inner else _hash(above[0])
                    own = [row[4] if row[7] is None else row[7]]
                    for k, level in enumerate(levels[:-1]):
                        left, right = siblings(level, i // ARITY**k)
                        own.append(_hash(left + own[-1] + right))
                    yield tree, block, row[6], row[4], proof, folded(own[-1], head[5]), None if row[7] is None else own

        yield from _in_batches(rows_out(), schema)

    return run


def _by_block(rows: DataFrame) -> DataFrame:
    """Rows with tree and pos as first columns tree, block, pos, ...; dealt by block and in order."""
    rest = [c for c in rows.columns if c not in ("tree", "block", "pos")]
    block = F.col("block") if "block" in rows.columns else F.floor(F.col("pos") / BLOCK).cast("long").alias("block")
    return rows.select("tree", block, "pos", *rest).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def layers_above(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` (tree, pos, total, digest) and the layers of block roots above, up to one node a tree."""
    layers = [nodes]
    while (layers[-1].agg(F.max("total")).first()[0] or 0) > 1:
        dealt = _by_block(layers[-1].select("tree", "pos", "total", "digest"))
        layers.append(materialise(dealt.mapInArrow(_reduce, "tree string, pos long, total long, digest string"), "manifest-nodes"))
    return layers


def with_paths(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """``nodes`` dealt by block, a block's first row being the one of ``above`` (tree, pos: the block, path)."""
    heads = above.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "path")
    plain = nodes.select(
        "tree", F.floor(F.col("pos") / BLOCK).cast("long").alias("block"), "pos", "total", "digest",
        F.lit(None).cast(_PATH).alias("path"), *[c for c in nodes.columns if c not in ("tree", "pos", "total", "digest")],
    )
    joined = plain.unionByName(heads, allowMissingColumns=True)
    return _by_block(joined)


def paths_of(layers: list[DataFrame], top: DataFrame) -> DataFrame:
    """Siblings above the nodes of the lowest but one layer, from those (``top``: tree, path) above the trees' roots."""
    above = top.select("tree", F.lit(0).cast("long").alias("pos"), "path")
    for nodes in layers[:0:-1]:
        dealt = with_paths(nodes.select("tree", "pos", "total", "digest"), above)
        above = materialise(dealt.mapInArrow(_descend, f"tree string, pos long, path {_PATH}"), "manifest-paths")
    return above


@dataclass
class Manifest:
    """Leaves with their places, the layers of block roots per source, the sources' roots with the siblings above them, and the root."""

    leaves: DataFrame
    layers: list[DataFrame]
    sources: DataFrame
    root: str | None


def build(rows: DataFrame) -> Manifest:
    """The tree over ``leaf_rows``."""
    leaves = materialise(placed(materialise(rows, "manifest-leaves"), ["tree", "doc_id", "digest"]), "manifest-placed")
    layers = layers_above(leaves)
    subroots = layers[-1].select(F.lit(None).cast("string").alias("tree"), F.col("tree").alias("source"), "digest")
    tops = materialise(placed(subroots, ["tree", "source"]), "manifest-subroots")
    upper = layers_above(tops)
    top = upper[-1].select("digest").first()
    above = upper[-1].select("tree", F.array().cast(_PATH).alias("path"))
    above = paths_of(upper, above)
    dealt = with_paths(tops.select("tree", "pos", "total", "digest"), above)
    paths = dealt.mapInArrow(_descend, f"tree string, pos long, path {_PATH}").select("pos", "path")
    sources = tops.join(paths, "pos").select("source", F.col("digest").alias("subroot"), "path")
    return Manifest(leaves, layers, materialise(sources, "manifest-sources"), top["digest"] if top else None)


def prove(manifest: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (recomputed from the altered, else own, leaf and the original siblings) and
    ``copied`` (null: not altered; else the version's own digests, from leaf to root)."""
    top = manifest.sources.select(F.col("source").alias("tree"), "path")
    above = paths_of(manifest.layers, top)
    kind = manifest.leaves.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    dealt = with_paths(manifest.leaves.select("tree", "pos", "total", "digest", "doc_id", "altered"), above)
    ddl = f"tree string, block long, doc_id {kind.simpleString()}, leaf string, proof_sha256 string, folded_root string, copied array<string>"
    proofs = materialise(dealt.mapInArrow(_prover(to_arrow_type(kind)), ddl), "manifest-proofs")
    names = manifest.sources.select("source", "subroot")
    rows = proofs.join(names, proofs["tree"].eqNullSafe(names["source"])).withColumn("root", F.lit(manifest.root)).drop("source")
    upper = above.select(F.col("tree").alias("at_tree"), F.col("pos").alias("at_block"), "path")
    same = F.col("tree").eqNullSafe(F.col("at_tree")) & (F.col("block") == F.col("at_block"))
    grown = F.aggregate(
        "path", F.col("copied"), lambda own, x: F.concat(own, F.array(F.sha2(F.concat(x["l"], F.element_at(own, -1), x["r"]).cast("binary"), 256)))
    )
    columns = ["doc_id", F.col("tree").alias("source"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "copied"]
    versions = rows.filter("copied is not null").join(upper, same).withColumn("copied", grown)
    return rows.filter("copied is null").select(*columns).unionByName(versions.select(*columns))


def manifest_rows(docs: DataFrame, altered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """``prove`` of ``docs`` with verified (whether the folded root is the root)."""
    where = F.lit(False) if where is None else where
    return prove(build(leaf_rows(docs, altered or {}, where))).withColumn("verified", F.col("folded_root") == F.col("root"))
