"""Conflict-constrained best-fit packing of documents into sequences of fixed capacity.

A document's length is its number of words plus one for the separator. Documents longer than the capacity are cut: full pieces fill a bin each,
the rest is packed like a short document. In a bin no two documents share a source, and no two belong to the same cluster of duplicates
(equal texts unless a cluster column is given).

Documents are dealt into packing shards of bounded size by a hash, so copies and sources spread evenly. In a shard they come longest first
(a stated total order); open bins are kept ordered by what room they have left and carry a bitmap of their sources and one of their
clusters. The search starts at the smallest room that suffices and goes on to the next larger ones until a bin without conflict is found:
the tightest compatible bin. Else a new bin is opened. Bins of one shard never meet another shard's, at the cost of a few partly filled
bins for each shard. Texts do not travel: only ids, lengths, sources and cluster keys do.

Defined cases: null and blank texts have length 1; a null source or cluster conflicts with none; a null id is packed like any other;
repeated rows are copies of each other and get different bins of one shard; ties are broken by doc_id, then by the position in the sorted
order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.textkit import slices, text_bytes, word_spans


@dataclass(frozen=True)
class PackParams:
    capacity: int = 2048
    shard_rows: int = 8192


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in (s for b in batches for s in slices(b, "text")):
        counts = np.diff(word_spans(*text_bytes(piece.column("text")))[2])
        keys = [None if not t.is_valid else int.from_bytes(hashlib.blake2b(t.as_buffer(), digest_size=8).digest(), "big", signed=True) for t in piece.column("text")]
        yield pa.RecordBatch.from_arrays(
            [piece.column("doc_id"), piece.column("source"), pa.array(keys, pa.int64()), pa.array(counts + 1, pa.int64())],
            names=["doc_id", "source", "cluster", "length"],
        )


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, cluster (of equal texts), length."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text")
    return rows.mapInArrow(_measure, "doc_id long, source string, cluster long, length long")


#: Open bins in a block of the order; a block that grows to twice as many is cut.
_BLOCK = 64


class Bins:
    """Open bins by rising room. A bin is (room, number); its bitmaps are kept by number.

    The order is held in blocks. Of each block the bits that all its bins carry are known, so the search passes over a block whose bins all
    conflict in one step, as where a source is in every bin.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.blocks: list[list[tuple[int, int]]] = []
        self.tops: list[tuple[int, int]] = []
        self.common: list[tuple[int, int]] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.fill: list[int] = []

    def new(self) -> int:
        self.sources.append(0)
        self.clusters.append(0)
        self.fill.append(0)
        return len(self.fill) - 1

    def _changed(self, b: int) -> None:
        block = self.blocks[b]
        if not block:
            del self.blocks[b], self.tops[b], self.common[b]
            return
        sources = clusters = -1
        for _, number in block:
            sources &= self.sources[number]
            clusters &= self.clusters[number]
        self.tops[b], self.common[b] = block[-1], (sources, clusters)

    def _insert(self, entry: tuple[int, int]) -> None:
        b = min(bisect_left(self.tops, entry), len(self.blocks) - 1)
        if b < 0:
            self.blocks.append([entry])
            self.tops.append(entry)
            self.common.append((0, 0))
            b = 0
        else:
            insort(self.blocks[b], entry)
        if len(self.blocks[b]) >= 2 * _BLOCK:
            for column, value in ((self.blocks, self.blocks[b][_BLOCK:]), (self.tops, entry), (self.common, (0, 0))):
                column.insert(b + 1, value)
            del self.blocks[b][_BLOCK:]
            self._changed(b + 1)
        self._changed(b)

    def _take(self, size: int, source: int, cluster: int) -> tuple[int, int] | None:
        """The tightest open bin with room for ``size`` and neither bit set, taken out of the order."""
        for b in range(bisect_left(self.tops, (size, -1)), len(self.blocks)):
            if self.common[b][0] & source or self.common[b][1] & cluster:
                continue
            block = self.blocks[b]
            for at in range(bisect_left(block, (size, -1)), len(block)):
                number = block[at][1]
                if not (self.sources[number] & source or self.clusters[number] & cluster):
                    entry = block.pop(at)
                    self._changed(b)
                    return entry
        return None

    def place(self, size: int, source: int, cluster: int) -> int:
        """The number of the tightest compatible bin, a new one if there is none."""
        room, number = self._take(size, source, cluster) or (self.capacity, self.new())
        self.sources[number] |= source
        self.clusters[number] |= cluster
        self.fill[number] += size
        if room > size:
            self._insert((room - size, number))
        return number


def pack(rows: list[tuple], capacity: int) -> list[tuple]:
    """(doc_id, source, cluster, length) rows of a shard, longest first, to (doc_id, piece, begin, size, bin, offset)."""
    bins, out = Bins(capacity), []
    bits: dict = {}
    groups: dict = {}
    seen: dict = {}
    for _, _, cluster, _ in rows:
        seen[cluster] = seen.get(cluster, 0) + 1
    for doc_id, source, cluster, length in rows:
        pieces = length // capacity if length > capacity else 0
        rest = length - pieces * capacity
        for piece in range(pieces):
            number = bins.new()
            bins.fill[number] = capacity
            out.append((doc_id, piece, piece * capacity, capacity, number, 0))
        if rest:
            source_bit = 0 if source is None else 1 << bits.setdefault(source, len(bits))
            cluster_bit = 0 if cluster is None or seen[cluster] < 2 else 1 << groups.setdefault(cluster, len(groups))
            number = bins.place(rest, source_bit, cluster_bit)
            out.append((doc_id, pieces, pieces * capacity, rest, number, bins.fill[number] - rest))
    return out


SCHEMA = "doc_id long, piece int, piece_begin long, piece_words long, shard int, bin long, bin_offset int"


def _packer(p: PackParams):
    def emit(shard: int, rows: list[tuple]) -> pa.RecordBatch:
        packed = list(zip(*pack(rows, p.capacity)))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
        doc_id, piece, begin, size, number, offset = (pa.array(c, t) for c, t in zip(packed, kinds))
        names = ["doc_id", "piece", "piece_begin", "piece_words", "shard", "bin", "bin_offset"]
        return pa.RecordBatch.from_arrays([doc_id, piece, begin, size, pa.array([shard] * len(doc_id), pa.int32()), number, offset], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = None, []
        for batch in batches:
            for at, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "source", "cluster", "length"))):
                if at != shard:
                    if rows:
                        yield emit(shard, rows)
                    shard, rows = at, []
                rows.append(tuple(row))
        if rows:
            yield emit(shard, rows)

    return run


def best_fit(docs: DataFrame, p: PackParams = PackParams(), cluster: str | None = None) -> DataFrame:
    """Where every piece of every document lies: shard, bin (numbered in its shard) and offset in the bin."""
    rows = measured(docs)
    if cluster:
        named = docs.select(F.col("doc_id").cast("long"), F.col(cluster).cast("long").alias("given")).dropDuplicates(["doc_id"])
        rows = rows.join(named, "doc_id", "left").withColumn("cluster", F.col("given")).drop("given")
    shards = max(1, -(-docs.count() // p.shard_rows))
    place = F.pmod(F.xxhash64("doc_id", "length", "cluster"), F.lit(shards)).cast("int")
    dealt = rows.withColumn("shard", place).repartitionById(shards, F.col("shard"))
    order = dealt.sortWithinPartitions("shard", F.desc("length"), "doc_id", "source", "cluster")
    return order.mapInArrow(_packer(p), SCHEMA)
