"""Near-duplicate documents by ProbMinHash, banding and verification.

* **Shingles**: runs of five words (``[^\\x20\\x09-\\x0D]+``, unchanged); a text of fewer words is one shingle. A shingle weighs
  1 + ln(occurrences in its text).
* **Signature**: every shingle sends a Poisson process of arrivals whose rate is its weight; each arrival picks one of ``m`` registers, and a
  register keeps the shingle that arrives first. A shingle stops as soon as its next arrival comes later than all registers' times. Two
  texts agree in a register with the probability Jaccard index of their weighted shingles. A text with a repeated shingle gets a second
  signature, of weights 1: its registers agree with the plain Jaccard index, by which links are defined. Without repeats both are the same.
* **Banding**: ``bands`` groups of registers of either signature; texts that agree on a whole group share a bucket (at a plain Jaccard index
  of 0.8 a pair misses all 40 bands of 6 of weights 1 with a probability of about 5e-6, and at 0.2 one pair in 400 shares one).
* **Verification**: a link needs a Jaccard index of 0.8 or more between the whole shingle sets.

No pairs of a group are written out. Equal texts are one node (smallest doc_id) from the start. First every bucket's members are verified
against its pivot, the member with the most company in all its buckets (the original, where the others are edits of it), and connected
groups are labelled. Then only buckets that still hold several groups are looked at: members
outside a bucket's largest group are compared with the members of other groups (set sizes and a sketch of the plain shingle sets drop what is
far from the threshold, verification decides), so a link between different groups is not lost to the choice of the pivot. Minima and sums are
aggregated before the shuffle and joins are plain equi-joins that AQE can split where a bucket is hot.

Result: one row per document with ``class_id``, the smallest doc_id of its class. Defined cases: null texts and texts without words are
classes of their own; rows that share a doc_id are one document; a null doc_id gets a null class; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import components, materialise
from ledgerloom.llm.textkit import gram_hashes, mix, slices, span_hashes, text_bytes, word_spans


@dataclass(frozen=True)
class NearDupParams:
    shingle: int = 5
    threshold: float = 0.8
    bands: int = 40
    rows: int = 6
    # Second pass: a pair is verified unless its set sizes rule a link out or the estimate lies so many standard deviations below the threshold;
    # the estimate is of the sketch, the smallest hashes of a shingle set (all of them, where a set has no more: then it decides nearly exactly).
    deviations: float = 4.9
    sketch: int = 512
    # Members of a bucket that one unit of the second pass holds and streams.
    x_block: int = 2048
    y_block: int = 16384

    @property
    def registers(self) -> int:
        return self.bands * self.rows

    def least(self, draws: int) -> float:
        """What an estimate from so many draws must reach."""
        return self.threshold - self.deviations * math.sqrt(self.threshold * (1 - self.threshold) / draws)


def shingles(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The hashes of each text's shingles, in order and with repeats; empty where there is no word."""
    data, off = text_bytes(column)
    starts, ends, first = word_spans(data, off)
    words = span_hashes(data, starts, ends)
    grams = gram_hashes(words, k)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        yield grams[a : b - k + 1] if b - a >= k else gram_hashes(words[a:b], b - a) if b > a else words[:0]


def signature(elements: np.ndarray, weights: np.ndarray, m: int) -> np.ndarray:
    """ProbMinHash registers of a weighted set: the 32 low bits of the element that reaches each register first."""
    earliest, chosen = np.full(m, np.inf), np.zeros(m, dtype=np.uint32)
    marks = elements.astype(np.uint32)
    clock = np.zeros(len(elements))
    step = 0
    block = max(1, math.ceil(1.5 * m * math.log(m + 1) / len(elements)))  # enough arrivals to reach all registers at once
    while len(elements):
        count = np.arange(step, step + block, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        draw = mix(elements[:, None] + count[None, :])
        gaps = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights[:, None]
        times = clock[:, None] + np.cumsum(gaps, axis=1)
        clock = times[:, -1]
        register = (((mix(draw) >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64).ravel()
        flat = times.ravel()
        near = np.flatnonzero(flat < earliest[register])
        near = near[np.argsort(-flat[near], kind="stable")]  # of several arrivals at a register, the earliest is written last
        earliest[register[near]] = flat[near]
        chosen[register[near]] = marks[near // block]
        going = clock < earliest.max()
        elements, weights, clock, marks = elements[going], weights[going], clock[going], marks[going]
        step += block
        block = max(1, block // 2)
    return chosen


def band_keys(sig: np.ndarray, p: NearDupParams) -> np.ndarray:
    """(texts, bands) bucket keys of (texts, registers) signatures."""
    parts = sig.reshape(-1, p.bands, p.rows)
    keys = np.broadcast_to(mix(np.arange(p.bands, dtype=np.uint64) + np.uint64(1)), parts.shape[:2])
    for j in range(p.rows):
        keys = mix(keys * np.uint64(0x9FB21C651E98DF25) + parts[:, :, j])
    return keys


def buckets_of(unique: np.ndarray, counts: np.ndarray, p: NearDupParams) -> np.ndarray:
    """Bucket keys of a text, sorted and distinct: those of its weighted shingles and those of its plain shingle set."""
    drawn = [signature(unique, 1.0 + np.log(counts), p.registers)]
    if counts.max() > 1:
        drawn.append(signature(unique, np.ones(len(unique)), p.registers))
    return np.unique(band_keys(np.stack(drawn), p).view(np.int64))


def _signer(p: NearDupParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (s for b in batches for s in slices(b, "text")):
            keys, sizes, marks = [], [], []
            for text, grams in zip(piece.column("text"), shingles(piece.column("text"), p.shingle)):
                keys.append(hashlib.md5(text.as_buffer() or b"").digest())
                unique, counts = np.unique(grams, return_counts=True)
                marks.append(buckets_of(unique, counts, p).tobytes() if len(unique) else b"")
                sizes.append(len(unique))
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(marks, pa.binary())],
                names=["doc_id", "text_key", "n_shingles", "buckets"],
            )

    return run


def signatures(docs: DataFrame, p: NearDupParams) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(_signer(p), "doc_id long, text_key binary, n_shingles int, buckets binary")


def _bander(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            own = batch.column("buckets").to_pylist()
            keys = np.frombuffer(b"".join(own), dtype=np.int64)
            nodes = np.repeat(batch.column("node").to_numpy(), [len(k) // 8 for k in own])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(nodes)], names=["bucket", "node"])


def _set_maker(p: NearDupParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (s for b in batches for s in slices(b, "text")):
            sets = [np.unique(g) for g in shingles(piece.column("text"), p.shingle)]
            marks = [np.unique((mix(s) >> np.uint64(32)).astype(np.uint32))[: p.sketch].tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [piece.column("node"), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(marks, pa.binary())], names=["node", "grams", "sketch"]
            )

    return run


def jaccard(a: bytes, b: bytes) -> float:
    """Jaccard index of two sorted sets of hashes."""
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    if not len(x) or not len(y):
        return 0.0
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common / (len(both) - common)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [jaccard(a.as_buffer(), b.as_buffer()) for a, b in zip(batch.column("grams_a"), batch.column("grams_b"))]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(values, pa.float64())], names=["a", "b", "similarity"])


def verified(pairs: DataFrame, sets: DataFrame, p: NearDupParams) -> DataFrame:
    """The pairs (a, b) whose shingle sets reach the threshold."""
    right = pairs.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("grams_b")), "b")
    both = right.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("grams_a")), "a")
    judged = both.select("a", "b", "grams_a", "grams_b").mapInArrow(_judge, "a long, b long, similarity double")
    return judged.filter(F.col("similarity") >= p.threshold)


def may_link(a: bytes, b: bytes, p: NearDupParams) -> bool:
    """False only where the sketches (sorted smallest hashes of two sets) put the Jaccard index well below the threshold."""
    x, y = np.frombuffer(a, dtype=np.uint32), np.frombuffer(b, dtype=np.uint32)
    whole = len(x) < p.sketch and len(y) < p.sketch
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    twice = both[1:] == both[:-1]
    if whole:  # the sets themselves, but for collisions of 32-bit hashes
        common = int(np.count_nonzero(twice))
        return common >= (p.threshold - 0.005) * (len(both) - common)
    # the smallest hashes of the union are a sample of it; those that stand twice lie in both sets
    fresh = np.concatenate([[True], ~twice])
    last = np.flatnonzero(fresh)[: p.sketch + 1]
    k = min(len(last), p.sketch)
    end = last[p.sketch] if len(last) > p.sketch else len(both)
    return int(np.count_nonzero(twice[: end - 1])) >= p.least(k) * k


def _block_pairs(p: NearDupParams):
    """Rows sorted by (bucket, x_block, y_block, asks descending): members outside the largest group (x) first, then all members (y).

    Emits the pairs of unlike groups whose sizes and sketches allow a link, each in the smallest of the buckets that the two share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, xs = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "x_block", "y_block", "asks")]
            node, root, outside, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "root", "outside", "n_shingles"))
            buckets, sketches = batch.column("buckets"), batch.column("sketch")
            change = np.zeros(len(node), bool)
            for k in keys:
                change[1:] |= k[1:] != k[:-1]
            found_x, found_y = [], []
            for a, b in zip([0, *np.flatnonzero(change)], [*np.flatnonzero(change), len(node)]):
                now = tuple(k[a] for k in keys[:3])
                if now != group:
                    group, xs = now, []
                lower = lambda r: frozenset(k for k in np.frombuffer(buckets[r].as_buffer(), dtype=np.int64).tolist() if k < now[0])  # noqa: B023, E731
                if keys[3][a]:
                    xs += [(node[r], root[r], size[r], lower(r), sketches[r].as_py()) for r in range(a, b)]
                    continue
                before: dict[int, tuple] = {}
                for x, rx, nx, bx, kx in xs:
                    # a pair of two outside members is met twice: from the smaller id only
                    hit = (root[a:b] != rx) & (~outside[a:b] | (x < node[a:b]))
                    hit &= np.minimum(size[a:b], nx) >= (p.threshold - 1e-9) * np.maximum(size[a:b], nx)
                    for r in (a + np.flatnonzero(hit)).tolist():
                        if r not in before:
                            before[r] = lower(r), sketches[r].as_py()
                        by, ky = before[r]
                        if bx.isdisjoint(by) and may_link(kx, ky, p):
                            found_x.append(x)
                            found_y.append(node[r])
            if found_x:
                x, y = np.array(found_x, dtype=np.int64), np.array(found_y, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return run


def _second_pass(members: DataFrame, labels: DataFrame, nodes: DataFrame, sets: DataFrame, p: NearDupParams) -> DataFrame:
    """Pairs of unlike groups in buckets that hold several groups; one of the two is outside its bucket's largest group.

    Outside members and all members of a bucket are cut into blocks of bounded size, and a pair of blocks is one unit of work: a large
    bucket spreads over many tasks, and no task holds more than a block.
    """
    named = members.join(labels, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    groups = named.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = groups.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("groups"), F.sum("n").alias("size"), F.max(F.struct("n", "root")).alias("largest")
    ).filter("groups > 1")
    blocks = mixed.select(
        "bucket", F.col("largest.root").alias("largest"),
        F.ceil((F.col("size") - F.col("largest.n")) / F.lit(p.x_block)).alias("xs"), F.ceil(F.col("size") / F.lit(p.y_block)).alias("ys"),
    )
    known = nodes.select("node", "n_shingles", "buckets").join(sets.select("node", "sketch"), "node")
    rows = named.join(blocks, "bucket").join(known, "node").withColumn("outside", F.col("root") != F.col("largest"))
    at = F.xxhash64("node")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    keep = ["bucket", "node", "root", "outside", "n_shingles", "buckets", "sketch"]
    asks = rows.filter("outside").select(*keep, F.lit(True).alias("asks"), F.pmod(at, F.col("xs")).alias("x_block"), every("ys").alias("y_block"))
    answers = rows.select(*keep, F.lit(False).alias("asks"), every("xs").alias("x_block"), F.pmod(at, F.col("ys")).alias("y_block"))
    units = asks.unionByName(answers).repartition("bucket", "x_block", "y_block")
    order = units.sortWithinPartitions("bucket", "x_block", "y_block", F.desc("asks"), "node")
    return order.mapInArrow(_block_pairs(p), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, p: NearDupParams = NearDupParams()) -> DataFrame:
    """doc_id, class_id, n_shingles for every document."""
    signed = materialise(signatures(docs, p), "signatures")
    texts = signed.filter("n_shingles > 0 and doc_id is not null").groupBy("text_key").agg(
        F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("buckets").alias("buckets")
    )
    texts = materialise(texts, "texts")
    bands = texts.select("node", "buckets").mapInArrow(_bander, "bucket long, node long")
    sizes = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = materialise(bands.join(sizes, "bucket"), "members")
    company = members.groupBy("node").agg(F.sum("n").alias("company"))
    pivots = members.join(company, "node").groupBy("bucket").agg(F.max_by("node", F.struct("company", -F.col("node"))).alias("pivot"))
    members = members.drop("n")
    involved = members.select("node").distinct()
    texts_of = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(materialise(involved, "involved"), "node")
    sets = materialise(texts_of.mapInArrow(_set_maker(p), "node long, grams binary, sketch binary"), "shingle-sets")
    arms = members.join(pivots, "bucket").filter("node <> pivot")
    stars = materialise(arms.select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct(), "stars")
    links = materialise(verified(stars, sets, p), "links")
    labels = components(links)
    more = _second_pass(members, labels, texts, sets, p).join(stars, ["a", "b"], "left_anti")
    more = materialise(verified(more, sets, p), "links")
    if not more.isEmpty():
        labels = components(labels.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more.select("a", "b")))
    same = texts.select("text_key", "node").join(labels, "node", "left").select("text_key", F.coalesce("root", "node").alias("class_id"))
    out = signed.select("doc_id", "text_key", "n_shingles").join(same, "text_key", "left")
    alone = F.col("n_shingles") == 0
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.when(F.col("doc_id").isNotNull(), F.col("class_id"))).alias("class_id"), "n_shingles")
