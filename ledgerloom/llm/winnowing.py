"""Document fingerprints by winnowing, and how alike neighbouring documents are.

A text's k-grams of code points get rolling hashes; of every window of ``w`` consecutive hashes the minimum is kept, the rightmost where
several are equal, together with its position. Two texts that share a run of ``w + k - 1`` code points or more therefore share a
fingerprint (the match guarantee), and no match shorter than ``k`` counts. A text too short for one window keeps its single minimum; one
shorter than ``k`` keeps the hash of the whole; an empty text has no fingerprint. The printed form holds 16 hex digits for each selected
hash: 8 of the hash, 8 of its position.

Likeness is the Jaccard index of the two sets of selected hashes (two empty sets: 1; one empty: 0).

Neighbours: documents in falling doc_id order, the last one's neighbour being the first. The table is cut into id ranges of about equal
row counts; each range is one sorted partition and gets the head of the next range as well, so nothing but one row a range is moved twice,
and a task holds one text and its neighbour. Driver and broadcast see one id per range.

Defined cases: null text is empty; null ids come last; rows with equal ids follow one another by text (so repeated rows are their own
neighbours); a table of one row is its own neighbour; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.textkit import mix, slices

_BASE = 0x100000001B3


@dataclass(frozen=True)
class WinnowParams:
    k: int = 20
    w: int = 64

    @property
    def guarantee(self) -> int:
        """Shared runs of at least so many code points are always found."""
        return self.k + self.w - 1


def rolling_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """32-bit hashes of all k-grams: runs of powers of two are combined, so a k-gram costs about log k steps."""
    n = len(points) - k + 1
    have = points.astype(np.uint64) + np.uint64(1)
    factor, width = _BASE, 1
    out, done = None, 0
    while True:
        if k & width:
            part = have[done : done + n]
            out = part if out is None else out * np.uint64(factor) + part
            done += width
        if width * 2 > k:
            break
        have = have[:-width] * np.uint64(factor) + have[width:]
        factor, width = factor * factor % (1 << 64), width * 2
    return mix(out) >> np.uint64(32)


def winnow(points: np.ndarray, p: WinnowParams) -> np.ndarray:
    """Selected (hash << 32 | position) of a text given as code points, by rising position."""
    n = len(points)
    if not n:
        return np.empty(0, np.uint64)
    hashes = rolling_hashes(points, min(p.k, n))
    m = len(hashes)
    # the complement of the position makes the rightmost of equal hashes the smallest key
    low = np.uint64(0xFFFFFFFF)
    keys = (hashes << np.uint64(32)) | (low - np.arange(m, dtype=np.uint64))
    w = min(p.w, m)
    width = 1
    have = keys
    while width * 2 <= w:
        have = np.minimum(have[:-width], have[width:])
        width *= 2
    windows = m - w + 1
    chosen = np.minimum(have[:windows], have[w - width : w - width + windows])
    fresh = np.empty(windows, dtype=bool)
    fresh[0] = True
    np.not_equal(chosen[1:], chosen[:-1], out=fresh[1:])
    chosen = chosen[fresh]
    return (chosen & ~low) | (low - (chosen & low))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index of two sorted sets of hashes."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common / (len(a) + len(b) - common)


def printed(marks: np.ndarray) -> str:
    return marks.astype(">u8").tobytes().hex()


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _fingerprint(text: str, p: WinnowParams) -> tuple[np.ndarray, np.ndarray]:
    marks = winnow(_points(text), p)
    return marks, np.unique(marks >> np.uint64(32))


def _range_number(cuts: list[int]) -> Column:
    """The number of falling cuts above the id, as a search tree; null ids come after all."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("doc_id") < cuts[mid], tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(tree(0, len(cuts)))


def _ranges(docs: DataFrame) -> tuple[DataFrame, int]:
    """``docs`` with the range of each row; the head of a range is there a second time, as the tail of the range before."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    quantiles = docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 1 / (4 * parts)) if parts > 1 else []
    cuts = sorted({int(c) for c in quantiles}, reverse=True)
    part = _range_number(cuts)
    heads = sorted((r["part"], r["head"]) for r in docs.groupBy(part.alias("part")).agg(F.max("doc_id").alias("head")).collect())
    # the first range holds the largest ids; its head follows the last range
    links = [(head, heads[i - 1][0]) for i, (_, head) in enumerate(heads)]
    link = spark.createDataFrame(links, "head long, goes int")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), part.alias("part"))
    own = F.struct(F.col("part"), F.lit(False).alias("tail"))
    tail = F.struct(F.col("goes").alias("part"), F.lit(True).alias("tail"))
    places = F.when(F.col("goes").isNull(), F.array(own)).otherwise(F.array(own, tail))
    joined = rows.join(F.broadcast(link), F.col("doc_id").eqNullSafe(F.col("head")), "left")
    return joined.select("doc_id", "text", F.explode(places).alias("place")).select("doc_id", "text", "place.part", "place.tail"), len(cuts) + 1


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
    "n_marks int"
)


def _mapper(p: WinnowParams):
    def emit(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (
                pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32()))],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_marks"],
        )

    def pair(this: tuple, after: tuple) -> tuple:
        doc_id, text, (marks, hashes) = this
        n = len(text)
        half = n // 2
        edited = text[: n - half] + after[1][:half]
        edited_marks, edited_hashes = _fingerprint(edited, p)
        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return (doc_id, n, sha, printed(marks), printed(edited_marks), likeness(hashes, edited_hashes), likeness(hashes, after[2][1]), len(marks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, closed = None, None, False
        rows, size = [], 0
        for piece in (s for batch in batches for s in slices(batch, "text")):
            for doc_id, text, at, tail in zip(*(c.to_pylist() for c in piece.columns)):
                if at != part:
                    part, held, closed = at, None, False
                if closed:
                    continue  # further rows with the head's id: the first one is the neighbour
                now = (doc_id, text, _fingerprint(text, p))
                if held is not None:
                    rows.append(pair(held, now))
                    size += len(rows[-1][3]) + len(rows[-1][4])
                held, closed = now, tail
                if size > 4 << 20:
                    yield emit(rows)
                    rows, size = [], 0
        if rows:
            yield emit(rows)

    return run


def fingerprint_documents(docs: DataFrame, p: WinnowParams = WinnowParams()) -> DataFrame:
    """One row per document: its fingerprint, that of its half-replaced text, and both likenesses."""
    rows, parts = _ranges(docs)
    placed = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "tail", F.col("doc_id").desc_nulls_last(), "text")
    return placed.mapInArrow(_mapper(p), SCHEMA)
