"""Quality rules: base rules over document statistics, then gradient-boosted trees over the same statistics.

1. **Statistics** of every whole text, in one pass without a shuffle: words ``[^\\x20\\x09-\\x0D]+``, their code points, symbols
   ``[#*$%&|<>]``, lines equal to an earlier line, words in 3-word windows that the text has twice or more, and some more. Only these numbers go on.
2. **Base rules**: fewer than ``least_words`` words, or more than ``most_repeated`` percent of them in repeated windows, fails.
3. **Trees** (``boosting.py``) learn from labelled documents that pass the base rules: up to ``rows_per_class`` of each class, those with
   the smallest hash of their id, weighted by how many of their class there are, so that the classes' shares are those of all labels at
   every size. Where a document has more of what ``FEATURES`` marks with -1, its score can only fall. The trees are one set of numpy node arrays (a few
   kilobytes, broadcast), and a batch of documents goes down all of them together.

Defined cases: null and empty texts have no words and fail; a document without a label is judged like any other; labels that are null, whose id
is null or that contradict each other count for nothing; without labels of both classes among the documents that pass, what passes the base
rules is kept (score 1); repeated rows are rows like any other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.boosting import BoostParams, Forest, train
from ledgerloom.llm.shared import materialise
from ledgerloom.llm.textkit import gram_hashes, mix, slices, span_hashes, text_bytes, word_spans

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class QualityParams:
    least_words: int = 50
    most_repeated: int = 50
    rows_per_class: int = 20_000
    least_score: float = 0.5
    boost: BoostParams = field(default_factory=BoostParams)


STATISTICS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_capitals", "n_loud", "n_digits",
)

#: Feature, and how the score may move with it.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "distinct_share": 0,
    "capital_share": -1, "loud_per_word": -1, "digit_share": 0, "words_per_line": 0,
}


def _table_of(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=np.int32)
    table[list(chars)] = 1
    return table


_SYMBOL, _LOUD = _table_of(SYMBOLS), _table_of(b"!?")
_CAPITAL, _DIGIT = _table_of(bytes(range(65, 91))), _table_of(bytes(range(48, 58)))
#: First bytes of code points that are not white space.
_POINT = 1 - _table_of(bytes([32, *range(9, 14), *range(128, 192)]))


def text_statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """``STATISTICS`` of every text, as arrays."""
    data, off = text_bytes(column)
    starts, ends, first = word_spans(data, off)
    n = np.diff(first)
    texts, owner = len(n), np.repeat(np.arange(len(n)), n)

    def total(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        return sums[off[1:]] - sums[off[:-1]]

    def own(keys: np.ndarray, text: np.ndarray) -> np.ndarray:
        return mix(keys ^ mix((text + 1).astype(np.uint64)))

    out = {"n_words": n, "word_chars": total(_POINT), "n_symbols": total(_SYMBOL)}
    breaks = np.flatnonzero(data == 10)
    line_starts, line_ends = np.sort(np.concatenate([off[:-1], breaks + 1])), np.sort(np.concatenate([breaks, off[1:]]))
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[worded], line_ends[worded]
    text = np.searchsorted(off, line_starts, side="right") - 1
    _, head = np.unique(own(span_hashes(data, line_starts, line_ends), text), return_index=True)
    lines = np.bincount(text, minlength=texts)
    out["n_dup_lines"] = lines - np.bincount(text[head], minlength=texts)
    words = span_hashes(data, starts, ends)
    grams = gram_hashes(words, 3)
    at = np.flatnonzero(np.arange(len(grams)) + 3 <= first[1:][owner[: len(grams)]])
    _, inverse, counts = np.unique(own(grams[at], owner[at]), return_inverse=True, return_counts=True)
    edges = np.zeros(len(words) + 4, dtype=np.int64)
    again = at[counts[inverse] > 1]
    edges[again] += 1
    edges[again + 3] -= 1
    covered = np.cumsum(edges)[: len(words)] > 0
    out["n_repeat_words"] = np.bincount(owner[covered], minlength=texts)
    _, head = np.unique(own(words, owner), return_index=True)
    out |= {"n_lines": lines, "n_distinct": np.bincount(owner[head], minlength=texts)}
    return out | {"n_capitals": total(_CAPITAL), "n_loud": total(_LOUD), "n_digits": total(_DIGIT)}


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in (s for b in batches for s in slices(b, "text")):
        found = text_statistics(piece.column("text"))
        yield pa.RecordBatch.from_arrays(
            [piece.column("doc_id"), *(pa.array(found[c].astype(np.int64)) for c in STATISTICS)], names=["doc_id", *STATISTICS]
        )


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the ``STATISTICS`` of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_measure, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in STATISTICS))


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """The ``FEATURES`` of documents with the given statistics, one row each."""
    words, chars, lines = (np.maximum(s[c], 1).astype(float) for c in ("n_words", "word_chars", "n_lines"))
    return np.stack([
        np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / words, s["n_dup_lines"] / lines, s["n_repeat_words"] / words,
        s["n_distinct"] / words, s["n_capitals"] / chars, s["n_loud"] / words, s["n_digits"] / chars, s["n_words"] / lines,
    ], axis=1)


def base_failed(p: QualityParams):
    return (F.col("n_words") < p.least_words) | (100 * F.col("n_repeat_words") > p.most_repeated * F.col("n_words"))


def fit(measured: DataFrame, labels: DataFrame, p: QualityParams = QualityParams()) -> Forest | None:
    """Trees from the documents of ``measured`` that pass the base rules and have a label (doc_id, quality); None if a class is missing."""
    agreed = (
        labels.select("doc_id", "quality").dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
        .filter("quality = most and quality in (0, 1)").drop("most")
    )
    known = measured.filter(~base_failed(p)).join(agreed, "doc_id")
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if len(counts) < 2:
        return None
    parts = []
    for label in (0, 1):
        chosen = known.filter(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id", *STATISTICS).limit(p.rows_per_class)
        parts.append(chosen.select(*STATISTICS).toPandas())
    x = np.concatenate([features({c: t[c].to_numpy() for c in STATISTICS}) for t in parts])
    y = np.repeat([0.0, 1.0], [len(t) for t in parts])
    weight = np.concatenate([np.full(len(t), counts[label] / len(t)) for label, t in enumerate(parts)])
    return train(x, y, weight * len(weight) / weight.sum(), tuple(FEATURES.values()), p.boost)


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest: Forest | None = shared.value
        for batch in batches:
            score = np.ones(batch.num_rows)
            if forest is not None:
                score = forest.probabilities(features({c: batch.column(c).to_numpy() for c in STATISTICS}))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "score"])

    return run


def judged(measured: DataFrame, forest: Forest | None, p: QualityParams = QualityParams()) -> DataFrame:
    """``measured`` with score, base_failed and kept."""
    shared = measured.sparkSession.sparkContext.broadcast(forest)
    rows = measured.select("doc_id", *STATISTICS)
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(_scorer(shared), f"doc_id {kind}, " + ", ".join(f"{c} long" for c in STATISTICS) + ", score double")
    return scored.withColumn("base_failed", base_failed(p)).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= p.least_score))


def judge(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """Statistics, score and verdict of every document, by trees that learn from ``labels``. Texts are read once."""
    measured = materialise(statistics(docs), "quality-statistics")
    return judged(measured, fit(measured, labels, p), p)
