"""Periodic runs in texts, and texts with their repetitions collapsed.

Words are ``[^\\x20\\x09-\\x0D]+``. A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are identical) and
at least ``max(least, 2 q)`` words that no neighbouring word extends keeping the period. Of a run only the first ``q`` words are kept.

The search is a sparse diagonal DP. A diagonal is a lag: it is active at a place while the word there equals the word one lag before, and
its match length counts how long. A run of period ``q`` is a diagonal of lag ``q`` whose match length reaches ``q``. An earlier occurrence
of what stands at a place makes its lag active or increments the length; a diagonal that ends with sufficient length emits its run.

* Lags below 16 are stepped word by word.
* Longer lags ``2 b <= d < 4 b`` (``b`` = 8, 16, 32, ...) are stepped in blocks of ``b`` words: a sufficient match of such a lag holds at
  least one whole block that starts at a multiple of ``b``. Blocks have exact names (pairs of names of half the size), and only the
  earlier occurrences of a block's name at these lags are looked at. A lag whose next block does not match has ended; the words that it
  still matches before its first and after its last block are added by names of halving sizes.
* A block inside a run of a period up to ``b / 2`` skips occurrences inside the same run: their lags are multiples of the period and
  end with that run, which is known already.

So a size costs at most two steps a word, and there are as many sizes as doublings: one word repeated a million times costs little more
than any other text. The steps of all texts of a batch are taken together; sorting by (lag, place) gives every diagonal its steps in the
order of the words. A multiple of a run's period gives the same stretch, of which the smallest lag stays.

Each text is judged alone, so there is no shuffle; a task holds a batch of bounded text (or one longer text) and about 100 bytes a word.

Defined cases: null, empty and blank texts have no words, no runs and an empty collapsed text; repeated rows and rows without an id are
rows like any other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.textkit import mix, slices, span_hashes, text_bytes, word_spans

#: Lags below twice this are stepped word by word; also the smallest block.
_BLOCK = 8


@dataclass(frozen=True)
class RunParams:
    #: Words that a run has at least.
    least: int = 12


def _repeated(keys: np.ndarray, places: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of ``places`` by their keys as an array over all ``n`` places (-1: nothing equal anywhere), and the places with a name."""
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    names = np.full(n, -1, dtype=np.int32)
    names[places[again]] = inverse[again]
    return names, places[again]


def _stepped_by_words(names: np.ndarray, least: int) -> Iterator[np.ndarray]:
    n = len(names)
    for lag in range(1, min(2 * _BLOCK, n)):
        active = np.zeros(n - lag + 2, dtype=np.int8)
        active[1:-1] = (names[lag:] == names[:-lag]) & (names[lag:] >= 0)
        edge = np.diff(active)
        begin, end = np.flatnonzero(edge == 1) + lag, np.flatnonzero(edge == -1) + lag
        enough = end - begin >= max(lag, least - lag)
        yield np.stack([begin[enough] - lag, end[enough], np.full(enough.sum(), lag)], axis=1)


def _run_of_block(runs: np.ndarray, size: int, n: int) -> np.ndarray:
    """For every block, the start of the run of a period up to half a block that holds it; ``n`` where there is none."""
    start = np.full(n // size + 1, n, dtype=np.int64)
    first, last = -(-runs[:, 0] // size), runs[:, 1] // size
    held = (runs[:, 2] * 2 <= size) & (last > first)
    count = (last - first)[held]
    steps = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start[np.repeat(first[held], count) + steps] = np.repeat(runs[held, 0], count)
    return start


def _stepped_by_blocks(levels: list[np.ndarray], places: np.ndarray, size: int, known: np.ndarray, least: int) -> np.ndarray:
    names = levels[-1]
    n = len(names)
    none = np.empty((0, 3), dtype=np.int64)
    blocks = places[places % size == 0]
    if not len(blocks):
        return none
    span = np.int64(n + 1)
    occurrences = np.sort(names[places] * span + places)
    base = names[blocks] * span
    newest = np.minimum(blocks - 2 * size, _run_of_block(known, size, n)[blocks // size] - 1)
    low = np.searchsorted(occurrences, base + np.maximum(blocks - 4 * size + 1, 0), side="left")
    count = np.maximum(np.searchsorted(occurrences, base + np.maximum(newest, -1), side="right") - low, 0)
    if not count.sum():
        return none
    at = np.repeat(blocks, count)
    earlier = occurrences[np.arange(len(at)) + np.repeat(low - (np.cumsum(count) - count), count)] - np.repeat(base, count)
    steps = np.sort((at - earlier) * span + at)
    lag, at = steps // span, steps % span
    fresh = np.concatenate([[True], (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + size)])
    first = np.flatnonzero(fresh)
    lag, begin, end = lag[first], at[first], at[np.append(first[1:], len(at)) - 1] + size
    for level, width in zip(levels[-2::-1], (size >> k for k in range(1, size.bit_length()))):
        back = np.flatnonzero(begin - lag >= width)
        p = begin[back] - width
        back = back[(level[p] >= 0) & (level[p] == level[p - lag[back]])]
        begin[back] -= width
        on = np.flatnonzero(end + width <= n)
        p = end[on]
        on = on[(level[p] >= 0) & (level[p] == level[p - lag[on]])]
        end[on] += width
    enough = end - begin >= np.maximum(lag, least - lag)
    return np.stack([begin - lag, end, lag], axis=1)[enough]


def find_runs(words: np.ndarray, longest: int | None = None, least: int = 12) -> np.ndarray:
    """(start, end, smallest period) of all runs in a sequence of word keys, by start, then period.

    ``longest`` bounds the stretch that can hold a run, as where the sequence joins several texts whose keys differ.
    """
    n = len(words)
    longest = n if longest is None else longest
    names, places = _repeated(words, np.arange(n), n)
    levels, size = [names], 1
    found = [np.empty((0, 3), dtype=np.int64), *_stepped_by_words(names, least)]
    while len(places) and size * 2 * 2 * 2 <= longest:  # a lag of two blocks needs four
        more = places[places + size < n]
        more = more[names[more + size] >= 0]
        kinds = np.int64(n)
        names, places = _repeated(names[more] * kinds + names[more + size], more, n)
        levels.append(names)
        size *= 2
        if size >= _BLOCK:
            found.append(_stepped_by_blocks(levels, places, size, np.concatenate(found), least))
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    if len(runs):
        runs = runs[np.concatenate([[True], (runs[1:, :2] != runs[:-1, :2]).any(axis=1)])]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def planted_order(n: int, h: int) -> np.ndarray:
    """Places of the words that stand at 0..n-1 once the stretch that ``h`` names repeats a part of itself (one text in ten)."""
    order = np.arange(n)
    if n and h >= 0 and h % 10 == 0:
        g = h // 10
        a = g % n
        order[a:] = a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return order


SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _mapper(p: RunParams, in_full: bool):
    def judged(raw: bytes, order: np.ndarray, runs: np.ndarray) -> tuple:
        lines = [f"{s},{e - s},{q}\n" for s, e, q in runs.tolist()]
        sha = hashlib.sha256("".join(lines).encode()).hexdigest()
        words = raw.split()  # of bytes: at 0x20 and 0x09 to 0x0D
        if len(runs) or (order != np.arange(len(order))).any():
            edges = np.zeros(len(order) + 1, dtype=np.int64)
            np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
            np.add.at(edges, runs[:, 1], -1)
            words = [words[i] for i in order[np.cumsum(edges)[:-1] == 0].tolist()]
        kept = b" ".join(words)
        top = (None, None, None, None)
        if len(runs):
            length = runs[:, 1] - runs[:, 0]
            s, e, q = runs[np.lexsort((runs[:, 2], runs[:, 0], -length))[0]].tolist()
            top = (s, e - s, q, 1000 * (e - s) // q)
        out = (len(runs), *top, sha, hashlib.sha256(kept).hexdigest())
        return (*out, [{"start": s, "length": e - s, "period": q} for s, e, q in runs.tolist()], kept.decode()) if in_full else out

    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + ([pa.list_(_RUN), pa.string()] if in_full else [])
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", *(["runs", "collapsed"] if in_full else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (s for b in batches for s in slices(b, "text")):
            data, off = text_bytes(piece.column("text"))
            starts, ends, first = word_spans(data, off)
            sizes = np.diff(first)
            orders = [planted_order(n, h) for n, h in zip(sizes.tolist(), piece.column("plant").to_pylist())]
            places = np.concatenate([o + b for o, b in zip(orders, first)])
            owner = np.repeat(np.arange(len(sizes)), sizes)
            # a word's key holds its text's number, so that no diagonal passes from one text to another
            keys = mix(span_hashes(data, starts, ends)[places] ^ mix((owner + 1).astype(np.uint64)))
            runs = find_runs(keys, int(sizes.max()), p.least)
            cuts = np.searchsorted(runs[:, 0], first)
            rows = []
            for t, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                own = runs[a:b] - np.array([first[t], first[t], 0])
                rows.append(judged(data[off[t] : off[t + 1]].tobytes(), orders[t], own))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *columns], names=["doc_id", *names])

    return run


def collapse_runs(docs: DataFrame, p: RunParams = RunParams(), plant: Column | None = None, in_full: bool = False) -> DataFrame:
    """Per document its runs' number, longest run and digests; with ``in_full`` also all ``runs`` and the ``collapsed`` text.

    ``plant`` (a long, null for none) first repeats a part of a text as ``planted_order`` says, to put known runs into a corpus.
    """
    planted = F.coalesce(plant, F.lit(-1)) if plant is not None else F.lit(-1)
    rows = docs.select("doc_id", planted.cast("long").alias("plant"), "text")
    more = ", runs array<struct<start:long,length:long,period:long>>, collapsed string" if in_full else ""
    return rows.mapInArrow(_mapper(p, in_full), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCHEMA}{more}")
