"""Token-sorted name similarity.

score(a, b) = 200 * LCS(ta, tb) / (len(ta) + len(tb)) on whitespace-tokenised, sorted, lower-case
texts. Comparisons against a threshold are made on integers (``200*LCS >= t*(la+lb)``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORD = 64
_CHUNK = 4096
#: Characters (rows x longest text) that one vectorised step holds.
_CELLS = 1 << 20


def token_sort(c: Column) -> Column:
    """Lower-case tokens in code-point order, joined by one space.

    Without lambdas, also the one ``array_sort`` compares with, which would be interpreted for every comparison; and split at one character,
    as ``split`` compiles any other pattern again for every text.
    """
    text = F.lower(c)
    spaced = F.when(text.rlike(r"[\t\n\x0B\f\r]"), F.regexp_replace(text, r"\s", " ")).otherwise(text)
    return F.array_join(F.sort_array(F.array_remove(F.split(spaced, " "), "")), " ")


def _advance(v: list[np.ndarray], m: list[np.ndarray]) -> None:
    """One text character of the published bit-parallel recurrence ``v = (v + (v & m)) | (v & ~m)``.

    ``v`` and ``m`` hold one array per 64-bit word, lowest first; the addition carries upwards.
    """
    carry = None
    for w in range(len(v)):
        u = v[w] & m[w]
        total = v[w] + u
        if len(v) > 1:
            over = total < u
            if carry is not None:
                total = total + carry
                over |= total < carry
            carry = over.astype(np.uint64)
        v[w] = total | (v[w] & ~m[w])


def _common(v: list[np.ndarray], lengths: np.ndarray) -> np.ndarray:
    """Zero bits of ``v`` below each pattern's length."""
    out = np.zeros(len(lengths), np.int64)
    for w, word in enumerate(v):
        bits = np.clip(lengths - w * _WORD, 0, _WORD)
        low = np.array([(1 << k) - 1 for k in range(_WORD + 1)], dtype=np.uint64)[bits]
        out += bits - np.bitwise_count(word & low).astype(np.int64)
    return out


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code-point matrix and lengths of a null-free string array."""
    n = len(texts)
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(int(lengths.max(initial=0)), 1)
    if int(lengths.sum()) != int(pc.sum(pc.binary_length(texts)).as_py() or 0):
        return np.array(texts.to_pylist(), dtype=f"U{width}").view(np.uint32).reshape(n, width), lengths
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"\0", np.uint8)
    at = offsets[:n, None] + np.arange(width)
    return data[np.minimum(at, len(data) - 1)].astype(np.uint32), lengths


def _compact(matrix: np.ndarray) -> tuple[np.ndarray, int]:
    """Character codes renumbered densely."""
    present = np.zeros(int(matrix.max()) + 1, bool)
    present[matrix] = True
    return (np.cumsum(present) - 1)[matrix], int(present.sum())


def _lcs_rows(pat: np.ndarray, pl: np.ndarray, txt: np.ndarray, tl: np.ndarray) -> np.ndarray:
    """LCS of row i of ``pat`` with row i of ``txt``; all rows advance together."""
    n, pw, tw = len(pl), max(int(pl.max()), 1), max(int(tl.max()), 1)
    ids, pad = _compact(np.concatenate([pat[:, :pw], txt[:, :tw]], axis=1))
    cell = np.arange(n)[:, None] * (pad + 1)
    at_pat = np.ascontiguousarray((np.where(np.arange(pw) < pl[:, None], ids[:, :pw], pad) + cell).T)
    at_txt = np.ascontiguousarray((np.where(np.arange(tw) < tl[:, None], ids[:, pw:], pad) + cell).T)
    masks = [np.zeros(n * (pad + 1), np.uint64) for _ in range(-(-pw // _WORD))]
    for i in range(pw):
        word = masks[i // _WORD]
        word[at_pat[i]] = word.take(at_pat[i]) | np.uint64(1 << (i % _WORD))
    for word in masks:
        word[pad :: pad + 1] = 0
    v = [np.full(n, np.iinfo(np.uint64).max, np.uint64) for _ in masks]
    for j in range(tw):
        _advance(v, [word.take(at_txt[j]) for word in masks])
    return _common(v, pl)


def lcs_pairs(a: pa.Array, b: pa.Array) -> pa.Array:
    """LCS length per pair of strings; null when either side is null."""
    out = np.zeros(len(a), np.int32)
    valid = pc.and_(a.is_valid(), b.is_valid())
    rows = np.flatnonzero(valid.to_numpy(zero_copy_only=False))
    a, b = a.take(pa.array(rows)), b.take(pa.array(rows))
    longest = np.maximum(pc.utf8_length(a).to_numpy(), pc.utf8_length(b).to_numpy()) if len(rows) else rows
    order = np.argsort(longest, kind="stable")
    start = 0
    while start < len(rows):
        end = min(start + _CHUNK, len(rows))
        while end - start > 1 and int(longest[order[end - 1]]) * (end - start) > _CELLS:
            end = start + (end - start) // 2
        part = order[start:end]
        start = end
        am, al = _codes(a.take(pa.array(part)))
        bm, bl = _codes(b.take(pa.array(part)))
        width = max(am.shape[1], bm.shape[1])
        am = np.pad(am, ((0, 0), (0, width - am.shape[1])))
        bm = np.pad(bm, ((0, 0), (0, width - bm.shape[1])))
        swap = al > bl
        pat, txt = np.where(swap[:, None], bm, am), np.where(swap[:, None], am, bm)
        out[rows[part]] = _lcs_rows(pat, np.minimum(al, bl), txt, np.maximum(al, bl))
    return pa.array(out, pa.int32(), mask=~valid.to_numpy(zero_copy_only=False))


@lru_cache(maxsize=1024)
def _masks(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, ch in enumerate(text):
        out[ch] = out.get(ch, 0) | 1 << i
    return out


def common_length(a: str, b: str) -> int:
    """LCS length of one pair, for rules that decide one after the other which pairs they look at."""
    masks, full = _masks(a), (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & masks.get(ch, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


@F.arrow_udf(T.IntegerType())
def lcs_length(a, b):
    return lcs_pairs(a, b)


def _bags(texts: list[str], letters: dict[str, int]) -> np.ndarray:
    """How often each text holds each character of ``letters``."""
    out = np.zeros((len(texts), len(letters)), np.int32)
    for k, t in enumerate(texts):
        for ch in t:
            if ch in letters:
                out[k, letters[ch]] += 1
    return out


#: Cells of a tile of pairs, or of one side of it.
_TILE = 1 << 21


class _Bags:
    """The characters of a block's texts that the other block has too, some texts at a time."""

    def __init__(self, texts: pa.Array):
        self.matrix, self.lengths = _codes(texts)
        self.letters = np.unique(self.matrix[np.arange(self.matrix.shape[1]) < self.lengths[:, None]])

    def counts(self, letters: np.ndarray, at: int, n: int) -> np.ndarray:
        """How often each of ``n`` texts holds each letter."""
        matrix, lengths = self.matrix[at : at + n], self.lengths[at : at + n]
        known = (np.arange(matrix.shape[1]) < lengths[:, None]) & np.isin(matrix, letters)
        cells = np.nonzero(known)[0] * len(letters) + np.searchsorted(letters, matrix[known])
        return np.bincount(cells, minlength=len(lengths) * len(letters)).reshape(len(lengths), len(letters))

    def most(self, letters: np.ndarray) -> np.ndarray:
        step = max(1, _TILE // len(letters))
        return np.max([self.counts(letters, at, step).max(axis=0) for at in range(0, len(self.lengths), step)], axis=0)

    def unary(self, letters: np.ndarray, most: np.ndarray, at: int, n: int) -> np.ndarray:
        """A column per letter and number up to ``most``: whether the text holds it so often. The last column is to be filled in."""
        letter = np.repeat(np.arange(len(most)), most)
        number = np.arange(len(letter)) - np.repeat(np.cumsum(most) - most, most) + 1
        counts = self.counts(letters, at, n)
        out = np.zeros((len(counts), len(letter) + 1), np.float32)
        out[:, :-1] = counts[:, letter] >= number
        return out


def best_block(left: list[str], right: list[str], threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``lcs_block``, but a pair that cannot be its left text's best may be left out.

    The LCS is at most the overlap of the two bags of characters, and of bags in unary notation the overlap is the inner product: one matrix
    product bounds a tile of pairs. A first pass over the tiles finds each left text's most promising partner, whose score is its first bound. A
    second one scores only pairs that can reach the threshold and the best so far.
    """
    none = np.zeros(0, np.int64)
    lefts, rights = pa.array(left, pa.string()), pa.array(right, pa.string())
    ours, theirs = _Bags(lefts), _Bags(rights)
    letters = np.intersect1d(ours.letters, theirs.letters)
    if not len(letters):
        return none, none, none
    most = np.minimum(ours.most(letters), theirs.most(letters))
    rl, side = theirs.lengths, max(1, _TILE // (int(most.sum()) + 1))
    high, wide = min(1024, side), min(2048, side)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def tiles() -> Iterator[tuple[int, np.ndarray]]:
        for at in range(0, len(right), wide):
            tile = theirs.unary(letters, most, at, wide)
            tile[:, -1] = rl[at : at + wide]
            yield at, tile

    for top in range(0, len(left), high):
        n = ours.lengths[top : top + high]
        mine = ours.unary(letters, most, top, high)
        mine[:, -1] = -0.5  # overlap less half the partner's length: most where the fewest characters are not shared
        lead, value = np.zeros(len(n), np.int64), np.full(len(n), -np.inf)
        for at, tile in tiles():
            reach = mine @ tile.T
            pick = reach.argmax(axis=1)
            reach = reach[np.arange(len(n)), pick]
            lead, value = np.where(reach > value, at + pick, lead), np.maximum(reach, value)
        common = lcs_pairs(lefts.slice(top, len(n)), rights.take(pa.array(lead))).to_numpy()
        least = np.maximum(threshold / 200, common / (n + rl[lead]))
        slack = 0.01 + 1e-6 * (n + int(rl.max()))  # what single precision may lose
        for at, tile in tiles():
            mine[:, -1] = -least
            i, j = np.nonzero(mine @ tile.T >= (least * n - slack)[:, None])
            for part in range(0, len(i), 16 * _CHUNK):
                a, b = i[part : part + 16 * _CHUNK], at + j[part : part + 16 * _CHUNK]
                common = lcs_pairs(lefts.take(pa.array(top + a)), rights.take(pa.array(b))).to_numpy().astype(np.int64)
                total = n[a] + rl[b]
                hit = (200 * common >= threshold * total) & (common / total >= least[a])
                a, b, common = a[hit], b[hit], common[hit]
                np.maximum.at(least, a, common / total[hit])
                found.append((top + a, b, common))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (none, none, none)  # type: ignore[return-value]


def lcs_block(
    left: list[str], right: list[str], threshold: int, best_only: bool = False
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of two bounded blocks with 200*LCS >= threshold*(la+lb): (left no, right no, LCS).

    The masks of the larger side are laid out per character once; each text of the smaller side
    then runs over the part of it that can reach the threshold by length and by common characters
    (the LCS is at most the overlap of the two bags of characters). With ``best_only`` pairs that
    cannot be their left text's best may be left out.
    """
    if best_only:
        return best_block(left, right, threshold)
    if len(left) > len(right):
        j, i, n = lcs_block(right, left, threshold)
        return i, j, n
    order = np.argsort([len(t) for t in right], kind="stable")
    texts = [right[k] for k in order]
    lengths = np.array([len(t) for t in texts], np.int64)
    words = -(-max(int(lengths.max()), 1) // _WORD)
    masks: dict[str, list[np.ndarray]] = {}
    for k, t in enumerate(texts):
        for pos, ch in enumerate(t):
            m = masks.get(ch)
            if m is None:
                m = masks[ch] = [np.zeros(len(texts), np.uint64) for _ in range(words)]
            m[pos // _WORD][k] |= np.uint64(1 << (pos % _WORD))
    letters = {ch: k for k, ch in enumerate(masks)}
    right_bags, left_bags = _bags(texts, letters), _bags(left, letters)

    def common_with(t: str, part: np.ndarray) -> np.ndarray:
        v = [np.full(len(part), np.iinfo(np.uint64).max, np.uint64) for _ in range(words)]
        for ch in t:
            m = masks.get(ch)
            if m is not None:
                _advance(v, [w[part] for w in m])
        return _common(v, lengths[part])

    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i, t in enumerate(left):
        n = len(t)
        lo = int(np.searchsorted(lengths * (200 - threshold), threshold * n, "left"))
        hi = int(np.searchsorted(lengths * threshold, (200 - threshold) * n, "right"))
        if lo >= hi:
            continue
        most = np.minimum(right_bags[lo:hi], left_bags[i]).sum(axis=1)
        total = n + lengths[lo:hi]
        part = np.flatnonzero(200 * most >= threshold * total)
        if not len(part):
            continue
        common = common_with(t, lo + part)
        hit = np.flatnonzero(200 * common >= threshold * total[part])
        if len(hit):
            found.append((np.full(len(hit), i), order[lo + part[hit]], common[hit]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(c) for c in zip(*found))  # type: ignore[return-value]


def lcs_native(a: Column, b: Column) -> Column:
    """The textbook dynamic programme as an ``aggregate`` fold; slow, kept as a cross-check."""
    zero = F.array_repeat(F.lit(0), F.length(b) + 1)
    positions = F.when(F.length(b) > 0, F.sequence(F.lit(1), F.length(b))).otherwise(F.array().cast("array<int>"))

    def step(row: Column, ch: Column) -> Column:
        return F.aggregate(
            positions,
            F.array(F.lit(0)),
            lambda acc, j: F.concat(
                acc,
                F.array(
                    F.when(F.substr(b, j, F.lit(1)) == ch, F.get(row, j - 1) + 1).otherwise(
                        F.greatest(F.get(row, j), F.element_at(acc, -1))
                    )
                ),
            ),
        )

    chars = F.filter(F.split(a, ""), lambda c: c != "")
    return F.element_at(F.aggregate(chars, zero, step), -1)


def may_reach(la: Column, lb: Column, threshold: int) -> Column:
    """Length bound that never drops a pair able to score ``threshold``."""
    return F.lit(200) * F.least(la, lb) >= F.lit(threshold) * (la + lb)


def reaches(lcs: Column, la: Column, lb: Column, threshold: int) -> Column:
    return F.lit(200) * lcs >= F.lit(threshold) * (la + lb)


def score(lcs: Column, la: Column, lb: Column) -> Column:
    """0-100; two empty texts count as identical."""
    return F.when(la + lb == 0, F.lit(100.0)).otherwise(F.lit(200.0) * lcs / (la + lb))
