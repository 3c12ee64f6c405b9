"""License scans by patience alignment.

Words are runs of ASCII letters, digits and non-ASCII bytes, in lower case. A template is compared with a stretch of the text like this:
equal words at both ends are matched; of the rest, words that occur exactly once in both are anchors; the longest increasing
subsequence of anchors stays; the gaps between them are aligned the same way. Coverage is the matched share of the template's words.

Which stretches: every place of a word that the template holds once votes for where the template would lie. The place with most votes is taken
with a quarter of the template's length on both sides, then the next one that is not within a quarter of a place taken before; so a text is
aligned a bounded number of times over its length. Before that, documents (and then stretches) that do not hold enough of the template's words to reach the
threshold are passed over, which cannot drop a match. Overlapping finds of a template count once, with the best coverage. Where wordings of
different licenses (versions too) match mostly the same words of a text, the one that matches more of them counts, then the better coverage.

What stands within a match and is not the template's is counted as extra words. Some licenses are another one with words added; where such a
word is among the extra ones, the match goes by their name (``VARIANTS``).

A document is scanned in its own task; only the templates, a fixed list, are sent along.

Result: one row per document with its number of matches, the best match (coverage, then the longer template, the smaller name, the earlier place)
and all matches. Defined cases: null, blank and wordless texts have no match; an empty table gives no rows; equal rows get equal results; other columns are
ignored.
"""

from __future__ import annotations

import json
import pkgutil
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.llm.textkit import slices, span_hashes, text_bytes, word_spans

# Whole texts, headers and notices of licenses, by license id and kind.
TEMPLATES: dict[str, str] = json.loads(pkgutil.get_data(__package__, "license_texts.json"))

# A wording, the word that its variant adds, how often at least, and the variant.
VARIANTS = (
    ("GPL-3.0/text", "affero", 3, "AGPL-3.0/text"),
    ("BSD-3-Clause/text", "advertising", 1, "BSD-4-Clause/text"),
)


@dataclass(frozen=True)
class LicenseParams:
    coverage: float = 0.8


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, index of each text's first word and one more)."""
    data, off = text_bytes(column)
    upper = (data >= 65) & (data <= 90)
    data = np.where(upper, data + 32, data).astype(np.uint8)
    inside = ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57)) | (data >= 128)
    starts, ends, first = word_spans(data, off, inside)
    return span_hashes(data, starts, ends), first


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence (patience piles)."""
    tops, piles, back = [], [], []
    for i, v in enumerate(values):
        at = bisect_left(tops, v)
        back.append(piles[at - 1] if at else -1)
        if at == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[at], piles[at] = v, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched places (in a, in b) of a patience alignment, rising in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        in_a, in_b = Counter(a[i:j]), Counter(b[k:m])
        where = {w: k + x for x, w in enumerate(b[k:m]) if in_b[w] == 1}
        anchors = [(i + x, where[w]) for x, w in enumerate(a[i:j]) if in_a[w] == 1 and w in where]
        kept = [anchors[x] for x in increasing([y for _, y in anchors])]
        if not kept:
            continue
        out += kept
        for (x, y), (x2, y2) in zip([(i - 1, k - 1), *kept], [*kept, (j, m)]):
            todo.append((x + 1, x2, y + 1, y2))
    return sorted(out)


class Templates:
    def __init__(self, texts: dict[str, str], p: LicenseParams):
        self.names = sorted(texts)
        words, first = hashed_words(pa.array([texts[n] for n in self.names], pa.string()))
        self.words = [words[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
        self.vocabulary = np.unique(words)
        # what a present word can add to the coverage, one entry for each word of a template
        entries = [(int(np.searchsorted(self.vocabulary, w)), t, n / len(own)) for t, own in enumerate(self.words) for w, n in Counter(own).items()]
        word, self.template, self.share = (np.array(c) for c in zip(*sorted(entries)))
        self.entry = np.searchsorted(word, np.arange(len(self.vocabulary) + 1))
        self.license = [n.partition("/")[0] for n in self.names]
        self.asked: tuple[list[int], list] = ([], [])
        self.variants: dict[int, tuple[int, int, int]] = {}
        self.labels, self.sizes = list(self.names), [len(own) for own in self.words]
        for name, word, times, variant in VARIANTS:
            if name in texts:
                base = self.names.index(name)
                self.variants[base] = int(hashed_words(pa.array([word]))[0][0]), times, len(self.labels)
                self.labels.append(variant)
                self.sizes.append(self.sizes[base])
        self.once = [{w: own.index(w) for w, n in Counter(own).items() if n == 1} for own in self.words]
        self.p = p

    def places(self, t: int, text: list[int]) -> list[int]:
        """Where the template may lie, by rising place: those with most votes, no two within a quarter of its length."""
        once, near = self.once[t], max(1, len(self.words[t]) // 4)
        taken: list[int] = []
        for place, _ in sorted(Counter(x - once[w] for x, w in enumerate(text) if w in once).items(), key=lambda v: (-v[1], v[0])):
            at = bisect_left(taken, place)
            if (at == 0 or place - taken[at - 1] >= near) and (at == len(taken) or taken[at] - place >= near):
                taken.insert(at, place)
        return taken

    def alone(self, t: int, text: list[int]) -> list[tuple[float, int, int, frozenset[int]]]:
        """(coverage, first word, end, matched words) of the template's matches in a text, not overlapping."""
        own, least = self.words[t], self.p.coverage - 1e-9
        slack, size = len(own) // 4, len(own)
        if len(text) < least * size:
            return []
        left, found = Counter(own), []
        begin = end = common = 0
        for place in self.places(t, text):
            lo, hi = max(0, place - slack), min(len(text), place + size + slack)
            if hi <= lo:
                continue
            for w in text[end:hi]:  # places rise, so the window only moves on
                if w in left:
                    left[w] -= 1
                    common += left[w] >= 0
            for w in text[begin:lo]:
                if w in left:
                    common -= left[w] >= 0
                    left[w] += 1
            begin, end = lo, hi
            if common < least * size:
                continue
            pairs = align(text[lo:hi], own)
            if len(pairs) >= least * size:
                found.append((len(pairs) / size, lo + pairs[0][0], lo + pairs[-1][0] + 1, [lo + x for x, _ in pairs]))
        out: list[tuple[float, int, int, frozenset[int]]] = []
        for cover, a, b, at in sorted(found, key=lambda f: (-f[0], f[2] - f[1], f[1])):
            if all(b <= x or y <= a for _, x, y, _ in out):
                out.append((cover, a, b, frozenset(at)))
        return sorted(out, key=lambda f: f[1])

    def labelled(self, t: int, first: int, end: int, matched: frozenset[int], text: list[int]) -> int:
        """The template's number, or that of its variant."""
        word, times, variant = self.variants.get(t, (0, 0, t))
        return variant if times and sum(text[x] == word and x not in matched for x in range(first, end)) >= times else t

    def among(self, ts: list[int], text: list[int]) -> list[tuple[int, float, int, int, int]]:
        """(label, coverage, first word, end, extra words) of some templates' matches, without those that another license explains better."""
        kept: list[tuple] = []
        for t, *f in sorted(((t, *f) for t in ts for f in self.alone(t, text)), key=lambda f: (-len(f[4]), -f[1], f[0], f[2])):
            if all(self.license[t] == self.license[g[0]] or 2 * len(f[3] & g[4]) <= len(f[3]) for g in kept):
                kept.append((t, *f))
        named = ((self.labelled(t, a, b, at, text), cover, a, b, b - a - len(at)) for t, cover, a, b, at in kept)
        return sorted(named, key=lambda f: (f[0], f[2]))

    def finds(self, t: int, text: list[int]) -> list[tuple[float, int, int, int]]:
        """(coverage, first word, end, extra words) of a label's matches in a text, as all templates together leave them."""
        if self.asked[0] is not text:
            self.asked = text, self.among(list(range(len(self.names))), text)
        return [f[1:] for f in self.asked[1] if f[0] == t]

    def scan(self, words: np.ndarray, first: np.ndarray) -> list[list[tuple[int, float, int, int, int]]]:
        """Matches (label, coverage, first word, end, extra words) of every text of a slice."""
        rows = len(first) - 1
        out: list[list[tuple[int, float, int, int, int]]] = [[] for _ in range(rows)]
        if not len(words):
            return out
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == words
        text = np.repeat(np.arange(rows), np.diff(first))
        pairs = np.unique(text[known] * len(self.vocabulary) + at[known])
        row, word = pairs // len(self.vocabulary), pairs % len(self.vocabulary)
        width = self.entry[word + 1] - self.entry[word]
        entry = np.arange(width.sum()) + np.repeat(self.entry[word] - np.cumsum(width) + width, width)
        bound = np.bincount(np.repeat(row, width) * len(self.names) + self.template[entry], self.share[entry], rows * len(self.names))
        able = bound.reshape(rows, len(self.names)) >= self.p.coverage - 1e-9
        for r in np.flatnonzero(able.any(axis=1)):
            out[r] = self.among(np.flatnonzero(able[r]).tolist(), words[first[r] : first[r + 1]].tolist())
        return out


SCHEMA = (
    "n_matches int, license string, coverage double, first_word int, end_word int, extra_words int, "
    "matches array<struct<license:string,coverage:double,first_word:int,end_word:int,extra_words:int>>"
)


def _scanner(texts: dict[str, str], p: LicenseParams):
    match = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int32()), ("end_word", pa.int32()), ("extra_words", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates, match_names = Templates(texts, p), [f.name for f in match]
        for piece in (s for b in batches for s in slices(b, "text")):
            found = templates.scan(*hashed_words(piece.column("text")))
            best = [min(f, key=lambda m: (-m[1], -templates.sizes[m[0]], m[0], m[2])) if f else None for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"),
                    pa.array([len(f) for f in found], pa.int32()),
                    pa.array([b and templates.labels[b[0]] for b in best], pa.string()),
                    pa.array([b[1] if b else 0.0 for b in best], pa.float64()),
                    pa.array([b and b[2] for b in best], pa.int32()),
                    pa.array([b and b[3] for b in best], pa.int32()),
                    pa.array([b and b[4] for b in best], pa.int32()),
                    pa.array([[dict(zip(match_names, (templates.labels[m[0]], *m[1:]))) for m in f] for f in found], pa.list_(match)),
                ],
                names=["doc_id", "n_matches", *match_names, "matches"],
            )

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, p: LicenseParams = LicenseParams()) -> DataFrame:
    """One row per document: number of matches, the best one, and all of them."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scanner(templates or TEMPLATES, p), f"doc_id {kind}, {SCHEMA}")
