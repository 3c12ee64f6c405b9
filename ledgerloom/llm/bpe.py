"""Byte-level BPE encoding and decoding by merge replay.

A task takes its documents in blocks of bounded text. The words of a block (matches of the pre-tokenizer's pattern) are gathered once each,
and the merges are replayed over all these distinct words together: an inverted index leads from a token pair to the word positions where it
stands, pairs are taken in rank order from a heap, and a merge looks only at its own positions and their two neighbours, whose new pairs join
the index. Each distinct word of the block is thus encoded once, however often it occurs, and the documents' ids are put together from the
words' ids.

The result equals encoding each word by itself: within a word the lowest rank goes first and, among equal ranks, the leftmost place. A merge
is therefore applied to the leftmost place of a word at a time, and further places of the same word come after any lower rank that it opened.

A word of more than ``LONG_WORD`` bytes (letters without spaces, long numbers) is replayed by itself from a heap of (rank, place), so that its
equal pairs need no step each through all its positions; its cost is that of sorting its bytes.

Blocks stand for the corpus: one table of all words would have to meet the texts again through a shuffle of both, which a scan does not need.

Defined cases: a null text is empty (no ids); an empty text has no ids; bytes are those of the UTF-8 text; equal rows give equal rows; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ledgerloom.llm.textkit import slices

#: Text bytes whose words are replayed together.
BLOCK_BYTES = 16 << 20
#: Words above so many bytes are replayed place by place.
LONG_WORD = 256
_NONE = np.int64(1 << 40)


@dataclass(frozen=True)
class Vocabulary:
    """Tokens by id, and for each mergeable pair (sorted key ``left * size + right``) the id that it becomes, which is also its rank."""

    tokens: tuple[bytes, ...]
    byte_ids: np.ndarray
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    by_pair: dict[int, int]

    @property
    def size(self) -> int:
        return len(self.tokens)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or ``_NONE``."""
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NONE)


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    """Reads a rank file: a line per token, base64 and rank. Every split of a token into two tokens is a mergeable pair."""
    ids: dict[bytes, int] = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ids[base64.b64decode(token)] = int(rank)
    tokens = [b""] * (max(ids.values()) + 1)
    pairs = []
    for token, rank in ids.items():
        tokens[rank] = token
        for cut in range(1, len(token)):
            left, right = ids.get(token[:cut]), ids.get(token[cut:])
            if left is not None and right is not None:
                pairs.append((left * len(tokens) + right, rank))
    pairs.sort()
    keys, ranks = np.array(pairs, dtype=np.int64).T
    return Vocabulary(tuple(tokens), np.array([ids[bytes([b])] for b in range(256)], dtype=np.int64), keys.copy(), ranks.copy(), dict(pairs))


def replay(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(token ids of all words one after the other, offsets of the words)."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes)
    n = int(ends[-1]) if len(words) else 0
    # position n is a border: no pair reaches over it
    token = np.full(n + 1, -1, dtype=np.int64)
    token[:n] = v.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
    word = np.full(n + 1, -1, dtype=np.int32)
    word[:n] = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    after = np.arange(1, n + 2, dtype=np.int32)
    before = np.arange(-1, n, dtype=np.int32)
    after[n] = n
    rank = np.full(n + 1, _NONE, dtype=np.int64)
    if n > 1:
        inner = np.flatnonzero(word[: n - 1] == word[1:n])
        rank[inner] = v.ranks(token[inner], token[inner + 1])

    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enlist(places: np.ndarray) -> None:
        """Adds positions to the index under the rank of the pair that begins there."""
        order = places[np.argsort(rank[places], kind="stable")]
        keys = rank[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        for key, run in zip(keys[starts].tolist(), np.split(order, starts[1:])):
            if key in index:
                index[key].append(run)
            else:
                index[key] = [run]
                heappush(heap, key)

    seeds = np.flatnonzero(rank < _NONE)
    if len(seeds):
        enlist(seeds)
    while heap:
        key = heappop(heap)
        runs = index.pop(key)
        places = np.unique(np.concatenate(runs)) if len(runs) > 1 else runs[0]
        places = places[rank[places] == key]
        if not len(places):
            continue
        if len(places) > 1:
            first = np.empty(len(places), dtype=bool)
            first[0] = True
            own = word[places]
            np.not_equal(own[1:], own[:-1], out=first[1:])
            if not first.all():
                index[key] = [places[~first]]
                heappush(heap, key)
                places = places[first]
        gone = after[places]
        right = after[gone]
        token[places] = key
        token[gone] = -1
        rank[gone] = _NONE
        after[places] = right
        before[right] = places
        left = before[places]
        rank[places] = _NONE
        has_right = word[right] == word[places]
        p, r = places[has_right], right[has_right]
        rank[p] = v.ranks(token[p], token[r])
        has_left = (left >= 0) & (word[left] == word[places])
        q, p2 = left[has_left], places[has_left]
        rank[q] = v.ranks(token[q], token[p2])
        fresh = np.concatenate([p, q])
        fresh = fresh[rank[fresh] < _NONE]
        if len(fresh):
            enlist(fresh)
    alive = np.flatnonzero(token[:n] >= 0)
    return token[alive], np.searchsorted(alive, np.concatenate([[0], ends]))


def replay_long(word: bytes, v: Vocabulary) -> list[int]:
    """Token ids of one word: a heap of (rank, place) and a chain of the places that are left."""
    n, none, by_pair, size = len(word), -1, v.by_pair, v.size
    start = v.byte_ids[np.frombuffer(word, dtype=np.uint8)]
    ranks = v.ranks(start[:-1], start[1:])
    places = np.flatnonzero(ranks < _NONE)
    heap = ((ranks[places] << 40) | places).tolist()
    heapify(heap)
    rank = np.where(ranks < _NONE, ranks, none).tolist() + [none]
    token, after, before = start.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        entry = heappop(heap)
        at, key = entry & ((1 << 40) - 1), entry >> 40
        if rank[at] != key:
            continue
        gone = after[at]
        right = after[gone]
        token[at], token[gone], rank[gone], after[at] = key, none, none, right
        if right < n:
            before[right] = at
            rank[at] = found = by_pair.get(key * size + token[right], none)
            if found >= 0:
                heappush(heap, (found << 40) | at)
        else:
            rank[at] = none
        left = before[at]
        if left >= 0:
            rank[left] = found = by_pair.get(token[left] * size + key, none)
            if found >= 0:
                heappush(heap, (found << 40) | left)
    return [t for t in token if t >= 0]


def encode_block(texts: list[str], pattern: regex.Pattern, v: Vocabulary) -> tuple[list[list[int]], list[str]]:
    """The words of each text as numbers, and by number the words' ids as decimal texts joined by commas."""
    numbers: dict[str, int] = {}
    split = []
    for text in texts:
        split.append([numbers.setdefault(w, len(numbers)) for w in pattern.findall(text)])
    words = [w.encode("utf-8", "surrogatepass") for w in numbers]
    long = [len(w) > LONG_WORD for w in words]
    ids, offsets = replay([b"" if apart else w for w, apart in zip(words, long)], v)
    listed = ids.tolist()
    marks = offsets.tolist()
    spelled = [
        ",".join(map(str, replay_long(w, v) if apart else listed[a:b])) for w, apart, a, b in zip(words, long, marks[:-1], marks[1:])
    ]
    return split, spelled


def decode(ids: list[int], v: Vocabulary) -> bytes:
    return b"".join(map(v.tokens.__getitem__, ids))


FIELDS = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]


def _mapper(path: str, pattern: str, ids_too: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, compiled = load(path), regex.compile(pattern)
        for batch in batches:
            for piece in slices(batch, "text", BLOCK_BYTES):
                texts = [t or "" for t in piece.column("text").to_pylist()]
                rows = []
                split, spelled = encode_block(texts, compiled, v)
                for words in split:
                    joined = ",".join(map(spelled.__getitem__, words))
                    ids = list(map(int, joined.split(","))) if joined else []
                    row = (len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decode(ids, v)).hexdigest())
                    rows.append((*row, ids) if ids_too else row)
                fields = [*FIELDS, ("ids", pa.list_(pa.int32()))] if ids_too else FIELDS
                columns = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), *(pa.array(c, t) for c, (_, t) in zip(columns, fields))], names=["doc_id", *(f for f, _ in fields)]
                )

    return run


def encode_documents(docs: DataFrame, path: str, pattern: str, ids_too: bool = False) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the bytes that they decode to; with ``ids_too`` the ids as well."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(_mapper(path, pattern, ids_too), schema + (", ids array<int>" if ids_too else ""))
