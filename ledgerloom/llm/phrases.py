"""Substring dedup with repeated-phrase automata.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A window is 20 consecutive words of one document; a word goes if a window covers it whose word
sequence also starts earlier (in a smaller doc_id, or further up in the same document). Windows are judged on the input.

1. **Recurring passages are confirmed.** Each window is represented by its anchor, the smallest hash among the 5-word runs that it holds
   (leftmost of equals), so equal windows have the same anchor at the same distance, and about one word in eight is an anchor. An anchor
   travels once, with 48-bit digests of the windows that it stands for; rows of one anchor meet sorted by (doc_id, place), and every
   window that was seen before in its group is a repeat. Documents are dealt into shards by a hash; of the repeats of a window in a
   shard the first one alone is confirmed. Adjacent confirmed windows make up a passage.
2. **Automata.** A shard's passages are compiled into one Aho-Corasick automaton. Its phrases are tiles of half a window, one after the other
   from a passage's start, so every window of a passage holds a whole tile; phrases of bounded length keep failure chains short.
3. **Every document of the shard is streamed** through it: the automaton finds where a passage recurs, which is known of one place only. A
   tile that is found is extended along its passage; what is then a window long goes if it stands at or after the place where it was confirmed.

A shard holds a bounded amount of text (or one longer text). Hot anchors (a run of 5 words that a noticeable share of documents has) are found
in a small sample; the sample only routes. Their windows travel one by one under a key of their own, after repeats within a slice were
settled on the spot, so a phrase in a third of all documents neither gathers in a task nor needs memory for its varying surroundings.

Defined cases: null and blank texts have no words; rows without an id come after all ids and are one document; rows that share a doc_id are
places of the same document, and of exactly repeated rows none is earlier than the other, so both keep their words; an empty table gives no
rows; other columns pass through as one struct, and only if asked for.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ledgerloom.llm.textkit import gram_hashes, mix, slices, sliding_min, span_hashes, text_bytes, word_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_DIGEST = 6
_LAST = (1 << 63) - 1


@dataclass(frozen=True)
class PhraseParams:
    window: int = 20
    anchor: int = 5
    #: Text bytes of the documents that share an automaton, on average.
    shard_bytes: int = 1 << 20
    #: Documents looked at for hot anchors, and the share of them that makes an anchor hot. Both steer routing only.
    sample_rows: int = 2000
    hot_share: float = 0.004


def _anchor_mapper(p: PhraseParams, hot: np.ndarray):
    low = np.uint64(0xFFFFFFFF)

    def one(piece: pa.RecordBatch) -> list[pa.RecordBatch]:
        data, off = text_bytes(piece.column("text"))
        starts, ends, first = word_spans(data, off)
        n = len(starts)
        if n < p.window:
            return []
        words = span_hashes(data, starts, ends)
        grams, windows = gram_hashes(words, p.anchor), gram_hashes(words, p.window)
        places = np.arange(len(grams), dtype=np.uint64)
        best = (sliding_min((grams & ~low) | places, p.window - p.anchor + 1) & low).astype(np.int64)
        owner = np.repeat(np.arange(len(off) - 1), np.diff(first))[: len(windows)]
        at = np.flatnonzero(np.arange(len(windows)) + p.window <= first[owner + 1])
        if not len(at):
            return []
        best, owner = best[at], owner[at]
        head = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
        count = np.diff(np.append(head, len(at)))
        key, doc = grams[best[head]], owner[head]
        start = at[head] - first[doc]
        digest = np.ascontiguousarray(windows[at].view(np.uint8).reshape(-1, 8)[:, :_DIGEST])
        ids = piece.column("did").to_numpy(zero_copy_only=False)
        tkeys = piece.column("tkey").to_numpy(zero_copy_only=False)

        def rows(key, doc, start, count, digest, lengths):
            ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            marks = pa.Array.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(digest))])
            return pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(ids[doc]), pa.array(tkeys[doc]), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), marks],
                names=["anchor", "did", "tkey", "start", "n", "digests"],
            )

        heated = np.isin(key, hot) if len(hot) else np.zeros(len(key), bool)
        if not heated.any():
            return [rows(key, doc, start, count, digest, count * _DIGEST)]
        each = np.repeat(heated, count)
        out = []
        if not heated.all():
            cool = ~heated
            out.append(rows(key[cool], doc[cool], start[cool], count[cool], digest[~each], count[cool] * _DIGEST))
        wkey = mix(np.repeat(key, count)[each] ^ windows[at[each]])
        wdoc = owner[each]
        wstart = at[each] - first[wdoc]
        wdigest = digest[each]
        order = np.lexsort((wstart, ids[wdoc], wkey))
        wkey, wdoc, wstart, wdigest = wkey[order], wdoc[order], wstart[order], wdigest[order]
        fresh = np.concatenate([[True], wkey[1:] != wkey[:-1]])
        lead = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        open_ = (ids[wdoc] == ids[wdoc[lead]]) & (wstart == wstart[lead])
        ones = np.ones(len(wkey), dtype=np.int32)
        out.append(rows(wkey[open_], wdoc[open_], wstart[open_], ones[open_], wdigest[open_], ones[open_] * _DIGEST))
        if not open_.all():
            done = ~open_
            spread = mix(ids[wdoc[done]].view(np.uint64) + wstart[done].astype(np.uint64))
            out.append(rows(spread, wdoc[done], wstart[done], ones[done], wdigest[:0], ones[done] * 0))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                yield from one(piece)

    return run


_PRIME = (1 << 31) - 1


def shard_of(did: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a document: two multiplicative hashes that no engine lets overflow."""
    return (did % _PRIME * 48271 % _PRIME + (did >> 31) % _PRIME * 69621 % _PRIME) % shards


def shard_column(did: Column, shards: int) -> Column:
    """``shard_of`` as an expression."""
    prime = F.lit(_PRIME).cast("long")
    low, high = (F.pmod(F.pmod(x, prime) * F.lit(k).cast("long"), prime) for x, k in ((did, 48271), (F.shiftright(did, 31), 69621)))
    return F.pmod(low + high, F.lit(shards).cast("long"))


def _repeat_mapper(shards: int):
    """Rows sorted by (anchor, did, start): emits those with a window that was there before, but not yet in their shard (of this batch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32))
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, did, start, n = (batch.column(c).to_numpy() for c in ("anchor", "did", "start", "n"))
            column = batch.column("digests")
            offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
            full = np.diff(offsets) > 0
            twin = anchor[1:] == anchor[:-1]
            shared = np.zeros(len(anchor), bool)
            shared[1:] |= twin
            shared[:-1] |= twin
            shared[anchor == last] = True
            shared[anchor == anchor[-1]] = True  # the group may go on in the next batch
            rows = np.flatnonzero(shared & full)
            mask = np.where(full, 0, (np.int64(1) << n.astype(np.int64)) - 1)
            if len(rows):
                raw = np.frombuffer(column.buffers()[2], np.uint8)
                count = n[rows].astype(np.int64)
                row = np.repeat(rows, count)
                j = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                place = offsets[row] + j * _DIGEST
                wide = np.zeros((len(row), 8), np.uint8)
                wide[:, :_DIGEST] = raw[place[:, None] + np.arange(_DIGEST)]
                key = mix(wide.view(np.uint64).ravel() ^ mix(anchor[row].view(np.uint64)))
                same = anchor[row[0]] == last
                lead = len(seen[0]) if same else 0
                keys, dids, starts = (np.concatenate([a[:lead], b]) for a, b in zip(seen, (key, did[row], (start[row] + j).astype(np.int32))))
                _, index, inverse = np.unique(keys, return_index=True, return_inverse=True)
                again = np.flatnonzero(((dids != dids[index[inverse]]) | (starts != starts[index[inverse]]))[lead:])
                _, once = np.unique(mix(key[again] ^ mix(shard_of(did[row[again]], shards).view(np.uint64))), return_index=True)
                np.bitwise_or.at(mask, row[again[once]], np.int64(1) << j[again[once]])
                tail = np.concatenate([np.full(lead, anchor[-1] == last and same), anchor[row] == anchor[-1]])
                keep = index[tail[index]]
                seen = keys[keep], dids[keep], starts[keep]
            else:
                seen = tuple(s[:0] for s in seen)
            last = anchor[-1]
            hit = np.flatnonzero(mask)
            if len(hit):
                columns = [batch.column("did").take(pa.array(hit)), batch.column("tkey").take(pa.array(hit))]
                columns += [pa.array(shard_of(did[hit], shards)), pa.array(start[hit]), pa.array(mask[hit].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["did", "tkey", "shard", "start", "mask"])

    return run


def starts_of(runs: list[tuple[int, int]]) -> list[int]:
    """The first words of the windows in ``runs`` (start, mask)."""
    return sorted({start + j for start, mask in runs for j in range(mask.bit_length()) if mask >> j & 1})


def passages(starts: list[int], window: int) -> list[tuple[int, int]]:
    """(first word, end) of the passages that confirmed windows make up."""
    out: list[list[int]] = []
    for s in starts:
        if out and s == out[-1][1] - window + 1:
            out[-1][1] = s + window
        else:
            out.append([s, s + window])
    return [(a, b) for a, b in out]


def first_windows(starts: list[int], words: list[str], window: int, seen: set[int]) -> list[int]:
    """Those of the windows whose words are not in ``seen``, which takes them up."""
    keys = gram_hashes(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64), window)[starts].tolist()
    return [s for s, k in zip(starts, keys) if not (k in seen or seen.add(k))]


class Phrases:
    """The passages of a shard, and an automaton over their tiles."""

    def __init__(self, documents: list[tuple[int, list[str], list[tuple[int, int]]]], window: int):
        """``documents``: (did, words, passages)."""
        self.window, self.tile = window, window // 2
        self.known: list[tuple[int, int, list[str]]] = []
        tiles: dict[str, list[tuple[int, int]]] = {}
        for did, words, spans in documents:
            for a, b in spans:
                number = len(self.known)
                self.known.append((did, a, words[a:b]))
                for t in range(a, b - self.tile + 1, self.tile):
                    tiles.setdefault(f" {' '.join(words[t : t + self.tile])} ", []).append((number, t - a))
        self.automaton = ahocorasick.Automaton()
        for phrase, places in tiles.items():
            self.automaton.add_word(phrase, places)
        if tiles:
            self.automaton.make_automaton()

    def locate(self, did: int, words: list[str]) -> np.ndarray | None:
        """Which words are covered by a confirmed window at or after the place where it was confirmed; None where there is none."""
        if not self.known or len(words) < self.window:
            return None
        edges, ends, reached = None, None, {}
        for at, places in self.automaton.iter(f" {' '.join(words)} "):
            if ends is None:
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            tile = int(np.searchsorted(ends, at)) + 1 - self.tile
            for number, offset in places:
                # a passage is followed along a diagonal once, up to where it ended
                diagonal = number, tile - offset
                if reached.get(diagonal, 0) > tile:
                    continue
                owner, start, phrase = self.known[number]
                low, high = tile, tile + self.tile
                p, q = offset, offset + self.tile
                while p and low and words[low - 1] == phrase[p - 1]:
                    p, low = p - 1, low - 1
                while q < len(phrase) and high < len(words) and words[high] == phrase[q]:
                    q, high = q + 1, high + 1
                reached[diagonal] = high
                if high - low >= self.window and (did, low) >= (owner, start + p):
                    edges = np.zeros(len(words) + 1, dtype=np.int64) if edges is None else edges
                    edges[low] += 1
                    edges[high] -= 1
        return None if edges is None else np.cumsum(edges)[:-1] > 0


def kept_text(text: str, gone: np.ndarray) -> str:
    """The text without the covered words: what stays together keeps its layout, and a cut becomes one space."""
    parts, begin, end = [], None, 0
    for match, out in zip(WORD.finditer(text), gone.tolist()):
        if out:
            if begin is not None:
                parts.append(text[begin:end])
            begin = None
        else:
            begin = match.start() if begin is None else begin
            end = match.end()
    if begin is not None:
        parts.append(text[begin:end])
    return " ".join(parts)


def _removal_mapper(p: PhraseParams, schema: pa.Schema):
    """Documents and their confirmed windows, sorted by (shard, did, tkey), the documents before the windows."""

    def finished(rows: list[dict], runs: dict[tuple[int, int], list[tuple[int, int]]]) -> pa.RecordBatch:
        split = [WORD.findall(r["text"] or "") for r in rows]
        words_of = {(r["did"], r["tkey"]): words for r, words in zip(rows, split)}
        seen: set[int] = set()  # several tasks may have confirmed a window of the shard
        confirmed = ((key, words_of[key], starts_of(found)) for key, found in sorted(runs.items()))
        phrases = Phrases([(key[0], words, passages(first_windows(s, words, p.window, seen), p.window)) for key, words, s in confirmed], p.window)
        for row, words in zip(rows, split):
            gone = phrases.locate(row["did"], words)
            left = words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g]
            text = row["text"] or ""
            row |= {
                "n_words": len(words), "n_removed": len(words) - len(left), "kept_text": text if gone is None else kept_text(text, gone),
                "kept_sha256": hashlib.sha256(" ".join(left).encode("utf-8", "surrogatepass")).hexdigest(),
            }
        return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows, runs = None, [], {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    if rows:
                        yield finished(rows, runs)
                    shard, rows, runs = row["shard"], [], {}
                if row["mask"] is None:
                    rows.append(row)
                else:
                    runs.setdefault((row["did"], row["tkey"]), []).append((row["start"], row["mask"]))
        if rows:
            yield finished(rows, runs)

    return run


def remove_repeats(docs: DataFrame, p: PhraseParams = PhraseParams(), with_text: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text and a struct ``extra`` of these columns of ``docs``."""
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    ids = docs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(did).alias("d"), F.sum(F.octet_length("text")).alias("bytes")).first()
    shards = max(1, -(-(ids["bytes"] or 0) // p.shard_bytes))
    # rows that share an id are told apart by their texts
    tkey = F.xxhash64("text") if ids["n"] != ids["d"] else F.lit(0).cast("long")
    columns = [did.alias("did"), tkey.alias("tkey"), F.col("text"), F.col("doc_id")]
    # one struct, so that no column of the table meets a name used here
    rest = [F.struct(*[F.col(f"`{c}`") for c in extra]).alias("extra")] if extra else []
    rows = docs.select(*columns[:3])
    schema = "anchor long, did long, tkey long, start int, n int, digests binary"
    hot = np.empty(0, np.uint64)
    if ids["n"]:
        part = min(1.0, p.sample_rows / ids["n"])
        sample = rows.filter(F.pmod(F.xxhash64("did", F.lit(17)), F.lit(1_000_000)) < int(part * 1_000_000) + 1)
        few = sample.mapInArrow(_anchor_mapper(p, hot), schema).select("anchor", "did").distinct().groupBy("anchor").count()
        least = max(8, int(p.hot_share * part * ids["n"]))
        hot = np.array(sorted(r["anchor"] for r in few.filter(F.col("count") >= least).select("anchor").collect()), dtype=np.int64).view(np.uint64)
    anchors = rows.mapInArrow(_anchor_mapper(p, np.sort(hot)), schema)
    meeting = anchors.repartition(F.col("anchor")).sortWithinPartitions("anchor", "did", "start")
    repeats = meeting.mapInArrow(_repeat_mapper(shards), "did long, tkey long, shard long, start int, mask int")
    both = docs.select(*columns, shard_column(did, shards).alias("shard"), *rest).unionByName(repeats, allowMissingColumns=True)
    dealt = both.repartition("shard").sortWithinPartitions("shard", "did", "tkey", F.col("mask").isNotNull())
    kinds = {"doc_id": docs.schema["doc_id"].dataType.simpleString(), "n_words": "long", "n_removed": "long", "kept_sha256": "string"}
    kinds |= {"kept_text": "string"} if with_text else {}
    out = StructType.fromDDL(", ".join(f"{c} {k}" for c, k in kinds.items()))
    if extra:
        out = out.add("extra", both.schema["extra"].dataType)
    return dealt.mapInArrow(_removal_mapper(p, to_arrow_schema(out)), out)
