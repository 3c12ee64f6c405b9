"""First places of many values in the running texts of their documents.

A document's elements make up its running text. A value is looked up in several forms, each in a reading; the first form that occurs decides.

* Searched readings: the raw text of single elements (``RAW``); letters and digits alone, over element borders (``LETTERS``); letters, digits
  and dots over borders, where a place counts only if no digit stands before or after it (``NUMBERS``).
* Keyed readings, where a form is found in the first element that has it as a key: the numbers in an element that stand free of further digits
  and dots, with and without a minus sign (``TOKENS``); the element's whole text as a number in normal form (``WHOLE``).

How they are searched depends on the document's length only:

* **Short documents** (up to two chunks of text) meet their values in one task, sorted, the elements first: the text is there once and is
  searched for one value after the other; forms are spelled until one is found, and a repeated value is passed over.
* **Long documents** are cut into chunks. Places are counted in what the reading keeps. Chunk ``c`` of size ``s`` answers for the places
  ``[c s, (c + 1) s)`` and also holds the margin after them, which exceeds the document's longest target; so every match lies in the chunk
  that answers for it. Long elements are cut into pieces first. No task needs more of a document than a chunk.
* **Gram index** of long documents: a target goes only to chunks that hold its rarest gram: an equi-join on (document, reading, gram), the
  grams being as long as the target allows (``GRAMS``) and rarest by the number of chunks that have them. It is verified there as in short
  documents. Keys are joined as they are. Of a chunk's grams only those leave its task that some target has.

Elements that a match overlaps are read off the pieces.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.columns import column_list, column_lists
from ledgerloom.operators.ordinals import running_sum
from ledgerloom.session import materialise

RAW, LETTERS, NUMBERS, TOKENS, WHOLE = range(5)
#: Least chunk size, and the characters of a piece.
CHUNK, PIECE = 2048, 1024
_PIECE_BITS = 20
#: Gram lengths; a target takes the longest that it has, and looks at so many of its grams at most.
GRAMS, TRIED = (12, 8, 5, 3, 2, 1), 8
#: Chunks of a stretch, and the most stretches of a document, for each of which its grams looked for are copied.
STRETCH, STRETCHES = 1024, 32
_NOT_LETTERS, _NOT_NUMBERS = re.compile(r"[\W_]+"), re.compile(r"[^\w.]+|_+")
_FREE, _SIGNED = re.compile(r"[0-9.]+"), re.compile(r"(?<![0-9.])-[0-9.]+")
_NOT_FREE = re.compile("[^0-9.]+")
#: The same for ASCII texts, most of all: the characters that are dropped, and a mask of those that the reading of numbers keeps.
_DROPPED = {kind: bytes(i for i in range(128) if p.match(chr(i))) for kind, p in ((LETTERS, _NOT_LETTERS), (NUMBERS, _NOT_NUMBERS), (WHOLE, _NOT_FREE))}
_ASCII_KEPT = np.array([chr(i).isalnum() or chr(i) == "." for i in range(128)])


def _without(text: str, kind: int, dropped: re.Pattern) -> str:
    return text.encode().translate(None, _DROPPED[kind]).decode() if text.isascii() else dropped.sub("", text)


def reading(text: str, kind: int) -> str:
    """What a reading keeps of a piece that ends its element or not; the raw reading keeps all."""
    return text if kind == RAW else _without(text.lower(), kind, _NOT_LETTERS if kind == LETTERS else _NOT_NUMBERS)


def normal_number(text: str) -> str:
    """Digits and dots only; trailing zeros after a dot dropped."""
    kept = _without(text, WHOLE, _NOT_FREE)
    return kept.rstrip("0").rstrip(".") if "." in kept else kept


def keys(text: str, kind: int) -> list[str]:
    """The keys of an element in a keyed reading."""
    if kind == TOKENS:
        return _FREE.findall(text) + (_SIGNED.findall(text) if "-" in text else [])
    whole = normal_number(text)
    return [whole] if whole else []


_PIECES = pa.schema([
    ("stem", pa.string()), ("kind", pa.int32()), ("place", pa.int64()), ("text", pa.string()), ("last", pa.bool_()), ("size", pa.int64()),
])


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements (stem, el_idx, text, kind) to pieces; a raw piece that ends its element counts one more for the border."""
    for batch in batches:
        rows = []
        for stem, el, text, kind in zip(*column_lists(batch)):
            for i in range(0, max(len(text), 1), PIECE):
                piece, last = text[i : i + PIECE], i + PIECE >= len(text)
                size = len(piece) + last if kind == RAW else len(reading(piece, kind))
                rows.append((stem, kind, (el << _PIECE_BITS) + i // PIECE, piece, last, size))
        yield as_batch(rows, _PIECES)


def gram_codes(text: str, k: int) -> np.ndarray:
    """64-bit codes of all ``k``-grams of a text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(points) - k + 1
    if n <= 0:
        return np.empty(0, np.int64)
    out = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        out = (out ^ points[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


class _Chunk:
    """A chunk's text in its reading, with the places of its pieces."""

    def __init__(self, kind: int, pieces: list[tuple[int, str, bool, int]]):
        self.kind = kind
        self.elements = [place >> _PIECE_BITS for place, *_ in pieces]
        self.base = pieces[0][3]
        border = "\0" if kind == RAW else " "
        self.raw = [text + border * last for _, text, last, _ in pieces]
        kept = self.raw if kind == RAW else [reading(t, kind) for t in self.raw]
        self.text = "".join(kept)
        self.starts = [0, *accumulate(map(len, kept))]
        self._map = None

    def _numbers(self) -> tuple[str, Sequence[int]]:
        """The lower-case text and the place in it of every character that the reading keeps."""
        if self._map is None:
            full = "".join(self.raw).lower()
            if full.isascii():
                where = np.flatnonzero(_ASCII_KEPT[np.frombuffer(full.encode(), np.uint8)])
            else:
                where = [i for i, c in enumerate(full) if c.isalnum() or c == "."]
            self._map = full, where
        return self._map

    def _stands(self, at: int, end: int) -> bool:
        if self.kind == LETTERS:
            return True
        if self.kind == RAW:
            first, last = (bisect_right(self.starts, i) - 1 for i in (at, end - 1))
            return self.elements[first] == self.elements[last] and end <= self.starts[last] + len(self.raw[last]) - (self.raw[last][-1:] == "\0")
        full, where = self._numbers()
        before, after = where[at] - 1, where[end - 1] + 1
        return not (before >= 0 and full[before].isdigit() or after < len(full) and full[after].isdigit())

    def find(self, target: str, low: int = 0, high: int | None = None) -> tuple[int, list[int]] | None:
        """(place, elements) of the first match that starts in ``[low, high)``, both counted in the document."""
        at = self.text.find(target, max(low - self.base, 0))
        while at >= 0 and (high is None or at + self.base < high):
            end = at + len(target)
            if self._stands(at, end):
                first, last = bisect_right(self.starts, at) - 1, bisect_left(self.starts, end)
                return at + self.base, sorted(set(self.elements[first:last]))
            at = self.text.find(target, at + 1)
        return None


class _Keyed:
    """The keys of all elements of a document, with the first element that has them."""

    def __init__(self, kind: int, pieces: list[tuple[int, str, bool, int]]):
        self.first: dict[str, int] = {}
        for place, text, *_ in pieces:
            for key in keys(text, kind):
                self.first.setdefault(key, place >> _PIECE_BITS)

    def find(self, target: str) -> tuple[int, list[int]] | None:
        el = self.first.get(target)
        return None if el is None else (el, [el])


class Document:
    """The elements of a short document, read in as many ways as its values ask for."""

    def __init__(self) -> None:
        self.pieces: list[tuple[int, str, bool, int]] = []
        self._readings: dict[int, _Chunk | _Keyed] = {}

    def add(self, place: int, text: str) -> None:
        self.pieces.append((place << _PIECE_BITS, text, True, 0))

    def find(self, spelled: Iterable[tuple[int, int, str]]) -> tuple[int, int, list[int]] | None:
        """(rank, place, elements) of the first form that occurs."""
        if self.pieces:
            for rank, kind, target in spelled:
                held = self._readings.get(kind)
                if held is None:
                    held = self._readings[kind] = (_Chunk if kind <= NUMBERS else _Keyed)(kind, self.pieces)
                found = held.find(target)
                if found:
                    return (rank, *found)
        return None


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """The first ``width`` columns and the rows that have them, of batches sorted by these."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*column_lists(batch)):
            if row[:width] != key:
                if rows:
                    yield key, rows
                key, rows = row[:width], []
            rows.append(row)
    if rows:
        yield key, rows


def _indexer(lengths: tuple[int, ...]):
    """Rows of a stretch (stem, kind, stretch, chunk, place, text, last, start, grams), the grams looked for first -> those of them in every chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, asked, wanted = None, [], np.empty(0, np.int64)

        def found(key: tuple, pieces: list[tuple]) -> pa.RecordBatch:
            text = _Chunk(key[1], pieces).text
            codes = np.unique(np.concatenate([gram_codes(text, k) for k in lengths]))
            codes = codes[wanted[np.minimum(np.searchsorted(wanted, codes), len(wanted) - 1)] == codes] if len(wanted) else codes[:0]
            n = len(codes)
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int32()), pa.array([key[3]] * n, pa.int64()), pa.array(codes)],
                names=["stem", "kind", "chunk", "gram"],
            )

        for key, rows in _groups(batches, 4):
            if key[:3] != held:
                held, asked, wanted = key[:3], [], np.empty(0, np.int64)
            if key[3] is None:
                asked = [np.frombuffer(r[8], np.int64) for r in rows]
                wanted = np.unique(np.concatenate(asked))
            else:
                yield found(key, [r[4:8] for r in rows])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams looked for (stem, kind, gram), many to a row."""
    for batch in batches:
        stem, kind, gram = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        by: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(stem.tolist(), kind.tolist())):
            by.setdefault(key, []).append(i)
        yield pa.RecordBatch.from_arrays(
            [pa.array([s for s, _ in by], pa.string()), pa.array([k for _, k in by], pa.int32()), pa.array([gram[i].tobytes() for i in by.values()], pa.binary())],
            names=["stem", "kind", "grams"],
        )


def _gram_length(n: int) -> int:
    return next(k for k in GRAMS if k <= n)


def _target_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Targets (tid, stem, kind, target) to their distinct grams of the longest length that they have; of very long ones, to some of them."""
    for batch in batches:
        tid, stem, kind, target = batch.columns
        codes = []
        for t in column_list(target):
            k = _gram_length(len(t))
            every = max(1, -(-(len(t) - k + 1) // TRIED))
            codes.append(np.unique(gram_codes(t, k)[::every]))
        row = pa.array(np.repeat(np.arange(len(codes)), [len(c) for c in codes]))
        grams = pa.array(np.concatenate([np.empty(0, np.int64), *codes]))
        yield pa.RecordBatch.from_arrays([tid.take(row), stem.take(row), kind.take(row), grams], names=["tid", "stem", "kind", "gram"])


def _grams_of(lengths: tuple[int, ...]):
    """Texts (id, stem, text) to their distinct grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tid, stem, text = batch.columns
            codes = [np.unique(np.concatenate([gram_codes(t, k) for k in lengths])) for t in column_list(text)]
            row = pa.array(np.repeat(np.arange(len(codes)), [len(c) for c in codes]))
            grams = pa.array(np.concatenate([np.empty(0, np.int64), *codes]))
            yield pa.RecordBatch.from_arrays([tid.take(row), stem.take(row), grams], names=["hid", "stem", "gram"])

    return run


def contained(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """Pairs (stem, part, whole) of a document's distinct texts ``parts`` (stem, part) and ``wholes`` (stem, whole) where one contains the other.

    A part meets only the wholes that hold its rarest gram; an empty part is in all of them.
    """
    empty = parts.filter("part = ''").join(wholes, "stem").select("stem", "part", "whole")
    parts = materialise(parts.filter("part <> ''").withColumn("tid", F.monotonically_increasing_id()), "text-parts")
    wholes = materialise(wholes.withColumn("hid", F.monotonically_increasing_id()), "text-wholes")
    lengths = _used_lengths(parts, "part")
    asked = parts.select("tid", "stem", F.lit(RAW).cast("int").alias("kind"), F.col("part").alias("target"))
    wanted = asked.mapInArrow(_target_grams, "tid long, stem string, kind int, gram long").select("tid", "stem", "gram")
    index = wholes.select("hid", "stem", "whole").mapInArrow(_grams_of(lengths), "hid long, stem string, gram long")
    index = materialise(index.join(wanted.select("stem", "gram").distinct(), ["stem", "gram"], "left_semi"), "text-grams")
    spread = index.groupBy("stem", "gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = wanted.join(spread, ["stem", "gram"]).groupBy("tid", "stem").agg(F.min(F.struct("n", "gram")).alias("g"))
    met = rarest.select("tid", "stem", F.col("g.gram").alias("gram")).join(index, ["stem", "gram"]).select("tid", "hid")
    pairs = met.join(parts, "tid").join(wholes.drop("stem"), "hid").filter(F.contains("whole", "part"))
    return pairs.select("stem", "part", "whole").unionByName(empty)


def _used_lengths(texts: DataFrame, column: str) -> tuple[int, ...]:
    """The gram lengths that the texts take (the driver sees one row a length)."""
    length = F.greatest(*[F.when(F.length(column) >= k, k).otherwise(0) for k in GRAMS])
    return tuple(r["k"] for r in texts.select(length.alias("k")).filter("k > 0").distinct().collect()) or (GRAMS[-1],)


def _keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements (stem, el_idx, text, kind) to their keys."""
    schema = pa.schema([("stem", pa.string()), ("kind", pa.int32()), ("target", pa.string()), ("at", pa.int64())])
    for batch in batches:
        rows = zip(*column_lists(batch))
        yield as_batch([(stem, kind, key, el) for stem, el, text, kind in rows for key in set(keys(text, kind))], schema)


#: From a value to what is looked for: (rank, reading, target), by rising rank.
Forms = Callable[[str], Iterable[tuple[int, int, str]]]
_FOUND = pa.schema([("stem", pa.string()), ("val", pa.string()), ("rank", pa.int32()), ("at", pa.int64()), ("els", pa.list_(pa.int64()))])
_FOUND_DDL = "stem string, val string, rank int, at long, els array<long>"


def _whole(forms: Forms):
    """Short documents: (stem, place, text), a document's elements before its values (without a place, sorted) -> the values found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, document, last = None, Document(), None
        for batch in batches:
            out = []
            for stem, place, text in zip(*column_lists(batch)):
                if stem != held:
                    held, document, last = stem, Document(), None
                if place is not None:
                    document.add(place, text)
                elif text != last:
                    last = text
                    found = document.find(forms(text))
                    if found:
                        out.append((stem, text, *found))
            yield as_batch(out, _FOUND)

    return run


def _spelled(forms: Forms):
    """Values (stem, val) to their targets."""
    schema = pa.schema([("stem", pa.string()), ("val", pa.string()), ("rank", pa.int32()), ("kind", pa.int32()), ("target", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*column_lists(batch))
            yield as_batch([(stem, val, *form) for stem, val in rows for form in forms(val)], schema)

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A chunk's pieces, then the targets sent to it -> the targets found."""
    schema = pa.schema([("stem", pa.string()), ("kind", pa.int32()), ("target", pa.string()), ("at", pa.int64()), ("els", pa.list_(pa.int64()))])
    held, pieces, chunk = None, [], None
    for batch in batches:
        out = []
        for stem, kind, number, place, text, last, start, size, target in zip(*column_lists(batch)):
            if (stem, kind, number) != held:
                held, pieces, chunk = (stem, kind, number), [], None
            if target is None:
                pieces.append((place, text, last, start))
            elif pieces:
                chunk = chunk or _Chunk(kind, pieces)
                found = chunk.find(target, number * size, (number + 1) * size)
                if found:
                    out.append((stem, kind, target, *found))
        yield as_batch(out, schema)


_ORDER = ["stem", "kind", "chunk", "place", "text", "last", "start", "size", "target"]


def _dealt(rows: DataFrame) -> DataFrame:
    ordered = rows.repartition("stem", "kind", "chunk").sortWithinPartitions("stem", "kind", "chunk", F.col("target").isNotNull(), "place")
    return ordered.select(_ORDER)


def _gram_index(pieces: DataFrame, wanted: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """(stem, kind, chunk, gram): the chunks that have a gram looked for.

    A chunk has some thousand grams, of which few are looked for: those go to the chunks, in a stretch of which they are held, eight bytes each.
    A document has at most ``STRETCHES``, so what is looked for is copied so many times at most.
    """
    stretch = F.pmod(F.floor(F.col("chunk") / STRETCH), F.lit(STRETCHES)).cast("int").alias("stretch")
    read = pieces.select("stem", "kind", stretch, "chunk", "place", "text", "last", "start")
    asked = wanted.mapInArrow(_packed, "stem string, kind int, grams binary").join(read.select("stem", "kind", "stretch").distinct(), ["stem", "kind"])
    dealt = read.unionByName(asked, allowMissingColumns=True).repartition("stem", "kind", "stretch")
    ordered = dealt.sortWithinPartitions("stem", "kind", "stretch", F.col("chunk").asc_nulls_first(), "place")
    columns = ["stem", "kind", "stretch", "chunk", "place", "text", "last", "start", "grams"]
    return ordered.select(columns).mapInArrow(_indexer(lengths), "stem string, kind int, chunk long, gram long")


def _routed(targets: DataFrame, pieces: DataFrame, measures: DataFrame) -> DataFrame:
    """(stem, kind, target, size, chunk): the chunks where a target (tid, stem, kind, target) can be."""
    lengths = _used_lengths(targets, "target")
    wanted = targets.select("tid", "stem", "kind", "target").mapInArrow(_target_grams, "tid long, stem string, kind int, gram long")
    index = materialise(_gram_index(pieces, wanted.select("stem", "kind", "gram").distinct(), lengths), "text-grams")
    spread = index.groupBy("stem", "kind", "gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = wanted.join(spread, ["stem", "kind", "gram"]).groupBy("tid", "stem", "kind").agg(F.min(F.struct("n", "gram")).alias("g"))
    chosen = rarest.select("tid", "stem", "kind", F.col("g.gram").alias("gram")).join(index, ["stem", "kind", "gram"])
    return chosen.select("tid", "chunk").join(targets, "tid").join(measures, ["stem", "kind"])


def _in_chunks(elements: DataFrame, spelled: DataFrame, chunk: int) -> DataFrame:
    """(stem, kind, target, at, els) of the targets of searched readings that occur."""
    targets = spelled.filter(F.col("kind") <= NUMBERS).select("stem", "kind", "target").distinct()
    targets = materialise(targets.withColumn("tid", F.monotonically_increasing_id()), "text-targets")
    margin = (F.max(F.length("target")) + 2).cast("long").alias("margin")
    measures = targets.groupBy("stem", "kind").agg(margin).withColumn("size", F.greatest(F.lit(chunk).cast("long"), "margin"))
    measures = materialise(measures, "text-measures")
    read = elements.join(measures.select("stem", "kind"), "stem").select("stem", "el_idx", "text", "kind")
    cut = read.mapInArrow(_cut, "stem string, kind int, place long, text string, last boolean, size long")
    ended = running_sum(cut, ["stem", "kind"], "place", F.col("size"), "end", 12 + _PIECE_BITS)
    ended = ended.withColumn("start", F.col("end") - F.col("size")).drop("size").join(measures, ["stem", "kind"])
    # a chunk also has the pieces that begin in its margin, and the one that ends on its border, for the character before its own
    first = F.floor((F.col("start") - F.col("margin")) / F.col("size"))
    chunks = F.sequence(F.greatest(F.lit(0).cast("long"), first), F.floor(F.col("end") / F.col("size")))
    pieces = materialise(ended.withColumn("chunk", F.explode(chunks)).withColumn("target", F.lit(None).cast("string")).select(_ORDER), "text-pieces")
    sent = _routed(targets, pieces, measures).select("stem", "kind", "target", "size", "chunk")
    return _dealt(pieces.unionByName(sent, allowMissingColumns=True)).mapInArrow(_verify, "stem string, kind int, target string, at long, els array<long>")


def _in_keys(elements: DataFrame, spelled: DataFrame) -> DataFrame:
    """(stem, kind, target, at, els) of the targets of keyed readings that some element has."""
    wanted = spelled.filter(F.col("kind") > NUMBERS).select("stem", "kind", "target").distinct()
    read = elements.join(wanted.select("stem", "kind").distinct(), "stem").select("stem", "el_idx", "text", "kind")
    have = read.mapInArrow(_keys_of, "stem string, kind int, target string, at long").groupBy("stem", "kind", "target").agg(F.min("at").alias("at"))
    return have.join(wanted, ["stem", "kind", "target"]).withColumn("els", F.array("at"))


def _of_long(elements: DataFrame, values: DataFrame, forms: Forms, chunk: int) -> DataFrame:
    spelled = values.select("stem", "val").mapInArrow(_spelled(forms), "stem string, val string, rank int, kind int, target string")
    spelled = materialise(spelled, "text-spelled")
    found = _in_chunks(elements, spelled, chunk).unionByName(_in_keys(elements, spelled))
    best = spelled.join(found, ["stem", "kind", "target"]).groupBy("stem", "val").agg(F.min(F.struct("rank", "at", "els")).alias("m"))
    return best.select("stem", "val", "m.rank", "m.at", "m.els")


def readable(elements: DataFrame, *others: str | Column) -> DataFrame:
    """Elements (stem, el_idx, text, others) that have a place; a missing text is empty."""
    return elements.filter("el_idx is not null").select("stem", F.col("el_idx").cast("long").alias("el_idx"), F.coalesce("text", F.lit("")).alias("text"), *others)


def long_documents(elements: DataFrame, chunk: int = CHUNK) -> DataFrame | None:
    """The stems of documents of more than two chunks of text; None without any."""
    sizes = elements.groupBy("stem").agg(F.sum(F.length("text") + 1).alias("n"))
    long = materialise(sizes.filter(F.col("n") > 2 * chunk).select("stem"), "text-long")
    return None if long.isEmpty() else long


def short_rows(elements: DataFrame, values: DataFrame, long: DataFrame | None, *order: Column) -> DataFrame:
    """Elements (stem, place, text, ...) and values (stem, text, ...) of short documents, a document's elements before its values.

    Both are dealt by document once: whatever is asked of them must be answered on the way.
    """
    rows = elements.unionByName(values, allowMissingColumns=True)
    rows = rows if long is None else rows.join(long, "stem", "left_anti")
    return rows.repartition("stem").sortWithinPartitions("stem", F.col("place").asc_nulls_last(), *order)


def first_places(elements: DataFrame, values: DataFrame, forms: Forms, chunk: int = CHUNK) -> DataFrame:
    """The first place of each of ``values`` (stem, val; repeated ones count once) in ``elements`` (stem, el_idx, text).

    Gives (stem, val, rank, at, els) of those found: the rank of the form, the place in the reading, and the elements that it overlaps.
    """
    elements = readable(elements)
    long = long_documents(elements, chunk)
    wanted = values.select("stem", F.col("val").alias("text"))
    rows = short_rows(elements.withColumnRenamed("el_idx", "place"), wanted, long, F.col("text"))
    found = rows.select("stem", "place", "text").mapInArrow(_whole(forms), _FOUND_DDL)
    if long is None:
        return found
    of_long = [t.join(long, "stem", "left_semi") for t in (elements, values.select("stem", "val").distinct())]
    return found.unionByName(_of_long(*of_long, forms, chunk))
