"""One-to-one line assignment as one sorted pass per document.

The greedy rule is sequential inside a document: lines come in index order and each takes its first free choice, order lines of its SKU
by position, then similar descriptions by score and position. A document's rows meet in one partition in the order in which they are
needed: its order lines, then every invoice line. Only a line that no free order line of its SKU takes is compared with texts. In a document
of bounded pairs it compares itself with the order's texts that are still free; in a larger one it is followed by the texts that are similar
to its own, best first, so they pass by and are not kept. What a task holds of a document is its order lines: which positions carry a SKU or a
description, the next free one of each, which are taken, and what the result shows of them, some hundred bytes an order line. The number of
jobs does not depend on the number of lines, and one path serves every size and both ways of comparing texts.

The pass hands on all that it knows of a document, so nothing is joined to its rows again: the pairs, the lines without one, and the order lines
that are left over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from ledgerloom.functions.columns import column_list
from ledgerloom.functions.similarity import common_length

ORDER_LINE, LINE = 0, 1
#: Roles of a result row. A line's row is its pair and its match in one, unless its index comes twice in the document.
BOTH, PAIR, MATCH, LEFT = 0, 1, 2, 3
_LINK, _HEAD = 7, 8

#: Of two texts: the score of the second for the first, if it is above the least given and acceptable, else None.
Rate = Callable[[str, str, float | None], float | None]


def similar(threshold: int) -> Rate:
    def rate(text: str, other: str, least: float | None) -> float | None:
        if text == other:
            return 100.0
        total, most = len(text) + len(other), min(len(text), len(other))
        if 200 * most < threshold * total or least is not None and 200.0 * most / total < least:
            return None
        common = common_length(text, other)
        return 200.0 * common / total if 200 * common >= threshold * total else None

    return rate


def containing(text: str, other: str, least: float | None) -> float | None:
    return 80.0 if text in other or other in text else None


class _Document:
    """Free positions of one document's order."""

    def __init__(self) -> None:
        self.by_sku: dict[str, list[int]] = {}
        self.by_text: dict[str, list[int]] = {}
        self.next: dict[tuple[int, str], int] = {}
        self.taken: set[int] = set()
        self.paired: set[int] = set()
        self.rows: list[tuple[int, int]] = []
        self.rows_at: dict[int, list[int]] = {}
        self.links: set[int] = set()

    def order_line(self, pos: int, sku: str | None, text: str | None, link: int, row: int) -> None:
        if sku is not None:
            self.by_sku.setdefault(sku, []).append(pos)
        if text is not None:
            self.by_text.setdefault(text, []).append(pos)
        self.rows_at.setdefault(pos, []).append(len(self.rows))
        self.rows.append((pos, row))
        self.links.add(link)

    def head(self, kind: int, key: str) -> int | None:
        """The first free position of a SKU (0) or a description (1)."""
        places = (self.by_text if kind else self.by_sku).get(key, ())
        at = self.next.get((kind, key), 0)
        while at < len(places) and places[at] in self.taken:
            at += 1
        self.next[kind, key] = at
        return places[at] if at < len(places) else None


class _Choice:
    """What an invoice line finds: a free order line of its SKU, else of the texts it compares itself with or that are offered by falling score."""

    def __init__(self, doc: _Document, sku: str | None):
        self.doc = doc
        first = doc.head(0, sku) if sku is not None else None
        self.tier, self.score, self.pos = (1, None, None) if first is None else (0, 100.0, first)

    def offer(self, text: str, score: float) -> None:
        """Of equal scores the first free position counts."""
        if self.tier == 0 or self.pos is not None and score < self.score:
            return
        pos = self.doc.head(1, text)
        if pos is not None and (self.pos is None or score > self.score or pos < self.pos):
            self.score, self.pos = score, pos

    def compare(self, text: str, rate: Rate) -> None:
        if self.tier == 0:
            return
        if rate(text, text, None) == 100.0 and self.doc.head(1, text) is not None:
            self.offer(text, 100.0)  # only an equal text scores as much
            return
        for other in self.doc.by_text:
            if self.doc.head(1, other) is not None:
                score = rate(text, other, self.score)
                if score is not None:
                    self.offer(other, score)

    def take(self) -> tuple[int, int, float] | None:
        if self.pos is None:
            return None
        self.doc.taken.add(self.pos)
        return self.pos, self.tier, self.score


class _Index:
    """The lines of a document with one index, as a rule one. If there are more, the last is compared with texts, those similar to any of them."""

    def __init__(self, doc: _Document, place: int | None, rate: Rate):
        self.doc, self.place, self.rate = doc, place, rate
        self.lines: list[tuple[str | None, str | None, int]] = []
        self.found: list[tuple[int, int, float]] = []
        self.choice: _Choice | None = None

    def _start(self) -> _Choice:
        for sku, _, _ in self.lines:
            self._take()
            self.choice = _Choice(self.doc, sku)
        for text in dict.fromkeys(t for _, t, _ in self.lines if t is not None):
            self.choice.compare(text, self.rate)
        return self.choice

    def _take(self) -> None:
        found = self.choice.take() if self.choice is not None else None
        if found is not None and self.place is not None and found[0] is not None:
            self.doc.paired.add(found[0])
            self.found.append(found)

    def offer(self, text: str, score: float) -> None:
        (self.choice or self._start()).offer(text, score)

    def rows(self) -> Iterator[tuple]:
        """(role, links, line_index, po_pos, tier, score, row of the line, row of the order line)."""
        if self.choice is None:
            self._start()
        self._take()
        doc, place, n = self.doc, self.place, len(self.doc.links)
        stock = [(found, doc.rows[k][1]) for found in self.found for k in doc.rows_at[found[0]]]
        once = len(self.lines) == 1
        for _, _, own in self.lines if n else ():
            if not stock:
                yield MATCH, n, place, None, None, None, own, None
            for found, row in stock * len(self.lines):
                yield BOTH if once else MATCH, n, place, *found, own, row
            for found, row in () if once else stock:
                yield PAIR, n, place, *found, own, row


_FLAT = pa.schema([
    ("stem", pa.string()), ("role", pa.int32()), ("links", pa.int32()), ("line_index", pa.int64()), ("po_pos", pa.int64()), ("tier", pa.int32()),
    ("score", pa.float64()),
])


def _pass(batches: Iterator[pa.RecordBatch], rate: Rate = similar(65), own: int = 1) -> Iterator[pa.RecordBatch]:
    """Rows (stem, kind, place, option, sku, text, score, and, to be shown: link, ``own`` columns of the line, those of the order line) to results."""
    stem, doc, index = None, _Document(), None
    held, names = None, []  # what the results show of the current document's rows that came in earlier batches
    for batch in batches:
        shown, names = batch.columns[_HEAD:], batch.schema.names[_HEAD:]
        if held is not None:
            shown = [pa.concat_arrays([h, s]) for h, s in zip(held, shown)]
        first = len(shown[0]) - len(batch) if shown else 0
        links = column_list(batch.column(_LINK)) if shown else repeat(0)
        out: list[tuple] = []
        for i, (name, kind, place, option, sku, text, score, link) in enumerate(zip(*map(column_list, batch.columns[:_LINK]), links), first):
            if index is not None and (name != stem or not option and (kind == ORDER_LINE or place != index.place)):
                out += [(stem, *r) for r in index.rows()]
                index = None
            if name != stem:
                out += _left(stem, doc)
                stem, doc = name, _Document()
            if kind == ORDER_LINE:
                doc.order_line(place, sku, text, link, i)
            elif option:
                index.offer(text, score)
            else:
                index = index or _Index(doc, place, rate)
                index.lines.append((sku, text, i))
        yield _rows(out, shown, names, own)
        # what goes on is kept: the document's order lines and the lines of the present index
        lines = index.lines if index is not None else []
        kept = pa.array([row for _, row in doc.rows] + [row for _, _, row in lines], pa.int64())
        held = [s.take(kept) for s in shown]
        doc.rows = [(pos, k) for k, (pos, _) in enumerate(doc.rows)]
        lines[:] = [(sku, text, len(doc.rows) + k) for k, (sku, text, _) in enumerate(lines)]
    if held is not None:
        out = [(stem, *r) for r in index.rows()] if index is not None else []
        yield _rows(out + _left(stem, doc), held, names, own)


def _left(stem: str, doc: _Document) -> list[tuple]:
    n = len(doc.links)
    return [(stem, LEFT, n, None, pos, None, None, None, row) for pos, row in doc.rows if pos is None or pos not in doc.paired]


def _rows(out: list[tuple], shown: list[pa.Array], names: list[str], own: int) -> pa.RecordBatch:
    columns = list(zip(*out)) or [()] * (len(_FLAT) + 2)
    flat = [pa.array(c, f.type) for c, f in zip(columns, _FLAT)]
    line, order_line = (pa.array(c, pa.int64()) for c in columns[len(_FLAT):])
    picked = [s.take(line if k < own else order_line) for k, s in enumerate(shown)]
    return pa.RecordBatch.from_arrays(flat + picked, names=_FLAT.names + names)


def assign(lines: DataFrame, stock: DataFrame, texts: DataFrame | None, keys: Callable[[DataFrame], DataFrame], rate: Rate) -> DataFrame:
    """(stem, role, links, line_index, po_pos, tier, score, mine, theirs), by the roles above.

    ``lines`` (stem, line_index, offered, mine) and ``stock`` (stem, po_pos, link, theirs), where ``link`` numbers the document's links to orders
    and the structs ``mine`` and ``theirs`` are what the result shows, their fields null where a row has none. ``keys`` adds sku and text, null for none,
    to rows after they were dealt out, so that they are not shuffled. ``offered`` lines do not compare themselves: they are followed by ``texts`` (stem, text, po_text, score).
    """
    c = F.col
    kinds = {"mine": lines.schema["mine"].dataType, "theirs": stock.schema["theirs"].dataType}
    none = {**{k: F.lit(None).cast(v) for k, v in kinds.items()}, "score": F.lit(None).cast("double"), "link": F.lit(None).cast("bigint"),
            "other": F.lit(None).cast("string"), "offered": F.lit(False), "option": F.lit(False)}

    def rows(df: DataFrame, kind: int, place, **given) -> DataFrame:
        cells = {**none, **given}
        return df.select("stem", F.lit(kind).alias("kind"), place.cast("bigint").alias("place"), *[cells[k].alias(k) for k in none])

    every = rows(stock, ORDER_LINE, c("po_pos"), link=c("link"), theirs=c("theirs")).unionByName(
        rows(lines.filter("stem is not null"), LINE, c("line_index"), offered=c("offered"), mine=c("mine")))
    if texts is not None:
        offers = keys(rows(lines.filter("offered"), LINE, c("line_index"), mine=c("mine"))).select("stem", c("place").alias("line_index"), "text")
        every = every.unionByName(rows(
            offers.join(texts, ["stem", "text"]), LINE, c("line_index"), option=F.lit(True), other=c("po_text"), score=c("score")))
    dealt = keys(every.repartition(c("stem")))
    text = F.when(c("option"), c("other")).when(~c("offered"), c("text"))
    # their fields pass as columns: the size of a struct in a batch is worked out anew for every row
    shown = {f"{s}_{f.name}": (s, f) for s, t in kinds.items() for f in t.fields}
    dealt = dealt.select("stem", "kind", "place", "option", "sku", text.alias("text"), "score", "link",
                         *[c(s)[f.name].alias(n) for n, (s, f) in shown.items()])
    order = dealt.sortWithinPartitions("stem", "kind", "place", "option", c("score").desc(), "text")
    schema = T.StructType([*from_arrow_schema(_FLAT), *[T.StructField(n, f.dataType) for n, (_, f) in shown.items()]])
    found = order.mapInArrow(partial(_pass, rate=rate, own=len(kinds["mine"].fields)), schema)
    return found.select(*_FLAT.names, *[F.struct(*[c(n).alias(f.name) for n, (of, f) in shown.items() if of == s]).alias(s) for s in kinds])
