"""The pass compares texts only where it must, and hands on whole results however its rows are cut into batches."""

import pyarrow as pa
from pyspark.sql import functions as F

from ledgerloom.functions.similarity import common_length, lcs_pairs
from ledgerloom.operators import assignment as A
from ledgerloom.operators import orders as O
from ledgerloom.params import Params
from test_assignment import tables

NAMES = ["stem", "kind", "place", "option", "sku", "text", "score", "link", "mine", "theirs"]
TYPES = [pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.string(), pa.string()]


def batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], names=NAMES)


def document(stem):
    return [
        (stem, 0, 0, False, "A", "ring blue", None, 7, None, "p0"), (stem, 0, 1, False, "B", "gear small", None, 7, None, "p1"),
        (stem, 0, 2, False, None, "widget", None, 7, None, "p2"), (stem, 0, 3, False, "D", "left over", None, 7, None, "p3"),
        (stem, 1, 0, False, "B", "anything", None, None, "m0", None), (stem, 1, 1, False, None, "ring blue", None, None, "m1", None),
        (stem, 1, 2, False, None, "widgets", None, None, "m2", None), (stem, 1, 3, False, None, "zzz", None, None, "m3", None),
    ]


def results(batches, rate=A.similar(65)):
    return [tuple(r.values()) for b in A._pass(iter(batches), rate) for r in b.to_pylist()]


def test_texts_are_compared_only_where_no_sku_and_no_equal_text_decides():
    asked = []

    def rate(text, other, least):
        asked.append((text, other))
        return A.similar(65)(text, other, least)

    got = results([batch(document("d"))], rate)
    assert [(r[3], r[4], r[7], r[8]) for r in got] == [(0, 1, "m0", "p1"), (1, 0, "m1", "p0"), (2, 2, "m2", "p2"), (3, None, "m3", None), (None, 3, None, "p3")]
    assert not [a for a in asked if a[0] in ("anything", "ring blue") and a[0] != a[1]]


def test_batches_may_cut_documents_anywhere():
    rows = document("a") + document("b")
    whole = results([batch(rows)])
    assert len(whole) == 10
    for size in (1, 2, 3, 5):
        assert results([batch(rows[i:i + size]) for i in range(0, len(rows), size)]) == whole


def test_one_pair_has_the_length_that_many_have():
    a, b = ["", "abc", "ring blue", "é" * 70, "kitten"], ["x", "abc", "blue ring", "é" * 65 + "a", "sitting"]
    assert [common_length(x, y) for x, y in zip(a, b)] == lcs_pairs(pa.array(a), pa.array(b)).to_pylist()


def test_a_document_of_two_links_keeps_its_rows(spark):
    """A link that comes twice offers every order line twice: pairs per copy of the order line, matches per link as well."""
    links, lines, stock = tables(spark, {"d": ([(0, "A", "ring"), (1, None, "zzz")], [(0, "A", "ring"), (1, "B", "gear")])})
    found = O.match_lines(links.unionByName(links), lines, stock, Params())
    assert O.assigned(found).count() == 2
    assert sorted(r.line_index for r in O.line_matches(found).collect()) == [0, 0, 0, 0, 1, 1]
    assert [r.po_pos for r in O.unmatched_po_lines(found).collect()] == [1, 1]


def test_an_index_that_comes_twice_gives_every_combination(spark):
    links, lines, stock = tables(spark, {"d": ([(0, "A", "ring"), (0, "A", "ring")], [(0, "A", "ring"), (1, "A", "ring")])})
    found = O.match_lines(links, lines, stock, Params())
    assert sorted(r.p for r in O.assigned(found).select(F.col("c.po_pos").alias("p")).collect()) == [0, 0, 1, 1]
    assert O.line_matches(found).count() == 8


def test_what_is_shown_passes_as_plain_columns(spark):
    """A struct's size in a batch is worked out anew for every row, so fields pass one by one: those of a line, then those of an order line."""
    rows = document("d")
    names = [*NAMES[:8], "mine_a", "mine_b", "theirs_a", "theirs_b", "theirs_c"]
    wide = [(*r[:8], r[8], r[8] and r[8] * 2, r[9], r[9] and r[9] * 2, None) for r in rows]
    types = [*TYPES[:8], *[pa.string()] * 5]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)], names=names) for part in (wide[:3], wide[3:6], wide[6:])]
    got = [tuple(r.values()) for b in A._pass(iter(batches), A.similar(65), 2) for r in b.to_pylist()]
    assert got == [(*r[:7], r[7], r[7] and r[7] * 2, r[8], r[8] and r[8] * 2, None) for r in results([batch(rows)])]

    lines = spark.createDataFrame([("a", 0, False, ("L", 1))], "stem string, line_index long, offered boolean, mine struct<sku: string, n: int>")
    stock = spark.createDataFrame([("a", 0, 1, ("L",)), ("a", 1, 1, (None,))], "stem string, po_pos long, link long, theirs struct<sku: string>")
    found = A.assign(lines, stock, None, lambda df: df.withColumn("sku", F.coalesce("mine.sku", "theirs.sku")).withColumn("text", F.lit(None).cast("string")), A.similar(65))
    plan = found._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "MapInArrow":
        plan = plan.children().head()
    assert not any(plan.children().head().schema().apply(i).dataType().typeName() == "struct" for i in range(plan.children().head().schema().length()))
    assert {(r.role, r.po_pos, r.mine.sku, r.mine.n, r.theirs.sku) for r in found.collect()} == {(A.BOTH, 0, "L", 1, "L"), (A.LEFT, 1, None, None, None)}
