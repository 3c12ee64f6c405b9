"""First places of targets in chunked running texts against a search of the whole text."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.grounding import find_values, offsets
from ledgerloom.operators.textsearch import CHUNK, LETTERS, NUMBERS, RAW, _Chunk, first_places, gram_codes


def kept(text, kind):
    """(character, place) of what a reading keeps of the running text."""
    return [(c, i) for i, c in enumerate(text.lower()) if c.isalnum() or (kind == NUMBERS and c == ".")]


def plain(elements, kind, target):
    """(elements) of the first match, None without one."""
    if kind == RAW:
        return next(([i] for i, t in enumerate(elements) if target in t), None)
    full, ends = "", []
    for t in elements:
        start, full = len(full), full + t + " "
        ends.append((start, len(full)))
    chars = kept(full, kind)
    stream = "".join(c for c, _ in chars)
    at = stream.find(target)
    while at >= 0:
        s, e = chars[at][1], chars[at + len(target) - 1][1] + 1
        touching = (s and full[s - 1].isdigit()) or (e < len(full) and full[e].isdigit())
        if kind == LETTERS or not touching:
            return [i for i, (a, b) in enumerate(ends) if max(a, s) < min(b, e)]
        at = stream.find(target, at + 1)
    return None


#: Test values name their reading. A lambda travels to the tasks by value, which cannot import this module.
as_target = lambda value: [(0, int(value[0]), value[1:])]


def corpus(seed, docs):
    rng = random.Random(seed)
    alphabet = ["a", "b", "1", "2", ".", "-", " ", "é", "B", "漢"]
    texts, targets = {}, []
    for d in range(docs):
        n = rng.choice([0, 1, 3, 40, 120])
        texts[f"d{d}"] = els = ["".join(rng.choice(alphabet[: rng.choice([4, 10])]) for _ in range(rng.choice([0, 1, 4, 9, 30]))) for _ in range(n)]
        whole = " ".join(els)
        for _ in range(12):
            at, size = rng.randrange(len(whole) + 1), rng.choice([1, 2, 3, 5, 8, 13, 20])
            piece = whole[at : at + size]
            stream = "".join(c for c in piece.lower() if c.isalnum())
            dotted = "".join(c for c in piece if c in "0123456789.")
            for kind, target in ((RAW, piece), (LETTERS, stream), (NUMBERS, dotted), (RAW, piece + "z"), (LETTERS, stream[::-1])):
                if target:
                    targets.append((f"d{d}", kind, target))
    return texts, sorted(set(targets))


@pytest.mark.parametrize("chunk", [8, 64, CHUNK])
def test_first_places_are_those_of_the_whole_text(spark, chunk):
    texts, targets = corpus(1, 60)
    rows = [(d, i, t) for d, els in texts.items() for i, t in enumerate(els)]
    elements = spark.createDataFrame(rows, "stem string, el_idx long, text string")
    wanted = spark.createDataFrame([(d, f"{k}{t}") for d, k, t in targets], "stem string, val string")
    # small chunks, so that documents have many and matches cross their borders
    found = {(r.stem, int(r.val[0]), r.val[1:]): r.els for r in first_places(elements, wanted, as_target, chunk).collect()}
    want = {t: plain(texts[t[0]], *t[1:]) for t in targets}
    assert found == {t: e for t, e in want.items() if e is not None}
    assert len(found) > 500 and len(found) < len(targets)


def test_long_elements_and_long_targets(spark):
    body = " ".join(f"w{i % 977}x{i}" for i in range(9000))
    els = ["head", body, "tail 12.50", "-", "9"]
    letters = "".join(c for c in body if c.isalnum())
    targets = [
        (RAW, body[30_000:34_000]), (RAW, body), (LETTERS, letters[50_000:50_050]), (LETTERS, letters[5:] + "tail"), (NUMBERS, "12.50"),
        (LETTERS, "509"), (NUMBERS, "509"), (RAW, "dw"), (RAW, "head w"),
    ]
    elements = spark.createDataFrame([("s", i, t) for i, t in enumerate(els)] + [("t", 0, None)], "stem string, el_idx long, text string")
    wanted = spark.createDataFrame([(s, f"{k}{t}") for k, t in targets for s in "stu"], "stem string, val string")
    rows = first_places(elements, wanted, as_target).collect()
    found = {(int(r.val[0]), r.val[1:]): r.els for r in rows}
    want = {t: plain(els, *t) for t in targets}
    assert found == {t: e for t, e in want.items() if e is not None} and {r.stem for r in rows} == {"s"}


def test_the_first_form_that_occurs_decides(spark):
    forms = lambda v: [(2, RAW, v + "x"), (3, LETTERS, v), (7, RAW, v)]
    rows = [("a", 0, "q b"), ("a", 1, "q"), ("a", 2, "qx"), ("b", 0, "- q -"), ("c", 0, "z")] + [("d", i, "z" * 90) for i in range(90)] + [("d", 90, "q")]
    elements = spark.createDataFrame(rows, "stem string, el_idx long, text string")
    wanted = spark.createDataFrame([(s, "q") for s in "abcd"], "stem string, val string")
    found = {r.stem: (r["rank"], r.els) for r in first_places(elements, wanted, forms).collect()}
    assert found == {"a": (2, [2]), "b": (3, [0]), "d": (3, [90])}


def test_a_chunk_finds_only_places_that_it_answers_for():
    pieces = [(i << 20, t, True, 10 * i) for i, t in enumerate(["abcabcabc", "abcabcabc"])]
    chunk = _Chunk(RAW, pieces)
    assert chunk.find("abc", 0, 10) == (0, [0])
    assert chunk.find("abc", 7, 10) is None
    assert chunk.find("abc", 10, 20) == (10, [1])
    assert chunk.find("c\0a", 0, 20) is None


def test_gram_codes_differ_by_length_and_order():
    assert len({*gram_codes("abcabd", 3).tolist(), *gram_codes("abcabd", 2).tolist()}) == 8
    assert gram_codes("ab", 3).size == 0


@pytest.mark.parametrize("filler", [0, 200])
def test_strategies_in_order(spark, filler):
    """In a short and in a long document."""
    els = ["Total 10.50", "10.5", "Acme", "Pty Ltd", "05/03/1998", "12 345", "x 77.0 y", "-3 - 3"] + ["filler words, 1 by 1, in every element"] * filler
    elements = spark.createDataFrame([("s", i, t) for i, t in enumerate(els)], "stem string, el_idx long, text string")
    wanted = ["10.50", "10.5", "10.500", "Acme Pty", "1998-03-05", "12345", "77", "-3", "3", "nothing", " ", None, "345", "45 x"]
    values = spark.createDataFrame([("s", v) for v in wanted], "stem string, value string")
    got = sorted((r.val, r.strategy, r.el_idx) for r in find_values(values, elements).collect())
    assert got == sorted([
        ("10.50", "exact", 0), ("10.5", "exact", 1), ("10.500", "number", 0), ("Acme Pty", "stream", 2), ("Acme Pty", "stream", 3),
        ("1998-03-05", "date", 4), ("12345", "number", 5), ("77", "number", 6), ("-3", "exact", 7), ("3", "exact", 7), ("345", "exact", 5), ("45 x", "stream", 5), ("45 x", "stream", 6),
    ])


def test_offsets_of_the_running_text(spark):
    elements = spark.createDataFrame([("s", i, t) for i, t in enumerate(["ab", "", "c"])], "stem string, el_idx long, text string")
    assert sorted(tuple(r) for r in offsets(elements).select("el_idx", "start", "end").collect()) == [(0, 0, 3), (1, 3, 4), (2, 4, 6)]
    assert offsets(elements.filter(F.lit(False))).count() == 0


def test_only_grams_looked_for_leave_the_chunks(spark, monkeypatch):
    from ledgerloom.operators import textsearch

    monkeypatch.setattr(textsearch, "STRETCH", 2)
    monkeypatch.setattr(textsearch, "STRETCHES", 3)
    texts = {("s", RAW, c): f"chunk {c} of s" for c in range(15)} | {("t", LETTERS, 0): "chunk0oft"}
    pieces = spark.createDataFrame([(*k, 0, t, True, 0) for k, t in texts.items()], "stem string, kind int, chunk long, place long, text string, last boolean, start long")
    grams = {k: {int(g) for g in gram_codes(t + ("\0" if k[1] == RAW else ""), 5)} for k, t in texts.items()}
    # of each document a few, one of another document's and one of none's
    asked = {("s", RAW, g) for g in sorted(set().union(*[v for k, v in grams.items() if k[0] == "s"]))[::3]} | {("s", RAW, 7), ("u", RAW, 7)}
    asked |= {("t", LETTERS, g) for g in [*sorted(grams["t", LETTERS, 0])[:2], *sorted(grams["s", RAW, 0])[:2]]}
    wanted = spark.createDataFrame(sorted(asked), "stem string, kind int, gram long")
    found = sorted(map(tuple, textsearch._gram_index(pieces, wanted, (5,)).collect()))
    assert found == sorted((*k, g) for k, v in grams.items() for g in v if (k[0], k[1], g) in asked)
    assert len(found) > 20 and {s for s, *_ in found} == {"s", "t"}


def test_elements_and_values_without_a_document_meet(spark):
    elements = spark.createDataFrame([(None, 0, "q a"), (None, 1, "b"), ("s", 0, "b")], "stem string, el_idx long, text string")
    wanted = spark.createDataFrame([(None, "b"), (None, "b"), (None, "z"), ("s", "b"), ("t", "b")], "stem string, val string")
    found = first_places(elements, wanted, lambda v: [(0, RAW, v)]).collect()
    assert sorted(((r.stem, r.els) for r in found), key=str) == [("s", [0]), (None, [1])]
