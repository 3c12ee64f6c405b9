"""Winnowing against a plain definition, and the neighbour rule on edge cases."""

import hashlib

import numpy as np
import pytest

from ledgerloom.llm.winnowing import WinnowParams, fingerprint_documents, rolling_hashes, winnow


def points(text):
    return np.array([ord(c) for c in text], dtype=np.uint32)


def plain(text, p):
    """Every window looked at on its own; ties to the right."""
    if not text:
        return []
    k = min(p.k, len(text))
    hashes = [int(rolling_hashes(points(text[i : i + k]), k)[0]) for i in range(len(text) - k + 1)]
    w = min(p.w, len(hashes))
    chosen = {}
    for i in range(len(hashes) - w + 1):
        window = hashes[i : i + w]
        at = max(j for j in range(w) if window[j] == min(window))
        chosen[i + at] = window[at]
    return [(chosen[i], i) for i in sorted(chosen)]


@pytest.mark.parametrize("text", ["", "a", "abc", "aaaaaaaaaaaaaaaaaaaa", "the cat sat on the mat and the cat sat on the hat", "éß漢字🎈" * 9])
@pytest.mark.parametrize("k,w", [(1, 1), (3, 4), (5, 7), (20, 64)])
def test_winnow_is_the_definition(text, k, w):
    p = WinnowParams(k, w)
    got = [(int(m) >> 32, int(m) & 0xFFFFFFFF) for m in winnow(points(text), p)]
    assert got == plain(text, p)


def test_shared_run_is_found():
    p = WinnowParams(5, 8)
    rng = np.random.default_rng(3)
    letters = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    for _ in range(50):
        run = letters(p.guarantee)
        a, b = (winnow(points(letters(30) + run + letters(30)), p) >> np.uint64(32) for _ in range(2))
        assert np.intersect1d(a, b).size


def expected(rows):
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(10**9)), r[1] or ""))
    out = []
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [
    [(1, "only one row of text here")],
    [(i, f"text number {i} " * (i % 7)) for i in range(60)],
    [(5, "same"), (5, "same"), (5, "other"), (4, None), (None, "no id"), (9, ""), (8, "é漢🎈 wide " * 4000)],
])
def test_neighbours(spark, rows):
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, part string, tail int")
    out = fingerprint_documents(df).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in out), key=str) == expected(rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)


def test_empty_table_and_equal_texts(spark):
    assert fingerprint_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    out = fingerprint_documents(spark.createDataFrame([(1, "abc " * 50), (2, "zzz"), (3, "abc " * 50)], "doc_id long, text string")).collect()
    assert len({r.fingerprint for r in out if r.doc_id != 2}) == 1
