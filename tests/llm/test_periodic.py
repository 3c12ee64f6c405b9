"""Periodic runs against a plain definition."""

import hashlib
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm.periodic import RunParams, collapse_runs, find_runs
from ledgerloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, least=12):
    """Every lag on its own; of equal stretches the smallest lag."""
    out, n = {}, len(words)
    for q in range(1, n):
        i = q
        while i < n:
            x = i
            while i < n and words[i] == words[i - q]:
                i += 1
            if i - x >= q and i - x + q >= least:
                out.setdefault((x - q, i), q)
            i += i == x
    return sorted(((s, e, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def expected(doc_id, text, plant):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if plant and doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    top = max(runs, key=lambda r: (r[1] - r[0], -r[0], -r[2]), default=None)
    return (
        doc_id, len(runs), *((top[0], top[1] - top[0], top[2], 1000 * (top[1] - top[0]) // top[2]) if top else (None,) * 4),
        hashlib.sha256("".join(f"{s},{e - s},{q}\n" for s, e, q in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(),
    )


def found(words, least=12):
    return [tuple(r) for r in find_runs(np.array(words, dtype=np.uint64), least=least).tolist()]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=40), st.integers(1, 6)), max_size=6), st.sampled_from([2, 12, 50]))
def test_runs_are_the_definition(parts, least):
    words = [w for part, times in parts for w in part * times]
    assert found(words, least) == plain_runs(words, least)


@pytest.mark.parametrize("m", [1, 7, 8, 15, 16, 17, 31, 33, 64, 100])
def test_blocks_of_one_word_between_borders(m):
    words = ([0] * m + [1]) * 5 + [0] * (m // 2)
    assert found(words) == plain_runs(words)


def test_fibonacci_words_have_runs_of_many_periods():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    assert found(b) == plain_runs(b)


def test_hundred_thousand_times_one_word():
    assert found([5] * 100_000) == [(0, 100_000, 1)]
    got = found([5] * 50_000 + [6] + [5] * 50_000)
    assert got == [(0, 50_000, 1), (50_001, 100_001, 1)]


def corpus(seed, size):
    rng = random.Random(seed)
    rows = [(None, "no id " * 9), (3, None), (4, ""), (5, " \t\r\n\x0b\x0c "), (6, "a b " * 12), (6, "a b " * 12), (7, "é漢 🎈\n" * 400)]
    for i in range(size):
        vocabulary = [f"{rng.choice('aéb漢')}{v}" for v in range(rng.choice([1, 2, 4, 30, 500]))]
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 200))]
        if rng.random() < 0.5 and words:
            at, n = rng.randrange(len(words)), rng.randrange(1, 30)
            words[at:at] = words[at : at + n] * rng.randrange(1, 7)
        rows.append((100 + i, rng.choice([" ", "\n", "  ", "\t "]).join(words)))
    return rows


@pytest.mark.parametrize("plant", [False, True])
def test_documents(spark, plant):
    rows = corpus(5, 150)
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id long, text string, n_runs int, plant string")
    out = collapse_runs(df, plant=F.crc32(F.col("doc_id").cast("string").cast("binary")) if plant else None)
    assert sorted(map(tuple, out.collect()), key=str) == sorted((expected(d, t, plant) for d, t in rows), key=str)


def test_texts_and_runs_in_full(spark):
    df = spark.createDataFrame([(1, "so it  goes " + "on and " * 8 + "ends"), (2, "once")], "doc_id int, text string")
    one, two = sorted(collapse_runs(df, RunParams(6), in_full=True).collect())
    assert (one.collapsed, [tuple(r) for r in one.runs]) == ("so it goes on and ends", [(3, 16, 2)])
    assert (two.collapsed, two.runs) == ("once", [])


def test_empty_table(spark):
    assert collapse_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.skipif(not Path(SF).exists(), reason="given tables absent")
def test_query_on_given_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op12_periodic_runs"](spark, SF).collect()
    # texts of up to some thousand words; every lag of the longer ones would take the plain search minutes
    plain = {d: expected(d, t, True) for d, t in docs if len(WORD.findall(t or "")) < 2500}
    assert len(got) == len(docs) and len(plain) > 0.9 * len(docs)
    assert all(tuple(r) == plain[r.doc_id] for r in got if r.doc_id in plain)
    assert sum(r.n_runs > 0 for r in got) > len(docs) / 20
