"""Substring dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.phrases import PhraseParams, Phrases, first_windows, passages, remove_repeats, shard_column, shard_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=20):
    last = 1 << 63
    first = {}
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        for s in range(len(words) - window + 1):
            key, place = tuple(words[s : s + window]), (last if doc_id is None else doc_id, s)
            first[key] = min(first.get(key, place), place)
    out = []
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        gone = set()
        for s in range(len(words) - window + 1):
            if first[tuple(words[s : s + window])] < (last if doc_id is None else doc_id, s):
                gone.update(range(s, s + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, size):
    rng = random.Random(seed)
    words = lambda n, v=3000: [f"{rng.choice('aéb漢')}{rng.randrange(v)}" for _ in range(n)]
    shared = [words(n) for n in (8, 12, 19, 20, 21, 33, 64, 150)]
    rows = []
    for i in range(size):
        body = words(rng.randrange(0, 120))
        for _ in range(rng.randrange(4)):
            passage = rng.choice(shared)
            a, b = sorted((rng.randrange(len(passage) + 1), rng.randrange(len(passage) + 1)))
            body += passage if rng.random() < 0.6 else passage[a:b]
            body += words(rng.randrange(40))
        if rng.random() < 0.1:
            body = words(25, 2) * 3 + ["x"] * rng.randrange(60)
        rows.append((i * 3, rng.choice([" ", "\n", " \t "]).join(body)))
    rows += [(rows[k][0] + 1, rows[k][1]) for k in rng.sample(range(size), size // 6)]
    rng.shuffle(rows)
    return rows


EDGES = [(1, None), (2, ""), (3, " \n"), (None, "n " * 30), (None, "k " * 45), (4, "q w e r t " * 12), (4, "q w e r t " * 12), (4, "a b c d e f " * 9), (5, "k " * 45), (7, "much text here " * 30_000)]


@pytest.mark.parametrize("p", [PhraseParams(), PhraseParams(shard_bytes=3000, hot_share=0.0001), PhraseParams(sample_rows=1)])
def test_against_brute_force(spark, p):
    rows = corpus(4, 260)
    df = spark.createDataFrame([(a, b, 9) for a, b in rows], "doc_id long, text string, start int").repartition(5)
    assert sorted(map(tuple, remove_repeats(df, p).collect()), key=str) == brute(rows)


def test_edges(spark):
    df = spark.createDataFrame([(a, b, "x") for a, b in EDGES], "doc_id long, text string, did string")
    assert sorted(map(tuple, remove_repeats(df).collect()), key=str) == brute(EDGES)
    assert remove_repeats(df.limit(0)).count() == 0


def test_kept_text_has_the_kept_words(spark):
    rows = corpus(9, 80)
    df = spark.createDataFrame([(a, b, "s") for a, b in rows], "doc_id long, text string, source string")
    for r in remove_repeats(df, with_text=True, extra=("source",)).collect():
        assert hashlib.sha256(" ".join(WORD.findall(r.kept_text)).encode()).hexdigest() == r.kept_sha256 and r.extra.source == "s"


def test_columns_of_any_name_pass_through(spark):
    """Every name that the operator uses inside or returns."""
    names = ["did", "tkey", "shard", "start", "mask", "anchor", "digests", "n", "n_words", "n_removed", "kept_sha256", "kept_text", "extra", "a.b"]
    rows = corpus(10, 40)
    df = spark.createDataFrame([(a, b, *[f"{c} of {a}" for c in names]) for a, b in rows], ["doc_id", "text", *names])
    out = remove_repeats(df, with_text=True, extra=tuple(names)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out), key=str) == brute(rows)
    assert all(r.extra.asDict() == {c: f"{c} of {r.doc_id}" for c in names} for r in out)


def test_automata_find_what_is_not_listed(spark):
    """One place of a recurring window is confirmed in a shard; without the automaton the others would stay."""
    rows = corpus(12, 120)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    wanted = [{"doc_id": a, "text": b} for a, b in rows]
    repeats = {}
    for doc_id, words in sorted((r["doc_id"], WORD.findall(r["text"])) for r in wanted):
        for s in range(len(words) - 19):
            repeats.setdefault(tuple(words[s : s + 20]), []).append((doc_id, s))
    places = sum(len(v) - 1 for v in repeats.values())
    recurring = [(v[1], k) for k, v in repeats.items() if len(v) > 1]
    known = {}
    for (doc_id, s), _ in recurring:
        known.setdefault(doc_id, []).append(s)
    by_id = dict(rows)
    phrases = Phrases([(d, WORD.findall(by_id[d]), passages(sorted(known[d]), 20)) for d in sorted(known)], 20)
    gone = {d: phrases.locate(d, WORD.findall(t)) for d, t in rows}
    assert {d: 0 if g is None else int(g.sum()) for d, g in gone.items()} == {d: n for d, _, n, _ in brute(rows)}
    assert len(recurring) < places / 2
    assert sum(r.n_removed for r in remove_repeats(df).collect()) == sum(n for _, _, n, _ in brute(rows))


def test_periodic_passages_do_not_multiply():
    """Equal tiles of one passage: as many places as distinct windows, not as words."""
    words = ["a", "b", "c"] * 4000
    starts = first_windows(list(range(3, len(words) - 19)), words, 20, set())
    assert starts == [3, 4, 5]
    phrases = Phrases([(1, words, passages(starts, 20))], 20)
    assert phrases.locate(1, words).sum() == len(words) - 3 and phrases.locate(2, words).all()


def test_shards_are_the_same_in_both_engines(spark):
    ids = [0, 1, 2, 999, -1, -(1 << 62), (1 << 63) - 1, 1 << 31, (1 << 31) - 1] + [k * 1000 for k in range(500)]
    df = spark.createDataFrame([(i,) for i in ids], "did long").select("did", shard_column(F.col("did"), 37).alias("s"))
    got = {r.did: r.s for r in df.collect()}
    assert [got[i] for i in ids] == shard_of(np.array(ids, dtype=np.int64), 37).tolist()
    assert max(np.bincount(shard_of(np.arange(0, 10**6, 1000), 37))) < 60
