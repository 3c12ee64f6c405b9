"""ProbMinHash estimates, and classes against brute force."""

import random

import numpy as np
import pyarrow as pa

from ledgerloom.llm.probminhash import NearDupParams, _block_pairs, _set_maker, buckets_of, may_link, near_duplicates, shingles, signature


def test_register_agreement_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    common, only_a, only_b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (40, 15, 25))
    a, b = np.concatenate([common, only_a]), np.concatenate([common, only_b])
    weight = lambda e: 1.0 + (e % np.uint64(3)).astype(float)
    wa, wb = weight(a), weight(b)
    pa_, pb = dict(zip(a.tolist(), wa / wa.sum())), dict(zip(b.tolist(), wb / wb.sum()))
    every = set(pa_) | set(pb)
    true = sum(1 / sum(max(pa_.get(f, 0) / pa_[e], pb.get(f, 0) / pb[e]) for f in every) for e in set(pa_) & set(pb))
    m = 4096
    assert abs((signature(a, wa, m) == signature(b, wb, m)).mean() - true) < 4 * (true * (1 - true) / m) ** 0.5


def test_signature_of_one_element_and_order():
    e = np.array([5, 9, 77], dtype=np.uint64)
    assert (signature(e[:1], np.ones(1), 96) == 5).all()
    assert (signature(e, np.ones(3), 96) == signature(e[::-1], np.ones(3), 96)).all()


def brute(rows, p):
    def grams(text):
        w = text.split()
        return {tuple(w[i : i + p.shingle]) for i in range(max(1, len(w) - p.shingle + 1))} if w else set()

    ids = [r[0] for r in rows]
    sets = [grams(r[1] or "") for r in rows]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if ids[i] == ids[j] or sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= p.threshold:
                x, y = sorted((find(ids[i]), find(ids[j])))
                root[y] = x
    return {i: find(i) for i in ids}


def test_classes_are_those_of_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(500)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows, n = [], 0

    def add(words):
        nonlocal n
        n += 7
        rows.append((n if rng.random() < 0.9 else 100_000 - n, " ".join(words)))

    for _ in range(25):
        base = text(rng.randrange(3, 400))
        for copy in range(rng.randrange(1, 7)):
            add(base)
            edited = list(base)
            for _ in range(max(1, len(base) // 90)):  # chains of ever more edits
                edited[rng.randrange(len(edited))] = f"edit{n}"
            base = edited
    shared = text(60)
    for _ in range(30):
        add(text(80) + shared + text(40))
    rows += [(3, None), (4, ""), (5, " \n"), (6, None), (8, "one"), (9, "one"), (8, "one"), (11, "long text " * 30_000)]
    df = spark.createDataFrame([(a, b, 1, "z") for a, b in rows], "doc_id long, text string, node int, sig string")
    got = near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.class_id for r in got} == brute(rows, NearDupParams())


def test_small_blocks_find_the_same(spark):
    """Many texts about as far from one original as the threshold: mixed buckets, cut into tiny blocks."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(90)]
    rows = []
    for i in range(70):
        words = list(base)
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(90)] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, NearDupParams())
    for p in (NearDupParams(), NearDupParams(x_block=3, y_block=7)):
        assert {r.doc_id: r.class_id for r in near_duplicates(df, p).collect()} == want


def test_sketch_drops_no_pair_at_the_threshold():
    rng, p = np.random.default_rng(3), NearDupParams()
    mark = lambda s: np.unique(s)[: p.sketch].tobytes()
    for n in (40, 500, 511, 512, 513, 3000):
        for share in (0.3, 0.81, 0.9, 1.0):
            e = rng.integers(0, 2**32, n, dtype=np.uint32)
            common = round(n * share)
            rest = (n - common) // 2
            a, b = e[: common + rest], np.concatenate([e[:common], e[common + rest :]])
            assert may_link(mark(a), mark(b), p) == (share > 0.5), (n, share)


def test_null_id_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert {(r.doc_id, r.class_id) for r in near_duplicates(df).collect()} == {(None, None), (1, 1), (2, 1)}
    assert near_duplicates(df.limit(0)).count() == 0


def test_copies_that_gain_or_lose_an_often_repeated_line(spark):
    """Plain Jaccard index above 0.8, probability Jaccard index far below: every pair is one class, though weighted registers seldom agree."""
    rng, rows = random.Random(11), []
    for i in range(60):
        base = [f"b{i}x{rng.randrange(10**6)}" for _ in range(100)]
        line = [f"l{i}x{rng.randrange(10**6)}" for _ in range(15)]
        long = base + line * 100
        rows += [(2 * i, " ".join(long if i % 2 else base)), (2 * i + 1, " ".join(base if i % 2 else long))]
    want = brute(rows, NearDupParams())
    assert len(set(want.values())) == 60
    assert {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_second_pass_links_copies_with_an_often_repeated_line():
    """The unit of the second pass, given one bucket: the pair is passed on, whatever the weighted registers say."""
    p = NearDupParams()
    base, line = [f"b{i}" for i in range(100)], [f"l{i}" for i in range(15)]
    texts = pa.array([" ".join(base), " ".join(base + line * 100)])
    grams = list(shingles(texts, p.shingle))
    keys = [buckets_of(*np.unique(g, return_counts=True), p) for g in grams]
    bucket = int(np.intersect1d(*keys)[0])
    made = next(_set_maker(p)(iter([pa.RecordBatch.from_arrays([pa.array([1, 2]), texts], names=["node", "text"])])))
    row = lambda i, asks: {
        "bucket": bucket, "x_block": 0, "y_block": 0, "asks": asks, "node": i + 1, "root": i + 1, "outside": i == 0,
        "n_shingles": len(np.unique(grams[i])), "buckets": keys[i].tobytes(), "sketch": made.column("sketch")[i].as_py(),
    }
    rows = pa.RecordBatch.from_pylist([row(0, True), row(0, False), row(1, False)])
    assert [b.to_pylist() for b in _block_pairs(p)(iter([rows]))] == [[{"a": 1, "b": 2}]]
