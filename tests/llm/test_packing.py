"""Packing: capacity and conflicts, best fit against a plain search, nothing lost, edge cases."""

import random
import time
from collections import Counter, defaultdict

from ledgerloom.llm.packing import PackParams, best_fit, pack


def plain(rows, capacity):
    """Looks at every bin each time: the smallest room that suffices, ties to the older bin, none with the source or the cluster."""
    bins, out = [], []
    for doc_id, source, cluster, length in rows:
        begin = 0
        while length - begin > capacity or (begin and length - begin == capacity):
            out.append((doc_id, begin, len(bins)))
            bins.append([0, set(), set()])
            begin += capacity
        size = length - begin
        if not size:
            continue
        fit = [(room, i) for i, (room, s, c) in enumerate(bins) if room >= size and source not in s and cluster not in c]
        if fit:
            i = min(fit)[1]
        else:
            i = len(bins)
            bins.append([capacity, set(), set()])
        bins[i][0] -= size
        bins[i][1] |= {source} - {None}
        bins[i][2] |= {cluster} - {None}
        out.append((doc_id, begin, i))
    return out


def test_a_shard_of_one_source_takes_no_square_of_its_rows():
    rows = [(i, "hot" if i % 50 else "other", None, 900 - i // 10) for i in range(8192)]
    start = time.time()
    packed = pack(rows, 2048)
    assert time.time() - start < 3
    assert len({n for *_, n, _ in packed}) >= 8000


def test_many_bins_with_few_conflicts():
    rng = random.Random(4)
    rows = sorted(((i, rng.choice("abcdefgh"), rng.choice([None, rng.randrange(40)]), rng.randrange(1, 60)) for i in range(1500)), key=lambda r: (-r[3], r[0]))
    assert [(d, b, n) for d, _, b, _, n, _ in pack(rows, 100)] == plain(rows, 100)


def test_tightest_compatible_bin():
    rng = random.Random(1)
    for _ in range(30):
        rows = [(i, rng.choice([None, "hot", "hot", "a", "b", "c"]), rng.choice([None, 1, 2, rng.randrange(99)]), rng.randrange(1, 260)) for i in range(200)]
        rows.sort(key=lambda r: (-r[3], r[0]))
        assert [(d, b, n) for d, _, b, _, n, _ in pack(rows, 100)] == plain(rows, 100)


def test_documents(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 90)) if i % 9 else None, rng.choice(["hot", "hot", f"s{i % 11}", None])) for i in range(700)]
    rows += [(5000 + i, "the same text here", f"t{i}") for i in range(60)] + [(9, "again", "x")] * 3 + [(None, "no id", "y"), (7000, "long " * 100_000, "z")]
    df = spark.createDataFrame([(*r, 1, "b") for r in rows], "doc_id long, text string, source string, shard int, bin string")
    p = PackParams(capacity=100, shard_rows=200)
    got = best_fit(df, p).collect()
    sizes, bins = Counter(), defaultdict(list)
    for r in got:
        sizes[r.doc_id] += r.piece_words
        bins[r.shard, r.bin].append(r)
    want = Counter()
    for doc_id, text, _ in rows:
        want[doc_id] += len((text or "").split()) + 1
    assert sizes == want
    source, text = {r[0]: r[2] for r in rows}, {r[0]: r[1] for r in rows}
    for members in bins.values():
        members.sort(key=lambda r: r.bin_offset)
        assert sum(r.piece_words for r in members) <= 100
        assert all(b.bin_offset >= a.bin_offset + a.piece_words for a, b in zip(members, members[1:]))
        for kind in (source, text):
            values = [kind[r.doc_id] for r in members if kind[r.doc_id] is not None]
            assert len(values) == len(set(values))
    assert best_fit(df.limit(0), p).count() == 0
