"""Sharding against a plain restatement, its edge cases, and a map that is kept and edited."""

import hashlib
import random
import zlib

import pytest

from ledgerloom.llm.sharding import ShardParams, load_version, save_version, shard_documents


def records(rows, slots):
    out = []
    for doc_id, text in rows:
        data = (text or "").encode()
        crc = zlib.crc32(data)
        key = f"{'' if doc_id is None else doc_id}:{crc}".encode()
        out.append((doc_id, len(data) + 1, crc, int(hashlib.md5(key).hexdigest()[:8], 16) % slots))
    return out


def rebalance(loads, home, shards):
    """From heavy to light, a slot moves to the lightest shard where that lowers the heavier of the two."""
    total = [0] * shards
    for slot, bytes_ in loads.items():
        total[home[slot]] += bytes_
    home = dict(home)
    for slot in sorted(loads, key=lambda s: (-loads[s], s)):
        light = total.index(min(total))
        if total[light] + loads[slot] < total[home[slot]]:
            total[home[slot]] -= loads[slot]
            total[light] += loads[slot]
            home[slot] = light
    return home


def loads_of(rows, p):
    loads = dict.fromkeys(range(p.slots), 0)
    for _, size, _, slot in records(rows, p.slots):
        loads[slot] += size
    return loads


def corpus(seed, n):
    rng = random.Random(seed)
    rows = [(i, "é漢 text " * rng.choice([0, 1, 5, 400])) for i in range(n)]
    return rows + [(None, None), (None, "no id"), (3, None), (7, "same"), (7, "same"), (7, "same"), (n, "")]


def frame(spark, rows):
    names = "doc_id long, text string, size string, shard string, slot int, vslot int, version int, bytes int, n int, at int, base int, e int"
    return spark.createDataFrame([(*r, "x", "y", *[1] * 8) for r in rows], names)


@pytest.mark.parametrize("p", [ShardParams(), ShardParams(3, 16), ShardParams(8, 8), ShardParams(1, 5)])
def test_places_are_those_of_the_plain_rule(spark, p):
    rows = corpus(1, 120)
    out, _ = shard_documents(frame(spark, rows), p)
    got = out.select("doc_id", "size", "text_crc32", "vslot", "shard", "slot").collect()
    want = rebalance(loads_of(rows, p), {s: s % p.shards for s in range(p.slots)}, p.shards)
    assert sorted((r[:4] for r in got), key=str) == sorted(records(rows, p.slots), key=str)
    assert all(r.shard == want[r.vslot] for r in got)
    for shard in {r.shard for r in got}:
        held = sorted((r for r in got if r.shard == shard), key=lambda r: r.slot)
        assert [r.slot for r in held] == list(range(len(held)))
        order = [(r.vslot, r.doc_id is not None, r.doc_id or 0, r.text_crc32) for r in held]
        assert order == sorted(order)


def test_sizes_are_near_equal(spark):
    rows = [(i, "w " * (1 + i % 50)) for i in range(3000)]
    out, _ = shard_documents(frame(spark, rows))
    totals = [r["sum(size)"] for r in out.groupBy("shard").sum("size").collect()]
    assert len(totals) == 8 and max(totals) <= 1.01 * min(totals)


def test_empty_table(spark):
    out, versions = shard_documents(frame(spark, []))
    assert out.count() == 0 and versions.count() == 2 * 4096


def test_a_kept_map_is_edited_and_its_versions_stay(spark, tmp_path):
    path, p = f"{tmp_path}/maps/documents", ShardParams(4, 32)
    home = {s: s % 4 for s in range(32)}
    for step, rows in enumerate((corpus(2, 60), corpus(3, 90), corpus(2, 60))):
        out, _ = shard_documents(frame(spark, rows), p, path)
        home, before = rebalance(loads_of(rows, p), home, 4), home
        assert {r.vslot: r.shard for r in load_version(spark, path).collect()} == home
        assert {r.vslot: r.shard for r in load_version(spark, path, step + 1).collect()} == before
        assert all(r.shard == home[r.vslot] for r in out.collect())
    assert load_version(spark, path).first().version == 4
    with pytest.raises(Exception):
        save_version(load_version(spark, path, 2), path)
