"""The Merkle manifest against a plain tree built with lists."""

import hashlib
import random
import zlib
from string import ascii_lowercase, ascii_uppercase

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.merkle import build, leaf_rows, manifest_rows, prove

LOWER = str.maketrans(ascii_uppercase, ascii_lowercase)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def grow(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def around(levels, i):
    """(left, right) of each level but the last."""
    out = []
    for level in levels[:-1]:
        run = level[i - i % 16 : i - i % 16 + 16]
        out.append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
        i //= 16
    return out


def expected(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        held = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = held, grow([leaf(r) for r in held])
    top = grow([trees[s][1][-1][0] for s in order])
    root, out = top[-1][0], []
    for j, s in enumerate(order):
        held, levels = trees[s]
        for i, r in enumerate(held):
            path = around(levels, i) + around(top, j)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            now = leaf((*r[:4], r[4] and r[4].translate(LOWER))) if tampered else leaf(r)
            for a, b in path:
                now = sha(a + now + b)
            out.append((r[0], leaf(r), levels[-1][0], root, sha("".join(a + b for a, b in path)), now, now == root))
    return sorted(out, key=str)


def corpus(seed, sizes):
    rng = random.Random(seed)
    rows = []
    for s, n in sizes.items():
        for _ in range(n):
            text = rng.choice([None, "", "lower only", "Mixed Ünd É", "X" * rng.randrange(50), "漢字 A"])
            rows.append((rng.randrange(10**6), s, rng.choice([None, "en"]), rng.choice([None, 3]), text))
    rng.shuffle(rows)
    return rows


def result(spark, rows):
    df = spark.createDataFrame(
        [(*r, "x", 1, 2) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, pos long, mid int"
    )
    out = manifest_rows(df, {"text": F.translate("text", ascii_uppercase, ascii_lowercase)}, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    return sorted(map(tuple, out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


@pytest.mark.parametrize("sizes", [
    {"a": 1}, {"a": 2}, {"a": 1, "b": 1, None: 1}, {"a": 16, "b": 17, "é": 256, "": 5, None: 40, "z": 257},
    {f"s{i}": 1 + i % 3 for i in range(300)},
])
def test_small_trees(spark, sizes):
    rows = corpus(1, sizes)
    assert result(spark, rows) == expected(rows)


def test_several_blocks_and_layers(spark):
    rows = corpus(2, {"hot": 9000, "block": 4096, "over": 4097, None: 300})
    assert result(spark, rows) == expected(rows)


def test_more_sources_than_a_block(spark):
    rows = corpus(3, {f"s{i}": 1 for i in range(4200)})
    assert result(spark, rows) == expected(rows)


def test_repeated_rows_and_ids(spark):
    rows = [(5, "a", "en", 1, "Same")] * 40 + [(5, "a", "en", 1, "Other")] * 3 + [(None, "a", None, None, "No Id")] * 20 + [(None, None, None, None, None)]
    assert result(spark, rows) == expected(rows)


def test_empty_table(spark):
    assert result(spark, []) == []


def test_versions_hold_only_copied_nodes(spark):
    rows = corpus(4, {"a": 300, "b": 20})
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    out = prove(build(leaf_rows(df, {"lang": F.lit("xx")}, F.col("doc_id") % 2 == 0))).collect()
    # leaf, three levels of 300 or two of 20 leaves, one level of two sources
    assert {(r.source, r.doc_id % 2, len(r.copied or [])) for r in out} == {("a", 0, 5), ("a", 1, 0), ("b", 0, 4), ("b", 1, 0)}
    versions = [r for r in out if r.copied]
    assert len({r.copied[-1] for r in versions}) == len({(r.source, r.doc_id) for r in versions}) and all(r.copied[-1] != r.root for r in versions)


def test_untouched_rows_are_folded_too(spark, monkeypatch):
    """With one wrong sibling in the stored paths of one source no row of that source verifies, altered or not."""
    from ledgerloom.llm import merkle

    def damaged(rows):
        tree = build(rows)
        wrong = F.transform("path", lambda x: F.struct(F.lit("0" * 64).alias("l"), x["r"].alias("r")))
        tree.sources = tree.sources.withColumn("path", F.when(F.col("source") == "b", wrong).otherwise(F.col("path")))
        return tree

    monkeypatch.setattr(merkle, "build", damaged)
    rows = corpus(5, {"a": 40, "b": 20})
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    out = manifest_rows(df).collect()
    assert {(r.source, r.verified) for r in out} == {("a", True), ("b", False)}
