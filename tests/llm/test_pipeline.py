"""The pipeline against brute force stage by stage, on a slice of planted cases and on the smallest given table."""

import random
import re
from collections import Counter
from pathlib import Path

import pytest

from corpus_pipeline import STAGES, run

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text):
    w = WORD.findall(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(rows):
    """Smallest ids of the classes: all pairs that share a shingle are compared."""
    sets = {r[0]: grams(r[1]) for r in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)
    for pair in {(min(a, b), max(a, b)) for ids in holders.values() for a in ids for b in ids if a != b}:
        a, b = pair
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [r for r in rows if find(r[0]) == r[0]]


def cut(rows, window=20):
    first, out = {}, []
    for i, text in rows:
        w = WORD.findall(text)
        for s in range(len(w) - window + 1):
            first[tuple(w[s : s + window])] = min(first.get(tuple(w[s : s + window]), (i, s)), (i, s))
    for i, text in rows:
        w = WORD.findall(text)
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (i, s):
                gone.update(range(s, s + window))
        left = [x for j, x in enumerate(w) if j not in gone]
        if left or not w:
            out.append((i, " ".join(left)))
    return out


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(5)
    vocabulary = {lang: [f"{lang}{''.join(rng.choice('aeioubdfg') for _ in range(5))}" for _ in range(700)] for lang in ("en", "fr")}
    text = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) for _ in range(n))
    rows, shared = [], text("en", 70)
    for i in range(150):
        lang = rng.choice(["en", "fr"])
        body = text(lang, rng.randrange(6, 150))
        if i % 6 == 0:
            body = f"{body} {shared} {text(lang, 30)}"
        rows.append((i, body, lang))
    rows += [(200 + i, rows[i][1], rows[i][2]) for i in range(20)]
    rows += [(300 + i, rows[6 * i][1] + " edit", rows[6 * i][2]) for i in range(20)]
    rows += [(400, None, "en"), (401, "", "en"), (402, "12 34 !!", None)]
    full = [(i, t, g, f"s{i % 3}", len(t or ""), "extra") for i, t, g in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(f"{tmp_path}/documents.parquet")
    docs, folder = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)
    columns, want = docs.columns, [(i, t) for i, t, _ in rows if i < 400]
    for (_, stage), expected in zip(STAGES[:3], (lambda r: r, near, cut)):
        out, want = stage(spark, docs, folder), expected(want)
        assert out.columns == columns
        out.write.parquet(f"{folder}/{stage.__name__}")
        docs = spark.read.parquet(f"{folder}/{stage.__name__}")
        got = {r.doc_id: " ".join(WORD.findall(r.text)) for r in docs.collect()}
        assert got == {i: " ".join(WORD.findall(t)) for i, t in want}
    sizes = Counter()
    for r in run(spark, folder).collect():
        sizes[r.doc_id] += r.piece_words
    assert sizes == {i: len(t.split()) + 1 for i, t in want}


def prose(rng, n):
    return " ".join(rng.choice(["the", "house", "river", "green", "walks", "under", "stone", "light"]) + rng.choice(["", "s", "ly", "ing"]) for _ in range(n))


def stages_of(spark, folder, rows, schema):
    """The documents after each of the first three stages."""
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in STAGES[:3]:
        stage(spark, docs, str(folder)).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


NAMES = [
    "n_words", "n_removed", "kept_sha256", "kept_text", "did", "tkey", "shard", "start", "mask", "extra", "runs", "row", "key", "pos", "tree", "last", "id", "tie",
    "mid", "range", "total", "class_id", "node", "bucket", "lang_pred", "score", "held_out", "cluster", "length", "piece", "bin", "digest", "anchor", "__stem",
]


@pytest.mark.parametrize("repeated", [False, True])
def test_columns_of_any_name_pass_through(spark, tmp_path, repeated):
    rng = random.Random(8)
    texts = [prose(rng, 60) for _ in range(12)]
    ids = [i // 2 if repeated else i for i in range(12)]
    rows = [(i, t, "en", "s", len(t), *[f"{c}{k}" for c in NAMES]) for k, (i, t) in enumerate(zip(ids, texts))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in NAMES)
    for docs in stages_of(spark, tmp_path, rows, schema):
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *NAMES]
        assert sorted(map(tuple, docs.collect())) == sorted(rows)
    assert run(spark, str(tmp_path)).select("doc_id").distinct().count() == len(set(ids))


def test_repeated_and_missing_ids(spark, tmp_path):
    """One id, two texts: both stay. Copies collapse to one, also without an id; a rejected text takes no namesake with it."""
    rng = random.Random(9)
    a, b, c, d = (prose(rng, 80) for _ in range(4))
    near = a + " again"
    given = [(1, a), (1, b), (1, a), (None, c), (None, c), (None, d), (2, b), (3, "12 34"), (3, near), (4, None), (None, "  ")]
    rows = [(i, t, "en", None, 0, n) for n, (i, t) in enumerate(given)]
    first, second, third = stages_of(spark, tmp_path, rows, "doc_id long, text string, lang string, source string, n_chars long, row int")
    assert Counter((r.doc_id, r.text) for r in first.collect()) == Counter((i, t) for i, t in given if t and t.split() and t != "12 34")
    assert sorted(((r.doc_id, r.text) for r in second.collect()), key=str) == sorted([(1, a), (1, b), (None, c), (None, d)], key=str)
    assert third.count() == 4


def test_the_run_leaves_its_last_table_only(spark, tmp_path):
    rng = random.Random(10)
    rows = [(i, prose(rng, 50), "en", "s", 1) for i in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = run(spark, str(tmp_path))
    folder = Path(out.inputFiles()[0].removeprefix("file:")).parents[1]
    assert [f.name for f in folder.iterdir()] == ["packing"] and out.count() == 5


def test_given_table(spark):
    out = run(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert 0.7 * docs.count() < out.select("doc_id").distinct().count() <= docs.count()


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert run(spark, str(tmp_path)).count() == 0
