"""Language identification: held-out accuracy, Viterbi against enumeration, mixed texts, edge cases."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm.langid import SCRIPTS, LangParams, fit, identify, viterbi
from ledgerloom.llm.textkit import mix

SF = "/root/testdata/sf0.001"


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    first = np.array([0, 5, 5, 6, 13])
    scores, which, penalty = rng.normal(size=(9, 3)) * 2, rng.integers(0, 9, 13), 1.5
    labels = viterbi(scores, which, first, penalty)
    for a, b in zip(first[:-1], first[1:]):
        value = lambda path: sum(scores[which[a + i], s] for i, s in enumerate(path)) - penalty * sum(x != y for x, y in zip(path, path[1:]))  # noqa: E731, B023
        best = max((value(path) for path in itertools.product(range(3), repeat=b - a)), default=0)
        assert abs(value(labels[a:b].tolist()) - best) < 1e-9


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert got[1] > 30 and got[0] > 0.95


def test_mixed_scripts_and_edges(spark):
    ru, en, el = "это простой русский текст о погоде", "this is a simple english text about weather", "αυτό είναι ένα απλό κείμενο για τον καιρό"
    train = [(i, t * 3, g) for i in range(60) for t, g in ((f"{ru} ", "ru"), (f"{en} ", "en"), (f"{el} ", "el"))]
    rows = [(1000, None, None), (1001, "", "en"), (1002, "12 34 ..", "en"), (1003, f"{en} {ru} {ru}", None), (1004, "漢字", None), (None, en, "en"), (1005, f"{ru} " * 30_000, None)]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in train + rows], "doc_id long, text string, lang string, lang_pred string, score double")
    got = {r.doc_id: r for r in identify(df, with_spans=True).collect() if r.doc_id is None or r.doc_id >= 1000}
    assert [(got[i].lang_pred, got[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[1003].lang_pred == "ru" and [(s["lang"], s["first"], s["end"]) for s in got[1003].spans] == [("en", 0, 8), ("ru", 8, 20)]
    assert got[1004].lang_pred in ("ru", "en", "el") and got[None].lang_pred == "en" and got[None].held_out is False and got[1005].lang_pred == "ru"


def test_without_labels_and_empty(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in identify(df).collect()] == [(1, False, "und", 0.0)] or identify(df).first().lang_pred == "und"
    assert identify(df.limit(0)).count() == 0


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_script(word):
    first = next((ord(c) for c in word if c.isalpha()), None)
    return None if first is None else [name for start, name in SCRIPTS if start <= first][-1]


def plain_grams(word, p):
    data, shift = f" {word} ".encode(), 64 - (p.buckets - 1).bit_length()
    for n in (2, 3, 4):
        for i in range(len(data) - n + 1):
            key = int.from_bytes(bytes([n]) + data[i : i + n], "big")
            yield int(mix(np.array([key], np.uint64))[0]) >> shift


def plain_identify(rows, p):
    """The model from plain counts, every word scored on its own, every path by the textbook recursion."""
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 4 == 2
    names = sorted({g for d, _, g in rows if g is not None and not held(d)})
    grams, scripts = {g: Counter() for g in names}, {g: Counter() for g in names}
    for d, text, g in rows:
        if g is None or held(d):
            continue
        for w in plain_words(text):
            if plain_script(w):
                grams[g].update(plain_grams(w, p))
                scripts[g][plain_script(w)] += sum(c.isalpha() for c in w)
    size = {g: sum(grams[g].values()) + 0.5 * p.buckets for g in names}
    log = lambda g, b: np.float32(math.log((grams[g][b] + 0.5) / size[g]) / 3)
    out = []
    for d, text, _ in rows:
        words, values = plain_words(text), []
        for w in words:
            total = [sum(float(log(g, b)) for b in plain_grams(w, p)) for g in names]
            total = [t - max(total) for t in total]
            script = plain_script(w)
            allowed = [script is not None and scripts[g][script] >= p.least_script_share * max(sum(scripts[g].values()), 1) for g in names]
            values.append([t if a else min(t, 0) + p.foreign for t, a in zip(total, allowed)] if any(allowed) else [0.0] * len(names))
        paths = [(v, [i]) for i, v in enumerate(values[0])] if words else []
        for row in values[1:]:
            top = max(range(len(names)), key=lambda i: paths[i][0])
            paths = [max((paths[j][0] - p.penalty * (j != i), j == i, paths[j][1]) for j in {i, top}) for i in range(len(names))]
            paths = [(value + row[i], path + [i]) for i, (value, _, path) in enumerate(paths)]
        best = max(paths, key=lambda x: x[0])[1] if words else []
        mass = Counter()
        for w, i in zip(words, best):
            mass[i] += sum(c.isalpha() for c in w)
        total = sum(mass.values())
        lead = min(mass, key=lambda i: (-mass[i], i)) if total else None
        out.append((d, held(d), "und" if lead is None else names[lead], mass[lead] / total if total else 0.0))
    return out


def test_predictions_are_those_of_plain_counts(spark):
    rng = random.Random(6)
    stems = {"en": "thing water house light", "de": "straße wäsche grün haus", "ru": "погода простой текст дом", "el": "κείμενο καιρός απλό"}
    word = lambda g: rng.choice(stems[g].split()) + rng.choice(["", "s", "en", "ый" if g == "ru" else "er"])
    rows = []
    for i in range(160):
        g = rng.choice(list(stems))
        other = rng.choice(list(stems))
        body = [word(g) for _ in range(rng.randrange(1, 25))] + [word(other) for _ in range(rng.choice([0, 0, 6]))] + ["12", "!"] * rng.randrange(2)
        rows.append((i, " ".join(body), g if rng.random() < 0.8 else None))
    rows += [(500, None, "en"), (501, "", None), (502, "7 8", "de"), (503, "漢字 text", None), (None, "water house", "en")]
    p = LangParams(buckets=1 << 12)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: tuple(r) for r in identify(df, p).collect()}
    assert len(got) == len(rows)
    for want in plain_identify(rows, p):
        assert got[want[0]][:3] == want[:3] and abs(got[want[0]][3] - want[3]) < 1e-9, (want, got[want[0]])


def test_no_label_is_left_out(spark):
    """A thousand labels: each has its own word."""
    rows = [(i, f"w{i:04d}x{i * 7919 % 10007} " * 4, f"l{i:04d}") for i in range(1000)]
    train = [(i + k * 10_000, t, g) for i, t, g in rows for k in range(2)]
    df = spark.createDataFrame(train, "doc_id long, text string, lang string")
    known = {g for d, _, g in train if zlib.crc32(str(d).encode()) % 4 != 2}
    assert set(fit(df, LangParams(buckets=1 << 10)).languages) == known and len(known) > 600
