"""Patience alignment against its definition and brute force, planted notices, edge cases."""

import random
import re
import time

import pyarrow as pa

from ledgerloom.llm.licenses import TEMPLATES, LicenseParams, Templates, align, hashed_words, increasing, scan_licenses


def test_longest_increasing_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        values = rng.sample(range(50), rng.randrange(0, 12))
        got = [values[i] for i in increasing(values)]
        best = max((bin(m).count("1") for m in range(1 << len(values)) if (s := [v for i, v in enumerate(values) if m >> i & 1]) == sorted(s)), default=0)
        assert got == sorted(got) and len(got) == best


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(new[-1], row[j + 1], row[j] + 1 if x == y else 0))
        row = new
    return row[-1]


def test_alignment():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(12) for _ in range(rng.randrange(15))] for _ in range(2))
        pairs = align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x < y and u < v for (x, u), (y, v) in zip(pairs, pairs[1:])) and len(pairs) <= lcs(a, b)
        a, b = rng.sample(range(20), 12), rng.sample(range(20), 12)  # with all words unique the anchors alone decide
        assert len(align(a, b)) == lcs(a, b) or len(align(a, b)) < lcs(a, b) and (a[0] == b[0] or a[-1] == b[-1])


def corpus():
    rng = random.Random(3)
    common = "the of a license licensed under version software this is public work general to and 2 0 3 4 by".split()
    rows = []
    for i in range(250):
        words = [rng.choice(common) if rng.random() < 0.3 else f"w{rng.randrange(4000)}" for _ in range(rng.randrange(0, 90))]
        for _ in range(rng.randrange(3)):
            own = rng.choice(list(TEMPLATES.values())).split()
            for _ in range(rng.randrange(0, max(1, len(own) // 6))):
                own[rng.randrange(len(own))] = f"e{rng.randrange(99)}"
            at = rng.randrange(len(words) + 1)
            words[at:at] = own * rng.choice([1, 1, 2])
        rows.append((i, rng.choice([" ", "\n", " * "]).join(words)))
    return rows


def test_prefilters_lose_nothing(spark):
    rows = corpus()
    templates, want = Templates(TEMPLATES, LicenseParams()), {}
    for doc_id, text in rows:
        words = hashed_words(pa.array([text]))[0].tolist()
        want[doc_id] = [(templates.labels[t], *f) for t in range(len(templates.labels)) for f in templates.finds(t, words)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")
    got = {r.doc_id: [tuple(m) for m in r.matches] for r in scan_licenses(df).collect()}
    assert got == want and sum(map(bool, got.values())) > 80


def test_planted_notices(spark):
    rows = [(i, f"Some words before it.\n{t}\nAnd some others after, license of a kind.") for i, t in enumerate(TEMPLATES.values())]
    found = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, name in enumerate(TEMPLATES):
        assert found[i].license == name and found[i].coverage == 1.0
        words = re.findall(r"[a-z0-9]+", rows[i][1].lower())
        assert words[found[i].first_word : found[i].end_word] == re.findall(r"[a-z0-9]+", TEMPLATES[name].lower())


def test_edges(spark):
    line = TEMPLATES["MIT/line"]
    rows = [(1, None), (2, ""), (3, " .. \n"), (4, line * 3), (None, line), (5, "under the license " * 40_000 + line), (6, "clean text only"), (6, "clean text only")]
    got = sorted(((r.doc_id, r.n_matches, r.license) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    mit = "MIT/line"
    assert got == sorted([(1, 0, None), (2, 0, None), (3, 0, None), (4, 3, mit), (None, 1, mit), (5, 1, mit), (6, 0, None), (6, 0, None)], key=str)
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_versions_and_variants_apart_with_edits():
    """Every wording with a few edited words is found, and best under its own license, though others differ from it by a word."""
    rng, templates = random.Random(8), Templates(TEMPLATES, LicenseParams())
    for name in templates.names:
        own = TEMPLATES[name].split()
        if len(own) > 1600:  # the longest texts: exact only, in test_planted_notices
            continue
        head, tail = len(own) // 3, len(own) // 2
        for n in (0, len(own) // 40):
            edited = list(own)
            for at in rng.sample(range(head, tail), min(n, tail - head)) if n else []:
                edited[at] = f"e{rng.randrange(99)}"
            words, first = hashed_words(pa.array([" ".join(["before", *edited, "after"])]))
            found = templates.scan(words, first)[0]
            assert found, name
            best = min(found, key=lambda m: (-m[1], -len(templates.words[m[0]]), m[0], m[2]))
            assert {templates.license[m[0]] for m in found} == {name.split("/")[0]} or n, (name, found)
            assert templates.license[best[0]] == name.split("/")[0] or n and name.split("/")[0] + "-only" == templates.license[best[0]], (name, found)


def test_gpl_2_header_is_not_gpl_3():
    templates = Templates(TEMPLATES, LicenseParams())
    for name in ("GPL-2.0/header", "BSD-2-Clause/text", "BSD-3-Clause/text", "ISC/text", "LGPL-2.1/header", "AGPL-3.0/header", "CC0-1.0/text", "Unlicense/text"):
        found = templates.scan(*hashed_words(pa.array([TEMPLATES[name]])))[0]
        assert [templates.names[m[0]] for m in found] == [name]


def test_a_notice_inside_another_text_counts():
    templates = Templates(TEMPLATES, LicenseParams())
    own = TEMPLATES["MIT/text"].split()
    text = " ".join([*own[:90], TEMPLATES["CC-BY-NC-4.0/line"], *own[90:]])
    assert {templates.names[m[0]] for m in templates.scan(*hashed_words(pa.array([text])))[0]} == {"MIT/grant", "MIT/text", "CC-BY-NC-4.0/line"}


def best_of(templates, text):
    found = templates.scan(*hashed_words(pa.array([text])))[0]
    return min(found, key=lambda m: (-m[1], -templates.sizes[m[0]], m[0], m[2]))


def test_licenses_with_added_words_go_by_their_own_names():
    templates = Templates(TEMPLATES, LicenseParams())
    affero = re.sub(r"(?<!Affero )General Public License", "Affero General Public License", TEMPLATES["GPL-3.0/text"], flags=re.I)
    label, coverage, _, _, extra = best_of(templates, affero)
    assert templates.labels[label] == "AGPL-3.0/text" and coverage > 0.99 and extra > 5
    clause = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software."
    own = TEMPLATES["BSD-3-Clause/text"].split()
    for at in (len(own) // 3, len(own) // 2):
        label, _, _, _, extra = best_of(templates, " ".join([*own[:at], clause, *own[at:]]))
        assert templates.labels[label] == "BSD-4-Clause/text" and extra > 15
    for name in ("GPL-3.0/text", "BSD-3-Clause/text"):
        label, coverage, _, _, extra = best_of(templates, f"advertising affero affero {TEMPLATES[name]} affero advertising")
        assert (templates.labels[label], coverage, extra) == (name, 1.0, 0)


def test_joined_licenses_take_time_by_their_length():
    templates = Templates(TEMPLATES, LicenseParams())
    for name in ("LGPL-2.1/text", "GPL-2.0/text"):
        if name not in TEMPLATES:
            continue
        for times in (1, 2, 4, 8):
            words = hashed_words(pa.array([f"{TEMPLATES[name]}\n" * times]))
            start = time.time()
            found = [m for m in templates.scan(*words)[0] if templates.labels[m[0]] == name]
            assert len(found) == times and all(m[1] == 1.0 and m[4] == 0 for m in found)
            assert time.time() - start < 0.5 * times, (name, times, time.time() - start)
