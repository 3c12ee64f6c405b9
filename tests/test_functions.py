"""Kernels and scalar functions against plain restatements."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from ledgerloom.operators import invoices as D
from ledgerloom.operators.export import nested_lines
from ledgerloom.operators.maintenance import duplicate_warnings
from ledgerloom.functions import scalars as S
from ledgerloom.functions import similarity as SIM
from ledgerloom.functions.similarity import lcs_block, lcs_length, lcs_native, lcs_pairs, token_sort
from ledgerloom.operators.ordinals import numbered, running_sum
from ledgerloom.operators.simjoin import similar_pairs
from ledgerloom.session import materialise


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def texts(rnd, n, alphabet, longest):
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, longest))) for _ in range(n)]


def test_pair_kernel_short_long_and_unicode():
    rnd = random.Random(3)
    for alphabet in ("abcd ", "abé漢 "):
        a, b = texts(rnd, 150, alphabet, 180), texts(rnd, 150, alphabet, 180)
        a[3], b[5] = None, ""
        assert lcs_pairs(pa.array(a), pa.array(b)).to_pylist() == [None if x is None else lcs(x, y) for x, y in zip(a, b)]


def test_block_kernel():
    rnd = random.Random(4)
    a, b = texts(rnd, 40, "abc ", 90), texts(rnd, 70, "abc ", 90)
    want = {(i, j, lcs(x, y)) for i, x in enumerate(a) for j, y in enumerate(b) if 200 * lcs(x, y) >= 75 * (len(x) + len(y))}
    assert set(zip(*(c.tolist() for c in lcs_block(a, b, 75)))) == want


def test_block_kernel_keeps_every_best():
    rnd = random.Random(9)
    a, b = texts(rnd, 60, "abcdef ", 24), texts(rnd, 700, "abcdef ", 24)
    every, best = (list(zip(*(c.tolist() for c in lcs_block(a, b, 60, only)))) for only in (False, True))
    ratio = lambda hit: hit[2] / (len(a[hit[0]]) + len(b[hit[1]]))
    for i in range(len(a)):
        top = max((ratio(h) for h in every if h[0] == i), default=None)
        assert {h for h in best if h[0] == i and ratio(h) == top} == {h for h in every if h[0] == i and ratio(h) == top}
    assert set(best) <= set(every) and len(best) < len(every)


def test_best_partners_are_found_over_all_tiles_and_few_pairs_are_scored(monkeypatch):
    rnd = random.Random(11)
    words = ["".join(rnd.choice("aeinorst") for _ in range(6)) for _ in range(12)] + ["é漢字", "Ünal"]
    b = sorted({" ".join(rnd.sample(words, 4)) for _ in range(900)})
    a = sorted({t.replace("i", "") for t in b[::3]} | {"zzz", "q", b[5]})
    monkeypatch.setattr(SIM, "_TILE", 1 << 12)
    scored = []
    monkeypatch.setattr(SIM, "lcs_pairs", lambda x, y: scored.append(len(x)) or lcs_pairs(x, y))
    got = {}
    for i, j, n in zip(*(c.tolist() for c in SIM.best_block(a, b, 75))):
        assert n == lcs(a[i], b[j]) and 200 * n >= 75 * (len(a[i]) + len(b[j]))
        got.setdefault(i, set()).add((n / (len(a[i]) + len(b[j])), j))
    for i in rnd.sample(range(len(a)), 25):
        ratios = [lcs(a[i], y) / (len(a[i]) + len(y)) for y in b]
        best = {(r, j) for j, r in enumerate(ratios) if r == max(ratios) and r >= 75 / 200}
        assert best == {h for h in got.get(i, ()) if h[0] == max(got[i])[0]}
    assert sum(scored) < len(a) * len(b) / 10
    assert all(len(c) == 0 for c in SIM.best_block(["abc"], ["xyz"], 75))


def test_words_are_sorted_without_interpreted_lambdas(spark):
    rows = ["b\ta  C\n\u00a0x", "", " \r\x0b\x0c ", None, "É é z\u2003y b a", "\U0001f600 \uffee"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    out = df.select(token_sort(F.col("t")).alias("s"))
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    spaces = re.compile("[ \t\n\x0b\f\r]+")
    want = [None if r is None else " ".join(sorted((w for w in spaces.split(r.lower()) if w), key=lambda w: w.encode())) for r in rows]
    assert [r.s for r in out.collect()] == want


def test_lines_of_a_payload_are_ordered_without_interpreted_lambdas(spark):
    rows = [("a", 1, "x"), ("a", 0, "y"), ("b", None, "z"), ("a", 1, None), (None, 2, "w"), ("b", 3, "v"), ("a", 0, "y")]
    out = nested_lines(spark.createDataFrame(rows, "stem string, line_index long, description string"))
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.stem: [tuple(i) for i in r.line_items] for r in out.collect()} == {
        "a": [(0, "y"), (0, "y"), (1, None), (1, "x")], "b": [(None, "z"), (3, "v")], None: [(2, "w")]}


def test_native_and_udf_agree(spark):
    rnd = random.Random(5)
    rows = list(zip(texts(rnd, 30, "abc", 8), texts(rnd, 30, "abc", 8)))
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", lcs_length(F.col("a"), F.col("b")).alias("u"), lcs_native(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(r.u == r.n == lcs(r.a, r.b) for r in got)


def test_similarity_join_is_exact(spark):
    rnd = random.Random(6)
    a, b = sorted(set(texts(rnd, 60, "abcde ", 30))), sorted(set(texts(rnd, 60, "abcde ", 30)))
    left = spark.createDataFrame([(x,) for x in a], "l string")
    right = spark.createDataFrame([(x,) for x in b], "r string")
    want = {(x, y) for x in a for y in b if 200 * lcs(x, y) >= 65 * (len(x) + len(y))}
    got = [(r.l, r.r) for r in similar_pairs(left, right, "l", "r", 65).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_running_sum_splits_ranges(spark):
    rows = [(k, p, v) for k in ("a", None) for p, v in zip(random.Random(1).sample(range(900), 300), range(300))]
    df = spark.createDataFrame(rows, "k string, p bigint, v bigint")
    got = {(r.k, r.p): r.s for r in running_sum(df, ["k"], "p", F.col("v"), "s", range_bits=4).collect()}
    for key in ("a", None):
        total = 0
        for _, p, v in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            total += v
            assert got[(key, p)] == total
    assert {r.n for r in numbered(df.filter("k = 'a'"), ["k"], "p", "n", 3).collect()} == set(range(1, 301))


def test_scalars(spark):
    rows = [("12 345 678 901", "Test.User@Company.COM", " 1,234.50 ", "3/7/2024"), ("", "invalid-email", "1.2.3", "2024-02-30"), (None, None, "-", "2024/1/5")]
    df = spark.createDataFrame(rows, "abn string, mail string, num string, d string")
    got = df.select(
        S.digits_only(F.col("abn")), S.email_domain(F.col("mail")), S.to_number(F.col("num")), S.parse_date(F.col("d")).cast("string"),
        token_sort(F.lit("Pty  ACME ltd")), S.header_key(F.lit("Unit_Price.-x")),
    ).collect()
    assert [tuple(r)[:4] for r in got] == [("12345678901", "company.com", 1234.5, "2024-07-03"), (None, None, None, None), (None, None, None, "2024-01-05")]
    assert got[0][4:] == ("acme ltd pty", "unit price x")


def test_response_cleanup(spark):
    raw = ['```json\n{"a": [1, 2,],}\n```', 'Sure: {"a": 1} done', "nothing"]
    df = spark.createDataFrame([(r,) for r in raw], "r string")
    assert [r[0] for r in df.select(S.clean_response(F.col("r"))).collect()] == ['{"a": [1, 2]}', '{"a": 1}', None]


def test_a_response_is_parsed_once_however_often_it_is_read(spark, tmp_path):
    item = '{"quantity": 2, "total": 5}'
    rows = [("a", '```\n{"total": 3, "line_items": [%s, %s]}\n``` \n' % (item, item)), ("b", "none"), ("c", None), ("d", '```{"total": 1}'), ("e", "{}```"), ("e", "{}```"), (None, "{}")]
    spark.createDataFrame(rows, "stem string, response string").write.parquet(str(tmp_path / "r"))
    parsed = D.parse_responses(spark.read.parquet(str(tmp_path / "r")))
    reads = (D.response_invoices(parsed), D.response_lines(parsed), D.parse_failures(parsed))
    for df in reads:
        assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    invoices, lines, failures = (sorted(df.collect(), key=str) for df in reads)
    assert sorted(((r.stem, r.total and float(r.total)) for r in invoices), key=str) == sorted([("a", 3.0), ("d", 1.0), ("e", None), ("e", None), (None, None)], key=str)
    assert [(r.stem, r.line_index, float(r.quantity)) for r in lines] == [("a", 0, 2.0), ("a", 1, 2.0)]
    assert [r.stem for r in failures] == ["b", "c"]


def test_a_name_that_most_suppliers_share_meets_each_request_once(spark):
    master = spark.createDataFrame([(i, f"S{i}", "Same Pty" if i % 10 else "Other", f"{i % 7}1") for i in range(500)], "ord int, id string, name string, abn string")
    asked = spark.createDataFrame([(i, " same PTY ", "" if i % 2 else "6 1") for i in range(100)], "ord int, name string, abn string")
    out = duplicate_warnings(asked, master)
    got = {r.ord: r.id for r in out.collect()}
    # by number the first is S6, by name S1; the first in file order counts
    assert got == {i: "S1" for i in range(100)}
    joined = [n for n in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in n]
    assert len(joined) == 2


def test_intermediate_tables_are_written_small(spark):
    files = materialise(spark.range(3), "small").inputFiles()
    assert files and all(f.endswith(".zstd.parquet") for f in files)
