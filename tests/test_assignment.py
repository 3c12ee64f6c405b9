"""The sorted pass must give the assignment of the greedy rule, for every size and in a fixed number of jobs."""

import random
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from ledgerloom.operators import orders as O
from ledgerloom.operators.textsearch import contained
from ledgerloom.params import MONEY, Params

WORDS = ["red", "ring", "blue", "widget", "small", "gear"]


def greedy(lines, stock, threshold):
    """Plain restatement of the rule: lines in order, SKU first, then best description, earliest on ties."""
    def sort_tokens(s):
        return " ".join(sorted(s.lower().split()))

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    out, used = {}, set()
    for i, sku, desc in lines:
        same = [p for p, s, _ in stock if p not in used and sku and s and s.upper() == sku.upper()]
        if same:
            out[i] = same[0]
        elif desc:
            a, best = sort_tokens(desc), (0, None)
            for p, _, d in stock:
                b = sort_tokens(d)
                score = 200 * lcs(a, b) / (len(a) + len(b))
                if p not in used and score > best[0]:
                    best = (score, p)
            if best[1] is not None and best[0] >= threshold:
                out[i] = best[1]
        if i in out:
            used.add(out[i])
    return out


def tables(spark, docs):
    money = "decimal(18,4)"
    inv = [(s, f"PO{s}", True) for s in docs]
    lines = [(s, i, sku, d) for s, (ls, _) in docs.items() for i, sku, d in ls]
    stock = [(f"PO{s}", p, sku, d) for s, (_, ps) in docs.items() for p, sku, d in ps]
    one = F.lit(1).cast(MONEY)
    links = spark.createDataFrame(inv, "stem string, po_key string, po_found boolean")
    lf = spark.createDataFrame(lines, "stem string, line_index bigint, sku string, description string")
    pf = spark.createDataFrame(stock, "po_key string, po_pos bigint, sku string, description string")
    for c in ("quantity", "unit_price", "total"):
        lf, pf = lf.withColumn(c, one), pf.withColumn(c, one)
    pf = pf.withColumn("line_number", (F.col("po_pos") + 1).cast("int")).withColumn("expected_quantity", one).withColumn("expected_unit_price", one)
    return links, lf, pf


def random_docs(seed, n, size):
    rnd = random.Random(seed)
    text = lambda: " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 3)))
    sku = lambda: rnd.choice([None, None, "A1", "a1", "B2", "C3"])
    return {
        f"d{k}": (
            [(i, sku(), rnd.choice([text(), text(), None])) for i in range(rnd.randint(0, size))],
            [(p, sku(), text()) for p in range(rnd.randint(0, size))],
        )
        for k in range(n)
    }


def picks(df):
    out = {}
    for r in df.select("stem", "c.line_index", "c.po_pos").collect():
        out.setdefault(r[0], {})[r[1]] = r[2]
    return out


def test_pass_follows_the_greedy_rule(spark):
    docs = random_docs(7, 12, 9) | {f"large{k}": d for k, d in enumerate(random_docs(8, 2, 90).values())}
    want = {s: g for s, (ls, ps) in docs.items() if (g := greedy(ls, ps, 65))}
    links, lines, stock = tables(spark, docs)
    assert picks(O.assign_lines(links, lines, stock, Params())) == want


def test_substring_of_a_large_document(spark):
    """Different texts, compared pair by pair and through the gram index: no bound by size."""
    for n in (120, 300):
        docs = {"big": ([(i, None, f"part {i} of") for i in range(n)], [(p, None, f"Part {p} of the lot") for p in range(n - 1, -1, -1)])}
        links, lines, stock = tables(spark, docs)
        assert picks(O.assign_lines(links, lines, stock, Params(), "substring"))["big"] == {i: i for i in range(n)}


def test_one_document_of_equal_lines(spark):
    docs = {"hot": ([(i, "S", "same text") for i in range(300)], [(p, "s", "same text") for p in range(280)])}
    links, lines, stock = tables(spark, docs)
    assert picks(O.assign_lines(links, lines, stock, Params()))["hot"] == {i: i for i in range(280)}


def test_jobs_do_not_grow_with_lines(spark):
    """Different texts on one side: the number of jobs is the same for 16 and 64 lines, and for documents whose texts are indexed."""
    tracker, counts = spark.sparkContext.statusTracker(), []
    for n in (16, 64, 128, 256, 512):
        docs = {"d": ([(i, None, f"ring number {i:04d}") for i in range(n)], [(p, None, "ring number 0000") for p in range(n)])}
        links, lines, stock = tables(spark, docs)
        spark.sparkContext.setJobGroup(f"assign{n}", "assignment")
        got = picks(O.assign_lines(links, lines, stock, Params()))
        spark.sparkContext.setJobGroup("", "")
        assert got["d"] == {i: i for i in range(n)}
        counts.append(len(tracker.getJobIdsForGroup(f"assign{n}")))
    for same in (counts[:2], counts[2:]):
        assert max(same) - min(same) <= 2, counts  # adaptive execution may merge a stage's job with another's


def test_mixed_sizes_follow_the_greedy_rule(spark):
    """Small documents next to large ones, with empty and repeated texts; both ways of comparing."""
    docs = random_docs(11, 6, 8) | {f"large{k}": d for k, d in enumerate(random_docs(12, 2, 120).values())}
    docs["large0"][0].append((500, None, "   "))
    docs["large1"][1].append((501, None, ""))
    want = {s: g for s, (ls, ps) in docs.items() if (g := greedy([(i, k, d and d.strip()) for i, k, d in ls], ps, 65))}
    links, lines, stock = tables(spark, docs)
    assert picks(O.assign_lines(links, lines, stock, Params())) == want


def test_containment_is_that_of_all_pairs(spark):
    rnd = random.Random(3)
    text = lambda: "".join(rnd.choice("ab é") for _ in range(rnd.choice([0, 1, 2, 4, 9, 14, 40])))
    wholes = {("d", text()) for _ in range(150)} | {("e", text()) for _ in range(5)}
    parts = {("d", text()) for _ in range(150)} | {(s, w[3 : 3 + rnd.randrange(20)]) for s, w in wholes}
    found = contained(spark.createDataFrame(list(parts), "stem string, part string"), spark.createDataFrame(list(wholes), "stem string, whole string"))
    assert sorted(map(tuple, found.collect())) == sorted((s, p, w) for s, p in parts for t, w in wholes if s == t and p in w)


def test_a_task_does_not_keep_similar_texts(spark):
    """2 000 lines against 2 000 order lines of one document, every text similar to every other: four million pairs pass by."""
    n = 2000
    docs = {"big": ([(i, None, f"industrial machine part {i:05d}") for i in range(n)], [(p, None, f"industrial machine part {p:05d}") for p in range(n)])}
    links, lines, stock = tables(spark, docs)
    got = picks(O.assign_lines(links, lines, stock, Params()))["big"]
    assert got == {i: i for i in range(n)}


def test_the_pass_holds_order_lines_only():
    """The state of a document does not grow while similar texts pass by."""
    from ledgerloom.operators.assignment import _pass

    names = ["stem", "kind", "place", "option", "sku", "text", "score"]
    def batches():
        yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*[("d", 0, p, False, None, f"t{p}", None) for p in range(50)]))))
        for i in range(60):
            offers = [("d", 1, i, True, None, f"t{p}", 90.0 - p % 7) for p in sorted(range(50), key=lambda p: (p % 7, f"t{p}"))]
            rows = [("d", 1, i, False, None, None, None), *offers]
            yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows))))

    tracemalloc.start()
    peaks = []
    for _ in _pass(batches()):
        peaks.append(tracemalloc.get_traced_memory()[0])
    tracemalloc.stop()
    assert max(peaks[30:]) < max(peaks[5:20]) + 50_000
