"""Files: masters, companies, lookup lists, landing folder, exports, streaming."""

import json

from pyspark.sql import functions as F

from ledgerloom.params import Params
from ledgerloom.plans.reconcile import Masters
from ledgerloom.sources import landing as L
from ledgerloom.sources import masters as M
from ledgerloom.streaming.watch import Watcher, start

SUPPLIERS = """id,name,abn,acn,email,phone,address,aliases
S1,Acme Supplies Pty Ltd,12 345 678 901,,accounts@acme.com,,"1 High St, Perth",
S2,Global Logistics Ltd,,,,,,Global Logistics|GL Freight
"""
ORDERS = """po_number,supplier_id,supplier_name,issue_date,expected_delivery,subtotal,tax_amount,total,currency,status,notes
PO-1,S9,Old,,,1,0,1,AUD,open,
po-1 ,S1,Acme Supplies Pty Ltd,2024-01-01,,"1,000.00",100,1100,,open,
"""
LINES = """po_number,line_number,sku,description,quantity,unit,unit_price,total
PO-1,1,A1,Blue widget,10,ea,100,1000
PO-9,1,,Orphan,1,ea,1,1
"""


def masters(spark, folder):
    for name, text in (("suppliers", SUPPLIERS), ("orders", ORDERS), ("lines", LINES)):
        (folder / f"{name}.csv").write_text(text)
    (folder / "companies.json").write_text(json.dumps([{"id": "C1", "name": "Us", "abn": "22 234 567 789", "aliases": []}]))
    headers = M.order_headers(M.read_csv(spark, f"{folder}/orders.csv", M.ORDER_COLUMNS))
    rows = M.read_csv(spark, f"{folder}/lines.csv", M.ORDER_LINE_COLUMNS)
    return Masters(
        M.supplier_master(M.read_csv(spark, f"{folder}/suppliers.csv", M.SUPPLIER_COLUMNS)), headers, M.order_lines(rows, headers),
        M.internal_companies(spark, f"{folder}/companies.json"),
    ), M.orphan_lines(rows, headers)


def test_master_files(spark, tmp_path):
    m, orphans = masters(spark, tmp_path)
    sup = m.suppliers.orderBy("supplier_ord").collect()
    assert [(r.supplier_id, r.abn, r.aliases) for r in sup] == [("S1", "12345678901", []), ("S2", None, ["Global Logistics", "GL Freight"])]
    po = m.purchase_orders.collect()
    assert [(r.po_key, r.supplier_id, float(r.subtotal), r.currency) for r in po] == [("PO-1", "S1", 1000.0, "AUD")]
    assert [(r.po_pos, r.sku) for r in m.po_lines.collect()] == [(0, "A1")]
    assert [r.po_key for r in orphans.collect()] == ["PO-9"]
    assert m.internal_companies.collect()[0].abn == "22 234 567 789"


def test_files_by_column_name(spark, tmp_path):
    """Missing, extra and re-ordered columns, a byte-order mark, a quoted line break, and several files in name order."""
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "b.csv").write_text('name,id,colour\n"Two\nlines",S3,red\nPlain,S4,\n')
    (tmp_path / "s" / "a.csv").write_text("\ufeffid,name,aliases\nS1,One,A|B\nS2\n", encoding="utf-8")
    (tmp_path / "s" / "c.csv").write_text("")
    rows = M.read_csv(spark, f"{tmp_path}/s/*.csv", M.SUPPLIER_COLUMNS).orderBy("ord").collect()
    assert [(r.ord, r.id, r.name, r.aliases, r.abn) for r in rows] == [
        (0, "S1", "One", "A|B", None), (1, "S2", None, None, None), (2, "S3", "Two\nlines", None, None), (3, "S4", "Plain", None, None)
    ]
    large = "".join(f"{i},{i}\n" for i in range(20_000))
    (tmp_path / "l.csv").write_text("id,name\n" + large)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        many = M.read_csv(spark, f"{tmp_path}/l.csv", M.SUPPLIER_COLUMNS)
        assert many.rdd.getNumPartitions() > 3 and many.filter("ord <> cast(id as bigint)").count() == 0 and many.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_absent_files_and_unsafe_names_give_no_rows(spark, tmp_path):
    assert M.read_csv(spark, f"{tmp_path}/none.csv", M.SUPPLIER_COLUMNS).count() == 0
    assert M.internal_companies(spark, f"{tmp_path}/none.json").count() == 0
    assert M.lookup_table(spark, str(tmp_path), "../etc").count() == 0
    M.write_lookup(spark.createDataFrame([("P1", "Plaza")], "id string, project_name string"), f"{tmp_path}/projects.csv")
    assert [tuple(r) for r in M.lookup_table(spark, str(tmp_path), "projects.csv").collect()] == [("P1", "Plaza")]


def test_landing_folder(spark, tmp_path):
    for n in ("a.pdf", "b.pdf", "c.txt"):
        (tmp_path / n).write_text("x")
    files = L.list_documents(spark, str(tmp_path))
    seen = files.filter("stem = 'a'").select("stem", F.col("mtime").alias("source_mtime"))
    assert [r.stem for r in L.pending(files, seen).collect()] == ["b"]
    moved = seen.withColumn("source_mtime", F.col("source_mtime") - 5)
    assert {(r.stem, r.is_reprocess) for r in L.pending(files, moved).collect()} == {("a", True), ("b", False)}


def land(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def test_stream_in_two_runs_equals_one(spark, tmp_path):
    m, _ = masters(spark, tmp_path)
    good = json.dumps({"invoice_number": "I1", "supplier": {"name": "acme supplies pty ltd"}, "po_number": "PO-1", "total": 1100,
                       "line_items": [{"sku": "a1", "quantity": 10, "unit_price": 100}]})
    docs = [{"stem": "x", "path": "/x.pdf", "mtime": 1.0, "response": good}, {"stem": "y", "path": "/y.pdf", "mtime": 2.0, "response": "no json"}]

    def run(base, *batches):
        base.mkdir()
        w = Watcher(f"{base}/log", lambda s: m, Params())
        for i, rows in enumerate(batches):
            land(base / "in", f"{i}.json", rows)
            start(spark, f"{base}/in", w, f"{base}/ck").awaitTermination()
        cols = ("stem", "status", "invoice_number", "matched_supplier", "error_count", "source_mtime")
        return sorted(tuple(r) for r in w.state(spark).select(*cols).collect()), w.log(spark).count()

    once, n1 = run(tmp_path / "one", docs)
    twice, n2 = run(tmp_path / "two", docs[:1], docs)
    assert once == twice and n1 == n2 == 2
    assert [r[:4] for r in once] == [("x", "needs_review", "I1", "Acme Supplies Pty Ltd"), ("y", "needs_review", None, None)]


def test_order_lines_are_joined_once_and_read_by_the_other_views(spark, tmp_path):
    """Other views read the stored order lines; they do not join lineitem and part again. Row by row views are not written."""
    import datetime as dt

    from catalogue import inputs as I
    from ledgerloom.session import written

    at = dt.datetime(1998, 1, 1)
    tables = {
        "supplier": ([(1, "S1")], "s_suppkey long, s_name string"),
        "part": ([(5, "red bolt", "Brand#1", "SMALL")], "p_partkey long, p_name string, p_brand string, p_type string"),
        "orders": ([(10, 3, at), (11, 3, at)], "o_orderkey long, o_custkey long, o_orderdate timestamp"),
        "lineitem": (
            [(10, 5, 1, n, 2.0, 20.0, at) for n in (1, 2)],
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp",
        ),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert I.lines(spark, str(tmp_path)).count() == 2
    before = set(written(spark))
    assert I.invoices(spark, str(tmp_path)).select("stem", "subtotal").collect()
    new = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in written(spark) if p not in before]
    assert sorted(new) == ["input-hdr", "input-poh"]
    read = {f.rsplit("/", 2)[1] for f in I.sql_view(spark, str(tmp_path), "hdr").inputFiles()}
    assert "lineitem.parquet" not in read and "part.parquet" not in read
